"""What the corpus operators share: reading tables, ASCII case, the shared work folder, hashed words."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import cut, discard, new_dir, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters that part words.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def own_keys(docs: DataFrame, id: str) -> bool:
    """Whether identifiers are integers of which none is null or repeated, which one count over them tells."""
    if docs.schema[id].dataType.simpleString() not in INTEGERS:
        return False
    counts = docs.groupBy(F.col(id).alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where("_row IS NULL OR _n > 1").isEmpty()


def keyed(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Each row of docs as a struct (_doc) with a key (_row).

    Identifiers are the keys where they tell rows apart. Else rows are written once with numbers, so that every read
    finds the same keys."""
    if own_keys(docs, id):
        return docs.select(F.struct("*").alias("_doc"), F.col(id).cast("bigint").alias("_row"))
    return cut(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "keyed")


def need_integers(docs: DataFrame, id: str) -> None:
    """Raises where identifiers are not whole numbers of at most 64 bits."""
    kind = docs.schema[id].dataType.simpleString()
    if kind not in INTEGERS:
        raise TypeError(f"{id} is {kind}: identifiers must be integers; key other rows with keyed()")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The array of words [^\\x20\\x09-\\x0D]+ of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Python workers get at most so many bytes at once, but for a longer row; a smaller setting is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key, "67108864b").rstrip("bB"))
    if now > most:
        spark.conf.set(key, str(most))


def bucket_bits(spark: SparkSession, least: int = 4) -> int:
    """log2 of the number of hash buckets: as many buckets at least as the session has shuffle partitions."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(16, max(least, (n - 1).bit_length()))


def lean(work):
    """work, a function of a task's batches, whose memory goes back to the system at its end: idle workers would keep what they took at most."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def lean_group(work):
    """The same for a function of one group."""

    @functools.wraps(work)
    def run(group: pa.Table) -> pa.Table:
        try:
            return work(group)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns to the system what Arrow and numpy have freed."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# --- files that tasks write and map -----------------------------------------------------------


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file; a repeated task writes the same bytes, and the last rename wins."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        path = urlparse(uri).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as out:
            out.write(data)
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as out:
            out.write(data)


def file_bytes(uri: str) -> np.ndarray:
    """A file's bytes: memory-mapped where the store is mounted, else read."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return np.memmap(parsed.path, dtype=np.uint8, mode="r")
    from pyarrow import fs

    store, remote = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(remote) as src:
        return np.frombuffer(src.read(), dtype=np.uint8)


# --- hashed words in numpy --------------------------------------------------------------------

ONE = np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 20
_SECTION = 1 << 14
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x reaches every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _BASE
        x = (x ^ (x >> np.uint64(29))) * _GOLD
        return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    with np.errstate(over="ignore"):
        return mix(a * _BASE + b)


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[ONE], np.full(size - 1, x, dtype=np.uint64)])) for x in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """s with s[i] = sum of code(byte j) * BASE ** j over j < i: any substring's hash is a difference."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(raw), _SECTION):  # whose arrays fit in a core's cache
            codes = _BYTE_CODES[raw[a : a + _SECTION]]
            codes *= up[a : a + _SECTION]
            codes[0] += out[a]
            np.cumsum(codes, out=out[a + 1 : a + _SECTION + 1])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end) under prefix_sums."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw bytes."""
    word = np.empty(len(raw) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_IS_SPACE[raw], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def hashed_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts in order, and offsets: text i has words offsets[i] to offsets[i + 1].

    Long texts are hashed in pieces that end at white space, so that memory stays bounded by _STEP and the longest word."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    block: list[bytes] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not block:
            return
        raw = np.frombuffer(b"\n".join(block), dtype=np.uint8)
        start, end = word_spans(raw)
        parts.append(span_hash(prefix_sums(raw), start, end))
        bounds = np.cumsum([len(b) + 1 for b in block])
        counts_here = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
        np.add.at(counts, np.array(owner), counts_here)
        block.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        data = data.lower() if lower else data
        at = 0
        while at < len(data):
            stop = len(data)
            if stop - at > _STEP:
                stop = at + _STEP
                while stop < len(data) and not _IS_SPACE[data[stop]]:
                    stop += 1
            block.append(data[at:stop])
            owner.append(i)
            held += stop - at + 1
            at = stop
            if held >= _STEP:
                flush()
    flush()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), offsets


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 6 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each has about `most` bytes of text; one text stays whole however long."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
        total = np.cumsum(sizes)
        at = 0
        while at < n:
            done = total[at - 1] if at else 0.0
            stop = int(min(max(np.searchsorted(total, done + most, side="right"), at + 1), at + rows, n))
            yield batch.slice(at, stop - at)
            at = stop
