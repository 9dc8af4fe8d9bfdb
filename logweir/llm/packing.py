"""Packing: documents are concatenated in one order and cut into sequences of fixed length.

Pass one turns every text into token ids and writes them, as 16-bit or 32-bit little-endian blocks, into the shared
folder, with the ids before each document in its partition. The totals of the partitions, a row for each task, are
summed up to global offsets. Pass two reads the blocks, adds its partition's offset and cuts at the multiples of the
sequence length; a document on a boundary gives a record on either side of it, a long one a record for each sequence
it crosses. Only the last sequence can be short, so padding is less than one sequence over the whole corpus, and the
offsets in a sequence leave no gaps.

The offsets' table has a row for each partition of the input (some bytes for each 128 MB), which is what makes it
small enough to broadcast; each task looks up one row.

Words repeat, so a task keeps the ids of words that it has seen, at most CACHE of them. Words end at
ASCII white space, where the vocabulary's own splitting ends pieces, too; trailing ASCII punctuation after plain
letters is a piece of its own, and lower-cased Latin letters go to the model directly. The results are those of
encoding whole texts, which the tests check.

Null and empty texts have only the end id. Rows with one identifier are packed one by one. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, text_batches

CACHE = 200_000
_PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words(dict):
    """Ids of words by their bytes, learned at the first look; at most CACHE words are kept."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.learn(word)
        return found


class Encoder:
    """Token ids of texts, as little-endian bytes, by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.codes = [k.to_bytes(self.width.itemsize, "little") for k in range(size)]
        self.end = self.codes[end]
        special = [str(x.content).encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.plain = self._is_plain()
        self.ascii = self.plain and not any(x.isalpha() for x in special)
        self.words, self.pieces, self.tails = Words(self._word), Words(self._letters), Words(self._whole)

    def _is_plain(self) -> bool:
        """Whether a lower-case word goes to the model as one piece, which some probes tell."""
        probe = ["hello", "straße", "déjà", "abcdefghij"]
        return all(self._letters(p.encode()) == self._whole(f"{p.upper()}!".encode() if p != "straße" else f"{p}!".encode())[: -self.width.itemsize] for p in probe)

    def _letters(self, letters: bytes) -> bytes:
        """Ids of one word of lower-case letters, straight from the model."""
        word = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(self.letters)
        return b"".join([self.codes[t.id] for t in self.model.tokenize(word)])

    def _whole(self, word: bytes) -> bytes:
        """Ids of any word by the vocabulary's whole chain of steps."""
        return b"".join([self.codes[k] for k in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])

    def _word(self, word: bytes) -> bytes:
        if self.ascii and word.isalpha():  # ASCII letters alone
            return self.pieces[word.lower()]
        head = word.rstrip(_PUNCTUATION)
        if self.plain and head and (letters := head.decode().lower()).isalpha() and max(letters) < "\u0250" and not self.special.search(word):
            tail = word[len(head) :]
            return self.pieces[letters.encode()] + (self.tails[tail] if tail else b"")
        return self._whole(word)

    def forget(self) -> None:
        """Gives the memory of learned words back."""
        for words in (self.words, self.pieces, self.tails):
            words.clear()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids = self.words.__getitem__
        return [b"".join([*map(ids, (t or "").encode().split()), self.end]) for t in texts]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One for each worker process."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def tokenized(docs: DataFrame, text: str, id: str, tokenizer: str, end: int) -> DataFrame:
    """(id, part, part_start, n_ids, width, ids): pass one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer, end)
        width = own.width.itemsize
        for batch in text_batches(batches, text, most=4 << 20):
            ids = own(batch.column(text).to_pylist())
            sizes = np.array([len(x) // width for x in ids], dtype=np.int64)
            starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at += int(sizes.sum())
            n = len(ids)
            yield pa.record_batch(
                [batch.column(id), pa.array(np.full(n, part, np.int64)), pa.array(starts), pa.array(sizes), pa.array(np.full(n, width, np.int32)), pa.array(ids, pa.binary())],
                ["id", "part", "part_start", "n_ids", "width", "ids"],
            )
        own.forget()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(lean(encode), f"id {kind}, part bigint, part_start bigint, n_ids bigint, width int, ids binary")


def cut_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pass two: the pieces of each document between multiples of length."""
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "sequence_id", "offset")}
        base, sizes, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "n_ids", "width"))
        blocks = batch.column("ids")
        for row, (first, n, width) in enumerate(zip(base.tolist(), sizes.tolist(), widths.tolist(), strict=True)):
            ids = np.frombuffer(blocks[row].as_buffer(), dtype=f"<u{width}")
            at = 0
            while at < n:
                sequence, offset = divmod(first + at, length)
                size = min(length - offset, n - at)
                values = (row, at, size, zlib.crc32(ids[at : at + size].astype("<u4").tobytes()), sequence, offset)
                for column, value in zip(cols.values(), values, strict=True):
                    column.append(value)
                at += size
        take = pa.array(cols.pop("row"), pa.int64())
        yield pa.record_batch(
            [batch.column("id").take(take), *[pa.array(v, pa.int64()) for v in cols.values()], batch.column("n_ids").take(take)],
            ["id", *cols, "doc_tokens"],
        )


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", end: int = 2, length: int = 4096) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: the vocabulary's path on every worker."""
    blocks = cut(tokenized(docs, text, id, tokenizer, end), "tokens")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("part")) - F.col("_total")
    offsets = totals.select("part", before.alias("_before"))
    placed = blocks.join(F.broadcast(offsets), "part").select("id", (F.col("_before") + F.col("part_start")).alias("start"), "n_ids", "width", "ids")
    kind = docs.schema[id].dataType.simpleString()
    pieces = placed.mapInArrow(
        lambda batches: cut_windows(batches, length),
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, doc_tokens bigint",
    )
    return pieces.select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
