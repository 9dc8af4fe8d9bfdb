"""Sorted hash arrays: tasks exchange blocks of arrays by hash bucket, a bucket's task writes its own, workers map them."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, file_bytes, lean, lean_group, mix, new_dir, put_file


#: Before each array: its kind, dimensions, first and last length. Blocks are small and many, so a header is read without parsing; arrays begin at multiples of eight.
HEADER = struct.Struct("<4sIQQ")


def pack_arrays(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        out += [HEADER.pack(a.dtype.str.encode(), a.ndim, a.shape[0], a.shape[-1]), a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(out)


def array_at(data: bytes | np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """The array whose header is there, as a view, and where the next one is."""
    kind, dims, first, last = HEADER.unpack(bytes(data[at : at + HEADER.size]))
    kind, shape, at = np.dtype(kind.rstrip(b"\0").decode()), (first, last)[:dims], at + HEADER.size
    found = np.frombuffer(data, kind, math.prod(shape), at).reshape(shape)
    return found, at + found.nbytes + -found.nbytes % 8


def unpack_arrays(data: bytes | np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        found, at = array_at(data, at)
        out.append(found)
    return out


def block_rows(bucket: np.ndarray, make) -> pa.RecordBatch:
    """A row for each bucket in a sorted array of buckets; make(a, b) packs its rows."""
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, dtype=np.int64)
    rows = [(int(bucket[a]), make(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])


_mapped: dict[str, list[np.ndarray]] = {}


def finish(folder: str, name: str, buckets: list[int]) -> None:
    """Writes which buckets have a file, at most one number for each; without it, or without such a file, look-ups fail."""
    put_file(f"{folder}/{name}-buckets.npy", pack_arrays(np.array(sorted(buckets), dtype=np.int64)))


def mapped(uri: str) -> list[np.ndarray]:
    """The arrays of one file, memory-mapped where the store is mounted."""
    if uri not in _mapped:
        if len(_mapped) > 4096:
            _mapped.clear()
        _mapped[uri] = unpack_arrays(file_bytes(uri))
    return _mapped[uri]


def bucket_arrays(folder: str, name: str, bucket: int) -> list[np.ndarray]:
    """The arrays of one bucket; none if it has no rows. Raises if a file is gone."""
    there = mapped(f"{folder}/{name}-buckets.npy")[0]
    at = np.searchsorted(there, bucket)
    return mapped(f"{folder}/{name}-{bucket}.npy") if at < len(there) and there[at] == bucket else []


def lookup(folder: str, name: str, bits: int, keys: np.ndarray, columns: int) -> np.ndarray:
    """For sorted keys, the columns beside them in the files `name`, the first being 1 for a file of keys alone; zeros where a key is missing."""
    out = np.zeros((max(columns, 1), len(keys)), dtype=np.int64)
    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[bucket], cuts[bucket + 1]
        arrays = bucket_arrays(folder, name, int(bucket))
        if not arrays or not len(arrays[0]):
            continue
        at = np.minimum(np.searchsorted(arrays[0], keys[a:b]), len(arrays[0]) - 1)
        hit = arrays[0][at] == keys[a:b]
        if not columns:
            out[0, a:b] = hit
        for k in range(columns):
            out[k, a:b] = np.where(hit, arrays[k + 1][at], 0)
    return out


Store = tuple[str, str, int]


def keep(rows: DataFrame, name: str, send, write) -> Store:
    """Exchanges what send(batch, bits) makes of rows by bucket and writes what write(parts) makes of a bucket's blocks: folder, name, bits."""
    spark = rows.sparkSession
    bits, folder = bucket_bits(spark), new_dir(spark, name)

    def blocks(batches):
        for batch in batches:
            yield send(batch, bits)

    def put(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        put_file(f"{folder}/{name}-{bucket}.npy", pack_arrays(*write([unpack_arrays(b.as_buffer().to_pybytes()) for b in table.column("block")])))
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    written = rows.mapInArrow(lean(blocks), "bucket int, block binary").groupBy("bucket").applyInArrow(lean_group(put), "bucket int")
    finish(folder, name, [r.bucket for r in written.collect()])
    return folder, name, bits


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def keep_ids(ids: DataFrame) -> Store:
    """Writes the distinct identifiers of a one-column table as sorted arrays."""

    def send(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
        keys = np.unique(mix(numbers(batch.column(0))))
        return block_rows((keys >> np.uint64(64 - bits)).astype(np.int32), lambda a, b: pack_arrays(keys[a:b]))

    return keep(ids, "ids", send, lambda parts: [np.unique(np.concatenate([p[0] for p in parts]))])


def has_ids(kept: Store, ids: np.ndarray) -> np.ndarray:
    """Which of the identifiers keep_ids has. mix() is one to one, so this is exact."""
    folder, name, bits = kept
    keys = mix(ids.astype(np.int64).view(np.uint64))
    order = np.argsort(keys)
    out = np.zeros(len(keys), dtype=bool)
    out[order] = lookup(folder, name, bits, keys[order], 0)[0] > 0
    return out


def keep_groups(rows: DataFrame) -> Store:
    """Writes a table (identifier, number) as sorted arrays: the distinct numbers of each identifier."""

    def send(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
        keys, values = mix(numbers(batch.column(0))), numbers(batch.column(1))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        return block_rows((keys >> np.uint64(64 - bits)).astype(np.int32), lambda a, b: pack_arrays(keys[a:b], values[a:b]))

    def write(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        keys, values = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])])
        keys, values = keys[new], values[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return [keys[first], np.concatenate([first[1:], [len(keys)]]), values]

    return keep(rows, "groups", send, write)


def groups_of(kept: Store, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For identifiers: offsets and their numbers, ascending for each; identifier k has those from offsets[k] to offsets[k + 1]."""
    folder, name, bits = kept
    keys = mix(ids.astype(np.int64).view(np.uint64))
    order = np.argsort(keys)
    sizes, found = np.zeros(len(keys), dtype=np.int64), {}
    cuts = np.searchsorted(keys[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(cuts)):
        arrays = bucket_arrays(folder, name, int(bucket))
        if not arrays:
            continue
        own = order[cuts[bucket] : cuts[bucket + 1]]
        at = np.minimum(np.searchsorted(arrays[0], keys[own]), len(arrays[0]) - 1)
        for k, place in zip(own[arrays[0][at] == keys[own]].tolist(), at[arrays[0][at] == keys[own]].tolist(), strict=True):
            found[k] = arrays[2][int(arrays[1][place - 1]) if place else 0 : int(arrays[1][place])]
            sizes[k] = len(found[k])
    flat = [found[k] for k in sorted(found)]
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(flat) if flat else np.zeros(0, np.uint64)
