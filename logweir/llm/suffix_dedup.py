"""Repeated-substring dedup: every byte covered by a string of SPAN bytes that also starts elsewhere is removed.

Strings that repeat are found by merging positional Burrows-Wheeler transforms of anchored strings.

Anchors. Of the GRAM-byte substrings in any SPAN bytes, the one with the smallest hash (of 50 bits; the first, if equal) is an
anchor. It depends on those bytes alone, so equal strings have equal anchors at equal places, and an anchor that
occurs once lies in no repeated string. One exchange of anchor hashes finds those that occur twice or more; they are
written as sorted arrays, which workers map into memory.

Transforms. Around each occurrence of a repeated anchor, the bytes that some string over it can reach (REACH on either
side) form a row. All rows of an anchor are aligned: an equal string lies at an equal place in each. Each task sends
its rows as a shard, equal rows once, to the bucket of the anchor. There, the shards' transforms are merged by
refining their interleave: it starts as the shards one after the other, and each iteration takes the next column's
symbols in the current order and deals the rows out stably by symbol. After column t the interleave orders all rows
by their reversed prefixes up to t, as if they had been sorted together, though no prefixes have been compared. Each
refinement carries along where the match of neighbours begins (the larger of the beginnings that it passes over), so
common prefixes come with the order. Where a row and a neighbour have matched for SPAN columns, the string that ends
there is repeated: the intervals. All strings over one anchor overlap, so a row's removed part is one interval.

A text's intervals are joined back to it. Anchors are at most one for each (SPAN - GRAM) / 2 bytes or so; rows in
exchange amount to a few times the bytes near repeats, and none for other bytes. Rows of anchors with more than HEAVY
occurrences, as in a passage that a third of all documents share, go another exact way: their strings are counted by
hash, with equal hashes in a task sent once, so that no task holds all of an anchor's rows.

Strings are judged on the input and never cross documents. Null and empty texts, and those under SPAN bytes, lose
nothing. A row is known by its identifier and text: repeated rows remove each other, as copies do. Null identifiers
are allowed, identifiers that aren't integers raise TypeError; other columns are ignored. Hashes of 64 bits for anchors only choose rows to compare; HEAVY strings are
compared by 64-bit hashes within one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, mix, need_integers, new_dir, pair, powers, prefix_sums, put_file, span_hash, text_batches
from .hash_arrays import block_rows, finish, lookup, pack_arrays, unpack_arrays

SPAN, GRAM = 200, 24
HEAVY, FLUSH_ROWS, MATRIX = 20_000, 10_000, 4_000
#: Strings over HEAVY anchors are hashed so many at a time.
WINDOWS = 1 << 18
#: Bits for a place in a section of windows whose least hashes are sought at a time, and such windows at most.
PLACE = 14
SECTION = 1 << PLACE
#: Bytes of text that are anchored at a time, for rows and for anchors alone.
ANCHORED, HASHED = 2 << 20, 1 << 19
#: Hashes that are held before they are sent as blocks, so that a bucket gets few large ones.
HELD = 500_000
#: The symbol of columns outside a row's text: no byte equals it.
PAD = 256


def sliding_argmin(x: np.ndarray, width: int, section: int = SECTION) -> np.ndarray:
    """The place of the least of each `width` neighbours, the leftmost of equal ones; a section of windows at a time, since each takes some
    arrays of its length. x: below 2 ** (64 - PLACE), since a place in its section stands behind each number."""
    out = np.empty(len(x) - width + 1, dtype=np.int64)
    section = min(section, (1 << PLACE) - width + 1)
    for a in range(0, len(out), section):
        b = min(a + section, len(out))
        out[a:b] = a + least_in_section(x[a : b + width - 1], width)
    return out


def least_in_section(x: np.ndarray, width: int) -> np.ndarray:
    """sliding_argmin of all of x, from minima of twice as many neighbours again and again."""
    least = (x << np.uint64(PLACE)) | np.arange(len(x), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)


class Anchored:
    """A batch of texts as one buffer, with its anchors: places, hashes and the limits of their texts."""

    def __init__(self, texts: list[bytes], span: int = SPAN, gram: int = GRAM):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        n, good = len(self.raw), sizes >= span
        self.sums = prefix_sums(self.raw)
        place = np.zeros(0, dtype=np.int64)
        grams = np.zeros(0, dtype=np.uint64)
        if good.any():
            _, down = powers(n + 1)
            with np.errstate(over="ignore"):
                grams = mix((self.sums[gram:] - self.sums[:-gram]) * down[: n - gram + 1])
            least = sliding_argmin(grams >> np.uint64(PLACE), span - gram + 1)
            inside = np.zeros(len(least) + 1, dtype=np.int64)
            np.add.at(inside, self.offsets[:-1][good], 1)
            np.add.at(inside, self.offsets[1:][good] - span + 1, -1)
            chosen = least[np.cumsum(inside)[:-1] > 0]
            # anchors rise, or else stay, from window to window
            place = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else place
        # anchors have the least hashes; mixed again, they spread over all buckets
        self.place, self.hash = place, mix(grams[place])
        self.text = np.searchsorted(self.offsets, place, side="right") - 1


def anchor_blocks(hashes: list[np.ndarray], bits: int) -> pa.RecordBatch:
    kinds, counts = np.unique(np.concatenate(hashes), return_counts=True)
    return block_rows((kinds >> np.uint64(64 - bits)).astype(np.int32), lambda a, b: pack_arrays(kinds[a:b], np.minimum(counts[a:b], HEAVY + 1)))


def repeated_at(folder: str, bits: int, hashes: np.ndarray) -> np.ndarray:
    """How often each anchor occurs in the corpus, 0 if once; from the mapped arrays."""
    out = np.zeros(len(hashes), dtype=np.int64)
    order = np.argsort(hashes)
    out[order] = lookup(folder, "anchors", bits, hashes[order], 1)[0]
    return out


def shard(batch: Anchored, pick: np.ndarray, ids: np.ndarray, bits: int, span: int = SPAN, gram: int = GRAM) -> pa.RecordBatch:
    """Rows around the picked anchors, equal ones once, with their occurrences, for each bucket."""
    reach = span - gram
    place, anchor, text = batch.place[pick], batch.hash[pick], batch.text[pick]
    first, last = batch.offsets[text], batch.offsets[text + 1]
    left, right = np.minimum(place - first, reach), np.minimum(last - place - gram, reach)
    whole = pair(span_hash(batch.sums, place - left, place + gram + right), left.astype(np.uint64))
    order = np.lexsort((whole, anchor))
    new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
    row = np.cumsum(new) - 1
    heads = order[new]
    bucket = (anchor[order] >> np.uint64(64 - bits)).astype(np.int32)

    def make(a: int, b: int) -> bytes:
        top = heads[row[a] : row[b - 1] + 1]
        length = left[top] + gram + right[top]
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) + np.repeat(place[top] - left[top] - (ends - length), length)
        own = order[a:b]
        start = place[own] - first[own]
        return pack_arrays(anchor[top], left[top], right[top], batch.raw[index], row[a:b] - row[a], ids[:, text[own]].view(np.uint64), start)

    return block_rows(bucket, make)


def repeated_strings(rows: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The first and last column where a repeated string of a row starts; first > last if none.

    rows: aligned symbols, PAD outside the text; group: rows of one anchor are neighbours; left, right: the columns that lie in the text."""
    n, columns = rows.shape
    order = np.arange(n)
    # where the match with the neighbour before begins; a group's first row has none
    begin = np.zeros(n, dtype=np.int32)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    begin[heads] = columns + 1
    first, last = np.full(n, columns, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    base = group.astype(np.int64) << 9
    for t in range(columns):
        key = base | rows[order, t]
        if (key[1:] < key[:-1]).any():
            moved = np.argsort(key, kind="stable")
            key = key[moved]
        else:
            moved = None
        other = np.concatenate([[True], key[1:] != key[:-1]])
        if moved is not None:
            # a row's match with its new neighbour begins at the latest beginning on the way between their old places
            gaps = np.empty(2 * n, dtype=np.int64)
            gaps[0::2] = np.concatenate([[0], moved[:-1]]) + 1
            gaps[1::2] = moved + 1
            gaps[0::2][other] = moved[other]
            padded = np.append(begin, np.int32(0))
            begin = np.maximum.reduceat(padded, gaps)[0::2]
            order = order[moved]
        begin[other] = t + 1
        begin[heads] = columns + 1
        start = t - span + 1
        if start >= 0:
            match = begin <= start
            hit = match.copy()
            hit[:-1] |= match[1:]
            at = order[hit]
            at = at[(left[at] <= start) & (t < right[at])]
            first[at] = np.minimum(first[at], start)
            last[at] = start
    return first, last


def merge_shards(blocks: pa.Table, span: int = SPAN, gram: int = GRAM) -> pa.Table:
    """All shards of one bucket: removed intervals (id, row, start, stop)."""
    reach = span - gram
    parts = [unpack_arrays(b.as_buffer().to_pybytes()) for b in blocks.column("block")]
    anchor, left, right = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
    left, right = left.astype(np.int64), right.astype(np.int64)
    raw = np.concatenate([p[3] for p in parts])
    shift = np.cumsum([0] + [len(p[0]) for p in parts])
    of_row = np.concatenate([p[4].astype(np.int64) + s for p, s in zip(parts, shift[:-1], strict=True)])
    ids = np.concatenate([p[5] for p in parts], axis=1).view(np.int64)
    start = np.concatenate([p[6].astype(np.int64) for p in parts])
    del parts
    length = left + gram + right
    ends = np.cumsum(length)
    # equal rows of different shards become one
    digest = np.array([hashlib.blake2b(raw[e - n : e].tobytes(), digest_size=8).digest() for e, n in zip(ends.tolist(), length.tolist(), strict=True)], dtype="S8")
    order = np.lexsort((left, digest, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (digest[order][1:] == digest[order][:-1]) & (left[order][1:] == left[order][:-1])
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.concatenate([[0], np.cumsum(~same)])
    heads = order[np.concatenate([[True], ~same])]
    of_kind = kind[of_row]
    occurs = np.bincount(of_kind, minlength=len(heads))
    first, last = np.full(len(heads), span + 2 * reach, dtype=np.int64), np.full(len(heads), -1, dtype=np.int64)
    group = np.concatenate([[0], np.cumsum(anchor[heads][1:] != anchor[heads][:-1])])
    sizes = np.bincount(group)
    at = 0
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    g = 0
    while g < len(sizes):  # whole groups, as many as MATRIX rows hold
        stop = max(g + 1, int(np.searchsorted(bounds, bounds[g] + MATRIX, side="right")) - 1)
        rows = np.arange(bounds[g], bounds[stop])
        rows = rows[sizes[group[rows]] > 1]
        if len(rows):
            pick = heads[rows]
            matrix = np.full((len(pick), gram + 2 * reach), PAD, np.uint16)
            size = length[pick]
            at = np.repeat(ends[pick] - size, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            column = np.repeat(reach - left[pick], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            matrix[np.repeat(np.arange(len(pick)), size), column] = raw[at]
            first[rows], last[rows] = repeated_strings(matrix, group[rows], reach - left[pick], reach + gram + right[pick], span)
        g = stop
    # a row that occurs twice repeats in all its strings
    twice = (occurs > 1) & (length[heads] >= span)
    first[twice] = reach - left[heads][twice]
    last[twice] = reach + gram + right[heads][twice] - span
    a, b = first[of_kind], last[of_kind]
    hit = b >= a
    return pa.table([pa.array(ids[0][hit]), pa.array(ids[1][hit]), pa.array((start + a - reach)[hit]), pa.array((start + b - reach + span)[hit])], names=["id", "row", "start", "stop"])


def window_hashes(batch: Anchored, pick: np.ndarray, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The strings over the picked anchors, each once however many anchors it has, in blocks: hash, start in the buffer, text."""
    place, text = batch.place[pick], batch.text[pick]
    low = np.maximum(place - (span - gram), batch.offsets[text])
    high = np.minimum(place, batch.offsets[text + 1] - span)
    real = high >= low
    inside = np.zeros(len(batch.raw) + 1, dtype=np.int32)
    np.add.at(inside, low[real], 1)
    np.add.at(inside, high[real] + 1, -1)
    np.cumsum(inside, out=inside)
    for at in range(0, len(inside), WINDOWS):
        starts = np.flatnonzero(inside[at : at + WINDOWS]) + at
        if len(starts):
            yield span_hash(batch.sums, starts, starts + span), starts, np.searchsorted(batch.offsets, starts, side="right") - 1


def as_runs(starts: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct starts as intervals that cover their strings: owner, start, stop."""
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] > starts[:-1] + span)]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(starts)]]) - 1 if len(at) else at
    return owner[at], starts[at], starts[ends] + span


def intervals(docs: DataFrame, text: str, span: int = SPAN, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(id, row, start, stop): parts of texts that repeated strings cover. docs: id, row and text."""
    spark = docs.sparkSession
    bits, folder = bucket_bits(spark, 6) + 2, new_dir(spark, "anchors")  # small buckets, since rows are wide

    def encoded(batch: pa.RecordBatch) -> Anchored:
        return Anchored([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()], span, gram)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_batches(batches, text, most=HASHED):
            held.append(encoded(batch).hash)
            size += len(held[-1])
            if size >= HELD:
                yield anchor_blocks(held, bits)
                held, size = [], 0
        if size:
            yield anchor_blocks(held, bits)

    def keep(name: str, most: int):
        def run(blocks: pa.Table) -> pa.Table:
            bucket = blocks.column("bucket")[0].as_py()
            parts = [unpack_arrays(b.as_buffer().to_pybytes()) for b in blocks.column("block")]
            kinds, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(kinds)).astype(np.int64)
            again = counts > 1
            put_file(f"{folder}/{name}-{bucket}.npy", pack_arrays(kinds[again], np.minimum(counts[again], most)))
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([int((counts > heavy).sum())], pa.int64())})

        return run

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text, most=ANCHORED):
            own = encoded(batch)
            seen = repeated_at(folder, bits, own.hash)
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row")]).astype(np.int64)
            pick = np.flatnonzero((seen > 1) & (seen <= heavy))
            for at in range(0, len(pick), FLUSH_ROWS):
                yield shard(own, pick[at : at + FLUSH_ROWS], ids, bits, span, gram)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_batches(batches, text, most=1 << 20):
            own = encoded(batch)
            for hashes, _, _ in window_hashes(own, np.flatnonzero(repeated_at(folder, bits, own.hash) > heavy), span, gram):
                held.append(hashes)
                size += len(hashes)
                if size >= HELD:
                    yield anchor_blocks(held, bits)
                    held, size = [], 0
        if size:
            yield anchor_blocks(held, bits)

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text, most=1 << 20):
            own = encoded(batch)
            for hashes, starts, owner in window_hashes(own, np.flatnonzero(repeated_at(folder, bits, own.hash) > heavy), span, gram):
                again = repeated_at(f"{folder}/windows", bits, hashes) > 1
                who, a, b = as_runs(starts[again], owner[again], span)
                first = own.offsets[who]
                yield pa.record_batch([batch.column("id").take(pa.array(who)), batch.column("row").take(pa.array(who)), pa.array(a - first), pa.array(b - first)], ["id", "row", "start", "stop"])

    kind = "id bigint, row bigint, start bigint, stop bigint"
    counted = docs.select(text).mapInArrow(gather, "bucket int, block binary").groupBy("bucket").applyInArrow(keep("anchors", heavy + 1), "bucket int, n bigint")
    written = F.collect_list("bucket").alias("written")  # at most 2 ** bits
    anchors = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hot"), written).first()
    finish(folder, "anchors", anchors.written)
    hot = anchors.hot
    found = docs.select("id", "row", text).mapInArrow(rows, "bucket int, block binary").groupBy("bucket").applyInArrow(lambda t: merge_shards(t, span, gram), kind)
    if hot:
        again = docs.select(text).mapInArrow(windows, "bucket int, block binary").groupBy("bucket").applyInArrow(keep("windows/anchors", 2), "bucket int, n bigint")
        finish(f"{folder}/windows", "anchors", again.agg(written).first().written)
        found = found.union(docs.select("id", "row", text).mapInArrow(covered, kind))
    return found


def without(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """n_bytes, n_removed, n_spans and what is left of each text, given its intervals."""
    for batch in text_batches(batches, text):
        out: list[tuple[int, int, int, str, bytes]] = []
        for data, a, b in zip(batch.column(text).to_pylist(), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
            raw = (data or "").encode("utf-8", "surrogatepass")
            left = raw
            spans: list[list[int]] = []
            for start, stop in sorted(zip(a or (), b or (), strict=True)):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            if spans:
                edges = [0, *[x for s in spans for x in s], len(raw)]
                left = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.record_batch([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", span: int = SPAN, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left."""
    need_integers(docs, id)
    keyed = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.col(text)).alias("row"))
    # null identifiers are told apart by their text alone
    found = intervals(keyed.withColumn("id", F.coalesce("id", F.lit(-(2**63)))), "text", span, gram, heavy)
    parts = found.distinct().groupBy("id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    parts = parts.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "starts", "stops")
    same = (F.coalesce("id", F.lit(-(2**63))) == F.col("_id")) & (F.col("row") == F.col("_row"))
    joined = keyed.join(parts, same, "left").select("id", "text", "starts", "stops")
    kind = docs.schema[id].dataType.simpleString()
    out = joined.mapInArrow(lambda batches: without(batches, "text"), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.select(F.col("id").cast(kind).alias(id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
