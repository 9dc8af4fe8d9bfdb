"""N-gram Jaccard join: parity sketches in size bands, joined by pigeonhole, verified exactly.

A document is the set of its 64-bit hashes of five-word shingles. Equal sets are one class and go on as one.

Sketch. A band is an octave of set sizes, [2^p, 2^(p+1)); a document is sketched for its own octave and, if a smaller
partner can lie there, for the one below. A sketch has m segments of 2^k bits; each shingle flips one bit, addressed
by its hash (the high bits are the segment), so that the Hamming distance of two sketches is at most the symmetric
difference of their sets. Sketches are sparse, so a segment is kept as the XOR of a random code for each set bit:
equal segments have equal codes.

Pigeonhole. A similarity of num / den or more allows a symmetric difference of at most d = (den - num) (a + b) / (den + num),
which can spoil at most d segments. m is chosen so that a document has more than d segments that aren't empty; two
that link then share one of them, and, in any order of segments common to all documents, they share one among the
first d + 1 of each (as in prefix filtering). The order puts segments last that occur often, so that passages which
many documents share make candidates only of documents that consist of them. That order comes from a sample, which
bears on cost alone: any order gives all links.

Join. Tasks send keys in sorted blocks to hash buckets; a bucket's task lists the documents of each key that has more
than one. Equal lists merge. First, each list's smallest document is paired with the others; pairs are verified on
whole texts, and links become components. What a long list still holds outside its smallest document's component, is
open, is paired with a few delegates of the list first. What is open still meets its lists' members in other
components by blocks: a task compares the short sketches of two blocks in numpy and gives only pairs that they allow,
so that a large group of texts just below the threshold makes rows for few of its pairs. So every candidate pair is
compared or already connected, while a large group of near copies costs a few pairs for each document.

Two documents share many lists, but only the one with the smallest number among those compares them: the lists of each
document are kept as sorted arrays, in which a task looks up a pair that its sketches allow. So a pair is given once.

Verification compares dense sketches of two to four bits for each shingle first, which lose no link and cost a twentieth
of the text, and then joins both texts to a pair that is left and intersects their sets. Texts in no such pair are not
exchanged: scans look identifiers up in sorted arrays that workers map. Nothing is collected on the driver but counts
and the order's bounded list of frequent segments.

Null and empty texts have no shingles, size 0, and stand alone; so do null identifiers, whose component is null.
Identifiers are integers, others raise TypeError. Fewer than five words are one shingle. Rows that repeat an identifier and text are linked; other columns are ignored.
A hash of 64 bits errs with a chance of about n^2 / 2^65 for n different shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, cut, discard, hashed_words, lean, lean_group, mix, need_integers, pair, small_batches, text_batches
from .components import components
from .hash_arrays import Store, block_rows, groups_of, has_ids, keep_groups, keep_ids, pack_arrays, unpack_arrays

WORDS, NUM, DEN = 5, 3, 4
FLUSH, CHUNK = 700_000, 4096
#: One of so many documents serves for the order of segments; the list holds at most so many of those seen LEAST times.
SAMPLED, FREQUENT, LEAST = 8, 1 << 19, 3
#: In lists of more than LARGE, what is open is first paired with so many delegates of the list, in so many rounds (cost alone).
LARGE, DELEGATES, ROUNDS = 32, 8, 1
#: Lists are compared in blocks of about so many members, by sketches of so many bits at most; so many pairs are listed
#: and compared at a time, from so many pairs of blocks.
BLOCK, BRIEF, LISTED, AT_ONCE, SLICE = 128, 4096, 1 << 18, 1 << 14, 64

def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, offsets = hashed_words(texts)
    folded = hashes.copy()
    for k in range(1, words):
        folded = pair(folded[: len(folded) - 1], hashes[k:]) if len(folded) > 1 else folded[:0]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(folded[a : b - words + 1]))
        elif b > a:
            one = hashes[a : a + 1]
            for k in range(a + 1, b):
                one = pair(one, hashes[k : k + 1])
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out

def segments(hashes: np.ndarray, octave: int) -> np.ndarray:
    """Keys of the sketch's segments that aren't empty; hashes are sorted."""
    bits = 64 if octave < 3 else octave + 12 if octave < 8 else octave
    place = hashes >> np.uint64(64 - bits)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    code = np.bitwise_xor.reduceat(mix(hashes), first)
    live = code != 0
    return mix(pair(code[live], place[first][live]) + np.uint64(octave))

def bands(n: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """The octaves that a set of size n is sketched for, each with the largest difference from a partner met there."""
    octave = n.bit_length() - 1
    out = [(octave, (den - num) * (n + n * den // num) // (den + num))]
    if octave and n * num < den << octave:
        out.append((octave - 1, (den - num) * (n + (1 << octave) - 1) // (den + num)))
    return out

def prefix_keys(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's keys: of each band the first d + 1 segments, frequent ones last."""
    out = []
    for octave, differ in bands(len(hashes)):
        keys = segments(hashes, octave)
        if len(keys) > differ + 1:
            rank = np.zeros(len(keys), dtype=np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                rank = np.where(frequent[at] == keys, counts[at], 0)
            keys = keys[np.lexsort((keys, rank))[: differ + 1]]
        out.append(keys)
    return np.concatenate(out)

def parity_sketch(hashes: np.ndarray, most: int = 1 << 62) -> bytes:
    """Twice as many bits as the next power of two above the set's size (256 at least), up to most; each shingle flips one."""
    size = min(max(256, 2 << len(hashes).bit_length()), most)
    flips = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def may_link(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """False if the sketches differ in more bits than the sets of a link can differ in shingles. The longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (DEN + NUM) <= (DEN - NUM) * (n_a + n_b)


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name for each set: its size and two independent sums of its hashes, mixed."""
    with np.errstate(over="ignore"):
        n = np.array([len(s) for s in sets], dtype=np.uint64)
        k1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        k2 = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5))) if len(s) else 0 for s in sets], dtype=np.uint64)
    return pair(pair(k1, k2), n).view(np.int64)


def set_rows(docs: DataFrame, text: str, id: str, runs: int) -> DataFrame:
    """(id, n, cid, sketch, brief, run): each document's set; brief is the sketch folded to BRIEF bits, sketch null where that is all of it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text):
            sets = shingle_sets(batch.column(text).to_pylist())
            brief = [parity_sketch(s, BRIEF) for s in sets]
            whole = [parity_sketch(s) if 8 * len(b) == BRIEF else None for s, b in zip(sets, brief, strict=True)]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(class_of(sets)), pa.array(whole, pa.binary()), pa.array(brief, pa.binary())]
            yield pa.record_batch([batch.column(id), *columns], ["id", "n", "cid", "sketch", "brief"])

    found = docs.select(F.col(id).cast("bigint").alias(id), text).mapInArrow(lean(rows), "id bigint, n bigint, cid bigint, sketch binary, brief binary")
    return found.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int"))


def frequent_segments(docs: DataFrame, text: str, id: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys that are frequent in the sample, sorted, with their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text):
            sets = [s for s in shingle_sets(batch.column(text).to_pylist()) if len(s)]
            keys = [np.concatenate([segments(s, octave) for octave, _ in bands(len(s))]) for s in sets]
            owner = [np.full(len(k), s.sum(dtype=np.uint64)) for k, s in zip(keys, sets, strict=True)]
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner).view(np.int64))], ["key", "owner"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit(1), F.col(id)), F.lit(SAMPLED)) == 0).select(text)
    counted = sample.mapInArrow(lean(rows), "key bigint, owner bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("a"), F.max("owner").alias("b"))
    # keys of one set's copies alone say nothing, since those are one class
    top = counted.where((F.col("n") >= LEAST) & (F.col("a") != F.col("b"))).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toPandas()
    keys = top["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(dtype=np.int64)[order]

def candidate_lists(docs: DataFrame, text: str, id: str, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gid, chunk, ids, sizes): classes that share a key, in chunks of at most CHUNK."""
    spark = docs.sparkSession
    bits = bucket_bits(spark, 6) + 2
    shared = spark.sparkContext.broadcast(order)  # at most FREQUENT entries

    def pack(keys: list[np.ndarray], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        by_key = np.argsort(flat)
        flat, owner = flat[by_key], owner[by_key]
        id_of, size_of = np.array(ids, dtype=np.int64).view(np.uint64), np.array(sizes)

        def make(a: int, b: int) -> bytes:
            local, index = np.unique(owner[a:b], return_inverse=True)
            return pack_arrays(flat[a:b], index, id_of[local], size_of[local])

        return block_rows((flat >> np.uint64(64 - bits)).astype(np.int32), make)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes, held = [], [], [], 0
        for batch in text_batches(batches, text):
            sets = shingle_sets(batch.column(text).to_pylist())
            for one, real, found in zip(class_of(sets).tolist(), batch.column(id).is_valid().to_pylist(), sets, strict=True):
                if real and len(found):
                    keys.append(prefix_keys(found, *shared.value))
                    ids.append(one)
                    sizes.append(len(found))
                    held += len(keys[-1])
            if held >= FLUSH:
                yield pack(keys, ids, sizes)
                keys, ids, sizes, held = [], [], [], 0
        if keys:
            yield pack(keys, ids, sizes)

    def meet(blocks: pa.Table) -> pa.Table:
        parts = [unpack_arrays(b.as_buffer().to_pybytes()) for b in blocks.column("block")]
        keys = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([p[2][p[1]] for p in parts]).view(np.int64)
        sizes = np.concatenate([p[3][p[1]].astype(np.int64) for p in parts])
        del parts
        by_key = np.lexsort((ids, keys))
        keys, ids, sizes = keys[by_key], ids[by_key], sizes[by_key]
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])  # copies send equal keys
        keys, ids, sizes = keys[once], ids[once], sizes[once]
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        long = np.flatnonzero(np.diff(cuts) > 1)
        seen: set[int] = set()
        rows: list[tuple] = []
        for k in long:
            a, b = int(cuts[k]), int(cuts[k + 1])
            own = ids[a:b].view(np.uint64)
            with np.errstate(over="ignore"):
                gid = int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix(own + np.uint64(b - a)))], dtype=np.uint64)).view(np.int64)[0])
            if gid in seen:
                continue
            seen.add(gid)
            for at in range(a, b, CHUNK):
                stop = min(at + CHUNK, b)
                rows.append((gid, (at - a) // CHUNK, ids[at:stop], sizes[at:stop]))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["gid", "chunk", "ids", "sizes"])

    blocks = docs.select(id, text).mapInArrow(lean(emit), "bucket int, block binary")
    lists = blocks.groupBy("bucket").applyInArrow(lean_group(meet), "gid bigint, chunk int, ids array<bigint>, sizes array<bigint>")
    return lists.dropDuplicates(["gid", "chunk"])

def fits(a: str, b: str):
    """Whether sizes allow a link."""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)

def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id: str) -> DataFrame:
    """Those of the distinct pairs (a, b) of representatives whose sets are similar enough: first by sketch, then by text."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")]
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*row) for row in zip(*columns, strict=True)], pa.bool_()))

    of = lambda x: classes.select(F.col("rep").alias(x), F.coalesce("sketch", "brief").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    near = cut(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(sift), "a bigint, b bigint"), "near")
    kept = keep_ids(near.select("a").union(near.select("b")).distinct())

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            real = np.asarray(ids.is_valid())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(real & has_ids(kept, values)))

    # only texts of pairs are exchanged
    texts = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(lean(needed), "id bigint, text string")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in text_batches(text_batches(batches, "ta", most=3 << 20), "tb", most=3 << 20):
            new = {}
            for ids, texts in (("a", "ta"), ("b", "tb")):
                for k, one in enumerate(batch.column(ids).to_pylist()):
                    if one not in held and one not in new:
                        new[one] = batch.column(texts)[k].as_py()
            if len(held) > 256:
                held = {}
                new = {}
                for ids, texts in (("a", "ta"), ("b", "tb")):
                    for k, one in enumerate(batch.column(ids).to_pylist()):
                        if one not in new:
                            new[one] = batch.column(texts)[k].as_py()
            held |= dict(zip(new, shingle_sets(list(new.values())), strict=True))
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = held[a], held[b]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = int((y[at] == x).sum()) if len(y) else 0
                good.append(both > 0 and DEN * both >= NUM * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in ("a", "b"))
    both = near.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    out = cut(both.mapInArrow(lean(check), "a bigint, b bigint").distinct(), "links")
    discard(docs.sparkSession, near, kept[0])
    return out


def settled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The lists' members with their components so far; settled are those in their leader's component."""
    found = cut(components(links), "components")
    placed = members.join(found, "id", "left").select("gid", "leader", "id", "size", "n", F.coalesce("component", "id").alias("component"))
    of_leader = found.select(F.col("id").alias("leader"), F.col("component").alias("of_leader"))
    placed = placed.join(of_leader, "leader", "left").withColumn("settled", F.col("component") == F.coalesce("of_leader", "leader"))
    out = cut(placed.drop("of_leader"), "placed")
    discard(links.sparkSession, found)
    return out


class Members:
    """Members of lists in a batch of blocks, as arrays; row k of the batch has those from offsets[k] to offsets[k + 1]."""

    def __init__(self, blocks: pa.Array):
        rows = blocks.flatten()
        self.offsets = blocks.offsets.to_numpy() - blocks.offsets[0].as_py()
        self.id, self.size, self.component = (rows.field(c).to_numpy() for c in ("id", "size", "component"))
        self.open = ~rows.field("settled").to_numpy(zero_copy_only=False)
        sketches = rows.field("brief").to_pylist()
        self.bytes = np.array([len(b) for b in sketches], dtype=np.int64)
        self.place = np.zeros(len(sketches), dtype=np.int64)
        self.words: dict[int, np.ndarray] = {}
        for n in np.unique(self.bytes).tolist():
            own = np.flatnonzero(self.bytes == n)
            self.place[own] = np.arange(len(own))
            self.words[n] = np.frombuffer(b"".join(sketches[k] for k in own), np.uint64).reshape(len(own), n // 8)

    def folded(self, n: int, to: int) -> np.ndarray:
        """The sketches of n bytes, folded."""
        return np.bitwise_xor.reduce(self.words[n].reshape(-1, n // to, to // 8), axis=1)


def close(x: Members, y: Members, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) have sketches that allow a link."""
    out = np.zeros(len(i), dtype=bool)
    kind = x.bytes[i] << 32 | y.bytes[j]
    for one in np.unique(kind).tolist():
        n, m = one >> 32, one & 0xFFFFFFFF
        a, b = x.folded(n, min(n, m)), y.folded(m, min(n, m))
        own = np.flatnonzero(kind == one)
        for at in range(0, len(own), AT_ONCE):
            some = own[at : at + AT_ONCE]
            differ = np.bitwise_count(a[x.place[i[some]]] ^ b[y.place[j[some]]]).sum(axis=1, dtype=np.int64)
            out[some] = differ * (DEN + NUM) <= (DEN - NUM) * (x.size[i[some]] + y.size[j[some]])
    return out


def met_before(left: Store, right: Store, a: np.ndarray, b: np.ndarray, gid: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) that meet in the lists gid share a list with a smaller number, too."""
    (ids_a, at_a), (ids_b, at_b) = (np.unique(x, return_inverse=True) for x in (a, b))
    (offsets_a, lists_a), (offsets_b, lists_b) = groups_of(left, ids_a), groups_of(right, ids_b)
    kinds = np.unique(lists_b)
    out = np.zeros(len(a), dtype=bool)
    if not len(kinds):
        return out
    have = np.repeat(np.arange(len(ids_b)), np.diff(offsets_b)) * len(kinds) + np.searchsorted(kinds, lists_b)
    sizes = np.diff(offsets_a)[at_a]
    done = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + LISTED, side="right")) - 1)
        of = np.repeat(np.arange(at, stop), sizes[at:stop])
        value = lists_a[offsets_a[at_a[of]] + np.arange(len(of)) + done[at] - done[of]]
        smaller = value < gid[of]
        of, value = of[smaller], value[smaller]
        place = np.minimum(np.searchsorted(kinds, value), len(kinds) - 1)
        code = at_b[of] * len(kinds) + place
        hit = (kinds[place] == value) & (have[np.minimum(np.searchsorted(have, code), len(have) - 1)] == code)
        out[of[hit]] = True
        at = stop
    return out


def block_pairs(batches: Iterator[pa.RecordBatch], left: Store, right: Store) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of open members in x with members in y, of different components, whose sizes and sketches allow a link, in the first list that they share."""
    for whole in batches:
        for first in range(0, whole.num_rows, SLICE):
            batch = whole.slice(first, SLICE)
            x, y, gids = Members(batch.column("x")), Members(batch.column("y")), batch.column("gid").to_numpy().view(np.uint64)
            many, others = np.diff(x.offsets).astype(np.int64), np.diff(y.offsets).astype(np.int64)
            done = np.concatenate([[0], np.cumsum(many * others)])
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(done, done[row] + LISTED, side="right")) - 1)
                of = np.repeat(np.arange(row, stop), np.diff(done[row : stop + 1]))
                nth = np.arange(len(of)) + done[row] - done[of]
                i, j = x.offsets[of] + nth // others[of], y.offsets[of] + nth % others[of]
                p, q = x.size[i], y.size[j]
                # a pair of two open members comes in both orders
                fit = x.open[i] & (x.component[i] != y.component[j]) & (~y.open[j] | (x.id[i] < y.id[j])) & (DEN * np.minimum(p, q) >= NUM * np.maximum(p, q))
                i, j, of = i[fit], j[fit], of[fit]
                good = close(x, y, i, j)
                a, b, of = x.id[i[good]], y.id[j[good]], of[good]
                if len(a):
                    new = ~met_before(left, right, a, b, gids[of])
                    a, b = a[new], b[new]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                row = stop


def across(rows: DataFrame, classes: DataFrame, left: Store, few: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of the lists' open members with members in other components, as far as sizes and sketches allow.

    rows: members with their components; few: the members to compare with, a bounded number in each list, else all;
    left: the lists of rows' members, by keep_groups, others in which a pair has been compared included."""
    right = left if few is None else keep_groups(few.select("id", "gid"))
    sketched = lambda x: x.join(classes.select(F.col("rep").alias("id"), "brief"), "id")
    gathered = lambda settled: F.collect_list(F.struct("id", "size", "component", settled, "brief")).alias("rows")
    lists = rows.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.max(~F.col("settled")).alias("open")).where("open")
    grouped = sketched(rows.join(lists.select("gid", "blocks"), "gid")).groupBy("gid", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    blocks = grouped.agg(gathered(F.col("settled")), F.max(~F.col("settled")).alias("open"))
    blocks = cut(blocks, "blocks") if few is None else blocks
    # one of the few counts as settled, so that every open member meets it
    others = blocks if few is None else sketched(few).groupBy("gid").agg(gathered(F.lit(True).alias("settled")))
    met = blocks.where("open").select("gid", F.col("rows").alias("x")).join(others.select("gid", F.col("rows").alias("y")), "gid")
    out = cut(met.mapInArrow(lean(lambda batches: block_pairs(batches, left, right)), "a bigint, b bigint").distinct(), "pairs")
    discard(rows.sparkSession, left[0], *([blocks] if few is None else [right[0]]))
    return out


def jaccard_components(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that it reaches by links), class_id (the smallest id with the same set)."""
    need_integers(docs, id)
    spark = docs.sparkSession
    small_batches(spark)
    runs = 1 << bucket_bits(spark, 6)
    sets = cut(set_rows(docs, text, id, runs), "sets")
    filled = sets.where("n > 0 AND id IS NOT NULL")
    first = filled.groupBy("run", "cid").agg(F.min("id").alias("own"), F.min("n").alias("n"))
    root = first.groupBy("cid").agg(F.min("own").alias("rep"), F.min("n").alias("n"))
    sketches = filled.select(F.col("id").alias("rep"), "cid", "sketch", "brief").dropDuplicates(["rep", "cid"])
    classes = cut(root.join(sketches, ["rep", "cid"]), "classes")
    lists = cut(candidate_lists(docs, text, id, frequent_segments(docs, text, id)), "lists")
    listed = lists.select("gid", F.explode(F.arrays_zip("ids", "sizes")).alias("m")).select("gid", F.col("m.ids").alias("cid"), F.col("m.sizes").alias("size"))
    members = listed.join(classes.select("cid", F.col("rep").alias("id")), "cid").select("gid", "id", "size")
    lead = members.groupBy("gid").agg(F.min(F.struct("id", "size")).alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = lead.select("gid", F.col("lead.id").alias("leader"), F.col("lead.size").alias("leader_size"), "n")
    members = cut(members.join(lead, "gid"), "members")
    star = members.where((F.col("id") != F.col("leader")) & fits("leader_size", "size")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(star, classes, docs, text, id)
    for salt in range(ROUNDS):
        placed = settled(members, links)
        large = members.where(F.col("n") > LARGE).withColumn("_place", F.row_number().over(Window.partitionBy("gid").orderBy(F.xxhash64("id", F.lit(salt)), "id")))
        few = cut(large.where(F.col("_place") <= DELEGATES).select("gid", "id").join(placed.select("gid", "id", "size", "component"), ["gid", "id"]), "delegates")
        still = placed.where(~F.col("settled") & (F.col("n") > LARGE))
        links = cut(links.union(verified(across(still, classes, keep_groups(still.select("id", "gid")), few), classes, docs, text, id)), "links")
        discard(spark, placed, few)
    placed = settled(members, links)
    # leaders have been compared with all
    more = verified(across(placed.where(F.col("id") != F.col("leader")), classes, keep_groups(members.select("id", "gid"))), classes, docs, text, id)
    final = components(links.union(more))
    discard(spark, lists, members, placed)
    named = classes.select("cid", "rep").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("cid", "rep", F.coalesce("component", "rep").alias("component"))
    # a class has at most one row in each run, and a run only its share of a large class
    labelled = first.select("run", "cid").join(named, "cid")
    alone = (F.col("s.n") == 0) | F.col("s.id").isNull()
    joined = sets.drop("sketch", "brief").alias("s").join(labelled.alias("c"), ["run", "cid"], "left")
    kind = docs.schema[id].dataType.simpleString()
    out = cut(joined.select(
        F.col("s.id").cast(kind).alias(id), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("s.id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.col("s.id")).otherwise(F.col("rep")).alias("class_id"),
    ), "components")
    discard(spark, sets, classes, final, links)
    return out
