"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, mapped by the workers.

Counting. Each task hashes its training texts' words and reduces its pairs (word before, word) to sorted blocks, one
for each hash bucket of the word before. A bucket's task merges the blocks of all tasks, so it holds every pair of
its words: it writes their counts and, for each word before, the total and how many continuations occur once, twice
and more often, as sorted arrays into the shared folder. On the way it yields, for each word, in how many kinds of
pairs it ends (the continuation count) and how often it occurs; a second exchange, by the word's own bucket, sums
those into the unigram arrays. Only sums of a few numbers for each bucket go to the driver: counts of counts for the
discounts, the number of tokens and kinds.

Storage and scoring. A bucket's arrays are files of sorted 64-bit hashes with their counts beside them. Workers map
the files, so the model takes page cache and not memory, shared by all workers of a machine. A batch of texts is
looked up together: its pairs are sorted first, and so each file is read front to back.

    p(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) * q(w)
    q(w)     = max(k(w) - D'(k), 0) / K + g' / (V + 1),  k: continuation counts, K: their sum

with modified Kneser-Ney discounts D1, D2 and D3+ for each order, and the last term shared among the V known words and
an unknown one. The order is two: on these corpora nearly every three words in a row are new, so that a third
order's counts outgrow the disk (README) while they cannot generalise.

A hot word's bucket is bounded by the number of different words, not by its count, since tasks reduce first. Hashes
have 64 bits; two words are confused with a chance of V^2 / 2^65.

Null and empty texts consist of the end token alone. A null identifier is never learned from and counts as held out.
With no training text, scores fall back on the unknown word's uniform probability. Rows that repeat are learned from
and scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, cut, hashed_words, mix, new_dir, pair, put_file, text_batches
from .hash_arrays import block_rows, finish, lookup, pack_arrays, unpack_arrays

START, END = mix(np.array([0x5354415254, 0x454E44], dtype=np.uint64))
FLUSH = 1_500_000




def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each text, and offsets."""
    words, offsets = hashed_words(texts)
    out_offsets = offsets + np.arange(len(offsets))
    tokens = np.empty(out_offsets[-1], dtype=np.uint64)
    ends = out_offsets[1:] - 1
    is_end = np.zeros(len(tokens), dtype=bool)
    is_end[ends] = True
    tokens[is_end] = END
    tokens[~is_end] = words
    return tokens, out_offsets


def before(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[offsets[:-1]] = START
    return out


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts rows by keys, and the starts of runs of equal rows in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def pair_blocks(tokens: np.ndarray, prior: np.ndarray, bits: int) -> pa.RecordBatch:
    """Pairs with counts; in a block, words before are kept once, with how many pairs each has."""
    order, starts = grouped(prior, tokens)
    counts = np.diff(np.concatenate([starts, [len(order)]]))
    at = order[starts]
    v, w = prior[at], tokens[at]

    def make(a: int, b: int) -> bytes:
        _, first = grouped(v[a:b])
        return pack_arrays(v[a:b][first], np.diff(np.concatenate([first, [b - a]])), w[a:b], counts[a:b])

    return block_rows((v >> np.uint64(64 - bits)).astype(np.int32), make)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of equal keys become one, values added."""
    order, starts = grouped(*keys)
    at = order[starts]
    return [k[at] for k in keys], [np.add.reduceat(v[order].astype(np.int64), starts) if len(starts) else v.astype(np.int64) for v in values]


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


STATS = "bucket int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, kinds bigint, total bigint, occurrences bigint"


def stats_row(bucket: int, counts: np.ndarray, occurrences: int) -> list:
    return [bucket, *counts_of_counts(counts), len(counts), int(counts.sum()), occurrences]


def merge_pairs(block_table: pa.Table, folder: str, bits: int) -> tuple[bytes, list]:
    """All blocks of one bucket: writes its arrays, yields its unigram rows and its statistics."""
    bucket = block_table.column("bucket")[0].as_py()
    vs, ws, cs = [], [], []
    for block in block_table.column("block"):
        v, repeat, w, c = unpack_arrays(block.as_buffer().to_pybytes())
        vs.append(np.repeat(v, repeat))
        ws.append(w)
        cs.append(c)
    (v, w), (c,) = summed([np.concatenate(vs), np.concatenate(ws)], [np.concatenate(cs)])
    del vs, ws, cs
    _, first = grouped(v)
    sizes = [np.add.reduceat((hit if hit is not c else c).astype(np.int64), first) for hit in (c, c == 1, c == 2, c >= 3)]
    key = pair(v, w) >> np.uint64(bits) | np.uint64(bucket) << np.uint64(64 - bits) if bits else pair(v, w)
    order = np.argsort(key)
    put_file(f"{folder}/pairs-{bucket}.npy", pack_arrays(key[order], c[order]))
    put_file(f"{folder}/before-{bucket}.npy", pack_arrays(v[first], *sizes))
    (kinds,), (ends, occurrences) = summed([w], [np.ones(len(w), dtype=np.int64), c])
    return pack_arrays(kinds, ends, occurrences), stats_row(bucket, c, int(c.sum()))


@dataclass(frozen=True)
class Order:
    """Discounts of one order from its counts of counts."""

    n: tuple[int, int, int, int]

    def discounts(self) -> np.ndarray:
        """By a count of 0, 1, 2 or more. Counts of counts that are too small for the estimate give 0.5, 1 and 1.5."""
        n1, n2, n3, n4 = self.n
        if min(self.n) <= 0:
            return np.array([0.0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1)]])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the sums that belong to the whole corpus."""

    folder: str
    bits: int
    pairs: Order
    words: Order
    kinds: int  # V
    tokens: int  # N
    ends: int  # K, the sum of continuation counts
    rest: float  # g', the mass that discounts free at the lower order


def score_batch(model: Model, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score for each text."""
    tokens, offsets = tokens_of(texts)
    prior = before(tokens, offsets)
    words, of_word = np.unique(tokens, return_inverse=True)
    contexts, of_context = np.unique(prior, return_inverse=True)
    code = of_context.astype(np.int64) * len(words) + of_word
    codes, of_pair = np.unique(code, return_inverse=True)
    v, w = codes // len(words), codes % len(words)
    keys = pair(contexts[v], words[w])
    keys = keys >> np.uint64(model.bits) | contexts[v] >> np.uint64(64 - model.bits) << np.uint64(64 - model.bits) if model.bits else keys
    by_key = np.argsort(keys)
    seen = np.zeros(len(keys), dtype=np.int64)
    seen[by_key] = lookup(model.folder, "pairs", model.bits, keys[by_key], 1)[0]
    ends, occurrences = lookup(model.folder, "words", model.bits, words, 2)
    total, one, two, more = lookup(model.folder, "before", model.bits, contexts, 4)
    low, high = model.words.discounts(), model.pairs.discounts()
    lower = np.maximum(ends - low[np.minimum(ends, 3)], 0) / max(model.ends, 1) + (model.rest if model.ends else 1.0) / (model.kinds + 1)
    free = np.where(total > 0, (high[1] * one + high[2] * two + high[3] * more) / np.maximum(total, 1), 1.0)
    p = np.maximum(seen - high[np.minimum(seen, 3)], 0) / np.maximum(total, 1)[v] + free[v] * lower[w]
    base = np.log10((occurrences + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
    # every text has its end token, so that no segment is empty
    sums = lambda x: np.add.reduceat(x, offsets[:-1])
    return np.diff(offsets), sums((occurrences > 0)[of_word].astype(np.int64)), sums(base[of_word]), sums(np.log10(p)[of_pair])


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts the texts of docs and leaves the arrays in the shared folder."""
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    folder = new_dir(spark, "ngrams")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in text_batches(batches, text):
            tokens, offsets = tokens_of(batch.column(text).to_pylist())
            held.append((tokens, before(tokens, offsets)))
            size += len(tokens)
            if size >= FLUSH:
                yield pair_blocks(np.concatenate([t for t, _ in held]), np.concatenate([p for _, p in held]), bits)
                held, size = [], 0
        if held:
            yield pair_blocks(np.concatenate([t for t, _ in held]), np.concatenate([p for _, p in held]), bits)

    def merge(block_table: pa.Table) -> pa.Table:
        unigrams, stats = merge_pairs(block_table, folder, bits)
        kinds, ends, occurrences = unpack_arrays(unigrams)
        own = block_rows((kinds >> np.uint64(64 - bits)).astype(np.int32), lambda a, b: pack_arrays(kinds[a:b], ends[a:b], occurrences[a:b]))
        rows = pa.table({"own": pa.array([stats[0]] * own.num_rows, pa.int32()), "bucket": own.column("bucket"), "block": own.column("block")})
        for k, name in enumerate(f.split()[0] for f in STATS.split(", ")[1:]):
            rows = rows.append_column(name, pa.array([stats[k + 1]] + [0] * (rows.num_rows - 1), pa.int64()))
        return rows

    def merge_words(block_table: pa.Table) -> pa.Table:
        bucket = block_table.column("bucket")[0].as_py()
        parts = [unpack_arrays(b.as_buffer().to_pybytes()) for b in block_table.column("block")]
        (w,), (ends, occurrences) = summed([np.concatenate([p[0] for p in parts])], [np.concatenate([p[k] for p in parts]) for k in (1, 2)])
        put_file(f"{folder}/words-{bucket}.npy", pack_arrays(w, ends, occurrences))
        names = [f.split()[0] for f in STATS.split(", ")]
        return pa.table([pa.array([x]) for x in stats_row(bucket, ends, int(occurrences.sum()))], names=names).cast(pa.schema([(n, pa.int32() if n == "bucket" else pa.int64()) for n in names]))

    sums = STATS.split(", ")[1:]
    # the first exchange's results are kept, as two things are made of them
    blocks = docs.select(text).mapInArrow(count, "bucket int, block binary")
    firsts = cut(blocks.groupBy("bucket").applyInArrow(merge, "own int, bucket int, block binary, " + ", ".join(sums)), "unigrams")
    names = [f.split()[0] for f in sums]
    high = firsts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    for name in ("pairs", "before"):
        finish(folder, name, [r.own for r in firsts.select("own").distinct().collect()])
    written = F.collect_list("bucket").alias("written")  # at most 2 ** bits
    low = firsts.select("bucket", "block").groupBy("bucket").applyInArrow(merge_words, STATS).agg(written, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    finish(folder, "words", low.written)
    pairs, words = Order((high.n1, high.n2, high.n3, high.n4)), Order((low.n1, low.n2, low.n3, low.n4))
    d = words.discounts()
    rest = (d[1] * low.n1 + d[2] * low.n2 + d[3] * (low.kinds - low.n1 - low.n2)) / max(low.total, 1)
    return Model(folder, bits, pairs, words, low.kinds, low.occurrences, low.total, float(rest))


def held_out(id: str, parts: int = 10) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(True))


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text):
            n, known, base, own = score_batch(model, batch.column(text).to_pylist())
            arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))]
            yield pa.record_batch([batch.column(id), *arrays], [id, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(rows, f"{id} {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def score_corpus(docs: DataFrame, text: str = "text", id: str = "doc_id", parts: int = 10) -> DataFrame:
    """Learns from all but a tenth (1 / parts) of the documents, scores all of them."""
    model = train(docs.where(~held_out(id, parts)), text)
    scored = score(docs, model, text, id)
    return scored.select(id, held_out(id, parts).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
