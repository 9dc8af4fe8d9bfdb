"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each text is described by the FEATURES, none of which depends on its language's words. Features are cut into bins at quantiles of the
sample. Boosting goes round the features; each turn fits one shallow tree (depth two) on that feature's bins to the
gradient of the logistic loss and adds a fraction of it to the feature's lookup table. With the tables settled, the
pairs of features that explain most of what is left get tables of their own, by trees that cut either feature once.
A score is the logistic of the intercept and the sum of looked-up bins, a few vectorised additions for each batch.

The model is learned on the driver from at most SAMPLE labelled documents, those with the smallest hash; only their
features (some numbers each) are gathered, and only they are joined, by broadcast, which SAMPLE bounds. Scoring reads
every text whole.

Null and empty texts have the features of no words and are scored like others. Null labels and null identifiers are
not learned from; a null identifier counts as held out. Repeated labels count once each; with no labels or one class
alone, the score is that class's share (0.5 without labels). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, text_batches

SAMPLE = 20_000
FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "pipes", "marks", "stops", "non_ascii",
    "distinct_words", "distinct_pairs", "lines_per_word", "repeated_lines", "white_space", "few_words",
)
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 32, 150, 0.15, 6, 30


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT, _SYMBOL, _PIPE, _MARK, _STOP, _SPACE = map(_bytes_in, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@~^_=+\\/{}[]", "|", "!?", ".,;:", " \t\n\r\v\f"))
_HIGH = (np.arange(256) >= 0x80).astype(np.int64)


def describe(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES) as float64."""
    words, offsets = hashed_words(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        own = words[offsets[i] : offsets[i + 1]]
        n, size = len(own), len(raw)
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters = max(size - count @ _SPACE, 1)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        pairs = own[1:] * np.uint64(3) + own[:-1]
        share = lambda part: float(count @ part) / letters
        out[i] = (
            np.log1p(n), np.log1p(size), letters / max(n, 1), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_PIPE), share(_MARK), share(_STOP), share(_HIGH),
            len(np.unique(own)) / max(n, 1), len(np.unique(pairs)) / max(n - 1, 1), len(lines) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1),
            float(count @ _SPACE) / max(size, 1), min(n, 100) / 100,
        )
    return out


def leaf(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    return gradient / (hessian + 1.0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to cut a row of bins in two, and the gain; 0 for no cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    if not len(gain) or gain.max() <= 1e-9:
        return 0, 0.0
    return int(gain.argmax()) + 1, float(gain.max())


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree over ordered bins, as one value for each bin."""
    cut, _ = best_cut(g, h) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), leaf(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts the rows of a grid once and then each part's columns once."""
    cut, gain = best_cut(g.sum(axis=1), h.sum(axis=1))
    parts = [slice(0, cut), slice(cut, len(g))] if cut else [slice(0, len(g))]
    out = np.zeros_like(g)
    for part in parts:
        gs, hs = g[part].sum(axis=0), h[part].sum(axis=0)
        _, more = best_cut(gs, hs)
        gain += more
        out[part] = shallow_tree(gs, hs, 1)
    return out, gain


@dataclass
class Additive:
    """edges: a feature's inner bin limits; tables: its values by bin; pairs: features a and b with a grid of values."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for i, j, grid in self.pairs:
            total += grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting; the same rows in any order give the same tables up to rounding."""
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or rate in (0.0, 1.0):
        return Additive(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    model = Additive(float(np.log(rate / (1 - rate))))
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    total = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, n in enumerate(sizes):
            g, h = residual()
            tree = RATE * shallow_tree(np.bincount(b[:, k], g, n), np.bincount(b[:, k], h, n))
            model.tables[k] += tree
            total += tree[b[:, k]]
    grid_of = lambda v, i, j: np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = residual()
    ranked = sorted(((pair_tree(grid_of(g, i, j), grid_of(h, i, j))[1], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, grid in model.pairs:
            g, h = residual()
            tree = RATE * pair_tree(grid_of(g, i, j), grid_of(h, i, j))[0]
            grid += tree
            total += tree[b[:, i], b[:, j]]
    return model


def held_out(id: str, parts: int = 3, at: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(parts)) == at, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", most: int = SAMPLE) -> Additive:
    """From the labelled documents (at most `most`) that are not held out."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id)).select(F.col(id).alias("_id"), (F.col(label) == 1).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    rows = docs.select(F.col(id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_y", "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text"):
            x = describe(batch.column("_text").to_pylist())
            yield pa.record_batch([batch.column("_doc"), batch.column("_y"), *[pa.array(c) for c in x.T]], ["_doc", "_y", *FEATURES])

    kind = docs.schema[id].dataType.simpleString()
    found = rows.mapInArrow(features, f"_doc {kind}, _y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["_doc", "_y"])
    return fit(found[list(FEATURES)].to_numpy(dtype=float), found["_y"].to_numpy(dtype=float))


def classify(docs: DataFrame, model: Additive, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS by FEATURES numbers and PAIRS grids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text):
            score = shared.value.score(describe(batch.column(text).to_pylist()))
            yield pa.record_batch([batch.column(id), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id, "score", "predicted"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(rows, f"{id} {kind}, score double, predicted int")


def classify_corpus(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Learns from the labels that are not held out, scores all documents."""
    model = learn(docs, labels, text, id)
    return classify(docs, model, text, id).select(id, held_out(id).alias("held_out"), "score", "predicted")
