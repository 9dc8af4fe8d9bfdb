"""Language ID: a bidirectional gated recurrent network over bytes labels every position; documents pool the labels.

A text's bytes (A-Z lower-cased) are read one by one in windows of LENGTH bytes, which cover the whole text and start
from an empty state, so that any length is read in parallel and in bounded memory. Each direction has one gate (a
light gated unit: no reset gate, so that a step is one product and one tanh):

    a = tanh(X[byte] + U h + c)    z = (1 + a[first half]) / 2    n = a[second half]    h' = z * h + (1 - z) * n

Every byte gets log probabilities of the languages from both directions' states. A document's probabilities are the
softmax of the sum of its bytes' log probabilities, tempered by the square root of their number.

Training is numpy backpropagation through time on the driver, over a bounded sample: for each language the documents
with the smallest hash, PER_LANGUAGE at most, and from each WINDOWS windows at hashed places of the whole text. The
sample is cut to those windows on the executors; its size does not grow with the corpus: of more than LANGUAGES full
languages, the rows with the smallest hashes stay, PER_LANGUAGE * LANGUAGES in all.

A text that is null or has no letter is `und` with score 0. Null languages are not learned from; if there is nothing
to learn from, every text is `und`. Null identifiers count as held out. Rows that repeat are labelled one by one;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, text_batches

LENGTH, HIDDEN = 192, 8
#: A window function with a limit up to 1000 is cut before its exchange.
PER_LANGUAGE, WINDOWS, LANGUAGES = 1000, 2, 256
EPOCHS, BATCH, RATE, SEED, LEAST_STEPS = 8, 256, 0.01, 7, 400
#: Windows are labelled so many at a time.
AT_ONCE = 1024


class Network:
    """Parameters by name; forward() and backward() over windows of bytes. Arrays are (time, units, windows)."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.languages = languages
        self.p = {"out": normal(len(languages), 2 * HIDDEN, scale=0.3), "bias": np.zeros(len(languages), np.float32)}
        for way in ("f", "b"):
            self.p["x" + way] = normal(2 * HIDDEN, 256, scale=0.5)
            self.p["u" + way] = normal(2 * HIDDEN, HIDDEN, scale=0.3)
            self.p["c" + way] = np.concatenate([np.ones(HIDDEN), np.zeros(HIDDEN)]).astype(np.float32)

    def _run(self, text: np.ndarray, mask: np.ndarray, way: str, states: np.ndarray, kept: list | None) -> None:
        """Fills states with one direction's."""
        steps, n = mask.shape
        table, u = self.p["x" + way] + self.p["c" + way][:, None], self.p["u" + way]
        h = np.zeros((HIDDEN, n), table.dtype)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = u @ h
            a += table.take(text[t], axis=1)
            np.tanh(a, out=a)
            z = a[:HIDDEN] + 1
            z *= 0.5
            if kept is not None:
                kept.append((t, h, a))
            new = h - a[HIDDEN:]
            new *= z
            new += a[HIDDEN:]
            new *= mask[t]
            states[t] = h = new

    def forward(self, text: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Log probabilities (time, languages, windows)."""
        kept = {"f": [], "b": []} if tape is not None else {"f": None, "b": None}
        both = np.empty((len(mask), 2 * HIDDEN, mask.shape[1]), self.p["out"].dtype)
        for k, way in enumerate(("f", "b")):
            self._run(text, mask, way, both[:, k * HIDDEN : (k + 1) * HIDDEN], kept[way])
        logits = self.p["out"] @ both
        logits += self.p["bias"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        if tape is not None:
            tape |= {"kept": kept, "both": both}
        return logits

    def backward(self, text: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients."""
        tape: dict = {}
        d = self.forward(text, mask, tape)
        weight = (mask / mask.sum()).astype(np.float32)
        own = np.arange(len(labels))
        loss = -float((d[:, labels, own] * weight).sum())
        np.exp(d, out=d)
        d[:, labels, own] -= 1
        d *= weight[:, None]
        grads = {"out": np.einsum("tln,tun->lu", d, tape["both"], optimize=True), "bias": d.sum(axis=(0, 2))}
        d_both = self.p["out"].T @ d
        for k, way in enumerate(("f", "b")):
            d_states, u = d_both[:, k * HIDDEN : (k + 1) * HIDDEN], self.p["u" + way]
            d_x = np.empty((len(mask), 2 * HIDDEN, len(labels)), u.dtype)
            d_u, carry = np.zeros_like(u), np.zeros(d_states.shape[1:], u.dtype)
            for t, h, a in reversed(tape["kept"][way]):
                dh = (d_states[t] + carry) * mask[t]
                z, candidate = 0.5 * a[:HIDDEN] + 0.5, a[HIDDEN:]
                d_a = d_x[t]
                d_a[:HIDDEN] = 0.5 * dh * (h - candidate)
                d_a[HIDDEN:] = dh * (1 - z)
                d_a *= 1 - a * a
                d_u += d_a @ h.T
                carry = dh * z + u.T @ d_a
            flat, bytes_ = d_x.transpose(1, 0, 2).reshape(2 * HIDDEN, -1), text.ravel()
            grads["u" + way], grads["c" + way] = d_u, flat.sum(axis=1)
            grads["x" + way] = np.stack([np.bincount(bytes_, row, 256) for row in flat])
        return loss, grads


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (time, windows), mask (time, windows) and each window's text."""
    counts = np.array([-(-len(t) // LENGTH) for t in texts], dtype=np.int64)
    raw = np.zeros((int(counts.sum()), LENGTH), np.uint8)
    at = np.concatenate([[0], np.cumsum(counts)])
    flat = raw.reshape(-1)
    for t, first in zip(texts, at[:-1], strict=True):
        flat[first * LENGTH : first * LENGTH + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.array([len(t) for t in texts], dtype=np.int64)[owner] - (np.arange(len(owner)) - at[:-1][owner]) * LENGTH
    mask = (np.arange(LENGTH)[:, None] < left).astype(np.float32)
    return np.ascontiguousarray(raw.T), mask, owner


def fit(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """Adam over shuffled batches of windows; the same samples give the same network. A small sample is gone through more
    often, since a network needs LEAST_STEPS steps whatever the sample's size."""
    samples = sorted((bytes(b), lang) for b, lang in samples if b)
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    network, rng = Network(languages, seed), np.random.default_rng(seed)
    code = {lang: k for k, lang in enumerate(languages)}
    text, mask, owner = windows_of([b for b, _ in samples])
    labels = np.array([code[lang] for _, lang in samples])[owner]
    m = {k: np.zeros_like(v) for k, v in network.p.items()}
    v = {k: np.zeros_like(v) for k, v in network.p.items()}
    step, epochs = 0, max(epochs, -(-LEAST_STEPS // -(-len(labels) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, grads = network.backward(text[:, pick], mask[:, pick], labels[pick])
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                network.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return network


def held_out(id: str, parts: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(True))


def sample(docs: DataFrame, text: str, id: str, lang: str, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """Windows of the labelled sample, cut on the executors."""
    span, size = LENGTH, F.octet_length("_text")
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(ascii_lower(F.col(text)).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(F.col(id)).alias("_hash"))
    narrow = rows.select("_lang", "_hash", *[
        F.substring(F.encode("_text", "UTF-8"), (F.pmod(F.xxhash64("_hash", F.lit(k)), F.greatest(size - span + 1, F.lit(1))) + 1).cast("int"), F.lit(span)).alias(f"_w{k}") for k in range(WINDOWS)
    ])
    order = ["_hash", *[f"_w{k}" for k in range(WINDOWS)]]  # identifiers may repeat
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(*order))
    taken = narrow.withColumn("_place", place).where(F.col("_place") <= per_language).drop("_place")
    most = taken.orderBy(*order, "_lang").limit(per_language * LANGUAGES)
    return [(bytes(r[f"_w{k}"]), r["_lang"]) for r in most.select("_lang", *[f"_w{k}" for k in range(WINDOWS)]).toLocalIterator() for k in range(WINDOWS)]


def label_texts(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    live = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
    if not live:
        return langs, scores
    data = [texts[i].encode("utf-8", "surrogatepass").lower() for i in live]
    total, size = np.zeros((len(live), len(network.languages))), np.array([len(b) for b in data])
    # long texts are read AT_ONCE windows at a time
    block: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        if block:
            found, mask, own = windows_of(block)
            sums = np.einsum("tln,tn->nl", network.forward(found, mask), mask, optimize=True)
            np.add.at(total, np.array(owner)[own], sums)
            block.clear()
            owner.clear()

    held = 0
    for k, b in enumerate(data):
        for at in range(0, len(b), AT_ONCE * LENGTH):
            block.append(b[at : at + AT_ONCE * LENGTH])
            owner.append(k)
            held += -(-len(block[-1]) // LENGTH)
            if held >= AT_ONCE:
                flush()
                held = 0
    flush()
    pooled = total / np.sqrt(size)[:, None]
    pooled -= pooled.max(axis=1, keepdims=True)
    chance = np.exp(pooled)
    chance /= chance.sum(axis=1, keepdims=True)
    for i, best, score in zip(live, chance.argmax(axis=1), chance.max(axis=1), strict=True):
        langs[i], scores[i] = network.languages[best], float(min(score, 1.0))
    return langs, scores


def identify(docs: DataFrame, network: Network | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of parameters

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text, most=2 << 20):
            langs, scores = label_texts(shared.value, batch.column(text).to_pylist())
            yield pa.record_batch([batch.column(id), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id, "lang_pred", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(rows, f"{id} {kind}, lang_pred string, score double")


def identify_corpus(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", parts: int = 5) -> DataFrame:
    """Learns from the labelled documents that are not held out, labels all."""
    network = fit(sample(docs.where(~held_out(id, parts)), text, id, lang))
    return identify(docs, network, text, id).select(id, held_out(id, parts).alias("held_out"), "lang_pred", "score")
