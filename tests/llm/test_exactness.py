"""Exactness where hashes agree by chance, and a network's training on few documents."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logweir.llm import language_id, quality_rules, suffix_dedup


def test_repeats_are_found_among_windows_with_equal_hashes(spark, monkeypatch):
    plain = F.xxhash64
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcde", k=n)) for n in (3, 9, 40, 90)]
    want = []
    for text in texts:
        ws = text.split()
        windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        want.append(len({k + d for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for d in range(3)}))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for bits in (0, 1, 3):  # windows have so many bits of a hash
        monkeypatch.setattr(F, "xxhash64", lambda *c, b=bits: F.shiftleft(F.pmod(plain(*c), F.lit(1 << b)), 40))
        assert [r.n_repeat_words for r in quality_rules.apply_rules(df).orderBy("doc_id").collect()] == want


def test_anchors_depend_on_a_window_alone():
    rng = np.random.default_rng(2)
    for width in (1, 2, 7, 64):
        for n in (width, width + 1, 200):
            x = rng.integers(0, 6, n).astype(np.uint64)
            want = [a + int(np.argmin(x[a : a + width])) for a in range(n - width + 1)]
            assert suffix_dedup.sliding_argmin(x, width).tolist() == want
    # a string has the same anchor in it, whatever stands around it and however long the batch is
    text = rng.integers(97, 101, 260).astype(np.uint8).tobytes()
    alone = suffix_dedup.Anchored([text])
    among = suffix_dedup.Anchored([rng.integers(97, 101, 5000).astype(np.uint8).tobytes(), text])
    assert set(alone.place.tolist()) == set((among.place[among.text == 1] - 5000).tolist())


def forward_plain(network, text):
    """The network read byte by byte: log probabilities for each byte."""
    half, p = language_id.HIDDEN, network.p

    def run(way, data):
        h, out = np.zeros(half), []
        for byte in data:
            a = np.tanh(p["x" + way][:, byte] + p["u" + way] @ h + p["c" + way])
            z = 0.5 * a[:half] + 0.5
            h = z * h + (1 - z) * a[half:]
            out.append(h)
        return out

    ahead, back = run("f", text), run("b", text[::-1])[::-1]
    scores = [p["out"] @ np.concatenate([a, b]) + p["bias"] for a, b in zip(ahead, back, strict=True)]
    return [s - math.log(sum(math.exp(x) for x in s)) for s in scores]


def test_forward_pass_is_the_formula():
    network = language_id.Network(["a", "b", "c"], 3)
    texts = [b"gated units", b"x", bytes(range(32, 120))]
    text, mask, owner = language_id.windows_of(texts)
    got = network.forward(text, mask)
    for k, t in enumerate(texts):
        assert np.allclose(got[: len(t), :, k], forward_plain(network, t), atol=1e-4)


def test_few_documents_are_learned_from_long_enough():
    rng = random.Random(9)
    parts = {"aa": ["the", "and", "ing", "wh"], "bb": ["für", "über", "sch", "ung"], "cc": ["que", "ción", "los", "ent"]}
    made = lambda: [(" ".join("".join(rng.choices(parts[x], k=2)) for _ in range(20)).encode()[: language_id.LENGTH], x) for _ in range(12) for x in parts]
    network = language_id.fit(made())
    held = made()
    found, _ = language_id.label_texts(network, [b.decode(errors="ignore") for b, _ in held])
    assert sum(a == b for a, (_, b) in zip(found, held, strict=True)) / len(held) >= 0.97
