"""Each corpus operator against a brute-force version on a small table with nulls, ties, repeats and long texts."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import exact_dedup, hash_arrays, jaccard_join, language_id, language_model, licenses, mixing, packing, quality_classifier, quality_rules, suffix_dedup
from logweir.llm.common import keyed
from logweir.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double"


def words_of(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120).split()
    texts = [None, "", " \n\t", "one", "One", "a b c d", "é É", "x" * 3000, "ab " * 900, prose(4000)]
    texts += [prose(rng.randint(5, 150)) for _ in range(60)]
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(12)]
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [texts[20].upper(), texts[20], texts[21], texts[21]]
    out = [(k, t, ["en", "de", None][k % 3], [f"s{k % 5}", None, "hot", "hot"][k % 4], 0, True, 1.0) for k, t in enumerate(texts)]
    return out + [out[15], (None, "no identifier at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(docs, keep=keep, fan_in=2, runs=8).collect()
        assert len(got) == len(rows)
        text = dict((r[0], lower(r[1])) for r in rows)
        for r in got:
            own = groups[text[r.doc_id]]
            win = best([i for i in own if i is not None], default=None)
            assert (r.keep_id, r.group_size, r.kept) == (win, len(own), r.doc_id == win)
            assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_language_model(docs, rows):
    got = {r.doc_id: r for r in language_model.score_corpus(docs).collect()}
    learned = [w for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in [words_of(t) + ["end"]]]
    c = Counter(w for ws in learned for w in ws)
    total, kinds = sum(c.values()), len(c)
    for i, t, *_ in rows:
        ws = words_of(t) + ["end"]
        base = sum(np.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total) and abs(r.base_score - base) < 1e-6
        assert np.isfinite(r.score) and r.held_out == (i is None or zlib.crc32(str(i).encode()) % 10 == 0)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_kneser_ney(docs, rows):
    model = language_model.train(docs)
    texts = [words_of(t) + ["end"] for _, t, *_ in rows]
    pairs = Counter(p for ws in texts for p in zip(["start", *ws], ws, strict=False))

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *[min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]] if min(n) else [0.0, 0.5, 1.0, 1.5]

    ends = Counter(w for _, w in pairs)
    high, low = discounts(list(pairs.values())), discounts(list(ends.values()))
    total, free = Counter(), Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        free[v] += high[min(n, 3)]
    kinds, rest = sum(ends.values()), sum(low[min(n, 3)] for n in ends.values())

    def p(v, w):
        lower = max(ends[w] - low[min(ends[w], 3)], 0) / kinds + rest / kinds / (len(ends) + 1)
        n = pairs.get((v, w), 0)
        return (max(n - high[min(n, 3)], 0) + free[v] * lower) / total[v] if total[v] else lower

    assert abs(sum(p("start", w) for w in ends) + p("start", "unseen") - 1) < 1e-9
    probes = [t for _, t, *_ in rows[:30]] + ["never seen words", "a b c d never"]
    want = [sum(np.log10(p(v, w)) for v, w in zip(["start", *ws], ws, strict=False)) for ws in (words_of(t) + ["end"] for t in probes)]
    assert np.allclose(language_model.score_batch(model, probes)[3], want)


def test_packing(docs, rows):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    got = packing.pack(docs, path, length=256).collect()
    covered, sequences = Counter(), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    times = Counter(r[0] for r in rows)
    assert all(covered[i] == times[i] * len(x) for i, x in ids.items())
    for k, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or k == max(sequences)


def test_encoder_equals_whole_texts():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    own = packing.Encoder(path, 2)
    texts = ["Straße'S don't WE'LL x1y2 <|endoftext|> a<|startoftext|>b É́ «foo», ½a ΣΑΣ \x1c a\x1cb 日本語 İx ẞ!?", "ABC!!! ###def", " ", None]
    for t, found in zip(texts, own(texts), strict=True):
        assert np.frombuffer(found, "<u2").tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_suffix_dedup(docs, rows, heavy):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    strings = Counter(b[i : i + 60] for _, b in texts for i in range(len(b) - 59))
    want = {}
    for i, b in texts:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 59):
            if strings[b[k : k + 60]] > 1:
                mask[k : k + 60] = True
        left = bytes(np.frombuffer(b, np.uint8)[~mask[:-1]])
        want[i] = (len(b), int(mask.sum()), int((mask[1:] < mask[:-1]).sum()), hashlib.sha256(left).hexdigest(), left)
    got = suffix_dedup.remove_repeats(docs, span=60, gram=12, heavy=heavy).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_windows_of_low_periods_are_listed_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 1000)
    texts = [b"a" * 5000, b"ab " * 1000, b"", b"short", bytes(range(256)) * 3]
    batch = suffix_dedup.Anchored(texts, 60, 12)
    blocks = list(suffix_dedup.window_hashes(batch, np.arange(len(batch.place)), 60, 12))
    assert max(len(hashes) for hashes, _, _ in blocks) <= 1000
    starts, owner = (np.concatenate([b[k] for b in blocks]).tolist() for k in (1, 2))
    assert list(zip(owner, starts, strict=True)) == [(k, int(batch.offsets[k]) + i) for k, t in enumerate(texts) for i in range(len(t) - 59)]


def test_anchors_spread_over_buckets():
    batch = suffix_dedup.Anchored([np.random.default_rng(3).integers(97, 123, 200_000, np.uint8).tobytes()])
    share = np.bincount((batch.hash >> np.uint64(60)).astype(np.int64), minlength=16) / len(batch.hash)
    assert len(batch.hash) > 1000 and share.max() < 2 / 16


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_suffix_dedup_nul_bytes_at_ends(spark, heavy):
    rng = random.Random(5)
    middle = "".join(rng.choice("abcdefgh") for _ in range(90))
    nuls = "\0" * 40
    texts = [middle, middle + nuls, nuls + middle, "a" * 3000, "a" * 70]
    strings = Counter(t[i : i + 60] for t in texts for i in range(len(t) - 59))
    want = {k: sum(any(strings[t[i : i + 60]] > 1 for i in range(max(0, j - 59), min(j, len(t) - 60) + 1)) for j in range(len(t))) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, span=60, gram=12, heavy=heavy).collect()} == want


def test_language_id(spark, empty):
    rng = random.Random(1)
    parts = {"aa": ["the", "and", "ing", "wh"], "bb": ["für", "über", "sch", "ung"]}
    data = [(k, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(4, 90))), lang) for k in range(240) for lang in [("aa", "bb")[k % 2]]]
    data += [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "the wh", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_corpus(df).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    right = [got[k].lang_pred == lang for k, _, lang in data[:240] if got[k].held_out]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify_corpus(empty).count() == 0


def test_gradients():
    network = language_id.Network(["a", "b"], 3)
    text, mask, owner = language_id.windows_of([b"hello wor", b"xy", bytes(range(97, 122)) * 9])
    labels = np.array([0, 1, 1])[owner]
    for k in network.p:
        network.p[k] = network.p[k].astype(np.float64)
    _, grads = network.backward(text, mask, labels)
    for name in ("out", "bias", "xf", "xb", "uf", "ub", "cf", "cb"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        step = 1e-3
        network.p[name][at] += step
        up = network.backward(text, mask, labels)[0]
        network.p[name][at] -= 2 * step
        down = network.backward(text, mask, labels)[0]
        network.p[name][at] += step
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name


def test_quality_rules(docs, rows):
    for r in quality_rules.apply_rules(docs).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        ws = [w.decode() for w in (text or "").encode().split()]
        windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {k + d for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if x.split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(ws), len(hit), len(lines) - len(set(lines)), sum(map(len, ws)))
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws)) and not (r.kept and r.base_failed)


def test_quality_classifier(spark, docs):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["word", "other", "thing."]) + rng.choice("abc") for _ in range(80))
    data = [(k, good() if k % 2 else " | ".join("AB###" for _ in range(60))) for k in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify_corpus(df, labels).collect()}
    assert all(got[k].predicted == k % 2 for k in range(120)) and 0 <= got[500].score <= 1
    assert [r.predicted for r in quality_classifier.classify_corpus(df.limit(1), labels.where("false")).collect()] == [1]


def test_licenses(spark):
    texts = ["MIT License. mit  license", "the GNU Lesser General Public License", "# SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0\nx", "spdx-license-identifier: MIT OR", None, "xmit license mit-license"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[:2]] == [(4, 2, 0, 2, "mit"), (6, 1, 3, 3, "gpl")]
    assert got[1].labels == "gpl,lgpl" and got[2].labels == "spdx:apache-2.0,spdx:gpl-2.0,spdx:mit" and got[3].labels == "spdx:invalid"
    assert (got[4].n_words, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0) and got[5].n_base == 1


def test_license_expressions():
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert all(licenses.evaluate(x) is None for x in ("", "and", "mit or", "(mit", "mit)", "mit apache"))
    assert licenses.evaluate("MIT AND GPL-3.0")[1] < licenses.evaluate("MIT OR GPL-3.0")[1] and licenses.evaluate("gpl-2.0 with classpath")[0] == {"gpl-2.0"}


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        ws = words_of(t)
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


def test_jaccard_join(docs, rows, empty):
    sets, want = brute_components(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        common = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 4 * both >= 3 * (len(a) + len(b) - both):
            assert jaccard_join.may_link(jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b), len(a), len(b))
            none = np.zeros(0, np.uint64)
            assert np.intersect1d(jaccard_join.prefix_keys(a, none, none), jaccard_join.prefix_keys(b, none, none)).size


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect())) and mixing.mix(empty).count() == 0
    sizes = defaultdict(int)
    for i, t, _, source, *_ in rows:
        sizes[source] += len(words_of(t))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and share * weight[s] > 3 * sizes[s]}
        if not over:
            target = {s: 3 * sizes[s] if s in full else share * weight[s] for s in order}
            break
        full |= over
    by_id = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        source = by_id[r.doc_id]
        assert r.size == len(words_of(next(t for i, t, *_ in rows if i == r.doc_id))) and r.source_size == sizes[source]
        assert abs(r.target - target[source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and (r.position is None or 0 <= r.position <= 1)
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)


def test_training_stream(docs):
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.mix(once).collect()}
    words = defaultdict(int)
    for r in mixing.training_stream(once).collect():
        words[r.doc_id] += len(words_of(r.text))
    assert all(words[i] == n for i, n in taken.items())


def test_training_stream_repeated_ids(spark):
    data = [(k, f"doc{k} " * (k % 7 + 1), "s") for k in range(20)] + [(None, f"none{k} " * 5, "s") for k in range(12)] + [(7, f"seven{k} " * 9, "t") for k in range(12)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(3)
    size = sum(len(words_of(t)) for _, t, _ in data)
    got = mixing.training_stream(df).collect()
    assert sum(len(words_of(r.text)) for r in got) == size and {r.text.split()[0] for r in got} <= {t.split()[0] for _, t, _ in data}
    passes = Counter((r.doc_id, r.text) for r in got)
    assert max(passes.values()) <= 3


def test_pipeline_mixes_whole_texts(spark, docs, rows):
    import corpus_pipeline

    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    sizes, times = {r[0]: len(words_of(r[1])) for r in rows}, Counter(r[0] for r in rows)
    got = corpus_pipeline.mixed(spark, docs, "").collect()
    assert {r.text for r in got} <= {r[1] for r in rows}
    passes = Counter(r.doc_id for r in got)
    assert any(sizes[i] and taken[i] % sizes[i] for i in sizes)
    assert all(passes[i] == int(taken[i] / sizes[i] + 0.5) for i in sizes if sizes[i] and times[i] == 1)


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    data = [(1, prose(1)), (1, prose(1)), (2, prose(1).upper()), (2, prose(1)), (None, prose(2)), (None, prose(2)), (None, prose(3)), (None, prose(3) + " tail"), (3, prose(4)), (3, prose(4) + " tail"), (5, prose(5)), (None, prose(5)), (6, prose(6)), (None, prose(6) + " tail")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    exact = corpus_pipeline.exact(spark, df, "")
    found = exact.collect()
    assert exact.columns == df.columns and Counter((r.doc_id, r.text.lower()) for r in found) == Counter({(2, prose(1)), (None, prose(2)), (None, prose(3)), (None, prose(3) + " tail"), (3, prose(4)), (3, prose(4) + " tail"), (5, prose(5)), (6, prose(6)), (None, prose(6) + " tail")})
    left = Counter((r.doc_id, r.text.lower().removesuffix(" tail")) for r in corpus_pipeline.near(spark, exact, "").collect())
    assert left == Counter({(2, prose(1)), (None, prose(2)), (None, prose(3)), (3, prose(4)), (5, prose(5)), (6, prose(6))})


def test_empty_tables(empty):
    for df in (exact_dedup.exact_dedup(empty), quality_rules.apply_rules(empty), licenses.scan_licenses(empty), language_model.score_corpus(empty), suffix_dedup.remove_repeats(empty)):
        assert df.count() == 0
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert packing.pack(empty, path).count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    clean = [(i, f"{t} the of and to in is that for it was {i} " + "the end of it " * 2, lang, source, n) for i, t, lang, source, n, *_ in rows if i is not None and t and 30 < len(words_of(t)) < 400]
    clean = list({r[0]: r for r in clean}.values())
    spark.createDataFrame(clean, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    left = seen["exact dedup"].collect()
    _, want = brute_components([(r.doc_id, r.text) for r in left])
    assert {r.doc_id for r in seen["near dedup"].collect()} == set(want.values()) and len(left) > len(set(want.values()))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count() > 0
    assert seen["packing"].agg(F.sum("length")).first()[0] == seen["packing"].groupBy("doc_id", "start", "sequence_id", "offset").agg(F.first("length").alias("n")).agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("few", [True, False])
def test_jaccard_join_by_blocks(spark, monkeypatch, few):
    """A group of near copies about the threshold, in lists of several blocks, with and without delegates."""
    for name, value in (("LARGE", 4 if few else 10**6), ("DELEGATES", 2), ("BLOCK", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(90):
        near = list(base[: rng.randint(75, 90)])
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(len(near))] = f"x{k}"
        texts.append(" ".join(near))
    rows = list(enumerate(texts))
    _, want = brute_components(rows)
    assert 2 < len(set(want.values())) < 80
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_a_pair_is_given_in_its_first_list(spark, tmp_path):
    rows = [(a, g) for g, ids in enumerate([[1, 2, 3], [2, 3], [1, 3, 4], [1, 2, 3, 4]]) for a in ids]
    store = hash_arrays.keep_groups(spark.createDataFrame(rows, "id bigint, gid bigint").repartition(3))
    lists = defaultdict(set)
    for a, g in rows:
        lists[a].add(g)
    pairs = [(a, b, g) for a in lists for b in lists for g in lists[a] & lists[b] if a != b]
    a, b, g = (np.array(x) for x in zip(*pairs, strict=True))
    found = jaccard_join.met_before(store, store, a, b, g.astype(np.uint64))
    assert found.tolist() == [min(lists[a] & lists[b]) < g for a, b, g in pairs]
    os.remove(next(str(p) for p in sorted(Path(store[0].removeprefix("file:")).glob("groups-*.npy")) if "buckets" not in p.name))
    hash_arrays._mapped.clear()
    with pytest.raises(FileNotFoundError):
        hash_arrays.groups_of(store, np.arange(10))


def test_pipeline_with_clashing_columns(spark):
    """Columns named like those that operators add, nulls, empty and repeated rows, and an empty table pass every stage."""
    import corpus_pipeline

    names = ["_id", "kept", "_words", "_row", "row", "_doc", "_position", "n_words", "_size", "component_id", "_keep_text"]
    prose = lambda k: " ".join(["the", "of", "and"] + [f"w{k}x{j}" for j in range(60)])
    data = [(k, prose(k % 6), "en", ["s", None, "t"][k % 3], 1) for k in range(12)] + [(None, None, None, None, None), (3, "", "en", "s", 0), (None, prose(9), None, None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in names:
        df = df.withColumn(name, F.lit(f"own {name}"))
    for docs, sizes in ((df.repartition(3), [13, 7, 7]), (df.where("false"), [0, 0, 0])):
        for (_, stage), size in zip(corpus_pipeline.STAGES, [*sizes, None, None], strict=True):
            before, docs = docs.columns, stage(spark, docs, "")
            rows = docs.collect()
            assert size is None or len(rows) == size
            assert "sequence_id" in docs.columns or docs.columns == before and all(r[n] == f"own {n}" for r in rows for n in names)
            docs = spark.createDataFrame(rows, docs.schema)
        assert (len(rows) > 0) == (sizes[0] > 0)


def test_identifiers_that_are_not_integers(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for operator in (jaccard_join.jaccard_components, suffix_dedup.remove_repeats):
        with pytest.raises(TypeError):
            operator(named)
    got = exact_dedup.exact_dedup(named).collect()
    assert len(got) == docs.count() and language_model.score_corpus(named).count() == len(got) and mixing.mix(named).count() == len(got)


def test_runs_are_merged_in_order(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 6  # other aggregates only list the digests of each run


def test_unique_identifiers_are_keys(spark):
    def keys(ids):
        docs = spark.createDataFrame([(i, "t", k) for k, i in enumerate(ids)], "doc_id int, text string, _row int")
        return [(r._doc.doc_id, r._row) for r in keyed(docs).collect()]

    assert sorted(keys([7, -3, 0])) == [(-3, -3), (0, 0), (7, 7)]
    assert keys([]) == []
    for ids in ([7, 7, 0], [7, None, 0], [None, None]):  # numbered, since identifiers don't tell rows apart
        found = keys(ids)
        assert len({key for _, key in found}) == len(ids) and sorted(map(str, ids)) == sorted(str(i) for i, _ in found)
