"""Lexical search, Merkle manifest and web archive, against brute force, SQL and round trips."""

import base64
import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweir.llm import lexical_search, merkle, queries, web_archive
from logweir.work import new_dir

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "  \n", "The the THE", "Été É 3x, 3X", "a" * 30_000 + " the end", "the\nend of\nthe end\n", "the\nend of\nthe end\n"]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_merkle_manifest", "op13_web_archive"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())


# --- lexical search -----------------------------------------------------------------------------


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute_search(docs, items, top):
    counted = [(d, k, Counter(terms(t))) for k, (d, t) in enumerate(docs)]
    counted = [(d, k, c, sum(c.values())) for d, k, c in counted if c]
    n_docs, n_terms, df, out = len(counted), sum(x[3] for x in counted), Counter(w for x in counted for w in x[2]), []
    for item, text in items:
        scores = []
        for d, k, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in Counter(terms(text)).items() if w in c)
            scores += [(-score, d is not None, d or 0, k)] if score > 0 else []
        out += [(item, r, s[2] if s[1] else None, -s[0]) for r, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ids", ["own", "repeated"])
def test_search_odd_rows(spark, ids):
    texts = [*ODD, *[f"word{k % 7} the common {'rare ' * (k % 3)}term" for k in range(40)]]
    docs = [(k if ids == "own" else [None, 5, k][k % 3], t) for k, t in enumerate(texts)]
    items = [(1, "the rare term"), (1, "word3 word3"), (None, "É 3x"), (4, None), (5, "nothing like it"), (6, "the " * 50)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, term string, n int")
    got = lexical_search.rank_documents(frame, spark.createDataFrame(items, "item_id int, text string"), top=9)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 9)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("postings_")]


def test_search_without_broadcast_and_empty(spark, monkeypatch):
    docs, items = [(k, f"a{k % 3} b c{k % 5}") for k in range(30)], [(k, f"a{k} c{k} b") for k in range(4)]
    frame, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, lexical_search.rank_documents(frame, asked, 5).collect()), key=repr) == brute_search(docs, items, 5)
    assert lexical_search.rank_documents(frame.limit(0), asked).collect() == [] == lexical_search.rank_documents(frame, asked.limit(0)).collect()


def test_scores_are_summed_without_an_exchange(spark):
    """Of the postings, only the best of each deal are exchanged."""
    docs = spark.range(200).select(F.col("id").alias("_row"), F.concat(F.lit("the word"), F.col("id").cast("string")).alias("text"))
    postings = lexical_search.Postings(docs, "text")
    items = spark.createDataFrame([(1, "the word7")], "_item bigint, text string")
    plan = lexical_search.search(postings, items, 3, [F.col("_row").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and len(re.findall(r"Exchange hashpartitioning\((_item|_row)", plan)) == 1
    postings.drop()


# --- Merkle manifest ----------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in doc))


def root_and_paths(nodes):
    """The root over a list of nodes, and each node's siblings from the lowest level upwards."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
    root, above = root_and_paths([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1 :])), *above[j]] for j, r in enumerate(runs) for k in range(len(r))]


def brute_manifest(docs):
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    mine = {s: sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))) for s in sources}
    made = {s: root_and_paths([leaf(d) for d in mine[s]]) for s in sources}
    root, tops = root_and_paths([made[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for doc, path in zip(mine[s], made[s][1], strict=True):
            cut = doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 2 == 0 and doc[4] is not None
            held = leaf((*doc[:4], doc[4].replace("\n", ""))) if cut else leaf(doc)
            for before, after in path + top:
                held = sha(before + held + after)
            out.append((doc[0], leaf(doc), made[s][0], root, sha("".join(b + a for b, a in path + top)), held, held == root))
    return sorted(out, key=repr)


def manifest_of(spark, docs):
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, _group string")
    return sorted(map(tuple, merkle.merkle_manifest(frame).collect()), key=repr)


def test_manifest_of_hot_null_and_single_groups(spark):
    docs = [(k, "hot" if k % 3 else None if k % 2 else f"s{k % 5}é", ["en", None][k % 2], k * 7, ODD[k % len(ODD)]) for k in range(130)]
    docs += [(None, "hot", None, None, None), (None, "hot", None, None, "b\n"), (7, "hot", "en", 49, "twice\n"), (7, "hot", "en", 49, "twice\n"), (500, "", None, None, ""), (501, "lone", "", 0, "\n")]
    got = manifest_of(spark, docs)
    assert got == brute_manifest(docs) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 28])
def test_manifest_of_one_group(spark, n):
    docs = [(k, "s", "en", k, f"line\n{k}") for k in range(n)]
    assert manifest_of(spark, docs) == (brute_manifest(docs) if n else [])


def test_paths_lead_to_the_root(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    made = merkle.build_manifest(docs)
    assert made.where(merkle.fold_path(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty() and made.select("root").distinct().count() == 1
    assert made.where(F.size("path") != 4).isEmpty()


# --- web archive --------------------------------------------------------------------------------


def brute_archive(pages, least=0):
    out = []
    top = {}
    for key, (p, _, h) in enumerate(pages):
        rank = (p is not None, p or 0, key)
        top[h or ""] = max(top.get(h or "", rank), rank)
    for key, (p, _, h) in enumerate(pages):
        raw, best = (h or "").encode(), top[h or ""]
        own = best[2] == key or len(raw) < least
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own or not best[0] else best[1]))
    return sorted(out, key=repr)


def read_warc(data):
    """Records of WARC bytes, by their declared lengths: headers and block."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:] if line)
        size = int(headers["Content-Length"])
        assert data[at:].startswith(b"WARC/1.1\r\n") and data[end + size : end + size + 4] == b"\r\n\r\n"
        out.append((headers, data[end : end + size]))
        at = end + size + 4
    return out


PAGES = [(k, f"http://h/{k % 4}", ["<p>copy</p>", None, "", f"own {k}\r\n\r\nWARC/1.1\r\n", "é" * k][k % 5]) for k in range(60)]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, tmp_path, least):
    pages = [*PAGES, (60, None, "x" * 200_000), (61, "http://h/a b\r\nX: y", "<p>copy</p>")]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, digest string, bytes int")
    folder = web_archive.write_archive(frame, new_dir(spark, "archive"), least=least)
    assert sorted(map(tuple, web_archive.read_archive(spark, folder).collect()), key=repr) == brute_archive(pages, least)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in pages})
    web_archive.export_warc(spark, folder, str(tmp_path / "warc"))
    found = [r for f in glob.glob(f"{tmp_path}/warc/part-*") for r in read_warc(open(f, "rb").read())]
    assert len(found) == len(pages) and len({h["WARC-Record-ID"] for h, _ in found}) == len(pages)
    by_id = {p: (h or "").encode() for p, _, h in pages}
    for headers, block in found:
        http, payload = block.split(b"\r\n\r\n", 1)
        page = by_id[int(headers["WARC-Record-ID"].split(":")[2])]
        assert f"Content-Length: {len(page)}".encode() in http and headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
        assert payload == (page if headers["WARC-Type"] == "response" else b"")
    whole = [r.record for r in web_archive.records(spark, folder, whole=True).collect()]
    assert len(whole) == len(pages) and sum(r.endswith("<p>copy</p>") for r in whole) == 13


def test_archive_of_null_and_repeated_pages(spark):
    pages = [(None, "u", "a"), (None, "u", "a"), (3, "u", "a"), (3, "u", "a"), (None, None, "b"), (None, None, "b")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = sorted(map(tuple, web_archive.archive_pages(frame).collect()), key=repr)
    assert got == brute_archive(pages) and sum(r[3] == "response" for r in got) == 2
    assert web_archive.archive_pages(frame.limit(0)).collect() == []


def test_damaged_payloads_are_told(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    folder = web_archive.write_archive(frame, new_dir(spark, "archive"))
    stored = [tuple(r) for r in spark.read.parquet(f"{folder}/payloads").collect()]
    spark.createDataFrame([(d, p + "!" if k == 3 else p) for k, (d, p) in enumerate(stored)], "digest string, payload string").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="has not the SHA-256"):
        web_archive.read_archive(spark, folder).collect()
