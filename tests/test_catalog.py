"""Every registered log query against its oracle on the smallest tables."""

import glob
import os

import pytest

from logweir.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())


def test_display_formats_reads_whole_texts(spark, tmp_path):
    texts = ["x" * 250 + "The end", "The start", "y" * 900, "é" * 300 + "tHe", ""]
    spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.before, r.hit) for r in QUERIES["display_formats"](spark, str(tmp_path)).collect()}
    places = [t.lower().find("th") for t in texts]
    assert got == {k: (len(t), "") if at < 0 else (at, t[at : at + 2]) for k, (t, at) in enumerate(zip(texts, places, strict=True))}
