"""Search by stretches of rows: the same rows as a scan, from a part of them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweir.operators import query
from logweir.operators.query import FilterSpec
from logweir.operators.search_index import SearchIndex, joined, runs_of, runs_of_stretches
from logweir.session import LogSession


@pytest.fixture(scope="module")
def rows(spark):
    made = random.Random(3)
    out = []
    for f in range(3):
        for k in range(700):
            word = "".join(made.choice("abcÉé") for _ in range(5))
            raw = f"Row {k} {word} of {f}" + ("\n  more Ünder it" if k % 97 == 0 else "")
            out.append((f, k, raw, "Other TÉXT" if k == 350 else f"Row {k} {word} of {f}"))
    out += [(3, 0, "", None), (3, 1, "ab", "ab"), (4, 5000, "far away", "far away")]
    return spark.createDataFrame(out, "file_id int, row_seq bigint, raw string, message string")


@pytest.mark.parametrize("text", ["Row 123 ", "more Ünder", "ünder", "Other TÉXT", "té", "ab", "", "É", "nowhere", "0 a", "\n  mo", "far AWAY", "of 2\n", "row 5"])
def test_same_rows_as_a_scan(rows, text):
    index = SearchIndex.build(rows, 50)
    plain = lambda df: sorted((r.file_id, r.row_seq) for r in df.where(FilterSpec(query=text).condition()).collect())
    assert plain(index.narrowed(rows, text)) == plain(rows)
    index.discard()


def test_stretches_that_cannot_match_are_left_out(rows):
    index = SearchIndex.build(rows, 50)
    assert [tuple(r) for r in index.stretches("other téxt").orderBy("file_id").collect()] == [(0, 7), (1, 7), (2, 7)]
    assert index.stretches("nowhere").count() == 0 and index.stretches("ab") is None
    assert index.narrowed(rows, "far away").count() == 1
    assert runs_of("abab") == ["aba", "bab"]


def test_spans_of_stretches():
    places = [(0, 1), (0, 2), (0, 3), (0, 7), (0, 9), (0, 10), (1, 0), (1, 50)]
    assert joined(places, 9) == [(0, 1, 3), (0, 7, 7), (0, 9, 10), (1, 0, 0), (1, 50, 50)]
    assert joined(places, 4) == [(0, 1, 3), (0, 7, 10), (1, 0, 0), (1, 50, 50)]
    assert joined(places, 3) == [(0, 1, 10), (1, 0, 0), (1, 50, 50)] and joined(places, 1) == [(0, 1, 10), (1, 0, 50)] and joined([], 3) == []


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_wide_spans_find_the_same(rows, monkeypatch, ranges):
    monkeypatch.setattr("logweir.operators.search_index.RANGES", ranges)
    index = SearchIndex.build(rows, 5)
    hit = FilterSpec(query="abc").condition()
    assert index.narrowed(rows, "abc").where(hit).count() == rows.where(hit).count() > 20


def test_many_stretches_fall_back_on_a_scan(rows, monkeypatch):
    monkeypatch.setattr("logweir.operators.search_index.NAMED", 2)
    index = SearchIndex.build(rows, 50)
    assert index.condition("row ") is None and index.narrowed(rows, "row ").count() == rows.count()


def scanned(df):
    """Rows that the plan's scans have given."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        found += leaves.apply(k).metrics().apply("numOutputRows").value()
    return found


def test_a_session_reads_a_fraction(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"2027-03-04T21:{k // 60 % 60:02d}:{k % 60:02d}Z INFO row {k} {'needle' if k == 41_000 else 'straw'}\n" for k in range(60_000)))
    session = LogSession(spark)
    session.add_file(str(path))
    spec = FilterSpec(query="NEEDLE")
    plain = [r.asDict() for r in session.search(spec).collect()]
    session.index_text()
    found = session.search(spec)
    assert [r.asDict() for r in found.collect()] == plain and len(plain) == 1
    assert scanned(found) <= 20_000 < 60_000 == scanned(query.filter_logs(session.logs(), spec))
    assert [r.row_seq for r in session.rows(spec, 0, 10).collect()] == [41_000]
    session.add_text("more.log", "2027-03-04T21:00:00Z INFO another needle\n")
    assert session.search(spec).count() == 2  # by a scan, until it is indexed again
    session.index_text()
    assert session.search(spec).count() == 2 and session.search(spec).where(F.col("file_id") == 1).count() == 1


def test_an_index_is_made_without_an_exchange(spark, rows):
    spark.sparkContext.setJobGroup("index", "index")
    index = SearchIndex.build(rows.union(spark.createDataFrame([(5, 0, None, "only a message")], rows.schema)), 50)
    tracker = spark.sparkContext.statusTracker()
    assert [len(tracker.getJobInfo(k).stageIds) for k in tracker.getJobIdsForGroup("index")] == [1]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in index.stretches("y a mess").collect()] == [(5, 0)]  # a row without raw text
    index.discard()


def test_slices_find_the_same_runs(spark, rows, monkeypatch):
    monkeypatch.setattr("logweir.operators.search_index.SLICE", 40)
    batch = pa.RecordBatch.from_pydict({"file_id": [0, 0, 1], "stretch": [0, 0, 0], "text": [b"abcd" * 20, b"bcda", None], "other": [None, b"abx", b"xy"]}, pa.schema([("file_id", pa.int32()), ("stretch", pa.int64()), ("text", pa.binary()), ("other", pa.binary())]))
    found = {(f, s, r.to_bytes(3)) for out in runs_of_stretches([batch]) for f, s, r in zip(*[c.to_pylist() for c in out.columns], strict=True)}
    assert found == {(0, 0, r) for r in (b"abc", b"bcd", b"cda", b"dab", b"abx")}
