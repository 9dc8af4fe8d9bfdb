"""Questions of a session: one pass snapshots against the separate answers, superseding, progress, pages, look-up by id."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from logweir import session as sessions
from logweir.operators import query, rows
from logweir.operators.query import FilterSpec
from logweir.session import LogSession, Superseded


@pytest.fixture(scope="module")
def log_file(tmp_path_factory):
    lines = []
    for k in range(600):
        stamp = f"2027-03-04T{21 + k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}Z"
        lines.append(f'{{"time":"{stamp}","level":"{("error", "warn", "info")[k % 3]}","service":"s{k % 7}","msg":"row {k}"}}' if k % 5 else f"{stamp} WARN [pool-{k % 4}] plain {k}")
        if k % 50 == 0:
            lines.append("\tat some.place")
    path = tmp_path_factory.mktemp("logs") / "app.log"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def session(spark, log_file):
    out = LogSession(spark, max_services=9)
    out.add_file(log_file)
    out.add_text("b.csv", "time,level,message\n2027-03-04T21:03:00Z,error,one\n2027-03-04T21:01:00Z,info,\"two\nlines\"\n")
    return out


@pytest.mark.parametrize("spec", [FilterSpec(), FilterSpec(levels=frozenset({0}), query="row 1"), FilterSpec(query="nowhere")])
def test_snapshot_equals_separate_answers(session, spec):
    logs, got = session.logs(), session.query(spec)
    plain = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]
    assert got.count == query.filter_logs(logs, spec).count() and got.total_rows == logs.count() == 602
    assert got.approx_bytes == rows.approx_bytes(logs).first().bytes
    assert got.levels == plain(query.facet_levels(logs), "level")
    assert got.services == [r.asDict() for r in query.facet_services(logs).collect()]
    assert got.files == plain(rows.file_stats(logs), "file_id")
    assert got.histogram == plain(query.histogram(logs, spec), "bucket")


def test_a_question_is_one_job_beside_the_totals(spark, session):
    session.query()
    group = "count-jobs"
    spark.sparkContext.setJobGroup(group, "")
    session.query(FilterSpec(levels=frozenset({1})))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    executions = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert 1 <= len(executions) <= 3  # stages of one adaptive execution are jobs of their own


def test_pages_and_seeks_by_the_index(session, monkeypatch):
    spec = FilterSpec(levels=frozenset({0, 1}))
    want = session.rows(spec, 0, 9999).collect()
    monkeypatch.setattr(sessions, "SHALLOW", 0)
    for start, stop in ((0, 5), (200, 230), (len(want) - 3, len(want) + 9)):
        assert session.rows(spec, start, stop).collect() == want[start:stop]
    assert session._index[0] == spec
    for ms in (want[100].ts_ms, 0, 10**15):
        assert session.position_for_time(spec, ms) == query.position_for_time(session.logs(), spec, ms).first().position


def test_rows_by_id(session):
    for r in session.logs().where("row_id IN (0, 1, 299, 599, 600, 601)").collect():
        found = session.detail(r.row_id)
        assert found["full_text"] == r.raw and session.row(r.row_id).first().asDict() == {c: r[c] for c in session.row(r.row_id).columns}
    assert session.detail(601)["fields"] == {"time": "2027-03-04T21:01:00Z", "level": "info", "message": "two\nlines"}
    assert session.detail(602) is None and session.detail(-1) is None
    plan = session.row(5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(row_seq), EqualTo(row_seq,5)]" in plan and plan.count("FileScan") == 1


def test_services_beyond_the_cap(session):
    kept = {r.service for r in session.logs().select("service").distinct().collect()} - {None}
    assert len(kept) == 9 and kept == {r.service for r in rows.first_services(session.spark.read.schema(sessions.ROW_SCHEMA).parquet(*[f.table for f in session.files]), 9).collect()}


def test_progress_of_a_file(spark, log_file):
    told = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        LogSession(spark).add_file(log_file, on_progress=lambda done, size: told.append((done, size)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert told == sorted(told) and told[-1][0] == told[-1][1] == len(open(log_file, "rb").read())
    with pytest.raises(ValueError, match="stop"):
        LogSession(spark).add_file(log_file, on_progress=lambda *_: (_ for _ in ()).throw(ValueError("stop")))


def test_a_question_ends_the_one_before(spark, log_file, monkeypatch):
    session = LogSession(spark)
    session.add_file(log_file)
    session.query()

    class Slow(FilterSpec):
        def condition(self):
            return F.expr("coalesce(reflect('java.lang.Thread', 'sleep', bigint(level * 0 + 400)), 'slept') <> raw")

    out = {}

    def ask():
        began = time.time()
        try:
            out["answer"] = session.query(Slow())
        except Superseded as problem:
            out["problem"] = problem
        out["took"] = time.time() - began

    thread = threading.Thread(target=ask)
    thread.start()
    deadline = time.time() + 30
    while not spark.sparkContext.statusTracker().getActiveStageIds() and time.time() < deadline:
        time.sleep(0.1)
    assert session.query(FilterSpec(levels=frozenset({0}))).count > 0
    thread.join(60)
    # the slow question sleeps for 600 rows of 0.4 s
    assert "problem" in out and out["took"] < 60
