"""A stream over a growing folder gives the rows that reading the whole logs does."""

import random

import pytest
from pyspark.sql import functions as F

from logweir.operators.rows import build_logs
from logweir.streaming import tail

NOW = 1_800_000_000_000


def parts_of(rng):
    lines = ["2027-03-04T21:30:05Z ERROR [a] first"] + [
        rng.choice([f"2027-03-04T21:{rng.randrange(60):02d}:00Z INFO [svc-{k % 3}] row {k}", f'{{"msg":"json {k}","level":"warn"}}', "\tat some.place", "", f"plain é {k}", "x" * 40]) for k in range(150)
    ]
    cuts = sorted(rng.sample(range(1, 150), 2))
    return lines, [lines[a:b] for a, b in zip([0, *cuts], [*cuts, None], strict=True)]


def batch_rows(spark, logs, most):
    from logweir.operators import rows
    from logweir.operators.parsers import with_line_record

    data = [(k, name, i // 9, i + 1, x) for k, (name, lines) in enumerate(sorted(logs.items())) for i, x in enumerate(lines)]
    df = spark.createDataFrame(data, "file_id int, file string, part int, line_no bigint, value string")
    made = rows.with_effective_time(with_line_record(rows.fold(df, most=most), F.col("text"), NOW))
    return sorted(tuple(r) for r in made.select("file", "row_seq", "line_no", "kind", "ts_ms", "eff_ts", "level", "service", "message", "raw", "folded").collect())


@pytest.mark.parametrize("most", [90])
def test_rows_fold_across_batches_and_a_restart(spark, tmp_path, most):
    rng = random.Random(most)
    logs = {}
    made = {name: parts_of(rng) for name in ("app.log", "edge.log")}
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    tail.configure_state(spark)
    (tmp_path / "in").mkdir()
    try:
        for step in range(3):
            for name, (lines, parts) in made.items():
                (tmp_path / "in" / f"{name}-{step:04d}").write_text("".join(x + "\n" for x in parts[step]))
                logs[name] = lines
            if step != 1:  # a query of its own each time, from the checkpoint that the last one left
                rows = tail.folded(tail.tail_lines(spark, str(tmp_path / "in"), files_per_trigger=10), NOW, most)
                rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.read.schema(tail.LOG_ROW).parquet(str(tmp_path / "out")).collect())
    want = batch_rows(spark, logs, most)
    ends = {name: max(r[1] for r in want if r[0] == name) for name in logs}
    assert got == [r for r in want if r[1] < ends[r[0]]] and len(got) > 100


def test_live_histogram_counts_by_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(f"2027-03-04T21:{m:02d}:30Z {w} [x] y" for m, w in ((1, "ERROR"), (1, "INFO"), (1, "ERROR"), (2, "WARN"))) + "\n")
    (tmp_path / "in" / "b.log").write_text("2027-03-04T22:30:00Z INFO [x] later\n")
    counts = tail.live_histogram(tail.parsed(tail.tail_lines(spark, str(tmp_path / "in"), 1), NOW))
    counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    got = sorted((r.window.start.minute, r.level, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, 2), (1, 2, 1), (2, 1, 1)]


def test_batch_rows_are_those_of_build_logs(spark):
    lines = ["2027-03-04T21:30:05Z ERROR [a] first", "\tat x", "second"]
    df = spark.createDataFrame([(0, "f", 0, i + 1, x) for i, x in enumerate(lines)], "file_id int, file string, part int, line_no bigint, value string")
    assert [(r.raw, r.folded) for r in build_logs(df, NOW).orderBy("row_seq").collect()] == [("\n".join(lines[:2]), 1), ("second", 0)]
