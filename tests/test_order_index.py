"""Places, pages and seeks by the order index, against sorted lists."""

import random

import pytest

from logweir.operators.query import display_index


def rows_of(rng, n):
    return [(rng.randrange(3), k, rng.choice([None, rng.randrange(40) * 1000]), f"m{k}") for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_places_pages_and_seeks(spark, n):
    rng = random.Random(n)
    data = rows_of(rng, n)
    want = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))
    index = display_index(spark.createDataFrame(data, "file_id int, row_seq bigint, eff_ts bigint, message string").repartition(7))
    assert index.count == n
    assert [(r.place, r.message) for r in index.places().orderBy("place").collect()] == [(k, r[3]) for k, r in enumerate(want)]
    for start, stop in ((0, 10), (140, 161), (-5, 3), (n - 2, n + 50), (9, 4), (n, n + 1)):
        assert [r.message for r in index.slice(start, stop).collect()] == [r[3] for r in want[max(start, 0) : max(stop, 0)]]
    for ms in (-1, 0, 500, 20_000, 39_000, 90_000):
        assert index.position("eff_ts", ms) == sum(r[2] is None or r[2] < ms for r in want)


def test_a_page_reads_one_range(spark):
    data = [(0, k, k * 10, f"m{k}") for k in range(2000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = display_index(spark.createDataFrame(data, "file_id int, row_seq bigint, eff_ts bigint, message string"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(index.stretches) > 2
    page = index.slice(1200, 1210)
    assert [r.message for r in page.collect()] == [f"m{k}" for k in range(1200, 1210)]
    assert len(page.inputFiles()) == 1 and index.range_of(1200) == next(k for k, s in enumerate(index.stretches) if s.before <= 1200 < s.before + s.rows)
    index.discard()
