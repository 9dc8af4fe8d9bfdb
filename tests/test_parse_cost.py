"""What parsing costs for each line: plans and patterns that stay small."""

import time

from pyspark.sql import functions as F

from logweir.operators import delimited
from logweir.operators.parsers import METHOD_BYTES, configure, with_line_record


def test_records_of_many_quotes_take_one_pass(spark):
    """Putting a field together quote by quote took the square of its length."""
    field = 'a""' * 300_000
    raw = [(0, f'"{field}";b;"c;d"'), (1, f'"{field}')]
    df = spark.createDataFrame(raw, "k int, v string")
    start = time.monotonic()
    cells, opened = delimited.record_cells(F.col("v"), ";"), [delimited.open_after(F.col("v"), ";", quoted) for quoted in (False, True)]
    got = df.select("k", cells.alias("cells"), F.array(*opened).alias("opened")).orderBy("k").collect()
    value = 'a"' * 300_000
    assert [(r.cells, r.opened) for r in got] == [([value, "b", "c;d"], [0, 0]), ([value], [1, 0])]
    assert time.monotonic() - start < 30


def test_generated_methods_are_compiled(spark):
    """The JVM interprets methods above METHOD_BYTES, which a chain of projections in one method was."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == METHOD_BYTES == 8000


def test_a_line_takes_few_projections(spark):
    """Each copies the row; a time's layouts had one for each."""
    configure(spark)
    df = spark.range(1).select(F.concat(F.lit("at "), F.col("id").cast("string")).alias("line"))
    plan = with_line_record(df, F.col("line"), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") <= 24
