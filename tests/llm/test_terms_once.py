"""Terms are made once for each text, also where Spark would infer filters from them."""

from pyspark.sql import functions as F

from logweir.llm.lexical_search import places


def test_terms_are_made_once(spark):
    docs = spark.createDataFrame([(1, "One two, one"), (2, "... "), (3, None), (4, "")], "_row bigint, text string")
    found = places(docs.repartition(2, "_row"), "text")
    assert sorted(map(tuple, found.collect())) == [(1, 3, "one"), (1, 3, "one"), (1, 3, "two")]
    plan = found.groupBy("_row", "n", "term").agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
