"""Scans of few splits."""

from pyspark.sql import functions as F

from logweir.work import spread


def test_one_row_group_in_many_splits_is_dealt_to_all_tasks(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(20_000).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # of which one has all rows
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 1
        dealt = spread(df).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(dealt) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in dealt) <= 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
