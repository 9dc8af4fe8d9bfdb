"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all run in one process (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logweir-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/logweir/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: its plan ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: So many splits for each core are dealt evenly enough.
SPLITS = 4


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits for the session's cores, dealt evenly, for work that is heavy for each row; others are left as they are. Splits are
    parts of files by bytes, but rows come with row groups, of which a large file may have one: most of its splits are then empty."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(SPLITS * cores) if df.rdd.getNumPartitions() < SPLITS * cores else df


def discard(spark: SparkSession, *made: DataFrame | str) -> None:
    """Deletes tables of cut() or folders that nothing will read again."""
    for one in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(one if isinstance(one, str) else one.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
