"""The corpus pipeline: each stage works on the documents that the one before has kept.

Documents may have further columns, of any name; they travel in a struct beside what an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from logweir.llm.common import keyed, new_dir, table
from logweir.llm.queries import vocabulary


def only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents of keyed rows whose key is in kept (column _row)."""
    return rows.join(kept, "_row", "left_semi").select("_doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules pass."""
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    return quality_rules.apply_rules(whole, keep=("_doc",)).where("kept").select("_doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier; one row, though identifiers repeat or are null."""
    rows = keyed(docs)
    named = rows.select(F.struct("_doc.doc_id", "_row").alias("_name"), "_doc.text")
    return only(rows, exact_dedup.exact_dedup(named, id="_name", keep="largest").where("kept").select("_name._row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar ones connect, the one with the smallest identifier; one row, though identifiers repeat or are null."""
    rows = keyed(docs)
    found = jaccard_join.jaccard_components(rows.select("_row", "_doc.text"), id="_row").select("_row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    return only(rows, found.join(rows.select("_row", "_doc.doc_id"), "_row").groupBy("component_id").agg(first).select("first._row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The whole documents as often as their source's target has them, in the order of training."""
    return mixing.training_stream(docs, whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]
#: Near duplicates connect over any number of steps and tokens come from a vocabulary file, which SQL cannot express:
#: tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
