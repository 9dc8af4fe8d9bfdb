"""Exact dedup: a tree merge of sorted digest runs.

Documents are dealt to runs by a hash of their identifier. Each run is sorted by digest and reduced to one row per
digest with the identifier that stays and a count. In each round, `fan_in` neighbouring runs (run div fan_in) are
exchanged and merged in digest order: the merge reads sorted rows and joins neighbours with one digest, until a single
run is left. (The identifier that stays is kept in a struct, for which Spark aggregates in sorted order and not by
hash tables.) Its rows then go back down: to the rows of the first runs (a digest has at most one in each run) and
from there to the documents. No step brings more than a run's share of one digest together, so a group that holds a
third of all rows is merged and labelled by many tasks.

A key is the SHA-256 digest with the text's length and a second, independent hash: each merge verifies all three
before an identifier is given up, and no text is exchanged. Only DataFrame functions are used.

Null texts count as empty. Texts that differ only in the case of A-Z are equal. Null identifiers never win against
others; a group of nothing but null identifiers keeps null. Rows that repeat an identifier and its text are all kept
or all dropped. An empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

KEY = ["_sha", "_bytes", "_check"]


def digests(docs: DataFrame, text: str = "text", id: str = "doc_id", runs: int = 64) -> DataFrame:
    """One narrow row per document: its identifier, run and verified digest key."""
    return (
        docs.select(F.col(id).alias("_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_norm"))
        .select(
            "_id",
            F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("int").alias("_run"),
            F.unhex(F.sha2(F.encode("_norm", "UTF-8"), 256)).alias("_sha"),
            F.octet_length("_norm").alias("_bytes"),
            F.xxhash64("_norm").alias("_check"),
        )
    )


def merged(runs: DataFrame, best) -> DataFrame:
    """Rows of one digest in one run become one. The struct makes this a merge of rows sorted by run and digest."""
    return runs.groupBy("_run", *KEY).agg(best("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest", fan_in: int = 4, runs: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. keep: whether the smallest or largest identifier of a group stays."""
    best, rank = {"smallest": (F.min, F.col("_id").isNull()), "largest": (F.max, F.col("_id").isNotNull())}[keep]
    rows = cut(digests(docs, text, id, runs), "digests")
    first = merged(rows.select("_run", *KEY, F.struct(rank.alias("rank"), F.col("_id").alias("id")).alias("_keep"), F.lit(1).cast("bigint").alias("_n")), best)
    level, left = first, runs
    while left > 1:
        level = merged(level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")), best)
        left = -(-left // fan_in)
    root = level.select(*KEY, F.col("_keep.id").alias("_win"), F.col("_n").alias("_size"))
    labelled = first.select("_run", *KEY).join(root, KEY)
    return rows.join(labelled, ["_run", *KEY]).select(
        F.col("_id").alias(id),
        F.col("_win").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_win")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
