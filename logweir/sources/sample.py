"""A built-in incident to try things on: a search index fills its disk, and the edge in front of it answers 503.

Two files as numbered lines, made by Spark from hashes of row numbers, the same on every run: JSON lines of the index's
nodes (with a stack trace) and access lines of the edge, over half an hour. Minutes 0 to 12 are quiet; the disk is
full in minute 14 and cleared in minute 17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2027-03-04 21:30:00 UTC.
BASE_MS = 1_804_195_800_000
MINUTE = 60_000
FULL_MS, CLEARED_MS = BASE_MS + 14 * MINUTE + 2_350, BASE_MS + 17 * MINUTE
NODES = ("shard-a", "shard-b", "shard-c", "crawler", "ranker")
PAGES = ("/find", "/suggest", "/similar/items", "/feeds/new", "/ping")
USUAL = ("segment flushed", "query planned", "synonyms reloaded", "crawl batch stored", "snapshot verified")
FILES = ("index-nodes.log", "edge-access.log")


def chance(salt: int) -> Column:
    """A number from 0 to 1 for each row and salt."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) / 1e6


def pick(salt: int, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(chance(salt) * len(values)).cast("int"))


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def node_lines(spark: SparkSession) -> DataFrame:
    rows = spark.range(1600).withColumn("ms", F.lit(BASE_MS) + F.floor(chance(1) * 30 * MINUTE))
    level = F.when(chance(2) > 0.93, "debug").when(chance(2) > 0.85, "warn").otherwise("info")
    text = F.when(level == "warn", "merge queue is long").when(level == "debug", "filter cache reused").otherwise(pick(4, USUAL))
    line = F.format_string('{"ts":"%s","severity":"%s","component":"%s","message":"%s","docs":%d}', iso(F.col("ms")), level, pick(3, NODES), text, F.floor(chance(5) * 4000))
    usual = rows.select("ms", F.lit(0).alias("place"), line.alias("value"))
    own = lambda level, text: f'{{"ts":"@","severity":"{level}","component":"shard-b","message":"{text}"}}'
    told = [(BASE_MS + m * MINUTE + 12_000, 0, own("warn", f"volume data1 is {61 + 3 * m}% full, reindex still running")) for m in range(8, 13)]
    told += [
        (FULL_MS, 1, "@ ERROR shard-b - java.io.IOException: No space left on device"),
        (FULL_MS, 2, "\tat org.example.index.SegmentWriter.flush(SegmentWriter.java:88)"),
        (FULL_MS, 3, "\tat org.example.index.MergeQueue.drain(MergeQueue.java:207)"),
        (FULL_MS, 4, "\tat org.example.node.Worker.run(Worker.java:33)"),
        (FULL_MS + 700, 0, own("error", "shard is read-only, queries are refused")),
        (CLEARED_MS - 20_000, 0, own("warn", "old segments are being deleted")),
        (CLEARED_MS, 0, own("info", "volume data1 is 54% full, shard accepts writes")),
    ]
    story = spark.createDataFrame(told, "ms bigint, place int, value string").withColumn("value", F.replace("value", F.lit("@"), iso(F.col("ms"))))
    return usual.union(story).withColumn("file_id", F.lit(0)).withColumn("file", F.lit(FILES[0]))


def edge_lines(spark: SparkSession) -> DataFrame:
    rows = spark.range(1400).withColumn("ms", F.lit(BASE_MS) + F.floor(chance(11) * 30 * MINUTE))
    refused = F.col("ms").between(FULL_MS + 1_000, CLEARED_MS)
    page = pick(12, PAGES)
    status = F.when(refused & (page != "/ping") & (chance(13) > 0.2), 503).when(chance(13) > 0.98, 410).otherwise(200)
    line = F.format_string(
        '198.51.100.%d - - [%s +0000] "GET %s?q=%d HTTP/2" %d %d "-" "sample/1.0"',
        F.floor(1 + chance(14) * 250), F.date_format(F.timestamp_millis(F.col("ms")), "dd/MMM/yyyy:HH:mm:ss"), page, F.floor(chance(15) * 500), status, F.floor(chance(16) * 3000),
    )
    return rows.select("ms", F.lit(0).alias("place"), line.alias("value")).withColumn("file_id", F.lit(1)).withColumn("file", F.lit(FILES[1]))


def sample_lines(spark: SparkSession) -> DataFrame:
    """(file_id, file, part, line_no, value) of both files."""
    both = node_lines(spark).unionByName(edge_lines(spark))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("ms", "place", "value")).cast("bigint")
    return both.select("file_id", "file", F.lit(0).alias("part"), place.alias("line_no"), "value")
