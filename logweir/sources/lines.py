"""Reading text as numbered lines: LF ends a line, up to two CRs before it are dropped, invalid UTF-8 is replaced."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import number_lines

HEAD_CHARS, HEAD_ROWS = 64 * 1024, 2048
#: A local file's path begins with one slash or with three.
LOCAL = "^file:/+"


def clean(value: Column) -> Column:
    return F.make_valid_utf8(F.regexp_replace(value, "\r{1,2}\\z", ""))


def tagged_lines(spark: SparkSession, paths: Sequence[str], first_id: int = 0) -> DataFrame:
    """(file_id, file, part, mid, value): part orders a file's splits, mid rises inside one."""
    out = None
    for k, path in enumerate(paths, first_id):
        one = spark.read.option("lineSep", "\n").text(path).select(
            F.lit(k).alias("file_id"), F.lit(path.rsplit("/", 1)[-1]).alias("file"),
            F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("part"),
            F.monotonically_increasing_id().alias("mid"), clean(F.col("value")).alias("value"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def scanned_lines(spark: SparkSession, paths: Sequence[str], owners: Sequence[tuple[str, int, str]]) -> DataFrame:
    """(file_id, file, part, value) of many files by one scan, in order inside a split. owners: the scan's files with the id and
    the name they go under; they are broadcast, as they come from the caller's own list. Ids are data here, so that generated code is
    the same for whatever files."""
    owned = spark.createDataFrame([*owners], "_path string, file_id int, file string")
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text([*paths]).select(
        F.regexp_replace(path, LOCAL, "file:/").alias("_path"), F.struct(path, start).alias("part"), clean(F.col("value")).alias("value"),
    )
    return lines.join(F.broadcast(owned), "_path").select("file_id", "file", "part", "value")


def read_lines(spark: SparkSession, paths: Sequence[str], first_id: int = 0) -> DataFrame:
    """(file_id, file, part, line_no, value). A byte order mark at a file's start is dropped."""
    numbered = number_lines(tagged_lines(spark, paths, first_id))
    return numbered.withColumn("value", F.when(F.col("line_no") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))


def text_lines(spark: SparkSession, name: str, text: str, file_id: int = 0) -> DataFrame:
    """The same for text in memory."""
    lines = text.removeprefix("﻿").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    rows = [(file_id, name, 0, k, line[:-2] if line.endswith("\r\r") else line.removesuffix("\r")) for k, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "file_id int, file string, part int, line_no bigint, value string")


def file_head(spark: SparkSession, path: str, chars: int = HEAD_CHARS) -> str:
    """The first characters of a file, for telling its shape."""
    return head_and_files(spark, path, chars)[0]


def head_and_files(spark: SparkSession, path: str, chars: int = HEAD_CHARS) -> tuple[str, list[str]]:
    """The first characters of a file or of a folder's files, and the paths that scanned_lines() knows them by. They are read from where the
    first file begins: a job over its splits could give the lines of any of them first."""
    files = spark.read.option("lineSep", "\n").text(path).inputFiles()
    lines: list[str] = []
    for file in sorted(files):  # a folder is read in the order of its files' names; the first may be empty
        lines = first_bytes(spark, file, 4 * chars).decode("utf-8", "replace").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        if lines:
            break
    return "\n".join(lines[:HEAD_ROWS])[:chars].removeprefix("﻿") + ("\n" if lines else ""), [re.sub(LOCAL, "file:/", f) for f in files]


def first_bytes(spark: SparkSession, file: str, most: int) -> bytes:
    """The first bytes of a file, given its URI; of what it holds, if it is compressed."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(spark._jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(most))
    finally:
        stream.close()
