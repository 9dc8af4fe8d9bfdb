"""Places in an order over all rows, and slices of it, without a task that holds all rows.

Rows are written once in ranges of the order, each range sorted by a task of its own. What is kept beside them is one
line for each written file: how many rows it has, how many stand before it, and its first and last order value. A row's
place is then its file's rows before plus its own number in it, and a slice or a seek opens the files that it falls in.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..work import cut, discard

AT = "_at"


@dataclass(frozen=True)
class Stretch:
    """A file of neighbouring rows: `before` rows of the order stand before its first, whose number is `first`."""

    path: str
    first: int
    rows: int
    before: int
    low: object
    high: object


class OrderIndex:
    """Rows in an order, written in ranges; build() makes one."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, stretches: list[Stretch]):
        self.spark, self.path, self.schema, self.stretches = spark, path, schema, stretches
        self.count = sum(s.rows for s in stretches)

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[Column], clock: str) -> OrderIndex:
        """order: the order's columns, which together should tell rows apart. clock: the column that leads it, nulls first.

        Rows that agree in all of order's columns come next to each other, in one range."""
        spark = df.sparkSession
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        # a task's number, then the row's number in its task: these rise along the order
        rows = cut(ranged.withColumn(AT, F.monotonically_increasing_id()), "order")
        ends = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min(AT).alias("first"), F.count(F.lit(1)).alias("rows"), F.min_by(clock, AT).alias("low"), F.max_by(clock, AT).alias("high"),
        )
        stretches, before = [], 0
        for r in sorted(ends.collect(), key=lambda r: r.first):  # a line for each written file
            stretches.append(Stretch(r.path, r.first, r.rows, before, r.low, r.high))
            before += r.rows
        return cls(spark, rows.written_to, rows.schema, stretches)

    def _read(self, some: list[Stretch]) -> DataFrame:
        """The rows of some files, with their place."""
        if not some:
            return self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField("place", T.LongType())])).drop(AT)
        rows = self.spark.read.schema(self.schema).parquet(*[s.path for s in some])
        if len(some) == len(self.stretches) and len(some) > 64:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        # a number's upper bits are the task's; the steps between tasks are as many as there are files
        offsets = self.spark.createDataFrame([(s.first, s.before) for s in some], "_first bigint, _before bigint").withColumn("_task", F.shiftright("_first", 33))
        near = offsets.groupBy("_task").agg(F.min(F.col("_before") - F.col("_first")).alias("_shift"))
        return rows.withColumn("_task", F.shiftright(AT, 33)).join(F.broadcast(near), "_task").withColumn("place", F.col(AT) + F.col("_shift")).drop("_task", "_shift", AT)

    def places(self) -> DataFrame:
        """All rows with their place, from 0."""
        return self._read(self.stretches)

    def slice(self, start: int, stop: int) -> DataFrame:
        """The rows from place start to stop (excluded), in order; only files that have some of them are read."""
        start, stop = max(start, 0), min(stop, self.count)
        some = [s for s in self.stretches if s.before < stop and s.before + s.rows > start] if start < stop else []
        return self._read(some).where((F.col("place") >= start) & (F.col("place") < stop)).orderBy("place")

    def position(self, clock: str, value) -> int:
        """How many rows stand before the first whose clock is value or later; null clocks come first. Reads one range, or none."""
        found, open_ones = 0, []
        for s in self.stretches:
            if s.high is None or s.high < value:
                found += s.rows
            elif s.low is None or s.low < value:
                open_ones.append(s)
        if open_ones:
            rows = self.spark.read.schema(self.schema).parquet(*[s.path for s in open_ones])
            found += rows.where(F.col(clock).isNull() | (F.col(clock) < F.lit(value))).count()
        return found

    def range_of(self, place: int) -> int:
        """Which file holds a place."""
        return bisect_right([s.before for s in self.stretches], place) - 1

    def discard(self) -> None:
        """Deletes the written rows."""
        discard(self.spark, self.path)
