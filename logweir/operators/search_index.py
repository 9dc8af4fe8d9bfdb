"""Substring search that reads only the stretches of rows that can hold a text.

Rows are numbered in stretches of equal length inside each file. For every stretch the index has the runs of three
bytes (of UTF-8) that its searchable texts contain. Each task writes those of its rows, sorted by run, so that nothing is exchanged and the
Parquet reader finds a run's stretches by the statistics of a few row groups of each part. A text that holds a needle holds all of its runs:
stretches that lack one are never read, and the rows of the others are tested again, so that what is found is what a scan would find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_ascii
from ..work import cut, discard

RUN = 3
#: Rows of a stretch; as many stretches as a question names, above which all rows are read; as many ranges as its condition has.
STRETCH, NAMED, RANGES = 1024, 2000, 128
#: Bytes of text whose runs are sought at a time.
SLICE = 2 << 20


def runs_in(texts: pa.Array, owner: np.ndarray) -> np.ndarray:
    """The runs of each binary text with its owner, each once: owner << 24 | run. Null texts have none."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] - ends[0] < RUN:
        return np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    runs = owner[text[:-2]] << 24 | data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return np.unique(runs[text[:-2] == text[2:]])


def runs_of_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over file_id, stretch and two binary texts of rows: the stretches' runs, from SLICE bytes or one row at a time. A stretch that several
    slices have rows of may have a run more than once."""
    for batch in batches:
        sizes = sum(np.nan_to_num(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(float)) for c in ("text", "other"))
        slices = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1, append=-1))
        for a, b in zip(slices[:-1], slices[1:], strict=True):
            some = batch.slice(a, b - a)
            files, stretches = (some.column(c).to_numpy(zero_copy_only=False) for c in ("file_id", "stretch"))
            heads = np.concatenate([[0], np.flatnonzero((files[1:] != files[:-1]) | (stretches[1:] != stretches[:-1])) + 1])
            owner = np.repeat(np.arange(len(heads)), np.diff(heads, append=b - a))
            found = np.unique(np.concatenate([runs_in(some.column(c), owner) for c in ("text", "other")]))
            at = heads[found >> 24]
            yield pa.record_batch([pa.array(files[at]), pa.array(stretches[at]), pa.array((found & 0xFFFFFF).astype(np.int32))], ["file_id", "stretch", "run"])


def runs_of(needle: str) -> list[str]:
    """The needle's runs, a character for each byte."""
    data = needle.encode().decode("latin-1")
    return sorted({data[k : k + RUN] for k in range(len(data) - RUN + 1)})


class SearchIndex:
    """The runs of each stretch of rows; build() makes one. rows have file_id and row_seq."""

    def __init__(self, spark: SparkSession, path: str, schema, stretch: int):
        self.spark, self.path, self.schema, self.stretch = spark, path, schema, stretch

    @classmethod
    def build(cls, rows: DataFrame, stretch: int = STRETCH) -> SearchIndex:
        """rows: file_id, row_seq, raw and message, which query.text_match() searches."""
        at = F.floor(F.col("row_seq") / stretch).cast("bigint").alias("stretch")
        first = F.substring_index(F.col("raw"), "\n", 1)
        other = F.when(~F.col("message").eqNullSafe(first), F.lower("message"))
        texts = rows.select("file_id", at, fold_ascii(F.col("raw")).cast("binary").alias("text"), other.cast("binary").alias("other"))
        found = texts.mapInArrow(runs_of_stretches, "file_id int, stretch bigint, run int")
        index = cut(found.sortWithinPartitions("run"), "runs")
        return cls(rows.sparkSession, index.written_to, index.schema, stretch)

    def stretches(self, needle: str) -> DataFrame | None:
        """(file_id, stretch) of all stretches that have every run of a needle in lower case; None for a needle too short to tell."""
        runs = runs_of(needle)
        if not runs:
            return None
        index = self.spark.read.schema(self.schema).parquet(self.path)
        codes = [int.from_bytes(r.encode("latin-1")) for r in runs]
        return index.where(F.col("run").isin(*codes)).groupBy("file_id", "stretch").agg(F.count_distinct("run").alias("n")).where(F.col("n") == len(runs)).select("file_id", "stretch")

    def condition(self, needle: str) -> Column | None:
        """Which rows can hold a needle, as ranges of row_seq that are pushed into the scan; None if all rows have to be read."""
        found = self.stretches(needle)
        some = found.limit(NAMED + 1).collect() if found is not None else None  # NAMED bounds what comes to the driver
        if some is None or len(some) > NAMED:
            return None
        spans = joined(sorted((r.file_id, r.stretch) for r in some), RANGES)
        files = sorted({file_id for file_id, _, _ in spans})
        if len(spans) > RANGES:
            return F.col("file_id").isin(*files)
        at = lambda low, high: (F.col("row_seq") >= low * self.stretch) & (F.col("row_seq") < (high + 1) * self.stretch)
        return any_of([(F.col("file_id") == file_id) & at(low, high) for file_id, low, high in spans])

    def narrowed(self, rows: DataFrame, query: str) -> DataFrame:
        """The rows that can hold a query's text; the query itself is still to be tested on them."""
        found = self.condition(query.lower())
        return rows if found is None else rows.where(found)

    def discard(self) -> None:
        """Deletes the index."""
        discard(self.spark, self.path)


def joined(places: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """Ascending (file, stretch) as spans (file, first, last) of neighbours. Above `most` spans, those of a file that lie closest
    become one; spans of different files stay apart, even if they are more."""
    spans: list[tuple[int, int, int]] = []
    limit = 1
    gaps = sorted(k - j for (f, j), (g, k) in zip(places, places[1:], strict=False) if f == g and k - j > 1)
    files = len({f for f, _ in places})
    if files + len(gaps) > most:
        limit = gaps[min(files + len(gaps) - most, len(gaps)) - 1] if gaps else 1
    for f, k in places:
        if spans and spans[-1][0] == f and k - spans[-1][2] <= limit:
            spans[-1] = (f, spans[-1][1], k)
        else:
            spans.append((f, k, k))
    return spans


def any_of(conditions: list[Column]) -> Column:
    """Whether one of them holds, as a balanced tree, since planning goes down a tree's depth."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    middle = len(conditions) // 2
    return any_of(conditions[:middle]) | any_of(conditions[middle:])
