"""Growing logs: lines are parsed as they arrive, rows fold across batches, histograms close by watermark.

A log is a name with any number of files, such as app.log-0001, app.log-0002: files of one name are its lines in the order
of their names. What is kept between batches is, for each log, the row that is still open and three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.parsers import configure, is_continuation, with_line_record
from ..operators.rows import FOLD_BYTES
from ..sources.lines import clean


#: What a file's name has behind its log's name.
PART = r"[-._]\d+$"
OPEN_ROW = "row_seq bigint, line_no bigint, lines bigint, size bigint, kind int, ts_ms bigint, eff_ts bigint, level int, service string, message string, texts array<string>"
LOG_ROW = "log string, row_seq bigint, line_no bigint, kind int, ts_ms bigint, eff_ts bigint, level int, service string, message string, raw string, folded int"


def tail_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(log, file, start, arrived, value) of new files in a folder; file, start and arrived order a log's lines."""
    source = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    file = F.col("_metadata.file_name")
    source = source.select(
        F.regexp_replace(file, PART, "").alias("log"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"), clean(F.col("value")).alias("value"),
    )
    return source.mapInArrow(numbered, "log string, file string, start bigint, value string, arrived bigint")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds arrived, which rises along each task's lines."""
    at = 0
    for batch in batches:
        places = pa.array(np.arange(at, at + batch.num_rows))
        at += batch.num_rows
        yield pa.record_batch([*batch.columns, places], [*batch.schema.names, "arrived"])


def parsed(lines: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Adds each line's own record; no state."""
    configure(lines.sparkSession)
    return with_line_record(lines, F.col("value"), now_ms)


class RowFolder(StatefulProcessor):
    """Folds a log's lines into rows. A row is given out once the next one begins."""

    def __init__(self, most: int = FOLD_BYTES):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("open", OPEN_ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # a trigger's lines of one log, which maxFilesPerTrigger bounds
        lines = pd.concat(list(rows)).sort_values(["file", "start", "arrived"], kind="stable").reset_index(drop=True)
        seq, first, count, size, *record, texts = self.held.get() if self.held.exists() else (-1, 0, 0, 0, *[None] * 6, [])
        top, texts, out = record[2], list(texts), []
        whole = lambda x: None if pd.isna(x) else int(x)

        def close() -> None:
            out.append((key[0], seq, first, *record, "\n".join(texts), len(texts) - 1))

        for line in lines.itertuples(index=False):
            count += 1
            own = len(line.value.encode())
            if seq >= 0 and not line.head and size + own + 1 <= self.most:
                texts.append(line.value)
                size += own + 1
                continue
            if seq >= 0:
                close()
            ts = whole(line.ts_ms)
            top = ts if top is None else top if ts is None else max(top, ts)
            seq, first, size, texts = seq + 1, count, own, [line.value]
            record = [int(line.kind), ts, top, int(line.level), line.service, line.message]
        self.held.update((seq, first, count, size, *record, texts))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG_ROW.split(", ")]).astype({c: "Int64" for c in ("ts_ms", "eff_ts")})

    def close(self) -> None:
        pass


def folded(lines: DataFrame, now_ms: int | None = None, most: int = FOLD_BYTES) -> DataFrame:
    """The rows of tail_lines() as batch reading makes them: continuation lines folded, numbered, with effective time.

    Needs the RocksDB state store (configure_state). A log's last row stays open until another begins."""
    marked = parsed(lines, now_ms).withColumn("head", ~is_continuation(F.col("value")))
    return marked.groupBy("log").transformWithStateInPandas(RowFolder(most), LOG_ROW, "Append", "None")


def configure_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_histogram(rows: DataFrame, step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows of each level in windows of a given width; a window is final once the watermark has passed it."""
    timed = rows.where(F.col("ts_ms").isNotNull()).withColumn("time", F.timestamp_millis("ts_ms")).withWatermark("time", late)
    return timed.groupBy(F.window("time", step), "level").agg(F.count(F.lit(1)).alias("rows"))
