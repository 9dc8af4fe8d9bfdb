"""Rows from lines: running values in file order, folding of continuation lines, effective time, file statistics.

A file's lines carry their split (part), so that running sums and maxima come in two steps: inside each part, by tasks
of their own, and over the parts' totals, a row for each part. No task needs a whole file.

Lines that come straight from a scan are in order inside a split, so split_rows() parses, folds and keeps the running
maximum in one pass over them; text is exchanged only where a row goes on in the next split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import cut, discard
from .parsers import is_continuation, with_line_record

FOLD_BYTES = 1 << 20
#: Columns of the table that all queries read.
COLUMNS = ("file_id", "file", "row_seq", "line_no", "kind", "ts_ms", "eff_ts", "level", "service", "message", "raw", "folded")


def running(df: DataFrame, value: Column, name: str, how: str = "sum", order: str = "line_no") -> DataFrame:
    """Adds the running sum or maximum of value in each file's order. df has file_id, part and the order column."""
    total = {"sum": F.sum, "max": F.max}[how]
    inside = Window.partitionBy("file_id", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_run_value", value)
    earlier = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy("file_id", "part").agg(total("_run_value").alias("_run_total")).select("file_id", "part", total("_run_total").over(earlier).alias("_run_before"))
    joined = marked.withColumn("_run_own", total("_run_value").over(inside)).join(parts, ["file_id", "part"])
    found = F.coalesce("_run_own", F.lit(0)) + F.coalesce("_run_before", F.lit(0)) if how == "sum" else F.greatest("_run_own", "_run_before")
    return joined.withColumn(name, found).drop("_run_value", "_run_own", "_run_before")


def number_lines(tagged: DataFrame) -> DataFrame:
    """Adds line_no from 1 in each file. tagged: file_id, part and mid, which rises inside a part."""
    counts = tagged.groupBy("file_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file_id", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("file_id", "part").orderBy("mid"))
    return tagged.withColumn("_place", place).join(offsets, ["file_id", "part"]).withColumn("line_no", (F.col("_place") + F.col("_before")).cast("bigint")).drop("_place", "_before", "mid")


MARK = "_mark"
#: What a line or a mark in a chunk is: a line of the chunk, a line of the next one that its last rows may take in, a place where a row begins.
OWN, NEXT, BEGINS = 0, 1, 2
STEP = "file_id int, group bigint, at bigint, to bigint, line_no bigint"


def next_rows(most: int, chunk: int, entries: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas over a chunk of one long row's lines: where its rows begin.

    A row that begins at byte `at` goes on to the last line end that keeps it at `most` bytes, or to its first line's
    end. With entries: for each place in the chunk's first bytes, and each place known to begin a row, where the first row behind
    the chunk begins. Without: the lines at which rows begin, from the places marked as such."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", MARK])
        lines, marks = pdf[pdf[MARK] != BEGINS], pdf[pdf[MARK] == BEGINS]
        begins, ends = lines["at"].to_numpy(), lines["to"].to_numpy()
        own = begins[lines[MARK].to_numpy() == OWN]
        low = int(pdf["chunk"].iloc[0]) * chunk
        if entries:
            starts = np.union1d(own[own - low <= most + 1], np.intersect1d(marks["at"], own))
        else:
            starts = np.intersect1d(marks["at"], own)
        open_ones, found, at = np.arange(len(starts)), [starts], starts.copy()
        while len(open_ones):
            furthest = ends[np.maximum(np.searchsorted(ends, at[open_ones] + most + 1, "right") - 1, 0)]
            at[open_ones] = np.maximum(furthest, ends[np.searchsorted(begins, at[open_ones])])
            inside = at[open_ones] < low + chunk
            inside[inside] = np.isin(at[open_ones[inside]], own)
            open_ones = open_ones[inside]
            if not entries:  # paths that have met go on as one
                _, firsts = np.unique(at[open_ones], return_index=True)
                open_ones = open_ones[firsts]
                found.append(at[open_ones])
        key = {"file_id": pdf["file_id"].iloc[0], "group": pdf["group"].iloc[0]}
        if entries:
            return pd.DataFrame({**key, "at": starts, "to": at, "line_no": 0})
        heads = np.unique(np.concatenate(found))
        return pd.DataFrame({**key, "at": heads, "to": heads, "line_no": lines["line_no"].to_numpy()[np.searchsorted(begins, heads)]})

    return run


def split_long_groups(lines: DataFrame, most: int = FOLD_BYTES, chunks: int = 16) -> DataFrame:
    """The lines (file_id, line_no) at which long rows are cut, so that none outgrows `most` bytes unless a single line
    does: each row takes lines as long as they fit. lines: file_id, part, line_no, group, size.

    Where a row ends follows from where it begins, so cuts form a chain. Lines are placed by the bytes before them and dealt to chunks of
    `chunks` times `most` bytes; each finds, from any place at which a row may enter it, where the first row behind it begins. These
    links alone are followed across chunks, by links of twice the length each time; then each chunk follows the rows that do enter it."""
    chunk = chunks * (most + 1)
    placed = running(lines, F.col("size") + 1, "to")
    placed = placed.select("file_id", "group", (F.col("to") - F.col("size") - 1).alias("at"), "to", "line_no", F.col("size").alias("_size"))
    number = F.floor(F.col("at") / chunk)
    early = (F.col("at") % chunk <= most) & (number > 0)
    copies = F.array_compact(F.array(F.struct(number.alias("chunk"), F.lit(OWN).alias(MARK)), F.when(early, F.struct((number - 1).alias("chunk"), F.lit(NEXT).alias(MARK)))))
    dealt = cut(placed.select("file_id", "group", "at", "to", "line_no", "_size", F.inline(copies)), "long-rows")
    own = dealt.where(F.col(MARK) == OWN)
    # a long row's first line begins a row, and so does the line after one that is too long by itself
    sure = own.groupBy("file_id", "group").agg(F.min("at").alias("at")).union(own.where(F.col("_size") > most).select("file_id", "group", F.col("to").alias("at"))).distinct()

    def with_marks(places: DataFrame) -> DataFrame:
        marks = places.select("file_id", "group", "at", F.col("at").alias("to"), F.lit(0).cast("bigint").alias("line_no"), F.floor(F.col("at") / chunk).alias("chunk"), F.lit(BEGINS).alias(MARK))
        return dealt.drop("_size").unionByName(marks).groupBy("file_id", "group", "chunk")

    spark = lines.sparkSession
    links = cut(with_marks(sure).applyInPandas(next_rows(most, chunk, True), STEP).drop("line_no"), "links")
    ends = own.groupBy("file_id", "group").agg((F.max("chunk") - F.min("chunk")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    reached, reach, made = cut(sure, "reached"), 1, [links]
    made.append(reached)
    while reach <= ends:  # all within reach - 1 links of a sure place are known
        more = reached.join(links, ["file_id", "group", "at"]).select("file_id", "group", F.col("to").alias("at"))
        reached = cut(reached.union(more).distinct(), "reached")
        onward = links.select("file_id", "group", F.col("at").alias("to"), F.col("to").alias("_then"))
        links = cut(links.join(onward, ["file_id", "group", "to"]).select("file_id", "group", "at", F.col("_then").alias("to")), "links")
        made += [reached, links]
        reach *= 2
    heads = cut(with_marks(reached).applyInPandas(next_rows(most, chunk, False), STEP).select("file_id", "line_no"), "heads")
    discard(spark, dealt, *made)
    return heads


def fold(lines: DataFrame, head: Column | None = None, most: int = FOLD_BYTES) -> DataFrame:
    """Lines to rows: file_id, file, part, row_seq (from 0), line_no and text of the first line, raw, folded.

    head: which lines begin a row (those that don't continue one, by default); a file's first line always does. Rows
    above `most` bytes are cut by split_long_groups(); all others are grouped by running sums."""
    head = ~is_continuation(F.col("value")) if head is None else head
    marked = lines.withColumn("head", F.coalesce(head, F.lit(True)) | (F.col("line_no") == 1)).withColumn("size", F.octet_length("value"))
    grouped = cut(running(marked, F.col("head").cast("bigint"), "group"), "lines")
    long = grouped.groupBy("file_id", "group").agg((F.sum("size") + F.count(F.lit(1)) - 1).alias("_bytes")).where(F.col("_bytes") > most).select("file_id", "group")
    if not long.isEmpty():
        cuts = split_long_groups(grouped.join(long, ["file_id", "group"], "left_semi").select("file_id", "part", "line_no", "group", "size"), most)
        again = grouped.drop("group").join(cuts.withColumn("_cut", F.lit(True)), ["file_id", "line_no"], "left")
        again = cut(again.withColumn("head", F.coalesce("_cut", "head")).drop("_cut"), "lines")
        grouped = running(again, F.col("head").cast("bigint"), "group")
    first = F.min(F.struct("line_no", "part", "value"))
    rows = grouped.groupBy("file_id", "file", "group").agg(first.alias("_first"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_lines"))
    return rows.select(
        "file_id", "file", F.col("_first.part").alias("part"), (F.col("group") - 1).alias("row_seq"), F.col("_first.line_no").alias("line_no"),
        F.col("_first.value").alias("text"), F.array_join(F.col("_lines.value"), "\n").alias("raw"), (F.size("_lines") - 1).alias("folded"),
    )


def with_record(rows: DataFrame, record: Column, ts: str = "ts_ms") -> DataFrame:
    """Adds a record's fields; a generator evaluates it once, where fields of a struct might each evaluate it anew."""
    return rows.select("*", F.inline(F.array(record))).withColumnRenamed("ts", ts)


def with_effective_time(rows: DataFrame) -> DataFrame:
    """Adds eff_ts: the latest ts_ms so far in the file, so that late rows stay where they stand. Rows are written first, so that they are parsed once."""
    return running(cut(rows, "rows"), F.col("ts_ms"), "eff_ts", "max", "row_seq")


SPLIT_ROWS = (
    "file_id int, file string, part struct<file_path: string, file_block_start: bigint>, seq bigint, at bigint, kind int, ts_ms bigint, top bigint, "
    "level int, service string, message string, raw string, folded int, size bigint, last boolean, odd boolean"
)
NO_TIME = -(1 << 63)


def fold_in_order(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over a scan's parsed lines: the rows of each split, with at most `most` bytes of a row held at a time.

    seq counts a split's rows from 1; what goes on from the split before has seq 0. top is the largest time so far in
    the split, last marks a split's last row. odd rows are too long, or begin with a byte order mark: another way is needed."""
    names = [column.split()[0] for column in SPLIT_ROWS.replace("file_path: string, file_block_start: bigint", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = None  # the split at hand; the first line of its open row
        texts: list[str] = []
        marked = False
        folded = size = at = lines = seq = 0
        top = NO_TIME

        def made(firsts: pa.RecordBatch, raw: pa.Array, seqs, ats, more, tops, sizes, last: bool) -> pa.RecordBatch:
            tops, sizes = np.asarray(tops, dtype=np.int64), np.asarray(sizes, dtype=np.int64)
            given = {c: firsts.column(c) for c in ("file_id", "file", "part", "kind", "level", "service", "message")}
            given |= {"ts_ms": firsts.column("ts"), "seq": pa.array(seqs, pa.int64()), "at": pa.array(ats, pa.int64()), "top": pa.array(tops, mask=tops == NO_TIME), "raw": raw}
            given |= {"folded": pa.array(more, pa.int32()), "size": pa.array(sizes), "last": pa.array(np.full(len(sizes), last)), "odd": pa.array((sizes > most) | marked)}
            return pa.record_batch([given[c] for c in names], names)

        def close(last: bool) -> pa.RecordBatch:
            raw = pa.array(["" if size > most else "\n".join(texts)], pa.string())
            return made(first, raw, [seq], [at], [folded], [top if seq else NO_TIME], [size], last)

        for batch in batches:
            if not batch.num_rows:
                continue
            path, start = batch.column("part").flatten()
            other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some, key = batch.slice(a, b - a), (path[a].as_py(), start[a].as_py())
                values = some.column("value")
                if key != part:
                    if first is not None:
                        yield close(True)
                    part, first, lines, seq, top = key, None, 0, 0, NO_TIME
                    marked = key[1] == 0 and values[0].as_py().startswith("\ufeff")
                heads = np.flatnonzero(some.column("head").to_numpy(zero_copy_only=False))
                lead = int(heads[0]) if len(heads) else b - a
                if lead:  # lines of the open row
                    if first is None:
                        first, texts, folded, size, at = some.slice(0, 1), [], -1, -1, lines
                    before = values.slice(0, lead)
                    folded, size = folded + lead, size + lead + pc.sum(pc.binary_length(before)).as_py()
                    texts = texts + before.to_pylist() if size <= most else []
                if len(heads):
                    if first is not None:
                        yield close(False)
                    bounds = np.append(heads, b - a)
                    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), "\n")
                    firsts, sizes, more = some.take(pa.array(heads)), pc.binary_length(raw).to_numpy(), np.diff(bounds) - 1
                    tops = np.maximum.accumulate(np.append(top, firsts.column("ts").fill_null(NO_TIME).to_numpy()))[1:]
                    seqs, ats, k = seq + 1 + np.arange(len(heads)), lines + heads, len(heads) - 1
                    if k:
                        yield made(firsts.slice(0, k), raw.slice(0, k), seqs[:k], ats[:k], more[:k], tops[:k], sizes[:k], False)
                    first, texts = firsts.slice(k, 1), [raw[k].as_py()]
                    folded, size, at, seq, top = int(more[k]), int(sizes[k]), int(ats[k]), int(seqs[k]), int(tops[k])
                lines += b - a
        if first is not None:
            yield close(True)

    return run


def split_rows(tagged: DataFrame, parse: Callable[[DataFrame, Column], DataFrame], head: Column | None = None, most: int = FOLD_BYTES) -> tuple[DataFrame, list[DataFrame]] | None:
    """fold_splits() where all files can be made so, else None."""
    out, made, _, others = fold_splits(tagged, parse, head, most)
    if others:
        discard(tagged.sparkSession, *made)
        return None
    return out, made


def fold_splits(tagged: DataFrame, parse: Callable[[DataFrame, Column], DataFrame], head: Column | None = None, most: int = FOLD_BYTES) -> tuple[DataFrame, list[DataFrame], set[int], set[int]]:
    """A scan's lines (file_id, file, part, value; in order inside a split) to the table with COLUMNS, the tables that it reads,
    the files whose rows these are, and the files that take number_lines() and fold(): those with a row above `most` bytes,
    and those that begin with a byte order mark or a line that would continue a row.

    parse adds a line's kind, ts, level, service and message. At most two rows of a split are exchanged, and a row for each file is collected."""
    head = F.coalesce(~is_continuation(F.col("value")) if head is None else head, F.lit(True))
    lines = tagged.select("file_id", "file", "part", "value", head.alias("head"))
    rows = cut(parse(lines, F.when(F.col("head"), F.col("value"))).mapInArrow(fold_in_order(most), SPLIT_ROWS), "rows")
    starts = F.col("seq") > 0
    totals = rows.groupBy("file_id", "part").agg(
        F.count_if(starts).alias("n"), F.sum(F.col("folded") + 1).alias("lines"), F.max("top").alias("top"), F.max("odd").alias("odd"),
        F.max(F.when(~starts, F.col("size") + 1)).alias("goes_on"), F.max(F.when(starts & F.col("last"), F.col("size"))).alias("last_size"),
    )
    before = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut(totals.select(
        "file_id", "part", "odd", "goes_on", "last_size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.max("top").over(before).alias("top_before"),
        F.last(F.when(F.col("n") > 0, F.col("part")), True).over(before).alias("anchor"),
    ), "splits")
    more = splits.where("goes_on IS NOT NULL").groupBy("file_id", F.col("anchor").alias("part")).agg(F.sum("goes_on").alias("more"))
    long = splits.join(more, ["file_id", "part"]).where(F.col("last_size") + F.col("more") > most)
    odd = splits.select("file_id", F.expr("odd OR goes_on IS NOT NULL AND anchor IS NULL").alias("odd")).union(long.select("file_id", F.lit(True)))
    found = {r.file_id: r.odd for r in odd.groupBy("file_id").agg(F.max("odd").alias("odd")).collect()}
    others = {k for k, is_odd in found.items() if is_odd}
    kept = rows.where(~F.col("file_id").isin(others)) if others else rows
    placed = kept.join(splits.drop("odd", "goes_on", "last_size"), ["file_id", "part"]).select(
        "*", (F.col("rows_before") + F.col("seq") - 1).alias("row_seq"), (F.col("lines_before") + F.col("at") + 1).alias("line_no"), F.greatest("top", "top_before").alias("eff_ts"),
    )
    edge = F.col("last") | ~starts
    own = [c for c in COLUMNS if c not in ("raw", "folded")]
    joined = placed.where(edge).groupBy("file_id", F.when(starts, F.col("part")).otherwise(F.col("anchor")).alias("of")).agg(
        F.max(F.when(starts, F.struct(*own))).alias("own"), F.array_sort(F.collect_list(F.struct("part", "raw"))).alias("texts"), F.sum(F.col("folded") + F.when(starts, 0).otherwise(1)).cast("int").alias("folded"),
    )
    joined = joined.select("own.*", F.array_join("texts.raw", "\n").alias("raw"), "folded")
    return placed.where(~edge).select(*COLUMNS).unionByName(joined.select(*COLUMNS)), [rows, splits], found.keys() - others, others


def build_logs(lines: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Numbered lines (file_id, file, part, line_no, value) to the table with COLUMNS."""
    return with_effective_time(with_line_record(fold(lines), F.col("text"), now_ms)).select(*COLUMNS)


def with_row_ids(logs: DataFrame) -> DataFrame:
    """Adds row_id: dense in the order of files and rows."""
    counts = logs.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return logs.join(counts.select("file_id", before.alias("_before")), "file_id").withColumn("row_id", F.col("_before") + F.col("row_seq")).drop("_before")


def in_places(rows: DataFrame) -> DataFrame:
    """Rows sorted by their place inside each task, so that written row groups tell which places they have."""
    return rows.sortWithinPartitions("row_seq")


def first_services(logs: DataFrame, most: int) -> DataFrame:
    """The first services in order of appearance."""
    seen = logs.where(F.col("service").isNotNull()).groupBy("service").agg(F.min(F.struct("file_id", "row_seq")).alias("_first"))
    return seen.orderBy("_first").limit(most).select("service")


def cap_services(logs: DataFrame, most: int = 512) -> DataFrame:
    """Keeps the first `most` services in order of appearance; the rest become null. The kept list is bounded by `most`."""
    kept = first_services(logs, most).withColumnRenamed("service", "_kept")
    return logs.join(F.broadcast(kept), F.col("service") == F.col("_kept"), "left").withColumn("service", F.col("_kept")).drop("_kept")


def file_stats(logs: DataFrame) -> DataFrame:
    return logs.groupBy("file_id", "file").agg(F.count(F.lit(1)).alias("rows"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))


def approx_bytes(logs: DataFrame) -> DataFrame:
    return logs.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"))
