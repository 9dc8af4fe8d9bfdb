"""A session over log files: add files, teach formats, ask.

Each file becomes rows once, written as Parquet into the session's folder; all questions read those tables, so that
column pruning, pushed filters and pruning by file apply. Asking changes nothing, so questions may overlap freely.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strptime import compile_time_format
from .functions.text import signature
from .operators import delimited
from .operators.custom import ColumnSpec, FormatError, PatternFormat, PatternSpec, compile_pattern_format
from .operators.parsers import CSV, CUSTOM, configure, with_line_record
from .operators.order_index import OrderIndex
from .operators.query import PAGE_COLUMNS, FilterSpec, Snapshot, Totals, detail, display_index, filter_logs, page, position_for_time, snapshot, totals_of
from .operators.search_index import SearchIndex
from .operators.rows import COLUMNS, first_services, fold, fold_splits, in_places, split_rows, with_effective_time, with_record
from .progress import watched
from .sources.lines import head_and_files, read_lines, scanned_lines, text_lines
from .sources.registry import FormatRegistry, Spec
from .sources.sample import FILES, sample_lines
from .work import cut, discard, new_dir

HEAD_LINES = 12
#: How many files' first lines are read at a time.
HEADS_AT_ONCE = 8
#: Pages that end before this place are found without an index.
SHALLOW = 10_000
ROW_SCHEMA = "file_id int, file string, row_seq bigint, line_no bigint, kind int, ts_ms bigint, eff_ts bigint, level int, service string, message string, raw string, folded int"


@dataclass(frozen=True)
class LogFile:
    file_id: int
    name: str
    lines: Callable[[], DataFrame]
    head: str
    signature: str
    dialect: delimited.Dialect | None
    spec: Spec | None
    pattern: PatternFormat | None
    table: str
    scan: Callable[[], DataFrame] | None = None


@dataclass(frozen=True)
class KnownFiles:
    """What is found once for a set of tables: rows before each file, all rows, and the services that are kept (None: all)."""

    tables: tuple[str, ...]
    before: dict[int, int]
    rows: int
    services: tuple[str, ...] | None


class Superseded(Exception):
    """A question whose jobs were ended, since another took its place."""


class LogSession:
    def __init__(self, spark: SparkSession, folder: str | None = None, registry: FormatRegistry | None = None, now_ms: int | None = None, max_services: int | None = 512):
        """folder: where rows are kept; on a cluster, one that all machines share (spark.checkpoint.dir by default)."""
        configure(spark)
        self.spark, self.registry, self.max_services = spark, registry or FormatRegistry(), max_services
        self.folder = folder or new_dir(spark, "logs")
        self.now = now_ms
        self.name = uuid.uuid4().hex[:8]
        self.files: list[LogFile] = []
        self._known: KnownFiles | None = None
        self._totals: Totals | None = None
        self._index: tuple[FilterSpec, OrderIndex] | None = None
        self._text: tuple[tuple[str, ...], SearchIndex] | None = None
        self._lock, self._epoch, self._running = Lock(), 0, None

    # --- adding -----------------------------------------------------------------------------------

    def add_file(self, path: str, name: str | None = None, spec: Spec | None = None, on_progress: Callable[[int, int], None] | None = None) -> LogFile:
        """Adds a file by its path. on_progress: called with the bytes read so far and the file's size, a few times a second
        and once at the end."""
        if on_progress is not None:
            with watched(self.spark, [path], on_progress):
                return self.add_file(path, name, spec)
        made = self._known_by(len(self.files), path, name, *head_and_files(self.spark, path), spec)
        return self._add(made)

    def add_files(self, paths: Sequence[str], names: Sequence[str] | None = None, on_progress: Callable[[int, int], None] | None = None) -> list[LogFile]:
        """Adds many files, in the order given, as add_file() would one by one. Their first lines are read side by side; all logs whose lines tell
        their own format then become rows in one pass, whatever their number, and only the others (delimited or taught ones, and those
        that such a pass can't cut into rows) take a pass of their own. Nothing is added if a file can't be read."""
        if on_progress is not None and paths:
            with watched(self.spark, paths, on_progress):
                return self.add_files(paths, names)
        with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
            heads = list(pool.map(lambda path: head_and_files(self.spark, path), paths))
        first, together, owners, new = len(self.files), [], {}, []
        for k, (path, name, (head, files)) in enumerate(zip(paths, names or [None] * len(paths), heads, strict=True), first):
            made = self._known_by(k, path, name, head, files)
            new.append(made)
            if not made.pattern and not made.dialect and owners.keys().isdisjoint(files):  # a path that is given again takes a pass of its own
                together.append(path)
                owners |= {file: (file, k, made.name) for file in files}
        done = self._write_together(together, [*owners.values()]) if len(together) > 1 else {}
        new = [replace(made, table=done[made.file_id]) if made.file_id in done else self._written(made) for made in new]
        self.files += new
        return new

    def _write_together(self, paths: list[str], owners: list[tuple[str, int, str]]) -> dict[int, str]:
        """Writes the rows of files whose lines tell their own format; the folder of each file for which that could be done."""
        rows, made, done, _ = fold_splits(scanned_lines(self.spark, paths, owners), lambda lines, line: with_line_record(lines, line, self.now, ts="ts"))
        folder = f"{self.folder}/together-{uuid.uuid4().hex[:8]}"
        if done:
            rows.withColumn("of", F.col("file_id")).sortWithinPartitions("of", "row_seq").write.partitionBy("of").parquet(folder)
        discard(self.spark, *made)
        return {k: f"{folder}/of={k}" for k in done}

    def add_text(self, name: str, text: str, spec: Spec | None = None) -> LogFile:
        k = len(self.files)
        return self._add(self._told(k, name, lambda: text_lines(self.spark, name, text, k), text[: 64 * 1024].removeprefix("﻿"), spec))

    def load_sample(self) -> list[LogFile]:
        out = []
        lines = cut(sample_lines(self.spark), "sample")
        for own, name in enumerate(FILES):
            k = len(self.files)
            mine = lines.where(F.col("file_id") == own).withColumn("file_id", F.lit(k))
            head = "\n".join(r.value for r in mine.orderBy("line_no").limit(100).collect())
            out.append(self._add(self._told(k, name, lambda mine=mine: mine, head, None)))
        return out

    def reparse(self, file_id: int, spec: Spec | None) -> LogFile:
        """Makes one file's rows anew, by a spec or, for None, by what is known of its signature."""
        old = self.files[file_id]
        self.files[file_id] = self._written(self._told(file_id, old.name, old.lines, old.head, spec, old.scan))
        return self.files[file_id]

    def reset(self) -> None:
        """Forgets all files and deletes their tables."""
        discard(self.spark, *[f.table for f in self.files])
        self.files, self._known, self._totals = [], None, None
        self._drop_index()
        self._drop_text()

    def _add(self, made: LogFile) -> LogFile:
        self.files.append(self._written(made))
        return self.files[-1]

    def _known_by(self, k: int, path: str, name: str | None, head: str, files: list[str], spec: Spec | None = None) -> LogFile:
        """What is told of a file by its path before its rows are made."""
        name = name or path.rsplit("/", 1)[-1]
        lines = lambda: read_lines(self.spark, [path], k).withColumn("file", F.lit(name))
        return self._told(k, name, lines, head, spec, lambda: scanned_lines(self.spark, [path], [(file, k, name) for file in files]))

    def _told(self, k: int, name: str, lines: Callable[[], DataFrame], head: str, spec: Spec | None, scan: Callable[[], DataFrame] | None = None) -> LogFile:
        """A file's format by its first lines, and the folder that its rows will be in."""
        dialect = delimited.sniff(head)
        mark = signature(dialect.header_line if dialect else None, head.split("\n", 1)[0].removesuffix("\r"))
        spec = spec or self.registry.find(mark)
        pattern = compile_pattern_format(spec, self.spark) if isinstance(spec, PatternSpec) else None
        return LogFile(k, name, lines, head, mark, dialect, spec, pattern, f"{self.folder}/{k}-{uuid.uuid4().hex[:8]}", scan)

    def _written(self, made: LogFile) -> LogFile:
        """Makes and writes a file's rows."""
        found = self._in_order(made) if made.scan is not None and (made.pattern or not made.dialect) else None
        if found:
            in_places(found[0]).write.parquet(made.table)
            discard(self.spark, *found[1])
        else:
            in_places(self._rows(made)).write.parquet(made.table)
        return made

    def _in_order(self, file: LogFile) -> tuple[DataFrame, list[DataFrame]] | None:
        """The rows by one pass over each split, and the tables they are made of; None where that can't be."""
        if not file.pattern:
            return split_rows(file.scan(), lambda lines, line: with_line_record(lines, line, self.now, ts="ts"))
        taught = lambda lines, line: with_record(lines, F.when(line.isNotNull(), file.pattern.parse(line)), ts="ts")
        found = split_rows(file.scan(), taught, file.pattern.matched(F.col("value")) if file.pattern.fold_unmatched else F.lit(True))
        return found and (found[0].withColumn("line_no", F.col("row_seq") + 1), found[1])

    def _rows(self, file: LogFile) -> DataFrame:
        if file.pattern:
            rows = fold(file.lines(), file.pattern.matched(F.col("value")) if file.pattern.fold_unmatched else F.lit(True))
            # rows are numbered by themselves here, not by their lines
            rows = with_record(rows.withColumn("line_no", F.col("row_seq") + 1), file.pattern.parse(F.col("text")))
        elif file.dialect:
            found = delimited.records(file.lines(), file.dialect.delimiter)
            samples = [r.fields for r in found.where(F.col("rec_no") <= delimited.ROLE_RECORDS).orderBy("rec_no").select("fields").collect()]
            rows = found.select("*", (F.col("rec_no") - 1).alias("row_seq"), F.col("rec_no").alias("line_no"), F.lit(0).alias("folded"))
            rows = delimited.with_field_record(rows, F.col("fields"), self._roles(file, samples), self.now)
        else:
            rows = with_line_record(fold(file.lines()), F.col("text"), self.now)
        return with_effective_time(rows).select(*COLUMNS)

    def _roles(self, file: LogFile, samples: list[list[str]]) -> delimited.Roles:
        roles = delimited.infer_roles(file.dialect.header, samples)
        spec = file.spec
        if not isinstance(spec, ColumnSpec):
            return roles
        time_format = None
        if spec.timestamp_format and spec.timestamp_format.strip():
            time_format = compile_time_format(spec.timestamp_format)
            if time_format is None:
                raise FormatError(f"the time layout {spec.timestamp_format!r} has a directive that is not known")
        wanted = {k: getattr(spec, k) for k in ("time", "level", "status", "message", "service")}
        return delimited.with_overrides(roles, file.dialect.header, wanted, time_format)

    # --- asking -----------------------------------------------------------------------------------

    def logs(self) -> DataFrame:
        """The rows of all files, with row_id. What the files are known for, and the services that are kept, is found once for each set of files."""
        if not self.files:
            return self.spark.createDataFrame([], f"{ROW_SCHEMA}, row_id bigint")
        rows = self.spark.read.schema(ROW_SCHEMA).parquet(*[f.table for f in self.files])
        known = self._known_files()
        if known.services is not None:  # max_services at most
            rows = rows.withColumn("service", F.when(F.col("service").isin(*known.services), F.col("service")))
        before = F.lit([known.before[f.file_id] for f in self.files]).cast("array<bigint>")
        return rows.withColumn("row_id", F.get(before, F.col("file_id")) + F.col("row_seq"))

    def _known_files(self) -> KnownFiles:
        """A row for each file and the first services, kept until a file is added or read anew."""
        tables = tuple(f.table for f in self.files)
        if self._known is None or self._known.tables != tables:
            rows = self.spark.read.schema(ROW_SCHEMA).parquet(*tables)
            counts = {r.file_id: r.n for r in rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            before, at = {}, 0
            for f in self.files:
                before[f.file_id] = at
                at += counts.get(f.file_id, 0)
            services = None
            if self.max_services:
                services = tuple(r.service for r in first_services(rows, self.max_services + 1).collect())
                services = services[: self.max_services] if len(services) > self.max_services else None
            self._known = KnownFiles(tables, before, at, services)
            self._totals = None
            self._drop_index()
        return self._known

    def view(self, name: str = "logs") -> None:
        """Makes the rows known to SQL."""
        self.logs().createOrReplaceTempView(name)

    def query(self, spec: FilterSpec = FilterSpec(), tag: str | None = None) -> Snapshot:
        """The answer to a question; it ends the jobs of the question before, which another thread may still be waiting for (Superseded).

        tag: a further name for the question's jobs, for spark.interruptTag(tag)."""
        with self._asking() as epoch:
            try:
                if tag:
                    self.spark.addTag(tag)
                logs = self.logs()
                if self._totals is None:
                    self._totals = totals_of(logs)
                return snapshot(logs, spec, self._totals)
            except Exception as problem:
                if self._epoch != epoch:
                    raise Superseded(f"question {epoch} gave way to question {self._epoch}") from problem
                raise
            finally:
                if tag:
                    self.spark.removeTag(tag)

    @contextmanager
    def _asking(self) -> Iterator[int]:
        """Numbers a question, whose jobs carry the number as a tag, and ends the jobs of the one before."""
        context = self.spark.sparkContext
        name = lambda epoch: f"logweir-{self.name}-{epoch}"
        with self._lock:
            self._epoch += 1
            epoch, running = self._epoch, self._running
            self._running = epoch
        if running is not None:
            context.cancelJobsWithTag(name(running))
        context.addJobTag(name(epoch))
        context.setInterruptOnCancel(True)
        try:
            yield epoch
        finally:
            context.removeJobTag(name(epoch))
            context.setInterruptOnCancel(False)
            with self._lock:
                if self._running == epoch:
                    self._running = None

    def index_text(self) -> SearchIndex:
        """Makes the text of all files known to searches, until a file is added or read anew."""
        tables = tuple(f.table for f in self.files)
        if self._text is None or self._text[0] != tables:
            self._drop_text()
            self._text = (tables, SearchIndex.build(self.logs().select("file_id", "row_seq", "raw", "message")))
        return self._text[1]

    def _drop_text(self) -> None:
        if self._text is not None:
            self._text[1].discard()
            self._text = None

    def search(self, spec: FilterSpec) -> DataFrame:
        """The filtered rows. After index_text(), only the stretches of rows that can hold the query's text are read."""
        logs = self.logs()
        if spec.query and self._text is not None and self._text[0] == tuple(f.table for f in self.files):
            logs = self._text[1].narrowed(logs, spec.query)
        return filter_logs(logs, spec)

    def rows(self, spec: FilterSpec, start: int, stop: int) -> DataFrame:
        """A page of the filtered rows in display order. Pages near the start are the smallest rows of each task; deeper ones
        come from the order index, which is made once for a filter and kept until another one is asked for."""
        if stop <= SHALLOW:
            return page(self.search(spec), FilterSpec(), start, stop)
        return self.order_index(spec).slice(start, stop).select(*PAGE_COLUMNS)

    def order_index(self, spec: FilterSpec) -> OrderIndex:
        """The filtered rows' places in display order."""
        self._known_files()
        if self._index is None or self._index[0] != spec:
            self._drop_index()
            self._index = (spec, display_index(self.search(spec).select(*PAGE_COLUMNS, "eff_ts")))
        return self._index[1]

    def _drop_index(self) -> None:
        if self._index is not None:
            self._index[1].discard()
            self._index = None

    def position_for_time(self, spec: FilterSpec, ms: int) -> int:
        """How many filtered rows stand before a time; from the order index, if it is at hand for the filter."""
        logs = self.logs()
        if self._index is not None and self._index[0] == spec:
            return self._index[1].position("eff_ts", ms)
        return position_for_time(logs, spec, ms).first().position

    def row(self, row_id: int) -> DataFrame:
        """The row with an id. The file and the place in it follow from the id; a file's rows are written sorted, so that the
        Parquet reader skips all row groups but the one that holds the place."""
        known = self._known_files() if self.files else None
        if known is None or not 0 <= row_id < known.rows:
            return self.logs().where(F.lit(False))
        file = max((f for f in self.files if known.before[f.file_id] <= row_id), key=lambda f: (known.before[f.file_id], f.file_id))
        seq = row_id - known.before[file.file_id]
        one = self.spark.read.schema(ROW_SCHEMA).parquet(file.table).where(F.col("row_seq") == seq)
        if known.services is not None:
            one = one.withColumn("service", F.when(F.col("service").isin(*known.services), F.col("service")))
        return one.withColumn("row_id", F.lit(row_id).cast("bigint"))

    def detail(self, row_id: int) -> dict | None:
        """A row's whole text and its fields."""
        row = self.row(row_id)
        found = row.select("file_id", "kind", "raw").first()
        if found is None:
            return None
        file, one = self.files[found.file_id], self.spark.createDataFrame([tuple(found)], "file_id int, kind int, raw string").withColumn("row_seq", F.lit(0))
        own = None
        if found.kind == CUSTOM:
            own = file.pattern.fields(F.substring_index("raw", "\n", 1))
        elif found.kind == CSV:
            own = delimited.record_fields(delimited.record_cells(F.col("raw"), file.dialect.delimiter), file.dialect.header)
        out = detail(one, own).first()
        return {"row_id": row_id, "full_text": out.full_text, "fields": out.fields}

    def file_info(self, file_id: int) -> dict:
        file = self.files[file_id]
        rows = self.spark.read.parquet(file.table).where(F.col("row_seq") < HEAD_LINES).orderBy("row_seq").select("raw")
        lines = [r.raw.split("\n", 1)[0] for r in rows.collect()]
        lines = [file.dialect.header_line, *lines][:HEAD_LINES] if file.dialect and not file.pattern else lines
        return {"file_id": file_id, "signature": file.signature, "csv_header": list(file.dialect.header) if file.dialect else None, "head_lines": lines}

    def preview(self, file_id: int, spec: PatternSpec, lines: int = 8) -> list[dict]:
        """How a pattern would read a file's first lines: what matched, and the records."""
        made = compile_pattern_format(spec, self.spark)
        head = self.file_info(file_id)["head_lines"]
        head = head[1:] if self.files[file_id].dialect and not self.files[file_id].pattern else head
        df = self.spark.createDataFrame([(k, x) for k, x in enumerate(head[:lines])], "k int, line string")
        rows = df.select("k", "line", made.matched(F.col("line")).alias("matched"), made.parse(F.col("line")).alias("r")).orderBy("k")
        return [{"line": r.line, "matched": r.matched, **r.r.asDict()} for r in rows.collect()]

    def teach(self, file_id: int, spec: Spec) -> LogFile:
        """Reads a file by a spec and remembers it for files of the same signature."""
        made = self.reparse(file_id, spec)
        self.registry.save(made.signature, spec)
        return made

    def export_text(self, file_id: int, path: str) -> None:
        """Writes a file's rows as text, under its header if it has one; a task for each stretch of rows, in order."""
        file = self.files[file_id]
        rows = self.spark.read.parquet(file.table).select("row_seq", F.col("raw").alias("value"))
        if file.dialect and not file.pattern:
            rows = rows.union(self.spark.createDataFrame([(-1, file.dialect.header_line)], "row_seq bigint, value string"))
        rows.repartitionByRange("row_seq").sortWithinPartitions("row_seq").select("value").write.text(path)
