"""Queries over the log table: filters, display order, paging, seek, facets, histogram, detail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import ERROR, NAMES, UNKNOWN, WARN, level_name
from ..functions.text import contains_folded
from .order_index import OrderIndex
from .parsers import ACCESS, JSON, LOGFMT, access_fields, json_fields, logfmt_map

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
#: The widths of a histogram's buckets.
STEPS = (SECOND, 5 * SECOND, 10 * SECOND, 30 * SECOND, MINUTE, 5 * MINUTE, 10 * MINUTE, 30 * MINUTE, HOUR, 6 * HOUR, DAY)
MOST_BUCKETS = 1_000_000
PAGE_COLUMNS = ("file_id", "file", "row_seq", "ts_ms", "level", "service", "line_no", "message", "folded")


@dataclass(frozen=True)
class FilterSpec:
    """All parts must hold; an empty part holds for every row. Times are effective times, both ends included."""

    levels: frozenset[int] = frozenset()
    files: frozenset[int] = frozenset()
    services: frozenset[str] = frozenset()
    time_from: int | None = None
    time_to: int | None = None
    query: str = ""

    def condition(self) -> Column:
        """Cheap parts come first."""
        out = F.lit(True)
        if self.levels:
            out &= F.col("level").isin(*sorted(self.levels))
        if self.files:
            out &= F.col("file_id").isin(*sorted(self.files))
        if self.services:
            out &= F.coalesce(F.col("service").isin(*sorted(self.services)), F.lit(False))
        if self.time_from is not None or self.time_to is not None:
            low = F.col("eff_ts") >= F.lit(self.time_from) if self.time_from is not None else F.lit(True)
            high = F.col("eff_ts") <= F.lit(self.time_to) if self.time_to is not None else F.lit(True)
            out &= F.col("eff_ts").isNotNull() & low & high
        if self.query:
            out &= text_match(self.query)
        return out


@dataclass(frozen=True)
class Snapshot:
    """One answer to a filter."""

    count: int
    total_rows: int
    approx_bytes: int
    levels: list = field(default_factory=list)
    services: list = field(default_factory=list)
    files: list = field(default_factory=list)
    histogram: list | None = None


def text_match(query: str) -> Column:
    """The raw text, A-Z folded, contains the query in lower case; or an extracted message does, in full lower case."""
    needle = query.lower()
    own = F.col("message") != F.substring_index(F.col("raw"), "\n", 1)
    return contains_folded(F.col("raw"), needle) | (own & F.contains(F.lower("message"), F.lit(needle)))


def display_order() -> list[Column]:
    """Rows before any time come first, file by file; then all files on one clock."""
    return [F.col("eff_ts").asc_nulls_first(), F.col("file_id").asc(), F.col("row_seq").asc()]


def display_index(logs: DataFrame) -> OrderIndex:
    """The rows in display order, for pages and seeks that read only where they fall."""
    return OrderIndex.build(logs, display_order(), "eff_ts")


def filter_logs(logs: DataFrame, spec: FilterSpec) -> DataFrame:
    return logs.where(spec.condition())


def page(logs: DataFrame, spec: FilterSpec, start: int, stop: int) -> DataFrame:
    """Rows start to stop (excluded) of the filtered rows in display order."""
    start = max(start, 0)
    rows = filter_logs(logs, spec).orderBy(*display_order()).offset(start).limit(max(stop - start, 0))
    return rows.select(*PAGE_COLUMNS)


def position_for_time(logs: DataFrame, spec: FilterSpec, ms: int) -> DataFrame:
    """How many filtered rows stand before the time; rows without a time do."""
    return filter_logs(logs, spec).agg(F.count_if(F.col("eff_ts").isNull() | (F.col("eff_ts") < ms)).alias("position"))


def facet_levels(logs: DataFrame) -> DataFrame:
    """Counts of all six levels over all rows."""
    dense = logs.sparkSession.range(UNKNOWN + 1).select(F.col("id").cast("int").alias("level"))
    counts = logs.groupBy("level").agg(F.count(F.lit(1)).alias("rows"))
    return dense.join(counts, "level", "left").select("level", level_name(F.col("level")).alias("name"), F.coalesce("rows", F.lit(0)).alias("rows"))


def facet_services(logs: DataFrame, top: int | None = None) -> DataFrame:
    """Rows of each service, most first, in order of appearance where equal."""
    counts = logs.where(F.col("service").isNotNull()).groupBy("service").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("file_id", "row_seq")).alias("_first"))
    ordered = counts.orderBy(F.desc("rows"), "_first").drop("_first")
    return ordered.limit(top) if top else ordered


def histogram_step(span: int, target: int = 120) -> int:
    return next((s for s in STEPS if span / s <= target), STEPS[-1])


def histogram(logs: DataFrame, spec: FilterSpec | None = None, target: int = 120) -> DataFrame | None:
    """A row for each bucket between the first and the last effective time of all rows: bucket, bucket_start_ms, total,
    matched, errors and warns (of matched rows). None if no row has a time."""
    ends = logs.agg(F.min("eff_ts").alias("low"), F.max("eff_ts").alias("high")).first()
    if ends.low is None:
        return None
    start, step, n = bucket_layout(ends.low, ends.high, target)
    hit = spec.condition() if spec else F.lit(True)
    at = F.least(F.floor((F.col("eff_ts") - start) / step), F.lit(n - 1))
    counts = logs.where(F.col("eff_ts").isNotNull()).groupBy(at.alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matched"),
        F.count_if(hit & (F.col("level") == ERROR)).alias("errors"), F.count_if(hit & (F.col("level") == WARN)).alias("warns"),
    )
    dense = logs.sparkSession.range(n).withColumnRenamed("id", "bucket")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dense.join(counts, "bucket", "left").select("bucket", (F.lit(start) + F.col("bucket") * step).alias("bucket_start_ms"), *map(zero, ("total", "matched", "errors", "warns")))


@dataclass(frozen=True)
class Totals:
    """What all questions of a session share, since it doesn't depend on the filter."""

    rows: int
    bytes: int
    low: int | None
    high: int | None


def totals_of(logs: DataFrame) -> Totals:
    return Totals(*logs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)), F.min("eff_ts"), F.max("eff_ts")).first())


def bucket_layout(low: int, high: int, target: int = 120) -> tuple[int, int, int]:
    """Start, step and number of a histogram's buckets between two times."""
    step = histogram_step(max(SECOND, high - low), target)
    start = low // step * step
    n = max(1, -(-(high - start + 1) // step))
    if n > MOST_BUCKETS:
        raise ValueError(f"times from {low} to {high} need {n} buckets; the most is {MOST_BUCKETS}")
    return start, step, n


def summary(logs: DataFrame, spec: FilterSpec, totals: Totals, target: int = 120) -> DataFrame:
    """All counts of a question in one pass, by GROUPING SETS over level, service, file and bucket.

    part says which set a row belongs to ('level', 'service', 'file' or 'bucket'); n counts rows and hits those that the
    filter keeps, of which errors and warns; first_row is the first by file and place, first_ts and last_ts are own times."""
    hit = spec.condition()
    dated = totals.low is not None
    start, step, n = bucket_layout(totals.low, totals.high, target) if dated else (0, 1, 1)
    bucket = F.least(F.floor((F.col("eff_ts") - start) / step), F.lit(n - 1)) if dated else F.lit(None).cast("bigint")
    narrow = logs.select("level", "service", "file_id", "file", "row_seq", "ts_ms", bucket.alias("bucket"), hit.alias("_hit"))
    grouped = narrow.groupingSets([["level"], ["service"], ["file_id", "file"], ["bucket"]], "level", "service", "file_id", "file", "bucket").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits"), F.count_if(F.col("_hit") & (F.col("level") == ERROR)).alias("errors"),
        F.count_if(F.col("_hit") & (F.col("level") == WARN)).alias("warns"), F.min(F.struct("file_id", "row_seq")).alias("first_row"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
    )
    # a column that a set leaves out has its bit set: level, service, file_id, file, bucket
    part = F.when(F.col("_set") == 0b01111, "level").when(F.col("_set") == 0b10111, "service").when(F.col("_set") == 0b11001, "file").otherwise("bucket")
    return grouped.select(part.alias("part"), *[c for c in grouped.columns if c != "_set"]).where((F.col("part") != "service") | F.col("service").isNotNull())


def snapshot(logs: DataFrame, spec: FilterSpec, totals: Totals, target: int = 120) -> Snapshot:
    """One answer to a question: a single job beside the totals. What comes to the driver is a row for each level, service, file and bucket."""
    found: dict[str, list] = {"level": [], "service": [], "file": [], "bucket": []}
    for r in summary(logs, spec, totals, target).collect():
        found[r.part].append(r)
    by_level = {r.level: r.n for r in found["level"]}
    services = sorted(found["service"], key=lambda r: (-r.n, r.first_row))
    buckets = None
    if totals.low is not None:
        start, step, n = bucket_layout(totals.low, totals.high, target)
        by_bucket = {r.bucket: r for r in found["bucket"]}
        zero = lambda k, name: getattr(by_bucket[k], name) if k in by_bucket else 0
        buckets = [{"bucket": k, "bucket_start_ms": start + k * step, "total": zero(k, "n"), "matched": zero(k, "hits"), "errors": zero(k, "errors"), "warns": zero(k, "warns")} for k in range(n)]
    return Snapshot(
        sum(r.hits for r in found["level"]), totals.rows, totals.bytes, [{"level": k, "name": NAMES[k], "rows": by_level.get(k, 0)} for k in range(UNKNOWN + 1)],
        [{"service": r.service, "rows": r.n} for r in services], [{"file_id": r.file_id, "file": r.file, "rows": r.n, "first_ts": r.first_ts, "last_ts": r.last_ts} for r in sorted(found["file"], key=lambda r: r.file_id)], buckets,
    )


def bucket_range(start_ms: int, step: int, bucket: int, selected: tuple[int, int] | None = None) -> tuple[int, int] | None:
    """The time range of a bucket; None if it is the one selected already."""
    found = (start_ms + bucket * step, start_ms + (bucket + 1) * step - 1)
    return None if found == selected else found


def detail(logs: DataFrame, custom: Column | None = None) -> DataFrame:
    """Each row's whole text and its fields as a map of texts; null for families without fields."""
    head = F.substring_index(F.col("raw"), "\n", 1)
    json = F.transform_values(json_fields(head), lambda _, v: F.coalesce(v.try_cast("string"), F.to_json(v)))
    fields = F.when(F.col("kind") == JSON, json).when(F.col("kind") == LOGFMT, logfmt_map(head, None)).when(F.col("kind") == ACCESS, access_fields(head))
    if custom is not None:
        fields = F.coalesce(custom, fields)
    return logs.select("file_id", "row_seq", F.col("raw").alias("full_text"), fields.alias("fields"))
