"""The registered log queries, with DuckDB SQL that must give the same rows.

Log lines are rendered from table columns in the format of each family and parsed back, so that the oracle can work on
the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import BY_WORD, ERROR, UNKNOWN, WARN, level_from_number, level_from_text, level_name
from ..functions.strptime import compile_time_format
from ..functions.text import format_bucket, format_bytes, highlight, line_signature
from ..functions.timestamps import field_stages, time_stages, with_times
from ..operators import delimited, query, rows
from ..operators.custom import PatternSpec, compile_pattern_format
from ..operators.parsers import ACCESS, GENERIC, JSON, LOGFMT, SYSLOG, configure, is_continuation, json_fields, logfmt_map, with_line_record
from ..work import spread

#: 2024-02-01: after all events, so that dates without a year are of 2024.
NOW_MS = 1_706_745_600_000
WORDS = ("error", "warn", "info", "debug", "trace", "notice", "weird")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ms (epoch milliseconds), word (a level word) and svc."""
    df = spread(table(spark, sf_dir, "events"))
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % len(WORDS)).cast("int"))
    return df.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type", "user_id", "props", word.alias("word"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("svc"))


def stamp(pattern: str) -> Column:
    return F.date_format(F.timestamp_millis("ms"), pattern)




def line_of(family: str) -> Column:
    """How each family writes an event."""
    iso = stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.col("event_id").cast("string")
    status = F.get(F.array(F.lit("200"), F.lit("404"), F.lit("502")), (F.col("event_id") % 3).cast("int"))
    return {
        "json": F.concat(F.lit('{"time":"'), iso, F.lit('","level":"'), F.col("word"), F.lit('","service":"'), F.col("svc"), F.lit('","msg":"event '), text, F.lit('"}')),
        "number": F.concat(F.lit('{"ts":'), F.col("ms").cast("string"), F.lit(',"level":'), (F.col("event_id") % 7 * 10).cast("string"), F.lit(',"msg":"n"}')),
        "logfmt": F.concat(F.lit("ts="), iso, F.lit(" level="), F.col("word"), F.lit(" service="), F.col("svc"), F.lit(' msg="event \\"'), text, F.lit('\\""')),
        "access": F.concat(F.lit("10.0.0.1 - "), F.col("svc"), F.lit(" ["), stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /e/'), text, F.lit(' HTTP/1.1" '), status, F.lit(' 512 "-" "ua"')),
        "syslog": F.concat(stamp("MMM d HH:mm:ss"), F.lit(" host1 "), F.col("svc"), F.lit("["), text, F.lit("]: "), F.upper("word"), F.lit(" event "), text),
        "generic": F.concat(stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), F.upper("word"), F.lit(" com.app."), F.col("svc"), F.lit(" - event "), text),
        "raw": F.concat(F.lit("event number "), text),
        "dotted": F.concat(stamp("dd.MM.yyyy HH:mm:ss"), F.lit(" | "), F.col("word"), F.lit(" | "), F.col("svc"), F.lit(" | event "), text),
    }[family]


def parsed(df: DataFrame, record: Column) -> DataFrame:
    """Binds the record in one projection; an explode keeps filters above it."""
    return df.select("event_id", F.explode(F.array(record)).alias("r")).select("event_id", "r.kind", F.col("r.ts").alias("ts_ms"), "r.level", "r.service", "r.message")


def parse_query(family: str, only: int) -> Callable[[SparkSession, str], DataFrame]:
    lines = lambda spark, sf_dir: events(spark, sf_dir).select("event_id", line_of(family).alias("line"))
    return lambda spark, sf_dir: with_line_record(lines(spark, sf_dir), F.col("line"), NOW_MS, only=only).drop("line")


FAMILIES = ("json", "logfmt", "access", "syslog", "generic", "raw")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for k, family in enumerate(FAMILIES):
        out = (F if out is None else out).when(F.col("event_id") % len(FAMILIES) == k, line_of(family))
    return events(spark, sf_dir).withColumn("line", out)


def mixed_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_line_record(mixed_lines(spark, sf_dir).select("line"), F.col("line"), NOW_MS).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ts_ms").alias("sum_ts"), F.count("service").alias("services"))


def time_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps in each layout that is recognised."""
    df = events(spark, sf_dir)
    shifted = F.date_format(F.timestamp_millis(F.col("ms") + 5_400_000), "yyyy/MM/dd HH:mm:ss.SSS")
    texts = {
        "iso_offset": F.concat(shifted, F.lit("+01:30")), "clf": stamp("dd/MMM/yyyy:HH:mm:ss"), "epoch_s": F.floor(F.col("ms") / 1000).cast("string"),
        "epoch_ms": F.col("ms").cast("string"), "epoch_frac": F.concat(F.floor(F.col("ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0")),
    }
    df = df.select("event_id", *[t.alias(f"_{k}") for k, t in texts.items()])
    df = with_times(df, {k: F.col(f"_{k}") for k in texts}, time_stages(F.lit(NOW_MS)))
    return with_times(df, {"field_ms": F.col("_epoch_ms")}, field_stages(F.lit(NOW_MS))).select("event_id", *texts, "field_ms")


def strptime_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    formats = {"dotted": ("%d.%m.%Y %H:%M:%S", "dd.MM.yyyy HH:mm:ss"), "clock12": ("%d %b %Y %I:%M %p", "dd MMM yyyy hh:mm a"), "millis": ("%Y-%m-%d %H:%M:%S,%L", "yyyy-MM-dd HH:mm:ss,SSS"), "zoned": ("%Y%m%d%H%M%S %z", "yyyyMMddHHmmss '+0100'")}
    df = df.select("event_id", *[stamp(p).alias(f"_{k}") for k, (_, p) in formats.items()])
    for k, (f, _) in formats.items():
        df = with_times(df, {k: F.col(f"_{k}")}, compile_time_format(f).stages())
    return df.select("event_id", *formats)


def pattern_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    made = compile_pattern_format(PatternSpec((r"^(?<timestamp>[\d.]+ [\d:]+) \| (?<level>\w+) \| (?<service>\w+) \| (?<message>.*)$",), ("%d.%m.%Y %H:%M:%S",), {"error": ("weird",)}), spark)
    return parsed(events(spark, sf_dir).withColumn("line", line_of("dotted")), made.parse(F.col("line")))


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a delimited file, quoted and with line feeds inside, read back by roles that are inferred."""
    text = F.col("event_id").cast("string")
    body = F.concat(F.lit('"event, ""'), text, F.lit('""\nmore"'))
    line = F.concat_ws(",", stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("word")), (F.lit(200) + F.col("event_id") % 4 * 100).cast("string"), F.col("svc"), body)
    head = "timestamp,level,status,service,message"
    df = events(spark, sf_dir).select(((F.col("event_id") + 1) * 2).alias("at"), F.posexplode(F.split(line, "\n")).alias("k", "value"))
    lines = df.select((F.col("at") + F.col("k")).alias("line_no"), "value").union(spark.createDataFrame([(1, head)], "line_no bigint, value string"))
    tagged = lines.select(F.lit(0).alias("file_id"), F.lit("events.csv").alias("file"), F.floor(F.col("line_no") / 4096).alias("part"), F.col("line_no").cast("bigint").alias("line_no"), "value")
    found = delimited.records(tagged, ",")
    roles = delimited.infer_roles(tuple(head.split(",")), [r.fields for r in found.where("rec_no <= 24").orderBy("rec_no").select("fields").collect()])
    return delimited.with_field_record(found, F.col("fields"), roles, NOW_MS).select("rec_no", "ts_ms", "level", "service", "message")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of lines; each third line is indented, so that it continues the one before."""
    df = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("int").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("k", "value"))
    indented = F.when(F.col("k") % 3 == 2, F.concat(F.lit("\tat "), F.col("value"))).otherwise(F.col("value"))
    return df.select("file_id", F.lit("text").alias("file"), F.floor(F.col("k") / 16).alias("part"), (F.col("k") + 1).cast("bigint").alias("line_no"), indented.alias("value"))


def fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fold(document_lines(spark, sf_dir)).select("file_id", "row_seq", "line_no", "folded", F.octet_length("raw").alias("raw_bytes"), F.md5("raw").alias("raw_md5"))


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("file_id", "line_no", is_continuation(F.col("value")).alias("continues"))


def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of three files whose times go back and forth."""
    df = events(spark, sf_dir).withColumn("file_id", (F.col("event_id") % 3).cast("int")).withColumn("row_seq", F.floor(F.pmod(F.col("event_id") * 7919, F.lit(10007))) * 1000000 + F.col("event_id"))
    return df.select("event_id", "file_id", F.concat(F.lit("file"), F.col("file_id").cast("string")).alias("file"), "row_seq", F.floor(F.col("row_seq") / 100000000).alias("part"), F.when(F.col("event_id") % 11 != 0, F.col("ms")).alias("ts_ms"),
                     level_from_text(F.col("word")).alias("level"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("service"), F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("message"), F.concat(F.lit("RAW "), F.col("props"), F.lit(" É "), F.col("word")).alias("raw"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.running(shuffled_rows(spark, sf_dir), F.col("ts_ms"), "eff_ts", "max", "row_seq").withColumn("line_no", F.col("row_seq")).withColumn("folded", F.lit(0)).drop("part")


def effective_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("event_id", "eff_ts")


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display order as a rank, from ranges of the order and their counts."""
    return query.display_index(logs(spark, sf_dir).select("event_id", "eff_ts", "file_id", "row_seq")).places().select("event_id", (F.col("place") + 1).cast("int").alias("place"))


SPECS = {
    "filter_levels": query.FilterSpec(levels=frozenset({ERROR, WARN})),
    "filter_files": query.FilterSpec(files=frozenset({1})),
    "filter_services": query.FilterSpec(services=frozenset({"click", "view"})),
    "filter_time_range": query.FilterSpec(time_from=1_706_000_000_000, time_to=1_706_650_000_000),
    "filter_combined": query.FilterSpec(levels=frozenset({ERROR, UNKNOWN}), files=frozenset({0, 2}), services=frozenset({"click"}), time_from=1_706_000_000_000, query="event 1"),
    "text_search_message": query.FilterSpec(query="EVENT 12"),
    "text_search_raw": query.FilterSpec(query="raw {"),
}


def filtered(spec: query.FilterSpec) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query.filter_logs(logs(spark, sf_dir), spec).select("event_id", "level", "eff_ts")


def documents_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search in whole texts, A-Z folded."""
    df = table(spark, sf_dir, "documents").withColumn("raw", F.col("text")).withColumn("message", F.substring_index("text", "\n", 1))
    return df.where(query.text_match("Ention The")).select("doc_id")


def histogram_of(spec: query.FilterSpec | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query.histogram(logs(spark, sf_dir), spec)


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.page(logs(spark, sf_dir), SPECS["filter_levels"], 40, 90).select("file_id", "row_seq", "ts_ms", "level", "service", "message")


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in the middle of all rows and the seek to its first time, both by the order index."""
    index = query.display_index(logs(spark, sf_dir).select("file_id", "row_seq", "eff_ts", "message"))
    middle = index.count // 2
    seek = index.position("eff_ts", 1_706_400_000_000)
    return index.slice(middle, middle + 256).select("place", "file_id", "row_seq", "eff_ts", "message", F.lit(seek).cast("bigint").alias("seek"))


def position_for_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.position_for_time(logs(spark, sf_dir), SPECS["filter_files"], 1_706_650_000_000)


def facet_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.facet_services(logs(spark, sf_dir), 14)


def service_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = logs(spark, sf_dir)
    users = events(spark, sf_dir).select(F.col("event_id").alias("_e"), "svc")
    return rows.cap_services(df.drop("service").join(users, F.col("event_id") == F.col("_e")).withColumnRenamed("svc", "service"), 40).groupBy("service").agg(F.count(F.lit(1)).alias("n"))


def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers from splits and places inside them."""
    df = shuffled_rows(spark, sf_dir).select("event_id", "file_id", "file", "part", F.col("row_seq").alias("mid"))
    return rows.number_lines(df).select("event_id", "line_no")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_lines(spark, sf_dir).select(line_signature(F.col("line")).alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def detail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.element_at(json_fields(F.col("props")), "k").try_cast("string").alias("k"))


def detail_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("event_id", line_of("logfmt").alias("line")).select("event_id", logfmt_map(F.col("line"), None).alias("fields"))
    fields = F.col("fields")
    return df.select("event_id", F.size(fields).alias("n"), F.element_at(fields, "service").alias("service"), F.element_at(fields, "msg").alias("msg"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(F.upper("word").alias("word"), (F.col("event_id") % 8 * 10 - 5).alias("number"))
    named = df.select(level_name(level_from_text(F.col("word"))).alias("by_word"), level_name(level_from_number(F.col("number"))).alias("by_number"))
    return named.groupBy("by_word", "by_number").agg(F.count(F.lit(1)).alias("n"))


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("text"))
    hit = highlight(F.col("text"), F.lit("TH"))
    return df.select("doc_id", format_bytes(F.col("n_chars") * 1000 + 1).alias("size"), format_bucket(F.col("doc_id") % 400 * 1000 * 3600).alias("bucket"), F.length(hit["before"]).alias("before"), hit["hit"].alias("hit"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lines of all families through folding, parsing and merging to a histogram of errors and warnings."""
    df = mixed_lines(spark, sf_dir).select(F.lit(0).alias("file_id"), F.lit("mixed.log").alias("file"), F.floor(F.col("event_id") / 4096).alias("part"), (F.col("event_id") + 1).cast("bigint").alias("line_no"), F.col("line").alias("value"))
    return query.histogram(rows.build_logs(df, NOW_MS), SPECS["filter_levels"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "json_lines_parse": parse_query("json", JSON),
    "json_numeric_level": parse_query("number", JSON),
    "logfmt_parse": parse_query("logfmt", LOGFMT),
    "access_parse": parse_query("access", ACCESS),
    "syslog_parse": parse_query("syslog", SYSLOG),
    "generic_parse": parse_query("generic", GENERIC),
    "mixed_dispatch": mixed_dispatch, "time_layouts": time_layouts, "strptime_custom": strptime_custom, "pattern_format": pattern_format,
    "csv_records": csv_records, "fold_lines": fold_lines, "continuations": continuations, "line_numbers": number_rows, "effective_ts": effective_ts,
    "merge_order": merge_order, **{k: filtered(v) for k, v in SPECS.items()}, "documents_search": documents_search,
    "facet_levels": lambda s, d: query.facet_levels(logs(s, d)), "facet_services": facet_services, "facet_files": lambda s, d: rows.file_stats(logs(s, d)),
    "histogram": histogram_of(None), "histogram_filtered": histogram_of(SPECS["filter_levels"]), "page_rows": page_rows, "deep_page": deep_page, "position_for_time": position_for_time,
    "service_cap": service_cap, "signature": signatures, "detail_fields_json": detail_json, "detail_fields_logfmt": detail_logfmt,
    "approx_bytes": lambda s, d: rows.approx_bytes(logs(s, d)), "levels": levels, "display_formats": display_formats, "flagship": flagship,
}

# --- the oracle --------------------------------------------------------------------------------

_LEVEL = "CASE word " + " ".join(f"WHEN '{w}' THEN {BY_WORD.get(w, UNKNOWN)}" for w in WORDS) + " END"
_EVENTS = f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, user_id, props, 'u' || user_id AS svc,
    ([{", ".join(f"'{w}'" for w in WORDS)}])[1 + event_id % {len(WORDS)}] AS word FROM events)"""
_ROWS = f"""{_EVENTS}, r AS (SELECT event_id, (event_id % 3)::INTEGER AS file_id, 'file' || (event_id % 3) AS file,
    (event_id * 7919 % 10007) * 1000000 + event_id AS row_seq, CASE WHEN event_id % 11 <> 0 THEN ms END AS ts_ms, ({_LEVEL})::INTEGER AS level,
    CASE WHEN event_id % 5 <> 0 THEN event_type END AS service, 'Event ' || event_id AS message, 'RAW ' || props || ' É ' || word AS raw, svc FROM e),
    l AS (SELECT *, max(ts_ms) OVER (PARTITION BY file_id ORDER BY row_seq ROWS UNBOUNDED PRECEDING) AS eff_ts FROM r)"""
_SECONDS = "ms // 1000 * 1000"
_STEP = """(SELECT CASE """ + " ".join(f"WHEN span / {s}.0 <= 120 THEN {s}" for s in query.STEPS[:-1]) + f""" ELSE {query.STEPS[-1]} END AS step, low, high
    FROM (SELECT greatest(1000, max(eff_ts) - min(eff_ts)) AS span, min(eff_ts) AS low, max(eff_ts) AS high FROM l))"""


def _record(kind: int, ts: str, level: str, service: str, message: str) -> str:
    return f"{_EVENTS} SELECT event_id, {kind}::INTEGER AS kind, {ts} AS ts_ms, ({level})::INTEGER AS level, {service} AS service, {message} AS message FROM e"


def _histogram(source: str, condition: str) -> str:
    return f"""{source}, p AS (SELECT step, low // step * step AS start, greatest(1, ceil((high - low // step * step + 1) / step))::BIGINT AS n FROM {_STEP}),
    c AS (SELECT least(n - 1, (eff_ts - start) // step) AS bucket, count(*) AS total, count(*) FILTER ({condition}) AS matched,
        count(*) FILTER (({condition}) AND level = 0) AS errors, count(*) FILTER (({condition}) AND level = 1) AS warns FROM l, p WHERE eff_ts IS NOT NULL GROUP BY 1)
    SELECT b AS bucket, start + b * step AS bucket_start_ms, coalesce(total, 0) AS total, coalesce(matched, 0) AS matched, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns
    FROM (SELECT unnest(range(n)) AS b, start, step FROM p) LEFT JOIN c ON b = bucket"""


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SEARCH = lambda q: f"(contains({_FOLDED.format('raw')}, '{q}') OR contains(lower(message), '{q}'))"
_WHERE = {
    "filter_levels": "level IN (0, 1)", "filter_files": "file_id = 1", "filter_services": "service IN ('click', 'view')",
    "filter_time_range": "eff_ts BETWEEN 1706000000000 AND 1706650000000",
    "filter_combined": f"level IN (0, 5) AND file_id IN (0, 2) AND service = 'click' AND eff_ts >= 1706000000000 AND {_SEARCH('event 1')}",
    "text_search_message": _SEARCH("event 12"), "text_search_raw": _SEARCH("raw {"),
}
_LINES = """WITH t AS (SELECT doc_id::INTEGER AS file_id, string_split(text, chr(10)) AS ls FROM documents),
    v AS (SELECT file_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS line_no FROM t),
    w AS (SELECT file_id, line_no, CASE WHEN line_no % 3 = 0 THEN chr(9) || 'at ' || x ELSE x END AS value FROM v),
    c AS (SELECT *, value = '' OR regexp_matches(value, '^([\\s\\x{A0}\\x{FEFF}]+|at\\s+\\S|Caused by:|\\.\\.\\. [0-9]+ (more|common frames)|Traceback \\(|goroutine [0-9]|-->)') AS continues FROM w)"""
_MIX = {k: f"event_id % {len(FAMILIES)} = {i}" for i, k in enumerate(FAMILIES)}

ORACLE_SQL: dict[str, str] = {
    "json_lines_parse": _record(0, "ms", _LEVEL, "svc", "'event ' || event_id"),
    "json_numeric_level": _record(0, "ms", "CASE event_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END", "NULL::VARCHAR", "'n'"),
    "logfmt_parse": _record(1, "ms", _LEVEL, "svc", "'event \"' || event_id || '\"'"),
    "access_parse": _record(2, _SECONDS, "CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END", "NULL::VARCHAR", "(['200', '404', '502'])[1 + event_id % 3] || ' GET /e/' || event_id"),
    "syslog_parse": _record(3, _SECONDS, f"CASE WHEN word = 'weird' THEN 2 ELSE {_LEVEL} END", "svc", "upper(word) || ' event ' || event_id"),
    "generic_parse": _record(4, "ms", _LEVEL, "'com.app.' || svc", "strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S,%g') || ' ' || upper(word) || ' com.app.' || svc || ' - event ' || event_id"),
    "mixed_dispatch": f"""{_EVENTS}, k AS (SELECT CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END::INTEGER AS kind,
        CASE event_id % 6 WHEN 0 THEN ms WHEN 1 THEN ms WHEN 2 THEN {_SECONDS} WHEN 3 THEN {_SECONDS} WHEN 4 THEN ms END AS t, CASE WHEN event_id % 6 IN (0, 1, 3, 4) THEN 1 END AS s FROM e)
        SELECT kind, count(*) AS n, sum(t)::BIGINT AS sum_ts, count(s) AS services FROM k GROUP BY kind""",
    "time_layouts": f"{_EVENTS} SELECT event_id, ms AS iso_offset, {_SECONDS} AS clf, {_SECONDS} AS epoch_s, ms AS epoch_ms, ms AS epoch_frac, ms AS field_ms FROM e",
    "strptime_custom": f"{_EVENTS} SELECT event_id, {_SECONDS} AS dotted, ms // 60000 * 60000 AS clock12, ms AS millis, {_SECONDS} - 3600000 AS zoned FROM e",
    "pattern_format": _record(8, _SECONDS, f"CASE WHEN word = 'weird' THEN 0 ELSE {_LEVEL} END", "svc", "'event ' || event_id"),
    "csv_records": f"""{_EVENTS} SELECT row_number() OVER (ORDER BY event_id) AS rec_no, ms AS ts_ms,
        (CASE WHEN event_id % 4 <> 0 AND word <> 'weird' THEN {_LEVEL} WHEN event_id % 4 <= 1 THEN 2 WHEN event_id % 4 = 2 THEN 1 ELSE 0 END)::INTEGER AS level,
        svc AS service, 'event, "' || event_id || '"' || chr(10) || 'more' AS message FROM e""",
    "fold_lines": f"""{_LINES}, s AS (SELECT *, sum(CASE WHEN continues AND line_no > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) AS g FROM c)
        SELECT file_id, (g - 1)::BIGINT AS row_seq, min(line_no)::BIGINT AS line_no, (count(*) - 1)::INTEGER AS folded, octet_length(encode(string_agg(value, chr(10) ORDER BY line_no)))::INTEGER AS raw_bytes,
        md5(string_agg(value, chr(10) ORDER BY line_no)) AS raw_md5 FROM s GROUP BY file_id, g""",
    "continuations": f"{_LINES} SELECT file_id, line_no::BIGINT AS line_no, continues FROM c",
    "line_numbers": f"{_ROWS} SELECT event_id, row_number() OVER (PARTITION BY file_id ORDER BY row_seq) AS line_no FROM l",
    "effective_ts": f"{_ROWS} SELECT event_id, eff_ts FROM l",
    "merge_order": f"{_ROWS} SELECT event_id, row_number() OVER (ORDER BY eff_ts NULLS FIRST, file_id, row_seq)::INTEGER AS place FROM l",
    **{k: f"{_ROWS} SELECT event_id, level, eff_ts FROM l WHERE {v}" for k, v in _WHERE.items()},
    "documents_search": f"SELECT doc_id FROM documents WHERE contains({_FOLDED.format('text')}, 'ention the')",
    "facet_levels": f"""{_ROWS} SELECT x::INTEGER AS level, (['ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', '—'])[1 + x] AS name, count(level) AS rows
        FROM range(6) t(x) LEFT JOIN l ON level = x GROUP BY x""",
    "facet_services": f"{_ROWS} SELECT service, count(*) AS rows FROM l WHERE service IS NOT NULL GROUP BY service",
    "facet_files": f"{_ROWS} SELECT file_id, file, count(*) AS rows, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM l GROUP BY file_id, file",
    "histogram": _histogram(_ROWS, "WHERE true").replace("FILTER ((WHERE true) AND", "FILTER (WHERE"),
    "histogram_filtered": _histogram(_ROWS, "WHERE level IN (0, 1)").replace("FILTER ((WHERE level IN (0, 1)) AND", "FILTER (WHERE level IN (0, 1) AND"),
    "page_rows": f"{_ROWS} SELECT file_id, row_seq, ts_ms, level, service, message FROM l WHERE level IN (0, 1) ORDER BY eff_ts NULLS FIRST, file_id, row_seq LIMIT 50 OFFSET 40",
    "deep_page": f"""{_ROWS}, o AS (SELECT row_number() OVER (ORDER BY eff_ts NULLS FIRST, file_id, row_seq) - 1 AS place, file_id, row_seq, eff_ts, message FROM l)
        SELECT *, (SELECT count(*) FROM o WHERE eff_ts IS NULL OR eff_ts < 1706400000000) AS seek FROM o
        WHERE place >= (SELECT count(*) // 2 FROM o) AND place < (SELECT count(*) // 2 FROM o) + 256""",
    "position_for_time": f"{_ROWS} SELECT count(*) FILTER (WHERE eff_ts IS NULL OR eff_ts < 1706650000000) AS position FROM l WHERE file_id = 1",
    "service_cap": f"""{_ROWS}, f AS (SELECT svc FROM l GROUP BY svc ORDER BY min((file_id, row_seq)) LIMIT 40)
        SELECT f.svc AS service, count(*) AS n FROM l LEFT JOIN f USING (svc) GROUP BY f.svc""",
    "detail_fields_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "detail_fields_logfmt": f"{_EVENTS} SELECT event_id, 4::INTEGER AS n, svc AS service, 'event \"' || event_id || '\"' AS msg FROM e",
    "approx_bytes": f"{_ROWS} SELECT sum(octet_length(encode(raw)))::BIGINT AS bytes FROM l",
    "levels": f"""{_EVENTS}, x AS (SELECT (['ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE', '—'])[1 + {_LEVEL}] AS by_word, event_id % 8 * 10 - 5 AS n FROM e)
        SELECT by_word, CASE WHEN n >= 50 THEN 'ERROR' WHEN n >= 40 THEN 'WARN' WHEN n >= 30 THEN 'INFO' WHEN n >= 20 THEN 'DEBUG' WHEN n >= 10 THEN 'TRACE' ELSE '—' END AS by_number, count(*) AS n FROM x GROUP BY 1, 2""",
    "display_formats": """WITH d AS (SELECT doc_id, n_chars, doc_id % 400 * 3600000 AS ms, text AS t FROM documents)
        SELECT doc_id, CASE WHEN n_chars * 1000 + 1 < 1024 THEN (n_chars * 1000 + 1) || ' B' WHEN n_chars * 1000 + 1 < 1048576 THEN printf('%.1f KB', (n_chars * 1000 + 1) / 1024.0) ELSE printf('%.1f MB', (n_chars * 1000 + 1) / 1048576.0) END AS size,
        CASE WHEN ms < 60000 THEN ms // 1000 || 's' WHEN ms < 86400000 THEN ms // 3600000 || 'h' ELSE ms // 86400000 || 'd' END AS bucket,
        (CASE WHEN instr(lower(t), 'th') > 0 THEN instr(lower(t), 'th') - 1 ELSE length(t) END)::INTEGER AS before,
        CASE WHEN instr(lower(t), 'th') > 0 THEN substr(t, instr(lower(t), 'th'), 2) ELSE '' END AS hit FROM d""",
    "signature": f"""{_EVENTS}, x AS (SELECT CASE event_id % 6
        WHEN 0 THEN '{{"time":"#-#-#T#:#:#.#Z","level":"' || word || '","service":"u#","msg":"event #"}}'
        WHEN 1 THEN 'ts=#-#-#T#:#:#.#Z level=' || word || ' service=u# msg="event \\"#\\""'
        WHEN 2 THEN '#.#.#.# - u# [#/' || strftime(make_timestamp(ms * 1000), '%b') || '/#:#:#:# +#] "GET /e/# HTTP/#.#" # # "-" "ua"'
        WHEN 3 THEN strftime(make_timestamp(ms * 1000), '%b') || ' # #:#:# host# u#[#]: ' || upper(word) || ' event #'
        WHEN 4 THEN '#-#-# #:#:#,# ' || upper(word) || ' com.app.u# - event #' ELSE 'event number #' END AS s FROM e) SELECT 'line:' || s AS signature, count(*) AS n FROM x GROUP BY 1""",
    "flagship": _histogram(f"""{_EVENTS}, k AS (SELECT event_id, event_id % 6 AS f, ms, word FROM e), q AS (SELECT event_id,
        CASE WHEN f IN (0, 1, 4) THEN ms WHEN f IN (2, 3) THEN {_SECONDS} END AS ts_ms,
        CASE WHEN f IN (0, 1, 4) THEN {_LEVEL} WHEN f = 2 THEN CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END WHEN f = 3 THEN CASE WHEN word = 'weird' THEN 2 ELSE {_LEVEL} END ELSE 5 END AS level FROM k),
        l AS (SELECT level, max(ts_ms) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff_ts FROM q)""", "WHERE level IN (0, 1)").replace("FILTER ((WHERE level IN (0, 1)) AND", "FILTER (WHERE level IN (0, 1) AND"),
}
