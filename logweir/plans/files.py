"""Registered queries that write text files from the tables, read them through a session, and ask about them.

The files have what rendered lines of a table lack: line ends with CRs, continuation lines, several files in a folder, quoted records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import UNKNOWN, level_from_text
from ..functions.strptime import compile_time_format
from ..functions.timestamps import field_stages, with_times
from ..operators import delimited, query
from ..operators.custom import ColumnSpec, PatternSpec, compile_pattern_format
from ..operators.parsers import ACCESS, configure
from ..operators.search_index import SearchIndex
from ..session import LogSession
from ..work import cut, new_dir
from .catalog import _EVENTS, _LEVEL, _LINES, _ROWS, _SECONDS, _STEP, FAMILIES, NOW_MS, SPECS, document_lines, events, line_of, logs, mixed_lines, stamp

LOG_COLUMNS = ("row_seq", "line_no", "kind", "ts_ms", "eff_ts", "level", "service", "folded")
MANY = 5
DOTTED = PatternSpec((r"^(?<timestamp>[\d.]+ [\d:]+) \| (?<level>\w+) \| (?<service>\w+) \| (?<message>.*)$",), ("%d.%m.%Y %H:%M:%S",), {"error": ("weird",)})


def written(df: DataFrame, name: str) -> str:
    """Writes line by event_id as text into the shared folder: a file for each range of events, named in their order."""
    path = new_dir(df.sparkSession, name)
    df.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.col("line").alias("value")).write.text(path)
    return path


def session_of(spark: SparkSession) -> LogSession:
    configure(spark)
    return LogSession(spark, now_ms=NOW_MS, max_services=None)


def with_trace() -> Column:
    """A CR behind some lines, and a frame of a stack below others."""
    line = F.concat("line", F.when(F.col("event_id") % 5 == 0, F.lit("\r")).otherwise(F.lit("")))
    return F.concat(line, F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("\n\tat app.Main.run(Main.java:"), F.col("event_id").cast("string"), F.lit(")"))).otherwise(F.lit("")))


def ingest_log_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all families with stack frames, written as a folder of files, added by its path."""
    session = session_of(spark)
    session.add_file(written(mixed_lines(spark, sf_dir).withColumn("line", with_trace()), "mixed.log"))
    return session.logs().select(*LOG_COLUMNS, F.octet_length("raw").alias("raw_bytes"))


def ingest_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines dealt to files by number, each a folder of its own, added at once: they become rows in one pass."""
    configure(spark)
    path = new_dir(spark, "many")
    lines = mixed_lines(spark, sf_dir).withColumn("line", with_trace()).select("event_id", (F.floor(F.col("event_id") / 11) % MANY).alias("of"), F.col("line").alias("value"))
    lines.repartitionByRange("event_id").sortWithinPartitions("of", "event_id").drop("event_id").write.partitionBy("of").text(path)
    session = session_of(spark)
    session.add_files([f"{path}/of={k}" for k in range(MANY)])
    return session.logs().select("file_id", *LOG_COLUMNS, F.octet_length("raw").alias("raw_bytes"))


def ingest_taught_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a format that is taught to the session; lines that don't match it go on with the row before. A second file,
    whose first line has the same shape (and level word), is read by what was taught."""
    lines = events(spark, sf_dir).withColumn("line", line_of("dotted"))
    more = F.when(F.col("event_id") % 6 == 1, F.lit("\nthat was all")).otherwise(F.lit(""))
    session = session_of(spark)
    first = session.add_file(written(lines.where("event_id div 7 % 2 = 0"), "one.log"))
    session.teach(first.file_id, DOTTED)
    session.add_file(written(lines.where("event_id div 7 % 2 = 1").withColumn("line", F.concat("line", more)), "two.log"))
    return session.logs().select("file_id", *LOG_COLUMNS, "message")


def ingest_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited export whose dialect is sniffed, with roles by header name; a few records have line feeds inside."""
    text = F.col("event_id").cast("string")
    more = F.when(F.col("event_id") % 100 == 99, F.lit("\nmore")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(";", stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("word"), (F.lit(200) + F.col("event_id") % 4 * 100).cast("string"), F.col("svc")), F.lit(';"event; ""'), text, F.lit('""'), more, F.lit('"'))
    head = spark.createDataFrame([(-1, "timestamp;severity;status;actor;note")], "event_id bigint, line string")
    path = written(head.union(events(spark, sf_dir).select(F.col("event_id").cast("bigint"), line)), "export.csv")
    session = session_of(spark)
    session.add_file(path, spec=ColumnSpec(level="(none)", service="actor", message="note"))
    return session.logs().select("row_seq", "kind", "ts_ms", "eff_ts", "level", "service", "message")


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a question, in one pass by grouping sets."""
    df = logs(spark, sf_dir)
    found = query.summary(df, SPECS["filter_levels"], query.totals_of(df))
    return found.select("part", "level", "service", "file_id", "bucket", "n", "hits", "errors", "warns", F.col("first_row.file_id").alias("first_file"), F.col("first_row.row_seq").alias("first_place"), "first_ts", "last_ts")


def detail_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.lit(0).alias("file_id"), F.col("event_id").alias("row_seq"), F.lit(ACCESS).alias("kind"), line_of("access").alias("raw"))
    fields = query.detail(rows).select("row_seq", "fields")
    return fields.select(F.col("row_seq").alias("event_id"), *[F.element_at("fields", k).alias(k) for k in ("remote", "user", "time", "method", "path", "status", "bytes")])


def detail_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a record by header name; empty ones are left out."""
    text = F.col("event_id").cast("string")
    raw = F.concat(F.lit('"a, ""'), text, F.lit('""",'), F.when(F.col("event_id") % 3 != 0, F.col("svc")).otherwise(F.lit("")), F.lit(','), F.col("word"))
    fields = delimited.record_fields(delimited.record_cells(F.col("raw"), ","), ("note", "user", "level"))
    df = events(spark, sf_dir).select("event_id", raw.alias("raw")).select("event_id", fields.alias("fields"))
    return df.select("event_id", F.size("fields").alias("n"), *[F.element_at("fields", k).alias(k) for k in ("note", "user", "level")])


def detail_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups of a taught format; null for lines that it doesn't match."""
    configure(spark)
    made = compile_pattern_format(DOTTED, spark)
    line = F.when(F.col("event_id") % 9 != 0, line_of("dotted")).otherwise(line_of("raw"))
    df = events(spark, sf_dir).select("event_id", line.alias("line")).select("event_id", made.fields(F.col("line")).alias("fields"))
    return df.select("event_id", *[F.element_at("fields", k).alias(k) for k in ("level", "service", "message")])


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in the lines of all documents that reads only stretches which can match, tested again row by row."""
    lines = cut(document_lines(spark, sf_dir).select("file_id", F.col("line_no").alias("row_seq"), F.col("value").alias("raw"), F.upper("value").alias("message")), "lines")
    index = SearchIndex.build(lines, 16)
    needle = "Ention The"
    return index.narrowed(lines, needle).where(query.text_match(needle)).select("file_id", F.col("row_seq").alias("line_no"))


def untidy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values with white space of all kinds around them, numbers with letters behind them, and dates in words."""
    df = events(spark, sf_dir)
    seconds = F.floor(F.col("ms") / 1000).cast("string")
    padded = lambda x: F.concat(F.lit("\t　"), x, F.lit("\r\n "))
    texts = {
        "spaced": padded(seconds), "suffixed": F.concat(F.lit(" "), seconds, F.when(F.col("event_id") % 2 == 0, F.lit("d")).otherwise(F.lit("F"))), "in_words": stamp("EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        "month_first": padded(stamp("MMMM d, yyyy h:mm a")), "slashed": stamp("M/d/yyyy"), "script": F.concat(F.date_format(F.timestamp_millis(F.col("ms") - 3_600_000), "EEE MMM dd yyyy HH:mm:ss 'GMT-0100'"), F.lit(" (x)")),
    }
    level, day = padded(F.upper("word")), padded(stamp("yyyy.MM.dd"))
    df = df.select("event_id", level.alias("_level"), day.alias("_day"), *[t.alias(f"_{k}") for k, t in texts.items()])
    df = with_times(df, {k: F.col(f"_{k}") for k in texts}, field_stages(F.lit(NOW_MS)))
    df = with_times(df, {"day": F.col("_day")}, compile_time_format("%Y.%m.%d").stages())
    return df.select("event_id", level_from_text(F.col("_level")).alias("level"), "day", *texts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_log_folder": ingest_log_folder, "ingest_many_files": ingest_many_files, "ingest_taught_format": ingest_taught_format, "ingest_csv_file": ingest_csv_file, "question_counts": question,
    "detail_fields_access": detail_access, "detail_fields_csv": detail_csv, "detail_fields_custom": detail_custom, "indexed_search": indexed_search, "untidy_values": untidy_values,
}

_RENDERED = {f: f"event_id % {len(FAMILIES)} = {k}" for k, f in enumerate(FAMILIES)}
_SYSLOG_LEVEL = f"CASE WHEN word = 'weird' THEN 2 ELSE {_LEVEL} END"
_STATUS_LEVEL = "CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END"
_ISO = "strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
_CLF = "strftime(make_timestamp(ms * 1000), '%d/%b/%Y:%H:%M:%S')"
_SYSLOG_TIME = "strftime(make_timestamp(ms * 1000), '%b %-d %H:%M:%S')"
_COMMA = "strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S,%g')"


def _ingested(file: str = "", parts: str = "") -> str:
    """Rows of the mixed lines with stack frames, numbered in each of `parts`."""
    return f"""{_EVENTS}, x AS (SELECT *, event_id % 6 AS f, row_number() OVER ({parts}ORDER BY event_id) - 1 AS row_seq, (event_id % 7 = 0)::INTEGER AS folded FROM e),
    q AS (SELECT event_id, row_seq, folded, f::INTEGER AS kind, CASE WHEN f IN (0, 1, 4) THEN ms WHEN f IN (2, 3) THEN {_SECONDS} END AS ts_ms,
        (CASE WHEN f IN (0, 1, 4) THEN {_LEVEL} WHEN f = 2 THEN {_STATUS_LEVEL} WHEN f = 3 THEN {_SYSLOG_LEVEL} ELSE {UNKNOWN} END)::INTEGER AS level,
        CASE WHEN f IN (0, 1, 3) THEN svc WHEN f = 4 THEN 'com.app.' || svc END AS service,
        CASE f WHEN 0 THEN '{{"time":"' || {_ISO} || '","level":"' || word || '","service":"' || svc || '","msg":"event ' || event_id || '"}}'
            WHEN 1 THEN 'ts=' || {_ISO} || ' level=' || word || ' service=' || svc || ' msg="event \\"' || event_id || '\\""'
            WHEN 2 THEN '10.0.0.1 - ' || svc || ' [' || {_CLF} || ' +0000] "GET /e/' || event_id || ' HTTP/1.1" 200 512 "-" "ua"'
            WHEN 3 THEN {_SYSLOG_TIME} || ' host1 ' || svc || '[' || event_id || ']: ' || upper(word) || ' event ' || event_id
            WHEN 4 THEN {_COMMA} || ' ' || upper(word) || ' com.app.' || svc || ' - event ' || event_id ELSE 'event number ' || event_id END AS line FROM x)
    SELECT {file}row_seq, row_seq + 1 + coalesce(sum(folded) OVER ({parts}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_no, kind, ts_ms,
        max(ts_ms) OVER ({parts}ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff_ts, level, service, folded,
        (octet_length(encode(line)) + CASE WHEN folded = 1 THEN 29 + length(event_id::VARCHAR) ELSE 0 END)::INTEGER AS raw_bytes FROM q"""


ORACLE_SQL: dict[str, str] = {
    "ingest_log_folder": _ingested(),
    "ingest_many_files": _ingested(f"(event_id // 11 % {MANY})::INTEGER AS file_id, ", f"PARTITION BY event_id // 11 % {MANY} "),
    "ingest_taught_format": f"""{_EVENTS}, x AS (SELECT *, (event_id // 7 % 2)::INTEGER AS file_id, row_number() OVER (PARTITION BY event_id // 7 % 2 ORDER BY event_id) - 1 AS row_seq FROM e)
        SELECT file_id, row_seq, row_seq + 1 AS line_no, 8::INTEGER AS kind, {_SECONDS} AS ts_ms, max({_SECONDS}) OVER (PARTITION BY file_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff_ts,
            (CASE WHEN word = 'weird' THEN 0 ELSE {_LEVEL} END)::INTEGER AS level, svc AS service, (event_id // 7 % 2 = 1 AND event_id % 6 = 1)::INTEGER AS folded, 'event ' || event_id AS message FROM x""",
    "ingest_csv_file": f"""{_EVENTS} SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_seq, {delimited.CSV}::INTEGER AS kind, ms AS ts_ms, max(ms) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff_ts,
        (CASE WHEN event_id % 4 <= 1 THEN 2 WHEN event_id % 4 = 2 THEN 1 ELSE 0 END)::INTEGER AS level, svc AS service,
        'event; "' || event_id || '"' || CASE WHEN event_id % 100 = 99 THEN chr(10) || 'more' ELSE '' END AS message FROM e""",
    "question_counts": f"""{_ROWS}, p AS (SELECT step, low // step * step AS start, greatest(1, ceil((high - low // step * step + 1) / step))::BIGINT AS last FROM {_STEP}),
        b AS (SELECT l.*, least(last - 1, (eff_ts - start) // step) AS bucket FROM l, p),
        g AS (SELECT grouping(level) + 2 * grouping(service) + 4 * grouping(file_id) + 8 * grouping(bucket) AS k, level, service, file_id, bucket, count(*) AS n, count(*) FILTER (WHERE level IN (0, 1)) AS hits,
            count(*) FILTER (WHERE level = 0) AS errors, count(*) FILTER (WHERE level = 1) AS warns, min((file_id, row_seq)) AS first_row, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts
            FROM (SELECT level, service, file_id, row_seq, ts_ms, bucket FROM b) GROUP BY GROUPING SETS ((level), (service), (file_id), (bucket)))
        SELECT CASE k WHEN 14 THEN 'level' WHEN 13 THEN 'service' WHEN 11 THEN 'file' ELSE 'bucket' END AS part, level, service, file_id, bucket, n, hits, errors, warns,
            first_row[1] AS first_file, first_row[2] AS first_place, first_ts, last_ts FROM g WHERE k <> 13 OR service IS NOT NULL""",
    "detail_fields_access": f"""{_EVENTS} SELECT event_id, '10.0.0.1' AS remote, svc AS "user", {_CLF} || ' +0000' AS "time", 'GET' AS method, '/e/' || event_id AS path,
        (['200', '404', '502'])[1 + event_id % 3] AS status, '512' AS bytes FROM e""",
    "detail_fields_csv": f"""{_EVENTS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END::INTEGER AS n, 'a, "' || event_id || '"' AS note, CASE WHEN event_id % 3 <> 0 THEN svc END AS "user", word AS level FROM e""",
    "detail_fields_custom": f"""{_EVENTS} SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN word END AS level, CASE WHEN event_id % 9 <> 0 THEN svc END AS service, CASE WHEN event_id % 9 <> 0 THEN 'event ' || event_id END AS message FROM e""",
    "indexed_search": f"{_LINES} SELECT file_id, line_no::BIGINT AS line_no FROM w WHERE contains(translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ention the') OR contains(lower(upper(value)), 'ention the')",
    "untidy_values": f"""{_EVENTS} SELECT event_id, ({_LEVEL})::INTEGER AS level, ms // 86400000 * 86400000 AS day, {_SECONDS} AS spaced, NULL::BIGINT AS suffixed, {_SECONDS} AS in_words,
        ms // 60000 * 60000 AS month_first, ms // 86400000 * 86400000 AS slashed, {_SECONDS} AS script FROM e""",
}
