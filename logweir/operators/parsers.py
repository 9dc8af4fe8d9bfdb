"""One log line to one record: struct(kind, ts, level, service, message), by Column expressions alone.

The families are tried in a fixed order and the first that fits is taken; a line that fits none is a raw record. Parsing
is a chain of projections (line_stages): a line's family, then where its time, level, service and message stand, then
their values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.levels import INFO, UNKNOWN, level_from_number, level_from_status, level_from_text
from ..functions.staged import PREFIX, Stage, Values, named, value, with_stages
from ..functions.timestamps import is_field_time, kept_time_stages, number_timestamp, other_time

JSON, LOGFMT, ACCESS, SYSLOG, GENERIC, RAW, CONTINUATION, CSV, CUSTOM = range(9)
KINDS = ("json", "logfmt", "access", "syslog", "generic", "raw", "continuation", "csv", "custom")
#: The keys of structured lines, in order of preference.
TIME_KEYS = ("time", "timestamp", "ts", "@timestamp", "datetime", "date", "t", "asctime")
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "log.level", "levelname")
MESSAGE_KEYS = ("msg", "message", "event", "text", "body")
SERVICE_KEYS = ("service", "logger", "name", "app", "component", "module", "source", "container")
SERVICE_LENGTH, PAIRS = 128, 64
#: The largest method that the JVM compiles; it interprets those above for as long as they run. Projections that don't fit into one method together
#: are generated one by one, in small methods.
METHOD_BYTES = 8000
#: The patterns of the families.
PAIR = r'[A-Za-z0-9_.@-]+=(?:"(?:[^"\\]|\\.)*"|\S*)'
ACCESS_LINE = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([A-Z]+) (\S+)[^"]*" (\d{3}) (\S+)'
SYSLOG_LINE = r"^[A-Za-z]{3} {1,2}\d{1,2} \d{2}:\d{2}:\d{2} (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
LEVEL_TOKEN = r"(?i)(?:^|[\s\[|(])(FATAL|CRITICAL|SEVERE|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE|FINE|VERBOSE)(?:[\s\]|):,-]|$)"
GENERIC_SERVICE = r"(?:\]\s*|\s)([A-Za-z][A-Za-z0-9_.$-]{2,64})\s+-\s+|\[([A-Za-z][A-Za-z0-9_.:-]{1,48})\]"
CONTINUES = r"^(?:[\s ﻿]+|at\s+\S|Caused by:|\.\.\. \d+ (?:more|common frames)|Traceback \(|goroutine \d|-->|\tat )"


def configure(spark: SparkSession) -> None:
    """The session settings that parsing relies on: UTC, the last of repeated keys, and a bound on the methods of generated code."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.mapKeyDedupPolicy", "LAST_WIN"), ("spark.sql.variant.allowDuplicateKeys", "true"), ("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))):
        spark.conf.set(key, value)


def record(kind, ts: Column, level: Column, service: Column, message: Column) -> Column:
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).cast("int").alias("kind"), ts.cast("bigint").alias("ts"),
        level.cast("int").alias("level"), service.cast("string").alias("service"), message.cast("string").alias("message"),
    )


def first_of(values: Column, value: Callable[[Column], Column]) -> Column:
    """The first of an array's elements for which value() isn't null."""
    return F.get(F.filter(F.transform(values, value), lambda x: x.isNotNull()), F.lit(0))


def known_level(level: Column) -> Column:
    return F.nullif(level, F.lit(UNKNOWN))


def service_name(value: Column) -> Column:
    return F.when((F.length(value) > 0) & (F.length(value) <= SERVICE_LENGTH), value)


# --- JSON ---------------------------------------------------------------------------------------


def wrapped_json(line: Column) -> Column:
    """A line that begins as an object, as the only element of a list: what stands behind it would be another element."""
    return F.when(line.startswith("{"), F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))))


def only_element(line: Column, wrapped: Column) -> Column:
    """The list's element if the line is nothing else. A line with a bracket may have closed the list early, which a second wrapping refuses."""
    whole = ~F.contains(line, F.lit("]")) | F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}"))).isNotNull()
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull() & whole, F.try_variant_get(wrapped, "$[0]", "variant"))


def json_object(line: Column) -> Column:
    """The line as a variant if it is one JSON object and nothing else."""
    return bind(wrapped_json(line), lambda wrapped: only_element(line, wrapped))


def json_fields(line: Column) -> Column:
    """The object's fields, each as JSON text."""
    return json_object(line).try_cast("map<string,variant>")


def json_values(keys: tuple[str, ...]) -> list[str]:
    """SQL for the values of keys in the stages' `body`."""
    return [f"""try_variant_get({PREFIX}body, '$["{key}"]', 'variant')""" for key in keys]


NUMERIC = ("BIGINT", "DOUBLE", "FLOAT")


def variant_text(value: Column) -> Column:
    """A variant's text if it is a string."""
    return F.when(F.schema_of_variant(value) == "STRING", value.try_cast("string"))


def variant_number(value: Column, kind: Column) -> Column:
    """A variant's number, given its kind, if it is one."""
    return F.when(kind.isin(*NUMERIC) | kind.startswith("DECIMAL"), value.try_cast("double"))


def is_json_time(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(F.when(kind == "STRING", is_field_time(value.try_cast("string"))).otherwise(number_timestamp(variant_number(value, kind)).isNotNull()), F.lit(False))


def json_level(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", level_from_text(value.try_cast("string")))
    number = variant_number(value, kind)
    return known_level(F.coalesce(text, F.when(number.isNotNull(), level_from_number(number))))


# --- key=value ----------------------------------------------------------------------------------


def logfmt_pairs(line: Column, most: int | None = PAIRS) -> Column:
    found = F.regexp_extract_all(line, F.lit(PAIR), F.lit(0))
    return F.slice(found, 1, most) if most else found


def pairs_map(pairs: Column) -> Column:
    """Keys and values; a key's last value counts. A quoted value loses its first and its last character, whatever that is."""

    def entry(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        raw = F.substring(pair, F.length(key) + 2, F.length(pair))
        inner = F.regexp_replace(F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0))), r"\\(.)", "$1")
        return F.struct(key.alias("key"), F.when(raw.startswith('"'), inner).otherwise(raw).alias("value"))

    return F.map_from_entries(F.transform(pairs, entry))


def logfmt_map(line: Column, most: int | None = PAIRS) -> Column:
    """A line's keys and values. most: how many pairs are read."""
    return pairs_map(logfmt_pairs(line, most))


# --- lines --------------------------------------------------------------------------------------


def access_fields(line: Column) -> Column:
    names = ("remote", "user", "time", "method", "path", "status", "bytes")
    pairs = [x for k, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(line, ACCESS_LINE, k))]
    return F.when(line.rlike(ACCESS_LINE), F.create_map(*pairs))


@lru_cache(maxsize=64)
def line_stages(context: int, now_ms: int | None = None, year: int | None = None, only: int | None = None) -> list[dict[str, Column]]:
    """Stages from `line` to its record: kind, ts, level, service, message. context: what they are kept for.

    The family comes first, then the texts that hold its time, level, service and message, and only then is one time read,
    whatever the family. Of several keys for one purpose, the first whose value will do counts: most often that is the
    first that is there, so the others are looked at only where it won't. only: the family that the lines are known to
    have; other lines have null records."""
    families = (JSON, ACCESS, SYSLOG, LOGFMT, GENERIC) if only is None else (only,)
    none = lambda kind: F.lit(None).cast(kind)
    maybe = lambda family, make, kind="string": make() if family in families else none(kind)
    is_kind = lambda v, family: (v("family") == family) if family in families else F.lit(False)

    def family(v: Values) -> dict[str, Column]:
        if only in (ACCESS, SYSLOG, GENERIC):
            return {"family": F.lit(only)}
        out = F.when(v("body").isNotNull(), F.lit(JSON))
        return {"family": out if only is not None else out.when(v("line").rlike(ACCESS_LINE), F.lit(ACCESS)).when(v("line").rlike(SYSLOG_LINE), F.lit(SYSLOG))}

    def loose(v: Values) -> dict[str, Column]:
        enough = lambda: F.when(F.size(F.array_remove(F.map_values(v("fields")), "")) >= 2, F.lit(LOGFMT))
        return {"family": F.coalesce(v("family"), maybe(LOGFMT, enough, "int"), maybe(GENERIC, lambda: F.lit(GENERIC), "int"))}

    def pick(first: Column, keys: tuple[str, ...], made: Callable[[Column], Column]) -> Column:
        """made() of the first value at hand, or else of the first other for which it isn't null."""
        return F.when(first.isNotNull(), F.coalesce(made(first), first_of(F.expr(f"array({', '.join(json_values(keys))})"), made)))

    def keyed(first: Column, keys: tuple[str, ...], made: Callable[[Column], Column]) -> Column:
        """The same for a line of keys and values."""
        return F.when(first.isNotNull(), F.coalesce(made(first), first_of(F.lit(list(keys)), lambda k: made(F.try_element_at(value("fields"), k)))))

    def picks(v: Values) -> dict[str, Column]:
        text = lambda t: F.nullif(t, F.lit(""))
        roles = {"level": (LEVEL_KEYS, json_level, lambda t: known_level(level_from_text(t))), "service": (SERVICE_KEYS, lambda x: service_name(variant_text(x)), service_name), "message": (MESSAGE_KEYS, lambda x: text(variant_text(x)), text)}
        out = {"json_time": maybe(JSON, lambda: pick(v("json_time"), TIME_KEYS, lambda x: F.when(is_json_time(x), x)), "variant"), "key_time": maybe(LOGFMT, lambda: keyed(v("first_time"), TIME_KEYS, lambda t: F.when(is_field_time(t), t)))}
        for role, (keys, of_json, of_text) in roles.items():
            kind = "int" if role == "level" else "string"
            out[role] = F.coalesce(maybe(JSON, lambda: pick(v(f"json_{role}"), keys, of_json), kind), maybe(LOGFMT, lambda: keyed(v(f"first_{role}"), keys, of_text), kind))  # noqa: B023
        return out

    def spans(v: Values) -> dict[str, Column]:
        return {
            "bracket": maybe(ACCESS, lambda: F.when(is_kind(v, ACCESS), F.regexp_extract(v("line"), ACCESS_LINE, 3))), "status": maybe(ACCESS, lambda: F.when(is_kind(v, ACCESS), F.regexp_extract(v("line"), ACCESS_LINE, 6))),
            "body_text": maybe(SYSLOG, lambda: F.when(is_kind(v, SYSLOG), F.regexp_extract(v("line"), SYSLOG_LINE, 4))),
        }

    def time_text(v: Values) -> dict[str, Column]:
        by_json = maybe(JSON, lambda: variant_text(v("json_time")))
        return {"time_text": F.when(is_kind(v, JSON), by_json).when(is_kind(v, ACCESS), v("bracket")).otherwise(F.coalesce(v("key_time"), v("line")))}

    def field_time(v: Values) -> dict[str, Column]:
        """Keys' values may also be numbers or dates."""
        text = F.when(v("ts").isNull() & (is_kind(v, JSON) | v("key_time").isNotNull()), other_time(v("time_text")))
        number = maybe(JSON, lambda: F.when(v("json_time").isNotNull(), number_timestamp(variant_number(v("json_time"), F.schema_of_variant(v("json_time"))))), "bigint")
        return {"ts": F.coalesce(v("ts"), text, number)}

    def token(v: Values) -> dict[str, Column]:
        """The first level word in the head of what is said."""
        said = F.coalesce(v("body_text"), F.when(is_kind(v, GENERIC), v("line")))
        after = F.when(is_kind(v, GENERIC) & v("ts").isNotNull(), F.substring(v("line"), v("stop") + 1, F.lit(120)))
        return {"token": F.regexp_extract(F.substring(said, 1, 160), LEVEL_TOKEN, 1), "after": after}

    def level(v: Values) -> dict[str, Column]:
        spoken = known_level(level_from_text(v("token")))
        said = F.when(is_kind(v, SYSLOG), F.coalesce(spoken, F.lit(INFO))).when(is_kind(v, GENERIC), spoken).when(is_kind(v, ACCESS), level_from_status(v("status").try_cast("int")))
        group = lambda k: F.nullif(F.regexp_extract(v("after"), GENERIC_SERVICE, k), F.lit(""))
        return {"level": F.coalesce(v("level"), said, F.lit(UNKNOWN)).cast("int"), "name": maybe(GENERIC, lambda: F.coalesce(group(1), group(2)))}

    def rest(v: Values) -> dict[str, Column]:
        process = maybe(SYSLOG, lambda: F.when(is_kind(v, SYSLOG), F.regexp_extract(v("line"), SYSLOG_LINE, 2)))
        request = maybe(ACCESS, lambda: F.when(is_kind(v, ACCESS), F.concat_ws(" ", v("status"), F.regexp_extract(v("line"), ACCESS_LINE, 4), F.regexp_extract(v("line"), ACCESS_LINE, 5))))
        raw = is_kind(v, GENERIC) & v("stop").isNull() & (v("level") == UNKNOWN)
        return {
            "service": F.coalesce(v("service"), process, maybe(GENERIC, lambda: F.when(level_from_text(v("name")) == UNKNOWN, v("name")))),
            "message": F.coalesce(v("message"), request, F.nullif(v("body_text"), F.lit("")), v("line")), "kind": F.when(raw, F.lit(RAW)).otherwise(v("family")).cast("int"),
        }

    def first_values(role: str, keys: tuple[str, ...]) -> Stage:
        return lambda v: {f"json_{role}": F.expr(f"coalesce({', '.join(json_values(keys))})")}

    def first_keyed(v: Values) -> dict[str, Column]:
        keys = {"time": TIME_KEYS, "level": LEVEL_KEYS, "service": SERVICE_KEYS, "message": MESSAGE_KEYS}
        return {f"first_{role}": F.when(v("family") == LOGFMT, F.coalesce(*[F.try_element_at(v("fields"), F.lit(k)) for k in of])) for role, of in keys.items()}

    structured = [
        lambda v: {"wrapped": wrapped_json(v("line"))}, lambda v: {"body": only_element(v("line"), v("wrapped"))}, first_values("time", TIME_KEYS), first_values("level", LEVEL_KEYS),
        first_values("service", SERVICE_KEYS), first_values("message", MESSAGE_KEYS),
    ]
    paired = [
        lambda v: {"pairs": F.when(v("family").isNull() & F.contains(v("line"), F.lit("=")), logfmt_pairs(v("line")))},
        lambda v: {"fields": F.when(F.size(v("pairs")) >= 2, pairs_map(v("pairs")))},
    ]
    before, after = [
        *(structured if JSON in families else [lambda v: {"body": none("variant")}]), family, *(paired if LOGFMT in families else [lambda v: {"fields": none("map<string,string>")}]),
        loose, *([first_keyed] if LOGFMT in families else []), picks, spans, time_text,
    ], [field_time, token, level, rest]
    return [*named(before), *kept_time_stages(context, now_ms, year), *named(after)]


RECORD = ("kind", "ts", "level", "service", "message")


def with_line_record(df: DataFrame, line: Column, now_ms: int | None = None, year: int | None = None, only: int | None = None, ts: str = "ts_ms") -> DataFrame:
    """Adds the record of each line: kind, ts_ms, level, service, message. now_ms: what tells the year of dates without one."""
    stages = line_stages(id(df.sparkSession.sparkContext), now_ms, year, only)
    return with_stages(df, stages, {"line": line}, {ts if c == "ts" else c: c for c in RECORD})


def is_continuation(line: Column) -> Column:
    return (line == "") | line.rlike(CONTINUES)
