"""Recognising timestamps in text, as epoch milliseconds. What carries no zone is UTC.

Dates roll over as in civil arithmetic: month 13 is January of the next year, day 45 lies in the next month.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import bind
from .staged import Stage, Values, in_expression, named, with_stages
from .text import number_of, trimmed

HEAD = 96
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: The layouts that are recognised, in the order in which they are tried.
ISO = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
CLF = r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?"
SYSLOG = r"^[A-Za-z]{3} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}"
EPOCH = r"^\d{10}(?:\d{3}|\.\d{1,6})?\b"
#: Those with a month's name, if it is one.
NAMED_CLF, NAMED_SYSLOG = (p.replace("[A-Za-z]{3}", "(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)") for p in (CLF, SYSLOG))
#: The first text of CLF's form, if it names a month.
FIRST_CLF = rf"\A(?:(?!{CLF})[\s\S])*+({NAMED_CLF})"
#: Any of these, in a text's head.
ANY = "|".join((ISO, NAMED_CLF, NAMED_SYSLOG, EPOCH))
#: How a field's value may begin with a date, besides: in words with the day or the month first, month/day/year, and by numbers
#: with the year first; each is followed by what writes it as year, month and day.
DATES = (
    (r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]{0,6}[ -](\d{4})(?!\d)", "$3 $2 $1"), (r"^([A-Za-z]{3})[a-z]{0,6}\.? (\d{1,2}),? (\d{4})(?!\d)", "$3 $1 $2"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", "$3 $1 $2"), (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)", "$1 $2 $3"),
)
#: Year, month and day, then maybe a clock of 24 or 12 hours, a zone and a remark.
WHOLE_DATE = (
    r"^(\d{4}) (\d{1,2}|[A-Za-z]{3}) (\d{1,2})(?:,?[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?: ?([AaPp])[Mm])?"
    r"(?: ?(?:Z|UTC|GMT|UT))?(?: ?([+-]\d{2}:?\d{2}))?)?(?: \([^)]*\))?\z"
)
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def whole(digits: Column) -> Column:
    """Digits as a number, null for none. A cast that fails makes an exception for each row, even where that gives null."""
    return F.when(digits != "", digits.try_cast("bigint"))


def part(text: Column, start: int, length: int) -> Column:
    """Digits at a fixed place, as a number; null where they aren't digits."""
    return whole(F.substring(text, start, length))


def civil_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, ms: Column) -> Column:
    """Epoch milliseconds of a UTC date whose month (from 1), day and time may lie outside their ranges."""
    first = F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (month - 1).cast("int"))
    days = F.unix_date(first).cast("bigint") + day - 1
    return days * DAY + hour * HOUR + minute * MINUTE + second * 1000 + ms


def month_of(name: Column) -> Column:
    """1 to 12 for three letters, null for others."""
    at = F.instr(F.lit(MONTHS), F.lower(name))
    return F.when((at > 0) & (at % 3 == 1), F.floor((at + 2) / 3))


def fraction_ms(digits: Column) -> Column:
    """Rounded milliseconds of the digits behind a decimal mark; 0 for none."""
    return F.coalesce(F.floor(F.concat(F.lit("0."), F.nullif(digits, F.lit(""))).try_cast("double") * 1000 + 0.5), F.lit(0))


def zone_ms(zone: Column) -> Column:
    """Milliseconds of an offset ±hhmm or ±hh:mm; 0 for Z or none."""
    digits = F.regexp_replace(zone, "[+:-]", "")
    size = part(digits, 1, 2) * HOUR + F.coalesce(part(digits, 3, 2), F.lit(0)) * MINUTE
    return F.coalesce(F.when(zone.startswith("-"), -size).when(zone.startswith("+"), size), F.lit(0))


def _epoch(m: Column) -> Column:
    ms = F.when(F.length(m) == 13, F.when(F.substring(m, 11, 1) == ".", fraction_ms(F.substring(m, 12, 6))).otherwise(part(m, 11, 3))).otherwise(fraction_ms(F.substring(m, 12, 6)))
    return part(m, 1, 10) * 1000 + ms


def time_stages(now_ms: Column | None = None, year: int | None = None) -> list[Stage]:
    """Stages from `time_text` to `ts` and `stop`: the first timestamp in the text's head and the number of characters up to
    its end, both null for none.

    now_ms: what tells the year of dates without one (the query's time by default); year: that year itself."""
    now_ms = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    iso, clf, syslog, epoch = range(4)

    def mark(v: Values) -> dict[str, Column]:
        """What the first layout that fits finds; the others aren't looked for."""
        head = F.substring(v("time_text"), 1, HEAD)
        find = lambda pattern: F.regexp_substr(head, F.lit(pattern))
        return {"mark": F.coalesce(find(ISO), F.nullif(F.regexp_extract(head, FIRST_CLF, 1), F.lit("")), find(NAMED_SYSLOG), find(EPOCH))}

    def layout(v: Values) -> dict[str, Column]:
        """Told by the mark: only a syslog time begins with a letter, only CLF has its third character no digit, only an epoch its fifth one a digit."""
        at = lambda k: F.substring(v("mark"), k, 1)
        return {"layout": F.when(at(1) > "9", F.lit(syslog)).when(at(3) == "/", F.lit(clf)).when(at(5).isin("-", "/"), F.lit(iso)).when(v("mark").isNotNull(), F.lit(epoch))}

    def of_layout(v: Values, *values: Column) -> Column:
        """One value for each of the layouts ISO, CLF and syslog."""
        out = F
        for k, x in enumerate(values):
            out = out.when(v("layout") == k, x)
        return out

    def fields(v: Values) -> dict[str, Column]:
        m, size = v("mark"), F.length(v("mark"))
        clock = of_layout(v, F.lit(12), F.lit(13), size - 7)
        two = lambda at: F.substring(m, at, F.lit(2)).try_cast("bigint")
        return {
            "year": of_layout(v, part(m, 1, 4), part(m, 8, 4), F.lit(year).cast("bigint") if year is not None else F.year(F.timestamp_millis(now_ms)).cast("bigint")),
            "month": of_layout(v, part(m, 6, 2), month_of(F.substring(m, 4, 3)), month_of(F.substring(m, 1, 3))),
            "day": of_layout(v, part(m, 9, 2), part(m, 1, 2), F.regexp_extract(m, r" (\d{1,2}) ", 1).try_cast("bigint")),
            "hour": two(clock), "minute": two(clock + 3), "second": two(clock + 6), "rest": of_layout(v, F.substring(m, 20, 64), F.substring(m, 22, 5)), "stop": F.instr(v("time_text"), m) + size - 1,
        }

    def small(v: Values) -> dict[str, Column]:
        rest = v("rest")
        some = (v("layout") == iso) & (rest != "")
        return {
            "ms": F.when(some, fraction_ms(F.regexp_extract(rest, r"^[.,](\d{1,9})", 1))).otherwise(F.lit(0)),
            "zone": F.when(some, zone_ms(F.regexp_extract(rest, r"([+-]\d{2}:?\d{2})$", 1))).when(v("layout") == clf, zone_ms(rest)).otherwise(F.lit(0)),
        }

    def civil(v: Values, years_ago: int = 0) -> Column:
        return civil_ms(v("year") - years_ago, *map(v, ("month", "day", "hour", "minute", "second", "ms")))

    def chosen(v: Values) -> dict[str, Column]:
        at = F.when(v("layout") == epoch, _epoch(v("mark"))).otherwise(v("civil") - v("zone"))
        if year is None:  # without a year, a date well in the future is last year's
            at = F.when((v("layout") == syslog) & (v("civil") > now_ms + 48 * HOUR), civil(v, 1)).otherwise(at)
        return {"ts": at.cast("bigint")}

    return [
        mark, layout, fields, small, lambda v: {"civil": civil(v)}, chosen,
    ]


@lru_cache(maxsize=64)
def kept_time_stages(context: int, now_ms: int | None = None, year: int | None = None) -> list[dict[str, Column]]:
    """time_stages for with_stages, made once. context: what they are kept for."""
    return named(time_stages(F.lit(now_ms) if now_ms is not None else None, year))


def find_timestamp(text: Column, now_ms: Column | None = None, year: int | None = None) -> Column:
    """struct(ts, stop) of time_stages, as one Column."""
    return in_expression(time_stages(now_ms, year), {"time_text": text}, lambda v: F.struct(v("ts").alias("ts"), v("stop").alias("stop")))


def number_timestamp(value: Column) -> Column:
    """Epoch seconds or milliseconds, told apart by size."""
    rounded = lambda x: F.floor(x + 0.5).cast("bigint")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).when(value > 1e12, rounded(value)).when(value > 1e9, rounded(value * 1000))


def has_time(text: Column) -> Column:
    """Whether there is a timestamp in the text's head."""
    return F.substring(text, 1, HEAD).rlike(ANY)


def written_date(text: Column) -> Column:
    """Epoch milliseconds of a date in one of the forms of DATES, maybe after a weekday; null for other texts. Days up to
    31 roll over into the next month; other numbers out of range are no date."""
    plain = F.regexp_replace(trimmed(text), "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]{0,6},? ", "")
    for form, ordered in DATES:
        plain = F.regexp_replace(plain, form, ordered)
    parts = lambda x: F.split(F.regexp_replace(x, WHOLE_DATE, "|".join(f"${k}" for k in range(1, 10))), r"\|")

    def made(p: Column) -> Column:
        number = lambda k: F.coalesce(whole(F.get(p, F.lit(k))), F.lit(0).cast("bigint"))
        name = F.get(p, F.lit(1))
        month = F.when(name.rlike("^[A-Za-z]"), month_of(name)).otherwise(whole(name))
        half = F.lower(F.get(p, F.lit(7)))
        hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0))
        at = civil_ms(number(0), month, number(2), hour, number(4), number(5), F.floor(fraction_ms(F.get(p, F.lit(6))))) - zone_ms(F.get(p, F.lit(8)))
        return F.when(month.between(1, 12) & number(2).between(1, 31) & (hour < 24) & (number(4) < 60) & (number(5) < 60), at)

    return bind(plain, lambda x: bind(F.when(x.rlike(WHOLE_DATE), parts(x)), made))


def other_time(text: Column) -> Column:
    """Of a field's value without a timestamp: what it means as a number, or else as a written date."""
    return bind(number_of(text), lambda number: F.when(number.isNotNull(), number_timestamp(number)).otherwise(written_date(text)))


def is_field_time(text: Column) -> Column:
    """Whether a field's value has a time."""
    return has_time(text) | other_time(text).isNotNull()


def field_stages(now_ms: Column | None = None) -> list[Stage]:
    """Stages from a field's value `time_text` to its time `ts`: a timestamp, a number or a date."""
    return [*time_stages(now_ms), lambda v: {"ts": F.coalesce(v("ts"), F.when(v("ts").isNull(), other_time(v("time_text"))))}]


def with_times(df: DataFrame, texts: dict[str, Column], stages: list[Stage]) -> DataFrame:
    """df with the time of each text, by stages of its own: those are projections in generated code."""
    made = named(stages)
    for name, text in texts.items():
        df = with_stages(df, made, {"time_text": text}, {name: "ts"})
    return df


def text_timestamp(value: Column, now_ms: Column | None = None) -> Column:
    """field_stages as one Column."""
    return in_expression(field_stages(now_ms), {"time_text": value}, lambda v: v("ts"))
