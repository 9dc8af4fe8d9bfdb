"""Text helpers: ASCII case folding, substring search, signatures, display formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at a value's ends, and how a number is written.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(text, F.lit(SPACES))


def number_of(text: Column) -> Column:
    """The number that a text is, but for white space around it; null for other texts, such as numbers with a type's letter."""
    digits = trimmed(text)
    return F.when(digits.rlike(f"^{NUMBER}\\z"), digits.try_cast("double"))


def plain_number(text: str) -> float | None:
    """The same for a value at hand."""
    return float(text.strip(SPACES)) if re.fullmatch(NUMBER, text.strip(SPACES)) else None


def fold_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def contains_folded(text: Column, needle: str) -> Column:
    """Whether the text, with A-Z folded, contains a needle that is lower-case already. An empty needle is everywhere."""
    return F.lit(True) if not needle else F.contains(fold_ascii(text), F.lit(needle))


def signature(header_line: str | None, first_line: str) -> str:
    """What recognises a file of a known shape: its delimited header, or its first line with digits masked."""
    return f"csv:{header_line}" if header_line is not None else "line:" + re.sub(r"[0-9]+", "#", first_line)[:200]


def line_signature(line: Column) -> Column:
    return F.concat(F.lit("line:"), F.substring(F.regexp_replace(line, "[0-9]+", "#"), 1, 200))


def highlight(message: Column, query: Column) -> Column:
    """struct(before, hit, after) around the first case-insensitive hit; hit is empty for none."""
    at = F.instr(F.lower(message), F.lower(query))
    size = F.length(query)
    hit = (at > 0) & (size > 0)
    return F.struct(
        F.when(hit, F.substring(message, F.lit(1), at - 1)).otherwise(message).alias("before"),
        F.when(hit, F.substring(message, at, size)).otherwise(F.lit("")).alias("hit"),
        F.when(hit, F.substring(message, at + size, F.length(message))).otherwise(F.lit("")).alias("after"),
    )


def format_time(ms: Column) -> Column:
    """Time of day in UTC; a dash for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS"), F.lit("—"))


def format_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def format_date_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def format_bytes(size: Column) -> Column:
    """Sizes in steps of 1024: B, KB, MB, GB."""
    scaled = lambda power, digits: F.format_string(f"%.{digits}f", size / float(1024**power))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(scaled(1, 1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(scaled(2, 1), F.lit(" MB")))
        .otherwise(F.concat(scaled(3, 2), F.lit(" GB")))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_bucket(ms: Column) -> Column:
    """A histogram step in its largest whole unit: s, m, h or d."""
    unit = lambda size, name: F.concat(F.floor(ms / size).cast("string"), F.lit(name))
    return F.when(ms < 60_000, unit(1000, "s")).when(ms < 3_600_000, unit(60_000, "m")).when(ms < 86_400_000, unit(3_600_000, "h")).otherwise(unit(86_400_000, "d"))
