"""Severity levels as small integers: from words, from numbers, to names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, trimmed

ERROR, WARN, INFO, DEBUG, TRACE, UNKNOWN = range(6)
NAMES = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE", "—")
#: The words of each level.
WORDS = {
    ERROR: ("error", "err", "fatal", "crit", "critical", "severe", "emerg", "alert", "panic", "e"),
    WARN: ("warn", "warning", "w"),
    INFO: ("info", "notice", "i"),
    DEBUG: ("debug", "fine", "d"),
    TRACE: ("trace", "finer", "finest", "verbose", "v"),
}
BY_WORD = {word: level for level, words in WORDS.items() for word in words}
#: The lowest number of each level, as numeric loggers write them.
FLOORS = ((50, ERROR), (40, WARN), (30, INFO), (20, DEBUG), (10, TRACE))


def level_of_word(text: str) -> int:
    return BY_WORD.get(text.strip(SPACES).lower(), UNKNOWN)


def level_from_text(text: Column) -> Column:
    words = F.find_in_set(F.lower(trimmed(text)), F.lit(",".join(BY_WORD)))
    return F.coalesce(F.get(F.lit(list(BY_WORD.values())), words - 1), F.lit(UNKNOWN))


def level_from_number(number: Column) -> Column:
    out = None
    for floor, level in FLOORS:
        out = (F if out is None else out).when(number >= floor, F.lit(level))
    return out.otherwise(F.lit(UNKNOWN))


def level_from_status(status: Column) -> Column:
    """HTTP status: 5xx is an error, 4xx a warning, all else information."""
    return F.when(status >= 500, F.lit(ERROR)).when(status >= 400, F.lit(WARN)).otherwise(F.lit(INFO))


def level_name(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in NAMES]), level), F.lit(NAMES[UNKNOWN]))


def parse_level_map(text: str) -> dict[str, list[str]]:
    """`error=A,B warn=C`: clauses by white space; unknown names are skipped, a later clause for a name replaces it."""
    out: dict[str, list[str]] = {}
    for clause in text.split():
        name, mark, tokens = clause.partition("=")
        if mark and name.lower() in {n.lower() for n in NAMES[:UNKNOWN]}:
            out[name.lower()] = [t for t in tokens.split(",") if t]
    return out
