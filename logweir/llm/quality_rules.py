"""Quality rules: a table of thresholds, compiled into one projection of text statistics.

All statistics of a text are built-in expressions, evaluated where the text is read: no shuffle, no user function.
A chain of projections binds what several statistics use (words, lines, windows), so that nothing is split twice.

Words that stand in repeated 3-word windows: a window's hash and position are packed into one long (the position in
as many low bits as the text needs) and sorted; neighbours in that order with equal hash bits and then equal words
are repeats; their positions, sorted again, are covered by runs of three. That takes n log n for any length.

Null and empty texts have no words, all statistics 0, and fail. Every row gives one row, repeated ones too; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be at by this have from or an not which but they we "
    "der die das und ist von den mit ein eine zu im auf für des dem nicht als auch es sich "
    "le la les et un une des est que qui dans pour en du au il sur pas plus ce "
    "el los las una por con para del se su al lo como más o y de"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if the statistic is below `least` or above `most`."""

    name: str
    value: Callable[[], Column]
    least: float | None = None
    most: float | None = None


def _ratio(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: The base rules (50 words; half of the words repeated) and those that are added to them.
BASE_RULES = (
    Rule("words", lambda: F.col("n_words"), least=50),
    Rule("repeated_words", _ratio("n_repeat_words", "n_words"), most=0.5),
)
RULES = (
    Rule("word_length", _ratio("word_chars", "n_words"), least=2.0, most=14.0),
    Rule("symbols_per_word", _ratio("n_symbols", "n_words"), most=0.3),
    Rule("duplicate_lines", _ratio("n_dup_lines", "n_lines"), most=0.5),
    Rule("stop_words", _ratio("n_stop_words", "n_words"), least=0.02),
    Rule("upper_case", _ratio("n_upper", "word_chars"), most=0.5),
)
#: Counts that the projection yields, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated(words: Column, order: Column, mask: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more. order: sorted longs of window hash and, under mask, position."""
    place = lambda x: x.bitwiseAND(mask).cast("int")
    near = lambda x, j: (x.bitwiseOR(mask) >= F.get(order, j + 1)) | (F.get(order, j - 1).bitwiseOR(mask) >= x)

    def same(p: Column, q: Column) -> Column:
        return (words[p] == words[q]) & (words[p + 1] == words[q + 1]) & (words[p + 2] == words[q + 2])

    def sure(found: Column) -> Column:
        # a neighbour past either end is null: no match. Where equal hash bits stand for different windows, all others are tried
        beside = lambda p, j: F.coalesce(same(p, F.get(found, j + 1)), F.lit(False)) | F.coalesce(same(p, F.get(found, j - 1)), F.lit(False))
        return F.filter(found, lambda p, j: beside(p, j) | F.exists(found, lambda q: (q != p) & same(p, q)))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end"))
    cover = lambda places: F.aggregate(F.sort_array(places), start, step, lambda acc: acc["n"])
    return bind(F.transform(F.filter(order, near), place), lambda found: F.when(F.size(found) > 0, cover(sure(found))).otherwise(F.lit(0)))


def statistics(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The carried columns with COUNTS, as longs. Each projection binds what the next one uses more than once."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    split = docs.select(*carry, words_of(F.col(text)).alias("_words"), lines.alias("_lines"))
    words = F.col("_words")
    # as many low bits as positions need
    mask = F.expr("shiftleft(1L, length(bin(size(_words)))) - 1")
    packed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("long")))
    order = F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(packed))
    bound = split.select("*", mask.alias("_mask")).select("*", order.alias("_order"), F.array_join(words, "").alias("_joined"))
    marks = F.regexp_replace("_joined", "[^#*$%&|<>\\p{Lu}]+", "")
    repeats = bind(F.col("_mask"), lambda m: bind(F.col("_order"), lambda o: bind(words, lambda w: repeated(w, o, m))))
    counted = bound.select("*", repeats.alias("_repeats"), marks.alias("_marks"))
    values = {
        "n_words": F.size(words),
        "word_chars": F.char_length("_joined"),
        "n_symbols": F.length(F.regexp_replace("_marks", "[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("_repeats"),
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
        "n_upper": F.length(F.regexp_replace("_marks", "\\P{Lu}+", "")),
    }
    # a filter on the result is not pushed below an explode, where it would repeat all of the above for each mention
    row = F.explode(F.array(F.struct(*[values[k].cast("long").alias(k) for k in COUNTS]))).alias("_counts")
    return counted.select(*carry, row).select(*carry, *[F.col("_counts")[k].alias(k) for k in COUNTS])


def passes(rules: tuple[Rule, ...]) -> Column:
    """The rules compiled into one Boolean expression over the counts."""
    out = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            out = out & (rule.value() >= rule.least)
        if rule.most is not None:
            out = out & (rule.value() <= rule.most)
    return out


def apply_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The `keep` columns with all counts, base_failed and kept."""
    carry = [f"_keep_{c}" for c in keep]
    flat = statistics(docs.select(F.col(text), *[F.col(c).alias(k) for c, k in zip(keep, carry, strict=True)]), text, carry)
    return flat.select(
        *[F.col(k).alias(c) for c, k in zip(keep, carry, strict=True)], *COUNTS, (~passes(base)).alias("base_failed"), passes((*base, *rules)).alias("kept")
    )
