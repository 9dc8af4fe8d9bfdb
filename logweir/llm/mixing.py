"""Mixing sources to target weights as a curriculum that changes over time.

Each source has a weight w and a slope a: at time t in [0, 1] it is drawn at the rate target * (1 + a * (2t - 1)).
Integrated, its demand up to t is D(t) = target * (t + a * (t^2 - t)), so the whole run takes exactly the target
whatever the slope. A source is read in a fixed order (by hash), over and over, until the target is reached; a
document whose first word is the source's c-th demanded word is trained on at the time t with D(t) = c, a quadratic
that is solved in closed form. Rows are range-sorted by that time.

Targets share all words by weight, at most `most` times a source's size; what lies above is shared again by weight
until no source is above. That fixed point is min(most * size, level * weight) with one common level, found from
prefix sums over the sources in the order of size / weight.

The running sums inside a source come in two steps, over hash ranges and then inside each range, so that a source
with a third of all rows is summed by many tasks. Only DataFrame functions are used; the only window over one
partition is over the table of sources (one row each).

Null texts have size 0. A null source is a source, last in order. Documents of size 0 take 0 words and the position
where they stand. Ties in the order fall back on identifier and size; equal rows are interchangeable. An empty table
gives an empty result; other columns pass through training_stream() and are ignored by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, cut, keyed, words_of

#: By a source's place in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Heavy sources lead the run, light ones close it.
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, most: float = 3.0) -> DataFrame:
    """sizes: (_source, _source_size). Adds each source's weight, slope and target."""
    of = lambda values, place: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))
    ranked = sizes.withColumn("_place", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", of(weights, F.col("_place"))).withColumn("_slope", of(slopes, F.col("_place")))
    ranked = ranked.withColumn("_cap", F.col("_source_size") * F.lit(float(most)))
    # in the order of cap / weight: if all before a source are full, the others share what is left at `_level`;
    # the first source whose cap holds that level is the first that is not full
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.sum("_source_size").over(all_rows).alias("_total"),
        F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_full"),
        F.sum("_w").over(rest).alias("_open"),
        F.row_number().over(by_level).alias("_rank"),
    ).withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level"))).over(all_rows)["_level"]
    return levels.withColumn("_target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select("_source", "_source_size", "_slope", "_target")


def placed(docs: DataFrame, text: str, id: str, source: str, weights: Sequence[float], slopes: Sequence[float], most: float, key: Sequence[str] = ()) -> DataFrame:
    """(_id, _size, _source_size, _target, _slope, _start, _taken): a document, its source and where it stands in it.

    key: columns that tell rows apart; they break the last ties and are passed on."""
    bits = bucket_bits(docs.sparkSession, 6)
    sized = docs.select(*key, F.col(id).alias("_id"), F.col(source).alias("_source"), F.size(words_of(F.col(text))).cast("long").alias("_size"))
    sized = cut(sized.withColumn("_order", F.xxhash64("_id")), "sizes").withColumn("_range", F.shiftright("_order", 64 - bits))
    ranges = sized.groupBy("_source", "_range").agg(F.sum("_size").alias("_range_size"))
    targets = source_targets(ranges.groupBy("_source").agg(F.sum("_range_size").alias("_source_size")), weights, slopes, most)
    before = F.sum("_range_size").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_range_size")
    ranges = ranges.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), before.alias("_before"))
    ranges = ranges.join(targets, F.col("_s").eqNullSafe(F.col("_source"))).drop("_source")
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    inside = Window.partitionBy("_s", "_r").orderBy("_order", F.col("_id").asc_nulls_first(), "_size", *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stands = sized.join(ranges, same).withColumn("_start", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))
    words = F.round("_target").cast("long")
    passes = F.when(F.col("_source_size") > 0, F.floor(words / F.col("_source_size"))).otherwise(F.lit(0)).cast("long")
    tail = words - passes * F.col("_source_size") - F.col("_start")
    taken = passes * F.col("_size") + F.greatest(F.lit(0), F.least(tail, F.col("_size")))
    return stands.select(*key, "_id", "_size", "_source_size", "_target", "_slope", "_start", taken.cast("long").alias("_taken"))


def position(word: Column) -> Column:
    """The time at which a source's demand reaches its word-th word; null beyond its target."""
    share, a = word / F.when(F.col("_target") > 0, F.col("_target")), F.col("_slope")
    return F.when(share > 1, None).when(a == 0, share).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * share)) / (2 * a))


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, most: float = 3.0) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and position (when it is first trained on; null if never), sorted by position in ranges."""
    out = placed(docs, text, id, source, weights, slopes, most).select(
        F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"), position(F.col("_start")).alias("position"),
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), id).sortWithinPartitions(F.col("position").asc_nulls_last(), id)


def training_stream(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, most: float = 3.0, whole: bool = False) -> DataFrame:
    """The documents as they are trained on: a row for each pass over each, with all columns of docs, sorted by position in ranges.

    A last pass that the target cuts short keeps the first words of its text, joined by single spaces; if `whole`, it is
    taken whole or not at all, whichever is nearer to the target, so that all texts stay as they are. Rows are known by
    keyed(), so that identifiers may repeat or be null."""
    columns, rows = docs.columns, keyed(docs, id)
    narrow = rows.select("_row", *[F.col("_doc")[c].alias(c) for c in (id, source, text)])
    taken = placed(narrow, text, id, source, weights, slopes, most, key=["_row"]).where("_taken > 0")
    if whole:
        taken = taken.withColumn("_taken", F.expr("(2 * _taken + _size) div (2 * _size) * _size")).where("_taken > 0")
    passes = taken.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_taken") / F.col("_size")) - 1).cast("int"))).alias("_pass"))
    timed = passes.select(
        "_row", F.least(F.col("_size"), F.col("_taken") - F.col("_pass") * F.col("_size")).alias("_words"), "_size",
        position(F.col("_start") + F.col("_pass") * F.col("_source_size")).alias("_position"),
    )
    own = F.col("_doc")[text]
    first = F.array_join(F.slice(words_of(own), F.lit(1), F.col("_words").cast("int")), " ")
    part = own if whole else F.when(F.col("_words") == F.col("_size"), own).otherwise(first)
    out = rows.join(timed, "_row").select("_position", F.struct(*[(part if c == text else F.col("_doc")[c]).alias(c) for c in columns]).alias("_doc"))
    return out.repartitionByRange("_position", F.col("_doc")[id]).sortWithinPartitions("_position", F.col("_doc")[id]).select("_doc.*")
