"""Values that build on one another, as stages.

A stage names new values by expressions over earlier ones. On a DataFrame each stage is a projection, so that a value is
computed once, whatever reads it, and generated code stays in small methods. Inside one expression the same stages are
bound to names in turn, for a place where only a Column will do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import bind

#: From a getter of earlier values to the new ones.
Values = Callable[[str], Column]
Stage = Callable[[Values], dict[str, Column]]
PREFIX = "_stage_"


def with_stages(df: DataFrame, stages: Sequence[dict[str, Column]], given: dict[str, Column], results: dict[str, str]) -> DataFrame:
    """df with new columns: results maps the columns' names to those of values. stages: what named() made; given: the first values."""
    own = df.columns
    df = df.withColumns({PREFIX + k: v for k, v in given.items()})
    for stage in stages:
        df = df.withColumns({PREFIX + k: v for k, v in stage.items()})
    # a generator keeps filters on the results above it: pushed through the stages, they would repeat these over and over
    return df.select(*own, F.inline(F.array(F.struct(*[value(v).alias(k) for k, v in results.items()]))))


def value(name: str) -> Column:
    """A value of with_stages."""
    return F.col(PREFIX + name)


def named(stages: Sequence[Stage]) -> list[dict[str, Column]]:
    """The stages' Columns for with_stages. Making them takes longer than planning them, so they are worth keeping."""
    return [stage(value) for stage in stages]


def in_expression(stages: Sequence[Stage], given: dict[str, Column], result: Callable[[Values], Column]) -> Column:
    """result of all values, as one Column."""

    def run(rest: Sequence[Stage], values: Values) -> Column:
        if not rest:
            return result(values)
        new = rest[0](values)
        return bound(new, values, rest[1:])

    def bound(new: dict[str, Column], earlier: Values, rest: Sequence[Stage]) -> Column:
        return bind(F.struct(*[v.alias(k) for k, v in new.items()]), lambda s: run(rest, lambda name: s[name] if name in new else earlier(name)))

    return bound(given, lambda name: given[name], stages)
