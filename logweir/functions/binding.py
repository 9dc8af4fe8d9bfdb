"""Binding a value to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: below a condition, Spark evaluates an expression each time it is mentioned.

    It is what a fold over no elements ends with. An element of a transformed array would do as well, but derives its type anew for each
    row, twice for each binding that it is nested in."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)
