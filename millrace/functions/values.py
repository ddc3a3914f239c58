"""Column helpers with the null rules that the retail jobs share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """condition, with false where it is null, so that it may be negated."""
    return F.coalesce(condition, F.lit(False))


def number(c: Column) -> Column:
    """A double, or null if the text is none."""
    return F.when(~F.isnan(v := F.trim(c.cast("string")).try_cast("double")), v)


def translated(c: Column, words: Mapping[str, object]) -> Column:
    """The word's translation, or null."""
    pairs = [F.lit(x) for pair in words.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def flags(named: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, as an array in order."""
    return F.array_compact(F.array(*(F.when(holds(c), name) for name, c in named.items())))


def flagged(array: str, condition: Column, name: str) -> Column:
    """The array with name appended where the condition holds."""
    return F.when(holds(condition), F.array_append(array, F.lit(name))).otherwise(F.col(array))


def half_even(c: Column) -> Column:
    return F.rint(c)


def within(c: Column, least: float, most: float) -> Column:
    return F.when(c < least, least).when(c > most, most).otherwise(c)
