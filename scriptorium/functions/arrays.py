"""Statistics of arrays as Column functions; all deviations are those of the population."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(values: Column) -> Column:
    """0 of an empty array."""
    return F.when(F.size(values) > 0, F.try_divide(total(values), F.size(values))).otherwise(F.lit(0.0))


def deviation(values: Column) -> Column:
    """0 of an empty array. From the sums of values and squares, so that one pass does."""
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    middle = mean(values)
    return F.when(F.size(values) > 0, F.sqrt(F.greatest(F.try_divide(squares, F.size(values)) - middle * middle, F.lit(0.0)))).otherwise(F.lit(0.0))


def count_if(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def n_distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values))


def runs(values: Column) -> Column:
    """Of an array of strings: how often the most frequent element occurs (most), and how many occur once (once).

    One pass over the sorted array.
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("once"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        same = s["last"] == x
        run = F.when(same, s["run"] + 1).otherwise(F.lit(1))
        once = F.when(same, s["once"] - F.when(s["run"] == 1, 1).otherwise(0)).otherwise(s["once"] + 1)
        return F.struct(x.alias("last"), run.alias("run"), once.alias("once"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.array_sort(values), start, step)


def contained(text: Column, phrases: Column) -> Column:
    """how many of the phrases occur in the text."""
    return F.size(F.filter(phrases, lambda p: F.contains(text, p)))


def members(values: Column, known: Column) -> Column:
    """How many elements are among ``known``."""
    return F.size(F.filter(values, lambda x: F.array_contains(known, x)))


def literal(values) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def rounded(x: Column, digits: int) -> Column:
    """Of the product with a power of ten, halves away from zero, as DuckDB and C round; round() goes by the shortest decimal form, so that 100 - 73.95 has 26.0 there."""
    return F.round(x.cast("double") * float(10**digits)) / float(10**digits)
