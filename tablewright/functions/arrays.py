"""Small steps over arrays as Column expressions: a value named once, gaps between neighbours, medians, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns computed once a row: as a generator's output, no later filter is moved into their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def at(array: Column, index: Column | int) -> Column:
    """The element with this index from 0; null before the first and past the last."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.when(index >= 0, F.try_element_at(array, (index + 1).cast("int")))


def least(array: Column, key: Callable[[Column], Column] = lambda e: e) -> Column:
    """The least key of an array, infinite where it is empty."""
    return F.coalesce(F.array_min(F.transform(array, key)), F.lit(INFINITE))


def largest(array: Column, key: Callable[[Column], Column] = lambda e: e) -> Column:
    """The largest key of an array, minus infinity where it is empty."""
    return F.coalesce(F.array_max(F.transform(array, key)), F.lit(-INFINITE))


def median(values: Column) -> Column:
    """The middle value, or the mean of the middle two; 0 for nothing."""
    return let(F.sort_array(F.filter(values, lambda v: v.isNotNull())), lambda s: F.coalesce((at(s, F.floor((F.size(s) - 1) / 2)) + at(s, F.floor(F.size(s) / 2))) / 2, F.lit(0.0)))


def round_half_up(value: Column) -> Column:
    """The nearest whole number, halves upwards also below zero."""
    return F.floor(value + 0.5)


def indexes(array: Column, test: Callable[[Column, Column], Column]) -> Column:
    """The indexes from 0 at which ``test(element, index)`` holds."""
    return F.filter(F.transform(array, lambda e, i: F.when(test(e, i), i)), lambda i: i.isNotNull())


def share(array: Column, test: Callable[[Column], Column]) -> Column:
    """The share of elements that pass; 0 of none."""
    return F.size(F.filter(array, test)) / F.greatest(F.size(array), F.lit(1))


def union(spans: Column) -> Column:
    """Spans struct<lo, hi> merged where they touch, in order."""
    kind = "array<struct<lo: double, hi: double>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        return F.when(F.coalesce(s["lo"] <= last["hi"], F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def gaps(spans: Column, narrowest: Column) -> Column:
    """struct<lo, hi> of the free stretches between neighbouring spans, ``narrowest`` wide at least, from the left."""
    runs = F.transform(spans, lambda s, i: F.struct(at(spans, i - 1)["hi"].alias("lo"), s["lo"].alias("hi")))
    return F.filter(runs, lambda r: r["lo"].isNotNull() & (r["hi"] - r["lo"] >= narrowest))
