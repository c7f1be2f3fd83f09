"""Vectors as array columns: scaling, cropping, resizing, and the arrays that linear models take.

All are built-in expressions.  Numbers are computed as doubles, whatever the array holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def variance(x: Column, centre: Column) -> Column:
    """Population variance about a given centre."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre)) / F.size(x)


def population_variance(x: Column) -> Column:
    return bound(doubles(x), lambda d: bound(mean(d), lambda m: variance(d, m)))


def squared_norm(x: Column) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), lambda a, v: a + v * v)


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(x), doubles(y), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)


def zscore(x: Column) -> Column:
    """(x - mean) / population deviation; only centred where the deviation is 0."""

    def scaled(d: Column) -> Column:
        return bound(mean(d), lambda m: bound(F.sqrt(variance(d, m)), lambda s: F.transform(d, lambda v: F.when(s > 0, (v - m) / s).otherwise(v - m))))

    return bound(doubles(x), scaled)


def minmax(x: Column, constant_to_zero: bool = True) -> Column:
    """To [0, 1]; a constant array becomes zeros, or stays as it is."""

    def scaled(d: Column) -> Column:
        lo, hi = F.array_min(d), F.array_max(d)
        flat = F.lit(0.0) if constant_to_zero else lo
        return F.transform(d, lambda v: F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(flat))

    return bound(doubles(x), scaled)


def symmetric(x: Column) -> Column:
    """To [-1, 1]; an error for a constant array."""

    def scaled(d: Column) -> Column:
        lo, hi = F.array_min(d), F.array_max(d)
        return F.when(hi > lo, F.transform(d, lambda v: 2 * (v - lo) / (hi - lo) - 1)).otherwise(F.raise_error(F.lit("a constant image can't be scaled to [-1, 1]")).cast("array<double>"))

    return bound(doubles(x), scaled)


def standardise(x: Column, centre: float, deviation: float) -> Column:
    """(x - centre) / deviation with numbers from a training split; a deviation below 1e-6 counts as 1."""
    return F.transform(doubles(x), lambda v: (v - centre) / (deviation if deviation >= 1e-6 else 1.0))


def unflatten(x: Column, height: int, width: int) -> Column:
    """Rows of an image that is stored row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.slice(x, i * width + 1, F.lit(width)))


def resize(x: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Nearest-neighbour resize: target row i takes source row floor(i * height / to_height), columns alike."""

    def pixel(t: Column) -> Column:
        row = F.floor(F.floor(t / to_width) * height / to_height)
        column = F.floor((t % to_width) * width / to_width)
        return F.get(x, (F.least(row, F.lit(height - 1)) * width + F.least(column, F.lit(width - 1))).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), pixel)


def crop_bar(x: Column, height: int, width: int, bar: int) -> Column:
    """Drops the bar columns on the left if they vary less than those on the right, else (ties too) those on the right."""

    def columns(d: Column, first: int, count: int) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.slice(d, i * width + first + 1, F.lit(count))))

    def cropped(d: Column) -> Column:
        left, right = population_variance(columns(d, 0, bar)), population_variance(columns(d, width - bar, bar))
        return F.when(left < right, columns(d, bar, width - bar)).otherwise(columns(d, 0, width - bar))

    return bound(doubles(x), cropped)


def with_bias(x: Column) -> Column:
    """The array followed by 1."""
    return F.concat(doubles(x), F.array(F.lit(1.0)))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def one_versus_rest(label: Column, classes: int) -> Column:
    """+1 for the class and -1 for others."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(-1.0))


def prefix(x: Column, n: int) -> Column:
    """The first n components."""
    return F.slice(x, 1, n)


def argmax(scores: Column) -> Column:
    """Place of the largest value from 0, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    def shares(d: Column) -> Column:
        return bound(F.transform(d, lambda v: F.exp(v - F.array_max(d))), lambda e: bound(total(e), lambda s: F.transform(e, lambda v: v / s)))

    return bound(doubles(scores), shares)


def split_counts(n: Column, validation: float, test: float) -> tuple[Column, Column]:
    """Rows of a class of n for validation and test.

    Rounded half to even; at least one each where asked for and the class has 3 (validation) or 2 (test); at least one
    row stays for training, and validation gives way first where it isn't smaller.
    """
    n = n.cast("long")
    t = F.greatest(F.rint(n * test).cast("long"), F.lit(1 if test > 0 else 0))
    v = F.when(n < 3, F.lit(0)).otherwise(F.greatest(F.rint(n * validation).cast("long"), F.lit(1 if validation > 0 else 0)))
    over = F.greatest(F.lit(0).cast("long"), t + v - (n - 1))
    # one by one from the larger, validation first of equals: first the difference, then by turns
    def taken(larger_v: Column, gap: Column) -> Column:
        rest = F.greatest(F.lit(0).cast("long"), over - gap)
        return F.when(larger_v, F.least(over, gap) + F.ceil(rest / 2)).otherwise(F.ceil(rest / 2))

    from_v = F.least(v, taken(v >= t, F.abs(v - t)))
    none = n <= 1
    return F.when(none, 0).otherwise(v - from_v).cast("long"), F.when(none, 0).otherwise(t - (over - from_v)).cast("long")
