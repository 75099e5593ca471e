"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (null counts as false)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def plogp(p: Column) -> Column:
    """-p log2 p, with p clipped to at least 1e-12."""
    q = F.greatest(p, F.lit(1e-12))
    return -q * F.log2(q)


def total(values: list[Column]) -> Column:
    """The sum of columns, from left to right."""
    out = values[0]
    for x in values[1:]:
        out = out + x
    return out


def cells(values: Column, k: int) -> list[Column]:
    """The k values of an array as columns, whose sums and products are compiled, which those of array functions are not."""
    return [values[i] for i in range(k)]


def entropy_bits(p: list[Column]) -> Column:
    """Entropy in bits of columns, clipped and normalised to sum 1."""
    q = [F.greatest(x, F.lit(1e-12)) for x in p]
    mass = total(q)
    return total([-(x / mass) * F.log2(x / mass) for x in q])


def array_entropy(p: Column) -> Column:
    """The same of an array of any length."""
    q = F.transform(p, lambda x: F.greatest(x, F.lit(1e-12)))
    total = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(q, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over a group; null for fewer than two rows or a constant side."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


#: The spellings of both sexes, in upper case.
MALE, FEMALE = ("M", "MALE", "1", "1.0"), ("F", "FEMALE", "0", "0.0")


def sex_text(x: Column) -> Column:
    """M or F for the usual spellings (letters, words, 1 and 0), '' for blank, else the upper-case text; null stays null."""
    t = F.upper(F.trim(x))
    return F.when(t.isin(*MALE), "M").when(t.isin(*FEMALE), "F").otherwise(t)


def leading_token(x: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(x, "_", 1)
