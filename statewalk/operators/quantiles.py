"""Exact quantiles of many groups at once, by counting: all ranks of all groups share each pass over the rows.

A pass counts the rows of every interval that still holds a wanted rank in equal bins, and keeps of each interval the bins that
hold one, with their least and greatest values as the next intervals. When few rows are left in an interval they are fetched.
Neither a task nor the driver holds a group's values, however many there are: the driver holds counts of bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewalk.operators.numbering import settled

#: Bins of an interval in one pass, and the most rows of an interval that are fetched.
BINS, FETCHED = 1024, 512


@dataclass
class Wanted:
    """A rank of a group, the interval that holds it, and how many of the group's values are below the interval."""

    group: tuple
    rank: int
    lo: float
    hi: float
    before: int = 0
    rows: int = 0
    found: float | None = None


def _located(rows: DataFrame, by: list[str], open_: list[Wanted]) -> DataFrame:
    """rows (by, _x) that are in an open interval, with the interval's number _i and bounds. Intervals don't overlap."""
    spark = rows.sparkSession
    intervals = sorted({(w.group, w.lo, w.hi) for w in open_}, key=repr)
    schema = T.StructType([T.StructField("_i", T.IntegerType()), *[T.StructField(f"_g_{c}", rows.schema[c].dataType) for c in by], T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
    table = spark.createDataFrame([(i, *g, lo, hi) for i, (g, lo, hi) in enumerate(intervals)], schema)
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    condition = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    for c in same:
        condition = condition & c
    return rows.join(F.broadcast(table), condition)  # as many rows as ranks are wanted


def quantiles(rows: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """by, q: an array of the interpolated quantiles of a column in each group, nulls and NaN left out.

    Groups are few, such as the states of a model: the driver holds a count for each bin of their intervals. A group without a
    value has no row. The column is written once, and read once a pass; three or four are usual, whatever the ranks.
    """
    x = F.col(column).cast("double")
    known = settled(rows.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")))
    totals = known.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).collect()
    wanted: dict[tuple, Wanted] = {}
    for r in totals:
        group = tuple(r[c] for c in by)
        for share in shares if r["_n"] else ():
            place = share * (r["_n"] - 1)
            for rank in (math.floor(place), math.ceil(place)):
                wanted[group, rank] = Wanted(group, rank, r["_lo"], r["_hi"], 0, r["_n"])
    while open_ := [w for w in wanted.values() if w.found is None]:
        for w in open_:
            if w.lo == w.hi:
                w.found = w.lo
        few = [w for w in open_ if w.found is None and w.rows <= FETCHED]
        many = [w for w in open_ if w.found is None and w.rows > FETCHED]
        if few:
            _fetch(known, by, few)
        if many:
            _refine(known, by, many)
    out = []
    for r in totals:
        group, values = tuple(r[c] for c in by), []
        for share in shares if r["_n"] else ():
            place = share * (r["_n"] - 1)
            low, high = wanted[group, math.floor(place)].found, wanted[group, math.ceil(place)].found
            values.append(low + (high - low) * (place - math.floor(place)))
        if values:
            out.append((*group, values))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("q", T.ArrayType(T.DoubleType()))])
    return rows.sparkSession.createDataFrame(out, schema)


def _fetch(known: DataFrame, by: list[str], few: list[Wanted]) -> None:
    held: dict[tuple, list[float]] = {}
    for r in _located(known, by, few).select(*by, "_lo", "_hi", "_x").collect():
        held.setdefault((tuple(r[c] for c in by), r["_lo"], r["_hi"]), []).append(r["_x"])
    for w in few:
        w.found = sorted(held[w.group, w.lo, w.hi])[w.rank - w.before]


def _refine(known: DataFrame, by: list[str], many: list[Wanted]) -> None:
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("_x")
    width = (hi - lo) / BINS
    far = hi / BINS - lo / BINS  # where the difference is beyond the greatest double
    place = F.when(width == float("inf"), x / far - lo / far).when(width > 0, (x - lo) / F.when(width > 0, width)).otherwise((x > lo).cast("double"))
    b = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(BINS - 1))  # ascends with x, so bins are ranges of ranks
    bins = _located(known, by, many).groupBy(*by, "_lo", "_hi", b.alias("_b")).agg(F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    of: dict[tuple, list] = {}
    for r in bins.collect():
        of.setdefault((tuple(r[c] for c in by), r["_lo"], r["_hi"]), []).append((r["_b"], r["_n"], r["_least"], r["_most"]))
    for rows in of.values():
        rows.sort()
    for w in many:
        below = w.before
        for _, n, least, most in of[w.group, w.lo, w.hi]:
            if below + n > w.rank:
                w.lo, w.hi, w.before, w.rows = least, most, below, n
                break
            below += n
