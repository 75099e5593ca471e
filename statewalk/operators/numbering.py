"""Numbers and running sums in an order of any number of rows: ranges in many tasks, then the ranges' totals."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bits of a row's number within its partition, as monotonically_increasing_id has them.
WITHIN = 33


def settled(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster shares for checkpoints; one is made up only where all of Spark runs here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster") and folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def in_ranges(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows, sorted over ranges of the order that are partitions, with _range and _at (the place within the range).

    They are written once, as ranges are drawn from a sample and another pass over the rows could draw others. There are as many
    ranges as shuffles have partitions, however few rows, since work on a row may be worth a task of its own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    one = settled(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return one.select(*rows.columns, F.shiftright("_id", WITHIN).cast("int").alias("_range"), F.col("_id").bitwiseAND((1 << WITHIN) - 1).alias("_at"))


def before(totals: DataFrame, value: str) -> DataFrame:
    """_range, _before: the sum of value over the ranges before each. There is one row a partition, which the driver adds up."""
    total, out = 0, []
    for r in sorted(totals.collect()):
        out.append((r["_range"], total))
        total += r[value] or 0
    return totals.sparkSession.createDataFrame(out, "_range int, _before long")


def places(rows: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0, within each family of `by`; equal rows are told apart, in any order.

    Families are ranges of the common order: a place in it less the family's first place, which is one grouped minimum, is the
    place in the family. So a family of any size is numbered in many tasks.
    """
    by = by or []
    ranged = in_ranges(rows, [*by, *order])
    starts = before(ranged.groupBy("_range").agg(F.count("*").alias("n")), "n")
    out = ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
    if not by:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_f_{c}") for c in by]).agg(F.min(name).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in by]
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first")).select(*rows.columns, name)


def running_sum(rows: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to and with each, in the order."""
    ranged = in_ranges(rows, order)
    totals = before(ranged.groupBy("_range").agg(F.sum(value).alias("n")), "n")
    inside = F.sum(value).over(W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn(name, inside).join(F.broadcast(totals), "_range").withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)
