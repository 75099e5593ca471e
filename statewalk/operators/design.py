"""Group designs: one-hot factors, row mappings, contrasts, alignment checks, covariate joins, file preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.functions.expressions import leading_token, sex_text
from statewalk.operators.numbering import places


def levels_in_order(rows: DataFrame, factor: str, position: str) -> DataFrame:
    """level, place: the factor's levels in the order of their first row, from 0. Null is no level."""
    first = rows.where(F.col(factor).isNotNull()).groupBy(F.col(factor).alias("level")).agg(F.min(position).alias("first"))
    # as many rows as levels: numbered in one small window
    return first.select("level", (F.row_number().over(W.orderBy("first", "level")) - 1).alias("place"))


def one_hot(rows: DataFrame, factor: str, levels: list[str], prefix: str) -> DataFrame:
    """rows with one 0/1 column for each level but the first, in the given order."""
    return rows.select("*", *[F.when(F.col(factor) == x, 1.0).otherwise(0.0).alias(f"{prefix}_{x}") for x in levels[1:]])


def demeaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each column less its mean over all rows: the means are one small row, joined to all."""
    if not columns:
        return rows
    means = rows.agg(*[F.avg(f"`{c}`").alias(f"_m_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(means))
    return out.select(*[(F.col(f"`{c}`") - F.col(f"`_m_{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def mapping(subjects: DataFrame, k: int, state_major: bool = False) -> DataFrame:
    """pos, sid, state (1..k), row_key: each subject (pos, sid) with each state.

    row_key numbers rows from 1, subject by subject or state by state, from the subject's place alone.
    """
    grid = subjects.withColumn("state", F.explode(F.sequence(F.lit(1), F.lit(k))))
    if state_major:
        total = subjects.agg(F.count("*").alias("total"))
        grid = grid.crossJoin(F.broadcast(total))
        return grid.select("pos", "sid", "state", ((F.col("state") - 1) * F.col("total") + F.col("pos") + 1).cast("long").alias("row_key"))
    return grid.select("pos", "sid", "state", (F.col("pos") * k + F.col("state")).cast("long").alias("row_key"))


def contrast(columns: list[str], wanted: str | None = None) -> list[int]:
    """Weights of a contrast on one column: the wanted one, else the last state, sex, fd, an age level, the intercept, the first."""
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"no column {wanted} in the design; it has {', '.join(columns)}")
        chosen = wanted
    else:
        states = [c for c in columns if c.startswith("state")]
        ages = [c for c in columns if c.startswith("age")]
        order = states[-1:] + [c for c in ("sex", "fd") if c in columns] + ages[:1] + [c for c in ("intercept",) if c in columns] + columns[:1]
        chosen = order[0]
    return [int(c == chosen) for c in columns]


def aligned(expected: DataFrame, actual: DataFrame, most: int = 10) -> DataFrame:
    """state, pos, expected_sid, actual_sid, kind of the first `most` mismatches of each state; no row for a state that agrees.

    expected and actual: (state, pos, sid). kind: 'missing' (no actual row), 'surplus' (no expected one) or 'differs'.
    """
    a, b = expected.withColumnRenamed("sid", "expected_sid"), actual.withColumnRenamed("sid", "actual_sid")
    both = a.join(b, ["state", "pos"], "full_outer")
    kind = F.when(F.col("actual_sid").isNull(), "missing").when(F.col("expected_sid").isNull(), "surplus").when(F.col("expected_sid") != F.col("actual_sid"), "differs")
    off = both.withColumn("kind", kind).where(F.col("kind").isNotNull())
    first = F.row_number().over(W.partitionBy("state").orderBy("pos"))
    return off.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")


def unknown_states(columns: DataFrame, prefix: str = "state") -> DataFrame:
    """state, n: the names of a columns map that don't begin with the prefix."""
    return columns.where(~F.lower("state").startswith(prefix)).groupBy("state").agg(F.count("*").alias("n"))


def exchange_blocks(rows: DataFrame) -> DataFrame:
    """row_key, sid, block of mapping rows (pos, sid, row_key): one block for each subject, from 1, in the subjects' order."""
    subjects = rows.groupBy("sid").agg(F.min("pos").alias("_pos"))
    numbered = places(subjects, ["_pos", "sid"], name="_place").select("sid", (F.col("_place") + 1).alias("block"))
    return rows.join(numbered, "sid").select("row_key", "sid", "block")


def listed_rows(rows: DataFrame, order: DataFrame) -> DataFrame:
    """pos and the rows (sid, ...) of listed sids, as often as a sid is listed."""
    return order.select("pos", "sid").join(rows, "sid").select("pos", *rows.columns)


def normalized_covariates(rows: DataFrame) -> DataFrame:
    """sid, uid, sex, age_group, fd from text columns (sid, sex, age_group, fd): spellings unified, bad numbers missing."""
    sid = F.trim("sid")
    return rows.select(sid.alias("sid"), leading_token(sid).alias("uid"), sex_text(F.col("sex")).alias("sex"), F.col("age_group"), F.expr("try_cast(fd as double)").alias("fd"))


def with_covariates(seqs: DataFrame, covariates: DataFrame, columns: list[str]) -> DataFrame:
    """seqs (sid, ...) with the covariates of the same sid, else the first known value by uid of the sid's leading token."""
    exact = covariates.select("sid", *[F.col(c).alias(f"_e_{c}") for c in columns])
    by_uid = covariates.groupBy("uid").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("sid"))).alias(f"_u_{c}") for c in columns])
    out = seqs.join(exact, "sid", "left").withColumn("_uid", leading_token(F.col("sid"))).join(by_uid.withColumnRenamed("uid", "_uid"), "_uid", "left")
    return out.select(*seqs.columns, *[F.coalesce(f"_e_{c}", f"_u_{c}").alias(c) for c in columns])


def unmatched(seqs: DataFrame, covariates: DataFrame) -> DataFrame:
    """sid of the sequences that neither sid nor uid finds in the covariates."""
    left = seqs.select("sid").distinct().join(covariates.select("sid"), "sid", "left_anti")
    return left.withColumn("uid", leading_token(F.col("sid"))).join(covariates.select("uid").distinct(), "uid", "left_anti").select("sid")


def preferred_files(files: DataFrame, token: str = "rest") -> DataFrame:
    """sid, name: of each subject's files the first by name among those that hold the token in any case, else among all.

    The subject is what stands before the first underscore.
    """
    has: Column = F.when(F.lower("name").contains(token), 0).otherwise(1)
    return files.groupBy(leading_token(F.col("name")).alias("sid")).agg(F.min_by("name", F.struct(has, "name")).alias("name"))


def in_order(rows: DataFrame, order: DataFrame) -> DataFrame:
    """rows (sid, ...) of the sids in order (pos, sid), with pos: the list's order, each sid at its first place."""
    first = order.groupBy("sid").agg(F.min("pos").alias("pos"))
    return rows.join(first, "sid").select("pos", *rows.columns)


def absent(order: DataFrame, rows: DataFrame) -> DataFrame:
    """sid of the list that no row has."""
    return order.select("sid").distinct().join(rows.select("sid").distinct(), "sid", "left_anti")


def columns_of(order: DataFrame, k: int) -> DataFrame:
    """state (0..k-1), col_index (from 1), sid: the columns of each state's stack, subjects in the list's order.

    The subjects are numbered once, for all states.
    """
    first = places(order.groupBy("sid").agg(F.min("pos").alias("pos")), ["pos", "sid"])
    grid = first.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.select("state", (F.col("place") + 1).cast("int").alias("col_index"), "sid")


def stacked(maps: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """state, col_index, sid, p, value of maps (sid, s, p, value): one column for each subject of a state's stack."""
    columns = columns_of(in_order(maps.select("sid").distinct(), order), k)
    return columns.join(maps.withColumnRenamed("s", "state"), ["state", "sid"]).select("state", "col_index", "sid", "p", "value")


def subject_level(rows: DataFrame) -> DataFrame:
    """One row for each subject of a design with a row for each state (column state from 1): columns of states are left out."""
    kept = [c for c in rows.columns if not c.startswith("state")]
    return rows.where(F.col("state") == 1).select(*kept)


def tidy_ids(rows: DataFrame) -> DataFrame:
    """rows without the column uid, if it is everywhere the sid or its leading token."""
    if "uid" not in rows.columns:
        return rows
    same = (F.col("uid") == F.col("sid")) | (F.col("uid") == leading_token(F.col("sid")))
    redundant = rows.agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("x")).first()["x"]
    return rows.drop("uid") if redundant else rows


def wrong_shapes(maps: DataFrame, k: int) -> DataFrame:
    """sid, states, features of the maps (sid, s, p) that have not k states of as many features as the first sid's."""
    by = maps.groupBy("sid").agg(F.countDistinct("s").alias("states"), F.countDistinct("p").alias("features"), F.count("*").alias("cells"))
    first = by.agg(F.min_by("features", "sid").alias("wanted"))
    return by.crossJoin(F.broadcast(first)).where((F.col("states") != k) | (F.col("features") != F.col("wanted")) | (F.col("cells") != F.col("states") * F.col("features"))).select("sid", "states", "features")
