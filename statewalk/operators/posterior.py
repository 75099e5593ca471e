"""Metrics of soft state sequences: rows (sid, t, g) with g the array of k state probabilities at step t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.functions.expressions import array_dot, cells, entropy_bits, flag, plogp, safe_corr, total
from statewalk.operators.numbering import settled
from statewalk.operators.quantiles import quantiles
from statewalk.operators.sequences import with_next


def normalized(weights: Column, k: int | None = None) -> Column:
    """An array divided by its sum; by 1 where the sum is 0. With k, of k values."""
    if k is not None:
        mass = total(cells(weights, k))
        return F.array(*[x / F.when(mass > 0, mass).otherwise(F.lit(1.0)) for x in cells(weights, k)])
    mass = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / F.when(mass > 0, mass).otherwise(F.lit(1.0)))


def expected_counts(gamma: DataFrame, k: int) -> DataFrame:
    """sid, steps, first (g at the first step), mass (sum of g) and c (k * k sums of g_t(i) g_t+1(j)): one window, one aggregation."""
    nxt = with_next(gamma.select("sid", "t", "g"), "g", "h")
    mass = F.array(*[F.sum(F.col("g")[i]) for i in range(k)])
    c = F.array(*[F.coalesce(F.sum(F.col("g")[i] * F.col("h")[j]), F.lit(0.0)) for i in range(k) for j in range(k)])
    return nxt.groupBy("sid").agg(F.count("*").alias("steps"), F.min_by("g", "t").alias("first"), mass.alias("mass"), c.alias("c"))


def soft_transitions(gamma: DataFrame, k: int) -> DataFrame:
    """sid, from_s, to_s, c."""
    out = expected_counts(gamma, k).select("sid", F.posexplode("c").alias("cell", "c"))
    return out.select("sid", F.floor(F.col("cell") / k).cast("int").alias("from_s"), (F.col("cell") % k).alias("to_s"), "c")


def soft_metrics(gamma: DataFrame, k: int) -> DataFrame:
    """sid, s, fo, present, dt_mean, n_visits, sr_state.

    A state with an expected count below 1 is absent: zeros, and no dwell time. dt_mean is 1 / (1 - stay), with the share of
    stays clipped below 1; visits are the first step's probability and the entries.
    """
    wide = expected_counts(gamma, k)
    states = []
    for s in range(k):
        row = sum((F.col("c")[s * k + j] for j in range(1, k)), F.col("c")[s * k])
        column = sum((F.col("c")[i * k + s] for i in range(1, k)), F.col("c")[s])
        states.append(F.struct(F.lit(s).alias("s"), F.col("mass")[s].alias("mass"), F.col("first")[s].alias("first"), row.alias("row"), column.alias("column"), F.col("c")[s * k + s].alias("stay")))
    long = wide.select("sid", "steps", F.explode(F.array(*states)).alias("x")).select("sid", "steps", "x.*")
    present = F.col("mass") >= 1
    used = present & (F.col("row") > 1e-6)
    p_self = F.least(F.greatest(F.col("stay") / F.when(F.col("row") > 1e-6, F.col("row")), F.lit(0.0)), F.lit(1.0 - 1e-9))
    entries, exits = F.col("column") - F.col("stay"), F.col("row") - F.col("stay")
    return long.select(
        "sid",
        "s",
        F.when(present, F.col("mass") / F.col("steps")).otherwise(0.0).alias("fo"),
        present.alias("present"),
        F.when(used, 1 / (1 - p_self)).alias("dt_mean"),
        F.when(used, F.col("first") + entries).otherwise(0.0).alias("n_visits"),
        F.when(used, (entries + exits) / F.greatest(F.col("steps") - 1, F.lit(1))).otherwise(0.0).alias("sr_state"),
    )


def junk_states(metrics: DataFrame, low_fo: float = 0.01, short_dt: float = 2.0, low_presence: float = 0.5) -> DataFrame:
    """By state: summaries of soft_metrics over sequences, and flags. A state without dwell times isn't flagged as short.

    The metrics are written once, for the means and the passes of the quantiles.
    """
    metrics = settled(metrics)
    names = ("fo", "dt_mean", "n_visits")
    long = metrics.select("s", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("y")) for c in names])).alias("x")).select("s", "x.metric", "x.y")
    found = quantiles(long, ["s", "metric"], "y", [0.5, 0.05])

    def of(metric: str, i: int) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("q")[i]))

    wide = found.groupBy(F.col("s").alias("_s")).agg(of("fo", 0).alias("fo_median"), of("fo", 1).alias("fo_q05"), of("dt_mean", 0).alias("dt_median"), of("n_visits", 0).alias("n_visits_median"))
    means = metrics.groupBy("s").agg(F.avg("fo").alias("fo_mean"), F.avg(flag(F.col("present"))).alias("presence_frac"), F.avg("dt_mean").alias("dt_mean"), F.avg("n_visits").alias("n_visits_mean"), F.avg("sr_state").alias("sr_state_mean"))
    both = means.join(wide, F.col("s").eqNullSafe(F.col("_s")), "left")
    out = both.select("s", "fo_median", "fo_mean", "fo_q05", "presence_frac", "dt_median", "dt_mean", "n_visits_median", "n_visits_mean", "sr_state_mean")
    fo, dt, there = F.col("fo_median") < low_fo, F.coalesce(F.col("dt_median") < short_dt, F.lit(False)), F.col("presence_frac") < low_presence
    return out.select("*", fo.alias("flag_low_fo"), dt.alias("flag_short_dt"), there.alias("flag_low_presence"), (fo | dt | there).alias("junk_state"))


def transition_rows(k: int) -> list[Column]:
    """The sums of the rows of the array c of expected counts."""
    return [total([F.col("c")[i * k + j] for j in range(k)]) for i in range(k)]


def soft_randomness(gamma: DataFrame, k: int) -> DataFrame:
    """sid, occ_entropy_bits, entropy_rate_bits, mean_self_transition.

    Rows of the transition matrix with an expected count below 1 count as missing: 0 in the rate, left out of the mean.
    """
    wide = expected_counts(gamma, k)
    rows, mass = transition_rows(k), cells(F.col("mass"), k)
    bits = [F.when(r >= 1, total([plogp(F.col("c")[i * k + j] / r) for j in range(k)])).otherwise(0.0) for i, r in enumerate(rows)]
    rate = total([m / total(mass) * b for m, b in zip(mass, bits)])
    stay = total([F.when(r >= 1, F.col("c")[i * k + i] / r).otherwise(0.0) for i, r in enumerate(rows)])
    known = total([F.when(r >= 1, 1).otherwise(0) for r in rows])
    return wide.select("sid", entropy_bits([m / F.col("steps") for m in mass]).alias("occ_entropy_bits"), rate.alias("entropy_rate_bits"), (stay / F.when(known > 0, known)).alias("mean_self_transition"))


def asymmetry(gamma: DataFrame, k: int) -> DataFrame:
    """sid, asym_raw, asym_norm: mean |P - P'| above the diagonal, and that over the mean |P + P'|; null if a row is missing, and
    for one state, which has nothing above the diagonal."""
    wide, rows = expected_counts(gamma, k), transition_rows(k)
    upper = [(i, j) for i in range(k) for j in range(i + 1, k)]
    if not upper:
        return wide.select("sid", F.lit(None).cast("double").alias("asym_raw"), F.lit(None).cast("double").alias("asym_norm"))
    p = {(i, j): F.col("c")[i * k + j] / F.when(rows[i] >= 1, rows[i]) for i in range(k) for j in range(k)}
    apart = total([F.abs(p[i, j] - p[j, i]) for i, j in upper]) / len(upper)
    joint = total([F.abs(p[i, j] + p[j, i]) for i, j in upper]) / len(upper)
    return wide.select("sid", apart.alias("asym_raw"), joint.alias("joint")).select("sid", "asym_raw", (F.col("asym_raw") / (F.col("joint") + 1e-12)).alias("asym_norm"))


def soft_switch(gamma: DataFrame, k: int | None = None) -> DataFrame:
    """sid, switch_rate_soft: mean chance of a change from step to step; null for sequences of one step."""
    both = with_next(gamma.select("sid", "t", "g"), "g", "h")
    stay = array_dot(F.col("g"), F.col("h")) if k is None else total([x * y for x, y in zip(cells(F.col("g"), k), cells(F.col("h"), k))])
    return both.select("sid", (1 - stay).alias("x")).groupBy("sid").agg(F.avg("x").alias("switch_rate_soft"))


def greatest(g: Column, k: int) -> Column:
    return F.greatest(*cells(g, k)) if k > 1 else g[0]


def indecision(gamma: DataFrame, k: int, dominant: float = 0.8, ambiguous: float = 0.5) -> DataFrame:
    """sid, steps, mean and median of entropy and of the greatest probability, shares of clear and of ambiguous steps."""
    x = gamma.select("sid", entropy_bits(cells(F.col("g"), k)).alias("h"), greatest(F.col("g"), k).alias("m"))
    half = F.lit(0.5)
    return x.groupBy("sid").agg(
        F.count("*").alias("steps"),
        F.avg("h").alias("entropy_mean"),
        F.percentile("h", half).alias("entropy_median"),
        F.avg("m").alias("max_mean"),
        F.percentile("m", half).alias("max_median"),
        F.avg(flag(F.col("m") >= dominant)).alias("frac_dominant"),
        F.avg(flag(F.col("m") < ambiguous)).alias("frac_ambiguous"),
    )


def sharpness(gamma: DataFrame, k: int) -> DataFrame:
    """One row: steps, median, p25, p75, least and most of the greatest probabilities."""
    m = gamma.select(greatest(F.col("g"), k).alias("m"))
    found = quantiles(m, [], "m", [0.5, 0.25, 0.75]).agg(F.first("q").alias("q"))  # one row, also where there is no step
    named = [F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("median", "p25", "p75"))]
    return m.agg(F.count("*").alias("steps"), F.min("m").alias("least"), F.max("m").alias("most")).crossJoin(F.broadcast(found)).select("steps", *named, "least", "most")


def histogram(gamma: DataFrame, k: int, bins: int = 20) -> DataFrame:
    """bin_left, bin_right, n of the greatest probabilities in equal bins of [0, 1], the last closed on the right."""
    spark = gamma.sparkSession
    b = F.least(F.floor(greatest(F.col("g"), k) * bins), F.lit(bins - 1)).cast("long")
    counted = gamma.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    return grid.join(counted, "bin", "left").select((F.col("bin") / bins).alias("bin_left"), ((F.col("bin") + 1) / bins).alias("bin_right"), F.coalesce("n", F.lit(0)).alias("n"))


def reliability(gamma: DataFrame, k: int, parts: int = 4, part_steps: int | None = None) -> DataFrame:
    """sid, fo_gamma_r: mean correlation, over pairs of parts, of the states' mean probabilities in the parts.

    With part_steps only sequences of exactly parts * part_steps steps are kept; without, each is cut into equal parts.
    """
    steps = F.count("*").over(W.partitionBy("sid"))
    rows = gamma.withColumn("steps", steps)
    if part_steps is not None:
        rows = rows.where(F.col("steps") == parts * part_steps)
    part = F.floor(F.col("t") * parts / F.col("steps")).cast("int")
    means = rows.withColumn("part", part).groupBy("sid", "part").agg(F.array(*[F.avg(F.col("g")[i]) for i in range(k)]).alias("m"))
    long = means.select("sid", "part", F.posexplode("m").alias("s", "x"))
    a, b = long.alias("a"), long.alias("b")
    both = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.part") < F.col("b.part")))
    by = both.groupBy(F.col("a.sid").alias("sid"), F.col("a.part").alias("p"), F.col("b.part").alias("q")).agg(safe_corr(F.col("a.x"), F.col("b.x")).alias("r"))
    return by.groupBy("sid").agg(F.avg("r").alias("fo_gamma_r"))
