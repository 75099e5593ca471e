"""Group statistics: effect sizes, residuals, permutation tests, repeated-measures F, false-discovery control."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.functions.expressions import flag, total
from statewalk.operators import permutations


def beside(rows: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """rows with aggregates of their family: windows by family, and for all rows together one row that is joined to each."""
    if not by:
        return rows.crossJoin(F.broadcast(rows.agg(*aggregates)))  # one row
    own = rows.groupBy(*by).agg(*aggregates)
    return rows.join(own, by)


def cohen_d(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, d of rows (grp in M, F; y): mean difference over the pooled deviation; 0 where that is 0 or a group is empty."""

    def of(level: str):
        return F.when(F.col("grp") == level, F.col("y"))

    m, f = of("M"), of("F")
    agg = rows.groupBy(*by).agg(F.count(m).alias("nm"), F.count(f).alias("nf"), F.avg(m).alias("m"), F.avg(f).alias("f"), F.var_samp(m).alias("vm"), F.var_samp(f).alias("vf"))
    spread = (F.col("nm") - 1) * F.coalesce("vm", F.lit(0.0)) + (F.col("nf") - 1) * F.coalesce("vf", F.lit(0.0))
    sd = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.greatest(F.col("nm") + F.col("nf") - 2, F.lit(1)))
    return agg.select(*by, F.when((F.col("nm") > 0) & (F.col("nf") > 0) & (sd > 0), (F.col("m") - F.col("f")) / F.when(sd > 0, sd)).otherwise(0.0).alias("d"))


def eta_sq(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, eta_sq of rows (grp, y): between-level share of the sum of squares; 0 without spread.

    A null level counts in the total only. Rows are only summed by level; means and squares come from the levels' few rows.
    """
    level = rows.groupBy(*by, "grp").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"))
    known = level.where("n > 0")
    own = W.partitionBy(*by) if by else W.partitionBy()
    known = known.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own))
    square = F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)
    out = known.groupBy(*by).agg(F.sum(F.when(F.col("grp").isNotNull(), square).otherwise(0.0)).alias("ssb"), F.sum(square + F.col("n") * F.col("var")).alias("sst"))
    return out.select(*by, F.when(F.col("sst") > 0, F.col("ssb") / F.when(F.col("sst") > 0, F.col("sst"))).otherwise(0.0).alias("eta_sq"))


def residualize(rows: DataFrame, by: list[str], nuisance: str = "fd") -> DataFrame:
    """rows with r: y less its regression on intercept and nuisance. Missing nuisance takes its mean (0 if all is missing);
    a constant nuisance has slope 0. Rows without y are dropped."""
    known = rows.where(F.col("y").isNotNull())
    both = F.when(F.col(nuisance).isNotNull(), F.col("y"))
    figures = {"_my": F.avg("y"), "_mx": F.avg(nuisance), "_sxy": F.covar_pop(F.col(nuisance), both), "_sxx": F.var_pop(nuisance)}
    if by:
        own = W.partitionBy(*by)
        x = known.select("*", *[f.over(own).alias(name) for name, f in figures.items()])
    else:
        x = beside(known, [], *[f.alias(name) for name, f in figures.items()])
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.when(F.col("_sxx") > 0, F.col("_sxx"))).otherwise(0.0)
    return x.withColumn("r", F.col("y") - F.col("_my") - slope * F.coalesce(F.col(nuisance) - F.col("_mx"), F.lit(0.0))).drop(*figures)


def permuted(rows: DataFrame, n_perm: int, by: tuple[str, ...] = (), seed: str = "42") -> DataFrame:
    """rows (by, sid, grp, ...) with perm (0 for the labels as they are, then 1..n_perm) and labels dealt anew.

    Rows of a family are numbered once by label and sid; permutation i gives row j the label at the place that a keyed bijection
    of the places gives it. Only the numbering sorts, in ranges.
    """
    placed = permutations.labelled_places(rows, list(by))
    return permutations.deal(placed.rows, n_perm, placed.levels, seed)


#: A statistic of a permutation reaches the observed one if it is less by no more than this share, which rounding can make up:
#: permutations that leave the groups as they are sum the same values in another order.
ROUNDING = 1e-9


def p_value(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, stat, p_perm, n_perm of stats (by, perm, stat): (permutations of at least the observed statistic + 1) / (permutations + 1).

    A missing observed statistic has no p. Statistics are not negative.
    """
    seen = stats.where("perm = 0").select(*by, F.col("stat").alias("seen"))
    rest = stats.where("perm > 0")
    both = rest.join(seen, list(by)) if by else rest.crossJoin(F.broadcast(seen))  # without families, seen is one row
    hits = both.groupBy(*by, "seen").agg(F.sum((F.col("stat") >= F.col("seen") * (1 - ROUNDING)).cast("long")).alias("hits"), F.count("*").alias("n_perm"))
    return hits.select(*by, F.col("seen").alias("stat"), F.when(F.col("seen").isNotNull(), (F.coalesce("hits", F.lit(0)) + 1) / (F.col("n_perm") + 1)).alias("p_perm"), "n_perm")


def two_level_test(rows: DataFrame, n_perm: int, by: tuple[str, ...] = ()) -> DataFrame:
    """|mean of M - mean of F| of rows (by, sid, r, grp) and its permutation p; null where a group is empty."""
    n, mean = F.col("sums")[0], {}
    for g in ("M", "F"):
        own = F.sum(F.when(F.col("grp") == g, n))
        mean[g] = F.sum(F.when(F.col("grp") == g, F.col("sums")[1])) / F.when(own > 0, own)
    sums = dealt_values(rows, n_perm, by)
    return p_value(sums.groupBy(*by, "perm").agg(F.abs(mean["M"] - mean["F"]).alias("stat")), by)


def dealt_values(rows: DataFrame, n_perm: int, by: tuple[str, ...]) -> DataFrame:
    """by, perm, grp, sums (number and sum of the known r) of rows (by, sid, r, grp) under the labels as they are and dealt anew."""
    placed = permutations.labelled_places(rows, list(by))
    return permutations.dealt_sums(placed, [flag(F.col("r").isNotNull()), F.coalesce("r", F.lit(0.0))], list(by), n_perm)


def multi_level_test(rows: DataFrame, n_perm: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Eta squared of rows (by, sid, r, grp) over all levels and its permutation p.

    The total sum of squares is the same under all permutations; that between levels comes from sums of r less its mean.
    """
    by = list(by)
    figures = [F.avg("r").alias("_mean"), (F.var_pop("r") * F.count("r")).alias("_sst")]
    whole = permutations.settled(rows.groupBy(*by).agg(*figures))  # one row a family
    match = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by]

    def with_whole(df: DataFrame) -> DataFrame:
        own = whole.select(*[F.col(c).alias(f"_w_{c}") for c in by], "_mean", "_sst")
        return df.join(own, match).drop(*[f"_w_{c}" for c in by]) if by else df.crossJoin(F.broadcast(own))

    left = with_whole(rows).withColumn("r", F.col("r") - F.col("_mean")).drop("_mean", "_sst")
    n, t = F.col("sums")[0], F.col("sums")[1]
    known = dealt_values(left, n_perm, tuple(by)).where(n > 0)
    # the sum over levels of n (mean - grand) ** 2; a null level counts in the grand mean only
    named = F.col("grp").isNotNull()
    parts = known.groupBy(*by, "perm").agg(F.sum(n).alias("n"), F.sum(t).alias("t"), F.sum(F.when(named, t * t / n)).alias("q"), F.sum(F.when(named, n)).alias("m"), F.sum(F.when(named, t)).alias("u"))
    grand = F.col("t") / F.col("n")
    between = F.greatest(F.coalesce(F.col("q") - grand * F.col("u") * 2 + F.col("m") * grand * grand, F.lit(0.0)), F.lit(0.0))
    stat = F.when(F.col("_sst") > 0, between / F.when(F.col("_sst") > 0, F.col("_sst"))).otherwise(0.0)
    return p_value(with_whole(parts).select(*by, "perm", stat.alias("stat")), tuple(by))


def effects(rows: DataFrame, by: tuple[str, ...], n_perm: int) -> DataFrame:
    """by, factor, stat, p_perm, effect, effect_name, q_bh of rows (by, sid, y, sex, age, fd): one row for each factor.

    y is residualised on the nuisance within each family. sex is tested between M and F with Cohen's d as its effect, age
    over all levels with eta squared. The q control false discoveries over all rows of the table.
    """
    left = permutations.settled(residualize(rows, list(by)).select(*by, "sid", "r", "sex", "age"))  # read by both tests and both effects
    sex = left.select(*by, "sid", "r", F.col("sex").alias("grp"))
    age = left.select(*by, "sid", "r", F.col("age").alias("grp"))
    d = cohen_d(sex.withColumnRenamed("r", "y"), list(by)).withColumnRenamed("d", "effect")
    eta = eta_sq(age.withColumnRenamed("r", "y"), list(by)).withColumnRenamed("eta_sq", "effect")
    parts = []
    for factor, test, effect, name in (("Sex", two_level_test(sex, n_perm, by), d, "cohen_d"), ("AgeGroup", multi_level_test(age, n_perm, by), eta, "eta_sq")):
        parts.append(test.join(effect, list(by)).select(*by, F.lit(factor).alias("factor"), "stat", "p_perm", "effect", F.lit(name).alias("effect_name")))
    return benjamini_hochberg(parts[0].unionByName(parts[1]), "p_perm", [*by, "factor"])


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, y: one row for each metric of the list that is a column; absent ones are passed by."""
    there = [m for m in metrics if m in wide.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in there]))
    return wide.select(*keys, pairs.alias("x")).select(*keys, "x.metric", "x.y")


def parcel_glm(stack: DataFrame, n_perm: int, by: tuple[str, ...] = (), seed: str = "42") -> DataFrame:
    """by, p, t, p_fwe of stack (by, sid, p, value, grp): two-sample t of each parcel and its family-wise p by the greatest |t|.

    Labels are permuted over the sequences of a family, the same way for all its parcels, so the greatest statistic keeps their
    dependence.
    """
    subjects = permutations.labelled_places(stack.groupBy(*by, "sid").agg(F.min("grp").alias("grp")), list(by))
    dealt = permutations.deal(stack.select(*by, "sid", "p", "value").join(subjects.rows, [*by, "sid"]), n_perm, subjects.levels, seed)
    m, f = (F.when(F.col("grp") == g, F.col("value")) for g in ("M", "F"))
    sums = dealt.groupBy(*by, "perm", "p").agg(F.count(m).alias("nm"), F.count(f).alias("nf"), F.avg(m).alias("m"), F.avg(f).alias("f"), F.var_samp(m).alias("vm"), F.var_samp(f).alias("vf"))
    pooled = ((F.col("nm") - 1) * F.col("vm") + (F.col("nf") - 1) * F.col("vf")) / F.when(F.col("nm") + F.col("nf") > 2, F.col("nm") + F.col("nf") - 2)
    t = (F.col("m") - F.col("f")) / F.when(pooled > 0, F.sqrt(pooled * (1 / F.col("nm") + 1 / F.col("nf"))))
    return greatest_p(sums.select(*by, "perm", "p", t.alias("t")), by)


def greatest_p(stats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, p, t, p_fwe of stats (by, perm, p, t): the share of permutations whose greatest |t| reaches a parcel's."""
    seen = stats.where("perm = 0").select(*by, "p", "t")
    most = stats.where("perm > 0").groupBy(*by, "perm").agg(F.max(F.abs("t")).alias("most"))
    both = seen.join(most, list(by)) if by else seen.crossJoin(F.broadcast(most))  # one row a permutation
    hits = both.groupBy(*by, "p", "t").agg(F.sum((F.col("most") >= F.abs("t") * (1 - ROUNDING)).cast("long")).alias("hits"), F.count("*").alias("n"))
    return hits.select(*by, "p", "t", F.when(F.col("t").isNotNull(), (F.coalesce("hits", F.lit(0)) + 1) / (F.col("n") + 1)).alias("p_fwe"))


def parcel_sign_flip(stack: DataFrame, n_perm: int, by: tuple[str, ...] = (), seed: str = "42") -> DataFrame:
    """by, p, t, p_fwe of stack (by, sid, p, value): one-sample t of each parcel's mean against zero, and its family-wise p.

    A permutation turns the signs of about half of the sequences, all parcels of a sequence alike, by md5(seed, i, sid).
    """
    flip = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "perm", "sid").cast("binary")), 1, 1) < "8"
    times = stack.select(*by, "sid", "p", "value").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    signed = times.withColumn("value", F.when((F.col("perm") > 0) & flip, -F.col("value")).otherwise(F.col("value")))
    sums = signed.groupBy(*by, "perm", "p").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return greatest_p(sums.select(*by, "perm", "p", (F.col("m") / F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("n"))).alias("t")), by)


def benjamini_hochberg(rows: DataFrame, p: str, tie: list[str], family: list[str] | None = None) -> DataFrame:
    """rows with q_bh: p times the family's size over its rank, made monotone from the largest p down, within [0, 1].

    A null p has no q and doesn't count. Ties are ordered by `tie`; their q are equal whatever the order. Families are sorted
    each in its own task; without families `adjusted` sorts all rows in many.
    """
    if not family:
        return adjusted(rows, p)
    part = W.partitionBy(*family)
    known = F.col(p).isNotNull()
    up = part.orderBy(F.col(p).asc_nulls_last(), *tie)
    m = F.sum(known.cast("int")).over(part)
    raw = F.when(known, F.col(p) * m / F.row_number().over(up))
    down = part.orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_raw", raw).withColumn("_rank", F.row_number().over(up))
    q = F.least(F.min("_raw").over(down), F.lit(1.0))
    return out.withColumn("q_bh", F.when(known, F.greatest(q, F.lit(0.0)))).drop("_raw", "_rank")


#: Bands of p-values for each factor of two, by which a family of any size is sorted in parts.
BANDS = 64


def adjusted(rows: DataFrame, p: str) -> DataFrame:
    """The same for one family of any size: equal p share a q, so distinct p are ranked by their counts, band by band.

    Only the bands' totals, a bounded number of rows, are put in order in one place. The rows are written once, as they are ranked
    by themselves.
    """
    rows = permutations.settled(rows)
    band = F.when(F.col("_p") > 0, F.floor(F.log2("_p") * BANDS)).otherwise(F.lit(-(1 << 20))).alias("_band")
    values = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")).select("_p", "_c", band)
    totals = values.groupBy("_band").agg(F.sum("_c").alias("_n"))
    totals = beside(totals, [], F.sum("_n").alias("_m")).select("_band", "_m", (F.sum("_n").over(W.orderBy("_band")) - F.col("_n")).alias("_before"))
    inside = W.partitionBy("_band").orderBy("_p")
    ranked = values.join(totals, "_band").withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_before") + F.sum("_c").over(inside)))
    least = ranked.groupBy("_band").agg(F.min("_raw").alias("_least"))
    later = F.min("_least").over(W.orderBy(F.desc("_band")).rowsBetween(W.unboundedPreceding, -1))
    least = least.select("_band", F.coalesce(later, F.lit(1.0)).alias("_later"))
    down = W.partitionBy("_band").orderBy(F.desc("_p"))
    found = ranked.join(least, "_band").select(F.col("_p"), F.greatest(F.least(F.min("_raw").over(down), F.col("_later"), F.lit(1.0)), F.lit(0.0)).alias("q_bh"))
    return rows.join(found, F.col(p) == F.col("_p"), "left").drop("_p")


def complete_blocks(rows: DataFrame, k: int) -> DataFrame:
    """rows (sid, s, y) of the sids that have all k states."""
    return rows.withColumn("_n", F.count("*").over(W.partitionBy("sid"))).where(F.col("_n") == k).drop("_n")


def rm_state_f(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, n_sid, f_obs, df_num, df_den, partial_eta2 of complete blocks (sid, s, y): the effect of the state within sids.

    Closed form of the nested-model F with sid dummies: the sums of squares within sids and of states are taken from group
    means, so rows are only summed.
    Degrees of freedom count columns, the nuisance constant within a sid among them: N k - N - k. Where blocks aren't complete
    the closed form doesn't hold, and there is no F.
    """
    sids = rows.groupBy(*by, "sid").agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.count("*").alias("n"))
    sums = sids.groupBy(*by).agg(F.count("*").alias("n_sid"), F.sum("n").alias("cells"), F.sum(F.col("n") * F.col("v")).alias("within"))
    states = rows.groupBy(*by, "s").agg(F.avg("y").alias("m")).groupBy(*by).agg(F.var_pop("m").alias("spread"))
    sums = sums.join(states, by) if by else sums.crossJoin(F.broadcast(states))  # one row a family
    sums = sums.withColumn("ss_state", F.col("cells") * F.col("spread"))
    rss = F.col("within") - F.col("ss_state")
    num, den = F.lit(k - 1), F.col("n_sid") * k - F.col("n_sid") - k
    f = F.when((rss > 0) & (den > 0) & (F.col("cells") == F.col("n_sid") * k), (F.col("ss_state") / num) / (rss / F.when(den > 0, den)))
    return sums.select(*by, "n_sid", f.alias("f_obs"), num.cast("long").alias("df_num"), den.cast("long").alias("df_den"), (F.col("ss_state") / F.when(F.col("ss_state") + rss > 0, F.col("ss_state") + rss)).alias("partial_eta2"))


def rm_state_test(rows: DataFrame, k: int, n_perm: int, by: tuple[str, ...] = (), seed: str = "42") -> DataFrame:
    """f_obs of the state effect and its permutation p: states are permuted within each sid, by a hashed order.

    Dealing a sid's values over its states changes the states' means alone, so a permutation is only summed by state: no row of it
    is moved. Where a sid hasn't k rows there is no F.
    """
    by = list(by)
    own = F.sort_array(F.collect_list(F.struct("s", "y")))
    sids = permutations.settled(rows.groupBy(*by, "sid").agg(own.alias("own"), F.var_pop("y").alias("v"), F.count("*").alias("n")))
    base = sids.groupBy(*by).agg(F.count("*").alias("n_sid"), F.sum("n").alias("cells"), F.sum(F.col("n") * F.col("v")).alias("within"), F.max((F.col("n") != k).cast("int")).alias("other"))
    at = [F.get("own", F.lit(i)) for i in range(k)]
    ranked = ranked_within(sids.select(*by, "sid", "own"), [x.isNotNull() for x in at], [x["s"] for x in at], n_perm, seed)
    dealt = ranked.select(*by, "perm", *[F.coalesce(*[F.when(F.col(f"_h{i}") == j, x["y"]) for i, x in enumerate(at)]).alias(f"_d{j}") for j in range(k)])
    means = dealt.groupBy(*by, "perm").agg(*[F.avg(f"_d{j}").alias(f"_m{j}") for j in range(k)])
    mean = total([F.col(f"_m{j}") for j in range(k)]) / k
    spread = total([F.pow(F.col(f"_m{j}") - mean, 2) for j in range(k)]) / k
    both = means.join(base, by) if by else means.crossJoin(F.broadcast(base))  # one row a family
    state, den = F.col("cells") * spread, F.col("n_sid") * k - F.col("n_sid") - k
    rss = F.col("within") - state
    f = F.when((rss > 0) & (den > 0) & (F.col("other") == 0), (state / (k - 1)) / (rss / F.when(den > 0, den))) if k > 1 else F.lit(None).cast("double")
    return p_value(both.select(*by, "perm", f.alias("stat")), tuple(by))


def ranked_within(rows: DataFrame, there: list[Column], labels: list[Column], n_perm: int, seed: str) -> DataFrame:
    """rows (sid, ...) under permutations 0 to n_perm: perm, and _h0, _h1, ..., the place of each of a row's values among those that
    are there, in their own order for 0, else by md5(seed, perm, sid, label). Few values a row are compared one by one, in compiled
    code, which functions over arrays aren't."""

    def one(x: Column) -> Column:
        return F.when(x, 1).otherwise(0)

    k = len(there)
    times = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    keys = times.withColumns({f"_key{i}": F.when(there[i], F.md5(F.concat_ws(":", F.lit(seed), "perm", "sid", labels[i]).cast("binary"))) for i in range(k)})

    def rank(i: int) -> Column:
        key, own = F.col(f"_key{i}"), total([F.lit(0)] + [one(there[j]) for j in range(i)])
        less = total([F.lit(0)] + [one(F.col(f"_key{j}") <= key if j < i else F.col(f"_key{j}") < key) for j in range(k) if j != i])
        return F.when(there[i], F.when(F.col("perm") == 0, own).otherwise(less))

    return keys.withColumns({f"_h{i}": rank(i) for i in range(k)}).drop(*[f"_key{i}" for i in range(k)])


def rm_interaction_f(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, f_obs, df_num, df_den, partial_eta2 of complete blocks (sid, s, y, grp): the interaction of the level with the state.

    Within a sid, y less the sid's mean leaves states and interaction only: the former explains the states' sum of squares,
    both together that of the cells of level and state. Degrees of freedom count columns, the sid's level and nuisance among
    them: (g - 1)(k - 1) and N k - N - g k. The level's main effect is absorbed by the sids and has no F of its own.
    """
    return interaction_f(centred(rows.where(F.col("grp").isNotNull()), by), by, k)


def centred(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, sid, y, ...) with c: y less the sid's mean."""
    return rows.withColumn("c", F.col("y") - F.avg("y").over(W.partitionBy(*by, "sid")))


def interaction_f(x: DataFrame, by: list[str], k: int) -> DataFrame:
    """rm_interaction_f of centred rows (by, s, c, grp): sums only."""
    return cells_f(x.groupBy(*by, "grp", "s").agg(F.count("*").alias("n"), F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("q")), by, k)


def cells_f(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """The same of the cells (by, grp, s, n, t, q): number, sum and sum of squares of c."""
    states = cells.groupBy(*by, "s").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("cells"), F.count("*").alias("g"))
    out = states.groupBy(*by).agg(F.sum("q").alias("q"), F.sum("cells").alias("cells"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("states"), F.max("g").alias("g"), F.max("n").alias("n_sid"))
    gain, rss = F.greatest(F.col("cells") - F.col("states"), F.lit(0.0)), F.col("q") - F.col("cells")
    num, den = (F.col("g") - 1) * (k - 1), F.col("n_sid") * (k - 1) - F.col("g") * k
    f = F.when((num > 0) & (den > 0) & (rss > 0), (gain / F.when(num > 0, num)) / (rss / F.when(den > 0, den)))
    return out.select(*by, f.alias("f_obs"), num.cast("long").alias("df_num"), den.cast("long").alias("df_den"), (gain / F.when(gain + rss > 0, gain + rss)).alias("partial_eta2"))


def rm_interaction_test(rows: DataFrame, k: int, n_perm: int, by: tuple[str, ...] = (), seed: str = "42") -> DataFrame:
    """f_obs of the interaction and its permutation p: levels are permuted over sids, each sid keeping one level."""
    known = rows.where(F.col("grp").isNotNull())
    sids = permutations.labelled_places(known.select(*by, "sid", "grp").distinct(), list(by))
    own = centred(known.select(*by, "sid", "s", "y"), list(by)).join(sids.rows, [*by, "sid"])
    sums = permutations.dealt_sums(sids._replace(rows=own), [F.lit(1.0), F.col("c"), F.col("c") * F.col("c")], list(by), n_perm, seed, ("s",))
    cells = sums.select(*by, "perm", "grp", "s", F.col("sums")[0].cast("long").alias("n"), F.col("sums")[1].alias("t"), F.col("sums")[2].alias("q"))
    return p_value(cells_f(cells, [*by, "perm"], k).select(*by, "perm", F.col("f_obs").alias("stat")), by)


def subject_blocks(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, sid, n (states that have a value), c (array: each state's value less the sid's mean, 0 where it has none), m (array of 1
    and 0: which have one), q (sum of squares of c) of rows (by, sid, s, y). Repeated values of a state are averaged.

    Centring within sids absorbs the sids' columns, and with them whatever is constant within a sid.
    """
    wide = rows.groupBy(*by, "sid").agg(*[F.avg(F.when(F.col("s") == i, F.col("y"))).alias(f"_y{i}") for i in range(k)])
    values = [F.col(f"_y{i}") for i in range(k)]
    held = wide.withColumn("n", total([F.when(y.isNotNull(), 1).otherwise(0) for y in values])).where("n > 0")
    held = held.withColumn("_m", total([F.coalesce(y, F.lit(0.0)) for y in values]) / F.col("n"))
    out = held.select(*by, "sid", "n", F.array(*[F.coalesce(y - F.col("_m"), F.lit(0.0)) for y in values]).alias("c"), F.array(*[flag(y.isNotNull()) for y in values]).alias("m"))
    return out.withColumn("q", total([F.col("c")[i] * F.col("c")[i] for i in range(k)]))


def gram(k: int) -> Column:
    """The sums over sids of the products of the centred state columns: the upper triangle, row by row."""
    m = [F.col("m")[i] for i in range(k)]
    return F.array(*[F.sum(m[i] * ((1.0 if i == j else 0.0) - m[j] / F.col("n"))) for i in range(k) for j in range(i, k)])


def centred_sums(k: int) -> Column:
    return F.array(*[F.sum(F.col("c")[i]) for i in range(k)])


def explained(k: int):
    """A function of the arrays gram and c: the sum of squares that the states explain, by the pseudo-inverse of each small matrix."""
    i, j = np.triu_indices(k)

    def solve(grams: pd.Series, sums: pd.Series) -> pd.Series:
        g, c = np.zeros((len(grams), k, k)), np.stack(sums) if len(sums) else np.zeros((0, k))
        if len(grams):
            g[:, i, j] = np.stack(grams)
            g[:, j, i] = g[:, i, j]
        return pd.Series(np.einsum("ni,nij,nj->n", c, np.linalg.pinv(g, rcond=1e-9, hermitian=True), c))

    return F.pandas_udf(solve, "double")


def _f(gain: Column, rss: Column, num: Column, den: Column) -> list[Column]:
    """f, df_num, df_den, partial_eta2; no F without freedom or where nothing is left over."""
    gain = F.greatest(gain, F.lit(0.0))
    f = F.when((num > 0) & (den > 0) & (rss > 0), (gain / F.when(num > 0, num)) / (rss / F.when(den > 0, den)))
    return [f.alias("f_obs"), num.cast("long").alias("df_num"), den.cast("long").alias("df_den"), (gain / F.when(gain + rss > 0, gain + rss)).alias("partial_eta2")]


FIGURES = ("f_obs", "df_num", "df_den", "partial_eta2")


def state_term(blocks: DataFrame, by: list[str], k: int, n_perm: int, seed: str = "42") -> DataFrame:
    """by, f_obs, p_perm, df_num, df_den, partial_eta2 of the state within sids, blocks being complete or not.

    A permutation deals a sid's values to the states that it has, in a hashed order, within the sid's row; which states it has,
    and so the products of the columns, stays.
    """
    base = blocks.groupBy(*by).agg(F.count("*").alias("n_sid"), F.sum("n").alias("rows"), F.sum("q").alias("all"), gram(k).alias("gram"))

    there = [F.col("m")[i] > 0 for i in range(k)]
    ranked = ranked_within(blocks.select(*by, "sid", "c", "m"), there, [F.lit(i) for i in range(k)], n_perm, seed)
    # a state that a sid has gets the value whose place in the hashed order is the state's place among the sid's own
    own = [total([F.lit(0)] + [F.when(there[j], 1).otherwise(0) for j in range(i)]) for i in range(k)]
    dealt = ranked.select(*by, "perm", *[F.when(there[j], F.coalesce(*[F.when(F.col(f"_h{i}") == own[j], F.col("c")[i]) for i in range(k)])).otherwise(0.0).alias(f"_d{j}") for j in range(k)])
    sums = dealt.groupBy(*by, "perm").agg(F.array(*[F.sum(f"_d{j}") for j in range(k)]).alias("sums"))
    found = sums.join(base, by).withColumn("gain", explained(k)("gram", "sums"))
    num, den = F.lit(k - 1), F.col("rows") - F.col("n_sid") - k
    return _with_p(found.select(*by, "perm", *_f(F.col("gain"), F.col("all") - F.col("gain"), num, den)), by)


def interaction_term(blocks: DataFrame, levels: DataFrame, by: list[str], k: int, n_perm: int, seed: str = "42") -> DataFrame:
    """The same of a level's interaction with the state. levels: (by, sid, grp) of the sids that have one.

    States and interaction together are a state effect of each level's own, so their sum of squares is that of the levels by
    themselves. Levels are dealt anew over sids.
    """
    placed = permutations.labelled_places(levels, by)
    own = blocks.join(placed.rows, [*by, "sid"])
    base = own.groupBy(*by).agg(F.count("*").alias("n_sid"), F.sum("n").alias("rows"), F.sum("q").alias("all"), F.countDistinct("grp").alias("g"), gram(k).alias("gram"), centred_sums(k).alias("sums"))
    base = base.withColumn("states", explained(k)("gram", "sums")).drop("gram", "sums")
    m, n_gram = [F.col("m")[i] for i in range(k)], k * (k + 1) // 2
    products = [m[i] * ((1.0 if i == j else 0.0) - m[j] / F.col("n")) for i in range(k) for j in range(i, k)]  # of `gram`
    each = permutations.dealt_sums(placed._replace(rows=own), products + [F.col("c")[i] for i in range(k)], by, n_perm, seed)
    each = each.select(*by, "perm", "grp", F.slice("sums", 1, n_gram).alias("gram"), F.slice("sums", n_gram + 1, k).alias("sums"))
    cells = each.withColumn("gain", explained(k)("gram", "sums")).groupBy(*by, "perm").agg(F.sum("gain").alias("cells"))
    found = cells.join(base, by)
    num, den = (F.col("g") - 1) * (k - 1), F.col("rows") - F.col("n_sid") - F.col("g") * k
    return _with_p(found.select(*by, "perm", *_f(F.col("cells") - F.col("states"), F.col("all") - F.col("cells"), num, den)), by)


def _with_p(stats: DataFrame, by: list[str]) -> DataFrame:
    stats = permutations.settled(stats)  # one row a permutation, read for the observed figures and for p
    p = p_value(stats.select(*by, "perm", F.col("f_obs").alias("stat")), tuple(by)).select(*by, "p_perm")
    return stats.where("perm = 0").select(*by, *FIGURES).join(p, by).select(*by, "f_obs", "p_perm", *FIGURES[1:])


def rm_omnibus(rows: DataFrame, k: int, n_perm: int) -> DataFrame:
    """metric, term, f_obs, p_perm, df_num, df_den, partial_eta2, q_bh of rows (metric, sid, s, y, sex, age): for each metric the
    terms State, AgeGroup, AgeGroup:State, Sex and Sex:State beside the sids and the nuisance, in one table.

    Sids may lack any states. The nuisance and the main effects of sex and age are constant within a sid: its columns absorb
    them, so those two terms have degrees of freedom but no F and no p; the nuisance counts as a column. A sid's level is its
    first one. State is tested by dealing states within sids, the interactions by dealing levels over sids. The q control
    false discoveries over all rows of the table.
    """
    by = ["metric"]
    known = rows.where(F.col("y").isNotNull())
    blocks = permutations.settled(subject_blocks(known, by, k))
    none = F.lit(None).cast("double")
    order = ["metric", "term", "f_obs", "p_perm", *FIGURES[1:]]
    parts = [state_term(blocks, by, k, n_perm).withColumn("term", F.lit("State")).select(*order)]
    for factor, term in (("age", "AgeGroup"), ("sex", "Sex")):
        levels = permutations.settled(known.groupBy("metric", "sid").agg(F.min_by(factor, "s").alias("grp")).where("grp is not null"))
        size = blocks.join(levels, ["metric", "sid"]).groupBy("metric").agg(F.sum("n").alias("rows"), F.count("*").alias("n"), F.countDistinct("grp").alias("g"))
        num, den = F.col("g") - 1, F.col("rows") - F.col("n") - k - F.col("g") + 1
        parts.append(size.select("metric", F.lit(term).alias("term"), none.alias("f_obs"), none.alias("p_perm"), num.cast("long").alias("df_num"), den.cast("long").alias("df_den"), none.alias("partial_eta2")))
        parts.append(interaction_term(blocks, levels, by, k, n_perm).withColumn("term", F.lit(f"{term}:State")).select(*order))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return benjamini_hochberg(table, "p_perm", ["metric", "term"])
