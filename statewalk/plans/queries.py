"""Every registered query of the sequence engine. Each reads its whole tables; doubles are rounded to six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.functions.expressions import r6, safe_corr
from statewalk.operators import arhmm, chain, design, glm, longsequences, matrices, posterior, sequences, statistics
from statewalk.plans import roles
from statewalk.sources import matrix_files, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Permutations and iterations of the registered queries; of a sweep's fits, and of the fit that is checked against SQL.
PERMUTATIONS, ITERATIONS, SWEEP_ITERATIONS, FEW_ITERATIONS = 100, 100, 20, 2


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, integers to bigint."""
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns])


@query
def seq_occupancy(spark, sf):
    return rounded(sequences.occupancy(roles.events(spark, sf), 5))


@query
def seq_occupancy_describe(spark, sf):
    return rounded(sequences.occupancy_summary(sequences.occupancy(roles.events(spark, sf), 5)))


@query
def seq_dwell(spark, sf):
    return rounded(sequences.dwell(roles.events(spark, sf), 5).drop("iv_mean", "n_visits"))


@query
def seq_intervisit(spark, sf):
    return rounded(sequences.dwell(roles.events(spark, sf), 5).select("sid", "s", "n_visits", "iv_mean"))


@query
def seq_runs(spark, sf):
    return rounded(sequences.runs(roles.events(spark, sf)))


@query
def seq_switch_global(spark, sf):
    return rounded(sequences.switch_global(roles.events(spark, sf)))


@query
def seq_switch_state(spark, sf):
    return rounded(sequences.switch_state(roles.events(spark, sf), 5))


@query
def seq_transition_counts(spark, sf):
    return rounded(sequences.transition_counts(roles.events(spark, sf), 5))


@query
def seq_transition_probs(spark, sf):
    return rounded(sequences.transition_probs(roles.events(spark, sf), 5).drop("n"))


@query
def seq_row_entropy(spark, sf):
    return rounded(sequences.row_entropy(sequences.transition_probs(roles.events(spark, sf), 5)))


@query
def seq_self_transition(spark, sf):
    return rounded(sequences.self_transition(sequences.transition_probs(roles.events(spark, sf), 5)))


@query
def seq_state_metrics(spark, sf):
    return rounded(sequences.state_metrics(roles.orders(spark, sf), 3))


@query
def seq_lzc(spark, sf):
    return rounded(sequences.lzc(roles.turns(spark, sf)))


@query
def chain_stationary_k3(spark, sf):
    return rounded(chain.stationary_k3(sequences.transition_probs(roles.orders(spark, sf), 3)))


@query
def chain_gap_k3(spark, sf):
    return rounded(chain.gap_k3(sequences.transition_probs(roles.orders(spark, sf), 3)))


@query
def chain_entropy_rate_k3(spark, sf):
    probs = sequences.transition_probs(roles.orders(spark, sf), 3)
    return rounded(chain.entropy_rate(probs, chain.stationary_k3(probs)))


@query
def chain_stationary_general(spark, sf):
    out = chain.chain_general(sequences.transition_probs(roles.orders(spark, sf), 3), 3)
    return rounded(out.select("sid", F.posexplode("pi").alias("s", "pi"), "spectral_gap"))


@query
def seq_global_metrics(spark, sf):
    return rounded(chain.global_metrics(roles.orders(spark, sf), 3))


@query
def ts_zscore(spark, sf):
    rows = roles.table(spark, sf, "events").select(F.col("user_id").alias("sid"), "event_id", "value")
    return rounded(matrices.zscore(rows, ["sid"], "value").select("sid", "event_id", "z"))


@query
def map_zscore(spark, sf):
    patterns = matrices.mean_patterns(roles.features(spark, sf))
    return rounded(matrices.zscore(patterns, ["s"], "mean").select("s", "p", "z"))


@query
def state_mean_patterns(spark, sf):
    return rounded(matrices.mean_patterns(roles.features(spark, sf)))


@query
def state_weighted_mean_var(spark, sf):
    rows = roles.gamma(spark, sf)
    long = rows.select(F.posexplode("g").alias("s", "g"), F.array("price", "quantity").alias("xs")).select("s", "g", F.posexplode("xs").alias("p", "x"))
    out = matrices.weighted_moments(long)
    # the variance of prices is near 1e9: as many digits as a double's sum keeps
    return rounded(out.select("s", "p", F.round("mean", 4).alias("mean"), F.round(F.col("var") / F.greatest(F.col("mean") * F.col("mean"), F.lit(1.0)), 6).alias("var_over_mean_sq")))


@query
def pattern_correlations(spark, sf):
    return rounded(matrices.pattern_correlations(matrices.mean_patterns(roles.features(spark, sf))))


@query
def clone_pairs(spark, sf):
    return rounded(matrices.clone_pairs(matrices.mean_patterns(roles.features(spark, sf)), 0.05))


@query
def clone_max_corr(spark, sf):
    pairs = matrices.pattern_correlations(matrices.mean_patterns(roles.features(spark, sf)))
    return rounded(pairs.agg(F.max("corr").alias("max_corr"), F.count("corr").alias("n_pairs")))


@query
def beta_maps_hard(spark, sf):
    return rounded(matrices.beta_maps_hard(roles.features(spark, sf)))


@query
def beta_maps_soft(spark, sf):
    rows = roles.gamma(spark, sf).select("sid", "t", "g", F.array(F.col("price") / 1000.0, "quantity").alias("y"))
    return rounded(matrices.beta_maps_soft(rows))


@query
def soft_transitions(spark, sf):
    return rounded(posterior.soft_transitions(roles.gamma(spark, sf), 3))


@query
def soft_state_metrics(spark, sf):
    return rounded(posterior.soft_metrics(roles.gamma(spark, sf), 3))


@query
def junk_table(spark, sf):
    return rounded(posterior.junk_states(posterior.soft_metrics(roles.gamma(spark, sf), 3), 0.01, 2.0, 0.5))


@query
def soft_randomness(spark, sf):
    return rounded(posterior.soft_randomness(roles.gamma(spark, sf), 3))


@query
def asymmetry(spark, sf):
    return rounded(posterior.asymmetry(roles.gamma(spark, sf), 3))


@query
def soft_switch_rate(spark, sf):
    return rounded(posterior.soft_switch(roles.gamma(spark, sf), 3))


@query
def indecision_subject(spark, sf):
    return rounded(posterior.indecision(roles.gamma(spark, sf), 3))


@query
def posterior_sharpness(spark, sf):
    return rounded(posterior.sharpness(roles.gamma(spark, sf), 3))


@query
def posterior_hist(spark, sf):
    return rounded(posterior.histogram(roles.gamma(spark, sf), 3))


@query
def reliability_runs(spark, sf):
    return posterior.reliability(roles.gamma(spark, sf), 3).select("sid", (F.round("fo_gamma_r", 5) + 0.0).alias("fo_gamma_r"))


@query
def network_fingerprint(spark, sf):
    patterns = matrices.mean_patterns(roles.features(spark, sf))
    names = patterns.select("p").distinct().select("p", F.concat(F.lit("area_"), F.element_at(F.array(*[F.lit(x) for x in ("Vis", "SomMot", "Cont", "Default")]), F.col("p") % 4 + 1), F.lit("_"), F.col("p").cast("string")).alias("name"))
    tokens = spark.createDataFrame([("visual", "vis"), ("motor", "sommot"), ("motor", "motor"), ("control", "cont"), ("default", "default")], "network string, token string")
    return rounded(matrices.network_fingerprint(patterns, names, tokens))


@query
def nuisance_corr(spark, sf):
    metrics = sequences.switch_global(roles.orders(spark, sf))
    both = metrics.join(roles.covariates(spark, sf).select("sid", "fd", "y"), "sid", "left")
    return rounded(both.agg(safe_corr(F.col("sr_global"), F.col("fd")).alias("r_sr_fd"), safe_corr(F.col("sr_global"), F.col("y")).alias("r_sr_y"), F.count("fd").alias("n")))


@query
def group_mean_sd(spark, sf):
    return rounded(matrices.group_mean_sd(roles.parcels(spark, sf)))


@query
def parcel_summary(spark, sf):
    return rounded(matrices.parcel_summary(roles.parcels(spark, sf)))


@query
def parcel_wide(spark, sf):
    return rounded(matrices.parcel_wide(roles.parcels(spark, sf), [0, 1, 2]))


def _dense(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    return rows.select(F.col("l_suppkey").alias("sid"), F.col("l_linenumber").alias("t"), F.col("l_partkey").alias("elem"), F.col("l_quantity").alias("value"))


def _atlas(spark, sf):
    return roles.table(spark, sf, "part").select(F.col("p_partkey").alias("elem"), F.col("p_brand").alias("label"))


@query
def parcellate_mean(spark, sf):
    return rounded(matrices.parcellate(_dense(spark, sf), _atlas(spark, sf)))


@query
def parcellate_median(spark, sf):
    return rounded(matrices.parcellate(_dense(spark, sf), _atlas(spark, sf), "MEDIAN"))


@query
def paint_labels(spark, sf):
    values = roles.parcels(spark, sf).groupBy("s", F.col("p").alias("label")).agg(F.avg("value").alias("value"))
    return rounded(matrices.paint(_atlas(spark, sf), values))


@query
def covariate_normalize(spark, sf):
    raw = roles.table(spark, sf, "customer").select(
        F.concat(F.lit(" c"), F.lpad("c_custkey", 7, "0"), F.lit("_run1")).alias("sid"),
        F.element_at(F.array(*[F.lit(x) for x in ("m", " Female ", "1", "0.0", "", "x")]), (F.col("c_custkey") % 6 + 1).cast("int")).alias("sex"),
        F.col("c_mktsegment").alias("age_group"),
        F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("fd"),
    )
    return rounded(design.normalized_covariates(raw))


@query
def covariate_fallback_join(spark, sf):
    known = roles.covariates(spark, sf).select(
        F.when(F.col("sid") % 3 == 0, F.concat(F.lit("c"), F.col("sid").cast("string"), F.lit("_a"))).otherwise(F.concat(F.lit("c"), F.col("sid").cast("string"))).alias("sid"),
        F.concat(F.lit("c"), F.col("sid").cast("string")).alias("uid"),
        "sex",
        F.when(F.col("sid") % 7 != 0, F.col("fd")).alias("fd"),
    )
    seqs = roles.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("_b")).alias("sid")).distinct()
    return rounded(design.with_covariates(seqs, known, ["sex", "fd"]))


@query
def preferred_file(spark, sf):
    rows = roles.table(spark, sf, "orders")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("_"), F.when(F.col("o_orderstatus") == "P", "REST").otherwise("task"), F.col("o_orderkey").cast("string"), F.lit(".ptseries"))
    return design.preferred_files(rows.select(name.alias("name")))


@query
def one_hot_levels(spark, sf):
    return rounded(design.levels_in_order(roles.covariates(spark, sf), "age", "sid"))


@query
def design_matrix(spark, sf):
    rows = roles.covariates(spark, sf)
    levels = [r["level"] for r in design.levels_in_order(rows, "age", "sid").orderBy("place").collect()]
    coded = design.one_hot(rows, "age", levels, "age").select("sid", F.lit(1.0).alias("intercept"), *[F.col(f"age_{x}").alias(f"age_{i}") for i, x in enumerate(levels[1:], 1)], F.when(F.col("sex") == "M", 1.0).otherwise(0.0).alias("sex"), "fd")
    return rounded(design.demeaned(coded, ["sex", "fd"]))


@query
def design_mapping(spark, sf):
    subjects = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("sid"))
    return rounded(design.mapping(subjects, 3))


def _listed(spark, sf):
    """A list of ids in the order of a remainder: all customers, those of nation 0 a second time, and for each of these an id
    that no customer has."""
    rows = roles.table(spark, sf, "customer").select(F.pmod(F.col("c_custkey") * 7919, F.lit(1000003)).alias("pos"), F.col("c_custkey").alias("sid"), "c_nationkey")
    again = rows.where("c_nationkey = 0")
    return rows.select("pos", "sid").union(again.select(F.col("pos") + 1000003, "sid")).union(again.select(F.col("pos") + 2000006, -F.col("sid")))


@query
def stack_columns(spark, sf):
    return rounded(design.columns_of(_listed(spark, sf), 3))


@query
def order_join(spark, sf):
    listed, known = _listed(spark, sf), roles.covariates(spark, sf).select("sid", "sex", "y")
    found = design.in_order(known, listed).select("sid", "pos", "sex", "y")
    missing = design.absent(listed, known).select("sid", F.lit(None).cast("bigint").alias("pos"), F.lit("absent").alias("sex"), F.lit(None).cast("double").alias("y"))
    return rounded(found.union(missing))


@query
def group_stack(spark, sf):
    maps = roles.parcels(spark, sf).select("sid", "s", "p", "value")
    order = maps.select("sid").distinct().select(F.pmod(F.col("sid") * 31, F.lit(101)).alias("pos"), "sid")
    return rounded(design.stacked(maps, order, 3))


@query
def subject_level_design(spark, sf):
    cov = roles.covariates(spark, sf).select(F.col("sid").alias("pos"), "sid", "fd")
    rows = design.mapping(cov.select("pos", "sid"), 3).join(cov.select("sid", "fd"), "sid").withColumn("state_2", F.when(F.col("state") == 2, 1.0).otherwise(0.0))
    return rounded(design.subject_level(rows.select("sid", "state", "state_2", "fd")))


@query
def map_shapes(spark, sf):
    """Suppliers whose maps lack a state or a brand that the first supplier's have."""
    return rounded(design.wrong_shapes(roles.parcels(spark, sf), 3))


@query
def alignment_check(spark, sf):
    """Expected: all customers. Actual: those with orders, which leaves gaps, the ones in debt under another name."""
    customers = roles.table(spark, sf, "customer")
    state, name = (F.col("c_nationkey") % 3).alias("state"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    expected = customers.select(state, F.col("c_custkey").alias("pos"), name.alias("sid"))
    ordered = roles.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    actual = customers.join(ordered, "c_custkey").select(state, F.col("c_custkey").alias("pos"), F.when(F.col("c_acctbal") < 0, "other").otherwise(name).alias("sid"))
    return rounded(design.aligned(expected, actual, 10))


@query
def cohen_d(spark, sf):
    return rounded(statistics.cohen_d(roles.covariates(spark, sf).select("age", F.col("sex").alias("grp"), "y"), ["age"]))


@query
def eta_sq(spark, sf):
    return rounded(statistics.eta_sq(roles.covariates(spark, sf).select("sex", F.col("age").alias("grp"), "y"), ["sex"]))


@query
def residualize(spark, sf):
    return statistics.residualize(roles.covariates(spark, sf), ["sex"]).select("sid", F.round("r", 4).alias("r"))


def _tested(spark, sf, grp):
    return roles.covariates(spark, sf).select("sid", F.col("y").alias("r"), F.col(grp).alias("grp"))


@query
def perm_two_level(spark, sf):
    return rounded(statistics.two_level_test(_tested(spark, sf, "sex"), PERMUTATIONS))


@query
def perm_multi_level(spark, sf):
    return rounded(statistics.multi_level_test(_tested(spark, sf, "age"), PERMUTATIONS))


@query
def stats_state_effects(spark, sf):
    """Sex and age effects on the state metrics of the order sequences, with false-discovery control."""
    wide = sequences.state_metrics(roles.orders(spark, sf), 3)
    long = statistics.long_metrics(wide, ["sid", "s"], ["fo", "dt_mean", "iv_mean", "sr_state"])
    cov = roles.covariates(spark, sf).select("sid", "sex", "age", "fd")
    return rounded(statistics.effects(long.join(cov, "sid"), ("metric", "s"), PERMUTATIONS))


@query
def stats_between_effects(spark, sf):
    """The same for sequence-level metrics."""
    wide = sequences.switch_global(roles.orders(spark, sf)).withColumn("steps", F.col("steps").cast("double"))
    long = statistics.long_metrics(wide, ["sid"], ["sr_global", "steps"])
    cov = roles.covariates(spark, sf).select("sid", "sex", "age", "fd")
    return rounded(statistics.effects(long.join(cov, "sid"), ("metric",), PERMUTATIONS))


@query
def parcel_glm_fwe(spark, sf):
    """t of every brand's mean price between the suppliers' two groups, by state, with family-wise p."""
    stack = roles.parcels(spark, sf).select("s", "sid", "p", "value", F.col("sex").alias("grp"))
    return rounded(statistics.parcel_glm(stack, PERMUTATIONS, ("s",)))


@query
def parcel_sign_flip(spark, sf):
    """t of every brand's price against the supplier's mean, by state, with family-wise p by sign flips."""
    stack = statistics.beside(roles.parcels(spark, sf), ["s", "sid"], F.avg("value").alias("m"))
    return rounded(statistics.parcel_sign_flip(stack.select("s", "sid", "p", (F.col("value") - F.col("m")).alias("value")), PERMUTATIONS, ("s",)))


@query
def rm_omnibus(spark, sf):
    """State, age, sex and their interactions on two metrics of customers' orders, in one table with false-discovery control."""
    cov = roles.covariates(spark, sf).select("sid", "sex", "age")
    return rounded(statistics.rm_omnibus(roles.order_metrics(spark, sf).join(cov, "sid"), 3, PERMUTATIONS))


@query
def rm_state_f(spark, sf):
    return rounded(statistics.rm_state_f(roles.blocks(spark, sf), [], 3))


@query
def rm_state_perm(spark, sf):
    return rounded(statistics.rm_state_test(roles.blocks(spark, sf), 3, PERMUTATIONS))


def _blocks_by_sex(spark, sf):
    return roles.blocks(spark, sf).join(roles.covariates(spark, sf).select("sid", F.col("sex").alias("grp")), "sid")


@query
def rm_interaction_f(spark, sf):
    return rounded(statistics.rm_interaction_f(_blocks_by_sex(spark, sf), [], 3))


@query
def rm_interaction_perm(spark, sf):
    return rounded(statistics.rm_interaction_test(_blocks_by_sex(spark, sf), 3, PERMUTATIONS))


@query
def bh_adjust(spark, sf):
    rows = roles.table(spark, sf, "part").select("p_partkey", "p_brand", (F.pmod(F.col("p_retailprice") * 7.0, F.lit(1000.0)) / 1000.0).alias("p"))
    return rounded(statistics.benjamini_hochberg(rows, "p", ["p_partkey"], ["p_brand"]))


def _lags(spark, sf):
    from pyspark.sql.window import Window as W

    rows = roles.table(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    first = F.first("value").over(w)
    return rows.select(F.col("user_id").alias("sid"), "event_id", "value", F.coalesce(F.lag("value", 1).over(w), first).alias("lag1"), F.coalesce(F.lag("value", 2).over(w), first).alias("lag2"))


@query
def ar_lag_design(spark, sf):
    return rounded(_lags(spark, sf).drop("value"))


@query
def ar_emission_loglik(spark, sf):
    import math

    out = _lags(spark, sf).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    miss = F.col("value") - (F.when(F.col("s") == 0, F.col("lag1") * 0.5).otherwise(F.col("lag1") * -0.25) + 10.0)
    var = F.when(F.col("s") == 0, 100.0).otherwise(400.0)
    return rounded(out.select("sid", "event_id", "s", (-0.5 * (miss * miss / var + F.log(2 * math.pi * var))).alias("log_b")))


@query
def hmm_forward_fixed(spark, sf):
    """Log-likelihood of each conversation under a two-state model of fixed parameters (an answer is a hit)."""
    import numpy as np
    import pandas as pd

    start, stay, hit = roles.START, roles.STAY, roles.HIT
    seqs = arhmm.sequences(roles.turns(spark, sf).select("sid", "t", F.col("s").alias("y")))

    def run(batches):
        trans = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
        table = np.log(np.array([hit, [1 - h for h in hit]]))
        for batch in batches:
            lengths = np.array([len(x) for x in batch["x"]])
            if len(lengths):
                missed = (np.concatenate(batch["x"].to_list()) != 0).astype(int)
                yield pd.DataFrame({"sid": batch["sid"], "loglik": arhmm.recursions(table[missed], lengths, np.array(start), trans)[0]})

    return rounded(seqs.mapInPandas(run, "sid long, loglik double"))


def _value_sequences(spark, sf):
    from pyspark.sql.window import Window as W

    rows = roles.table(spark, sf, "events")
    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    z = matrices.zscore(rows.select(F.col("user_id").alias("sid"), "ts", "event_id", "value", t.alias("t")), ["sid"], "value")
    return arhmm.sequences(z.select("sid", "t", F.array("z").alias("y")))


@query
def hmm_fit_decode(spark, sf):
    seqs = _value_sequences(spark, sf)
    model = arhmm.fit(seqs, 2, order=1, max_iter=ITERATIONS, seed=42)
    out = arhmm.decode(seqs, model)
    return rounded(out.select("sid", "t", "s", F.col("g")[0].alias("g0"), F.col("g")[1].alias("g1"), "loglik"))


@query
def hmm_em_steps(spark, sf):
    """Log-likelihood and parameters before each of two iterations from fixed ones: two states, one feature, no lag."""
    import numpy as np

    from statewalk.operators.arhmm import Parameters, statistics as sums, update

    seqs = _value_sequences(spark, sf)
    (a, b), (stay0, stay1) = roles.START, roles.STAY
    p = Parameters(np.array([a, b]), np.array([[stay0, 1 - stay0], [1 - stay1, stay1]]), np.array([[[roles.LEVELS[0]]], [[roles.LEVELS[1]]]]), np.ones((2, 1)), np.zeros((2, 1)), 0)
    rows = []
    with arhmm.kept(seqs) as (held, parts):
        for i in range(FEW_ITERATIONS + 1):
            found = sums(held, p, parts)
            rows.append((i, float(found[0][0]), *(float(x) for x in (p.start[0], p.trans[0, 0], p.trans[1, 1], p.weights[0, 0, 0], p.weights[1, 0, 0], p.var[0, 0], p.var[1, 0]))))
            p = update(found, p)
    return rounded(spark.createDataFrame(rows, "step int, loglik double, start0 double, stay0 double, stay1 double, level0 double, level1 double, var0 double, var1 double"))


@query
def sweep_summary(spark, sf):
    from statewalk.plans.selection import sweep, summary_by_k

    return rounded(summary_by_k(sweep(_value_sequences(spark, sf), [2, 3], [1, 2], max_iter=SWEEP_ITERATIONS)))


@query
def segment_index(spark, sf):
    """Each sequence's place in the rows of all, by id."""
    return rounded(sequences.segment_index(roles.events(spark, sf)))


@query
def state_text(spark, sf):
    """Each sequence's states as text, one a line, which is what the sink writes."""
    return sequences.state_text(roles.events(spark, sf))


@query
def exchange_blocks(spark, sf):
    """A block of exchange for each listed subject, in the list's order, on each of its rows."""
    subjects = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("sid"))
    return rounded(design.exchange_blocks(design.mapping(subjects, 3)))


@query
def beta_features(spark, sf):
    """Regression maps beside the rows of the series they come from: distance of each vector to its state's map."""
    rows = roles.features(spark, sf)
    return rounded(matrices.beta_distance(rows, matrices.beta_maps_hard(rows)))


@query
def used_parcels(spark, sf):
    """The parcel maps of listed subjects, one copy for each time that a subject is listed."""
    maps = roles.parcels(spark, sf).select("sid", "s", "p", "value")
    listed = roles.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), "l_linestatus").agg(F.min("l_orderkey").alias("pos")).select("pos", "sid")
    return rounded(design.listed_rows(maps, listed).groupBy("s", "p").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query
def unknown_states(spark, sf):
    """Names in a columns map that aren't state names, with the times they occur."""
    rows = roles.table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "error").otherwise(F.concat(F.lit("state"), F.length("event_type").cast("string"))).alias("state"))
    return rounded(design.unknown_states(rows))


@query
def series_files(spark, sf):
    """The events' values as a matrix file for each user, written and read back: step and value."""
    folder = roles.shared_folder(spark, "series")
    rows = roles.table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("_value.txt")).alias("name"), F.struct("ts", "event_id").alias("t"), F.array("value").alias("y"))
    matrix_files.write(rows, folder)
    return rounded(matrix_files.series(spark, folder).select(F.col("sid").cast("bigint").alias("sid"), "t", F.col("y")[0].alias("value")))


@query
def series_shapes(spark, sf):
    """Shapes of the same files, found without parsing them, and whether they are used."""
    folder = roles.shared_folder(spark, "series")
    rows = roles.table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("_value.txt")).alias("name"), F.struct("ts", "event_id").alias("t"), F.array("value").alias("y"))
    matrix_files.write(rows, folder)
    return rounded(readers.preflight(matrix_files.shapes(spark, folder)).select("name", "n_dim", "rows", "p", "keep"))


#: Steps of a chunk where all events are one sequence.
ONE_CHUNK = 512


def _one_sequence(spark, sf):
    """All events as one sequence: a single id that holds every row."""
    rows = roles.table(spark, sf, "events").withColumn("all", F.lit(0).cast("bigint"))
    return sequences.positions_in_ranges(rows, "all", ["ts", "event_id"], "event_type", roles.EVENT_STATES)


@query
def one_sequence_dwell(spark, sf):
    """Runs of the one sequence, summarised by state, in chunks."""
    return rounded(sequences.dwell(_one_sequence(spark, sf), 5, ONE_CHUNK))


@query
def one_sequence_transitions(spark, sf):
    return rounded(sequences.transition_counts(_one_sequence(spark, sf), 5, ONE_CHUNK))


@query
def hmm_one_sequence(spark, sf):
    """Probabilities of two hidden states of fixed parameters at every step of the one sequence (a purchase is a hit)."""
    import numpy as np

    start, stay, hit = roles.START, roles.STAY, roles.HIT
    p = arhmm.Parameters(np.array(start), np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]]), np.zeros((2, 1, 1)), np.ones((2, 1)), np.zeros((2, 1)), 0)

    def emit(x, halo):
        missed = (x[halo:, 0] != 0).astype(int)
        return np.log(np.array([hit, [1 - h for h in hit]]))[missed]

    bought = F.lit(float(roles.EVENT_STATES.index("purchase")))
    steps = _one_sequence(spark, sf).select("sid", "t", F.array(F.col("s") - bought).alias("y"))
    out = longsequences.decode(longsequences.chunks(steps, 0, ONE_CHUNK), p, emit)
    return rounded(out.select("t", F.col("g")[0].alias("g0"), "loglik"))


def _supplier_design(spark, sf):
    """Intercept, balance and group of the suppliers, exchanged within blocks of nations."""
    rows = roles.table(spark, sf, "supplier")
    sid = F.col("s_suppkey")
    return rows.select(sid.alias("sid"), F.lit(1.0).alias("intercept"), (F.col("s_acctbal") / 1000.0).alias("fd"), F.when(sid % 2 == 0, 1.0).otherwise(0.0).alias("sex"), (F.col("s_nationkey") % 3).alias("block"))


@query
def parcel_glm_design(spark, sf):
    """t of the suppliers' group beside intercept and balance in every brand's prices, permuted within blocks, one-tailed."""
    stack = roles.parcels(spark, sf).select("s", "sid", "p", "value")
    return rounded(glm.parcel_design_test(stack, _supplier_design(spark, sf), ["intercept", "fd", "sex"], [0, 0, 1], PERMUTATIONS, ("s",), two_tailed=False))
