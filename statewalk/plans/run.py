"""A full run: series and covariates in, metric, quality-control, map, design and statistics tables out.

Every stage writes one table under a path that carries the parameters it depends on and a fingerprint of the input; a stage
whose table is there is read instead of run again, unless force is set. Other input in the same folder gets tables of its own.
"""

from __future__ import annotations

import itertools
import json
import logging
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.functions.expressions import safe_corr
from statewalk.operators import arhmm, chain, design, glm, matrices, posterior, sequences, statistics
from statewalk.plans.config import Config
from statewalk.plans.selection import scorecard, scored, summary_by_k
from statewalk.sources import matrix_files, writers
from statewalk.sources.writers import existing, keyed_table, report

LOG = logging.getLogger("statewalk")
#: Columns of a metrics table that aren't metrics.
NOT_METRICS = {"sid", "uid", "s", "sex", "age_group", "age", "fd"}
STATE_METRICS = ["fo", "dt_mean", "dt_median", "dt_var", "n_visits", "iv_mean", "sr_state", "row_entropy_bits", "self_transition"]


def numeric_columns(df: DataFrame) -> list[str]:
    """The metrics of a table: its numeric columns but for those that name or describe a subject."""
    return [c for c, kind in df.dtypes if c not in NOT_METRICS and (kind in ("double", "float", "int", "bigint", "smallint") or kind.startswith("decimal"))]


def fingerprint(df: DataFrame) -> str:
    """A number of a table's rows and columns, whatever the order of its rows."""
    total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{int(total[1] or 0) % (1 << 64):016x}{total[0]}"



@dataclass
class Run:
    """series: (sid, t, y array); covariates: (sid, uid, sex, age_group, fd)."""

    spark: SparkSession
    config: Config
    root: str
    series: DataFrame
    covariates: DataFrame
    force: bool = False

    def _stage(self, name: str, make: Callable[[], DataFrame], **params) -> DataFrame:
        found = None if self.force else existing(self.spark, self.root, name, **params)
        if found is not None:
            LOG.info("%s: read", name)
            return found
        began = time.perf_counter()
        out = self.spark.read.parquet(keyed_table(make(), self.root, name, **params))
        LOG.info("%s: written in %.1f s", name, time.perf_counter() - began)
        return out

    @cached_property
    def _series(self) -> dict:
        return {"series": fingerprint(self.series.select("sid", "t", "y"))}

    @cached_property
    def _known(self) -> dict:
        return {"cov": fingerprint(self.covariates.select("sid", "uid", "sex", "age_group", "fd"))}

    @property
    def _fit(self) -> dict:
        h = self.config.hmm
        return {"K": h.K, "seed": h.seed, "order": h.ar_order, "max_iter": h.max_iter, "backend": h.backend, **self._series}

    @property
    def _all(self) -> dict:
        return {**self._fit, **self._known}

    def training(self) -> DataFrame:
        """sid, t, y, each feature z-scored within its sequence."""

        def make() -> DataFrame:
            long = self.series.select("sid", "t", F.posexplode("y").alias("p", "value"))
            z = matrices.zscore(long, ["sid", "p"], "value")
            rows = z.groupBy("sid", "t").agg(F.sort_array(F.collect_list(F.struct("p", "z"))).alias("x"))
            return rows.select("sid", "t", F.transform("x", lambda v: v["z"]).alias("y"))

        return self._stage("training", make, **self._series)

    def segments(self) -> DataFrame:
        """sid, start, end, n_tr, in the order of the sequences."""
        return self._stage("segments", lambda: sequences.segment_index(self.training()), **self._series)

    def model(self) -> arhmm.Parameters:
        """Fitted, or read from the table that an earlier run wrote."""
        h = self.config.hmm

        def make() -> DataFrame:
            p = arhmm.backend(h.backend)(arhmm.sequences(self.training()), h.K, order=h.ar_order, max_iter=h.max_iter, seed=h.seed)
            row = (p.start.tolist(), p.trans.tolist(), p.weights.tolist(), p.var.tolist(), p.means.tolist(), p.order, p.loglik)
            return self.spark.createDataFrame([row], "start array<double>, trans array<array<double>>, weights array<array<array<double>>>, var array<array<double>>, means array<array<double>>, `order` int, loglik double")

        r = self._stage("model", make, **self._fit).first()
        return arhmm.Parameters(*[np.array(r[c]) for c in ("start", "trans", "weights", "var", "means")], r["order"], r["loglik"])

    def decoded(self) -> DataFrame:
        """sid, t, s, g (six decimals), loglik."""
        make = lambda: arhmm.decode(arhmm.sequences(self.training()), self.model()).withColumn("g", F.transform("g", lambda x: F.round(x, 6)))
        return self._stage("decoded", make, **self._fit)

    def _covariates(self, df: DataFrame) -> DataFrame:
        return design.with_covariates(df, self.covariates, ["sex", "age_group", "fd"])

    def metrics_state(self) -> DataFrame:
        return self._stage("metrics_state", lambda: self._covariates(sequences.state_metrics(self.decoded(), self.config.hmm.K)), **self._all)

    def metrics_global(self) -> DataFrame:
        return self._stage("metrics_global", lambda: self._covariates(chain.global_metrics(self.decoded(), self.config.hmm.K)), **self._all)

    def transitions(self) -> DataFrame:
        return self._stage("transitions_long", lambda: self._covariates(sequences.transition_probs(self.decoded(), self.config.hmm.K)), **self._all)

    def quality(self) -> dict[str, DataFrame]:
        """Sharpness, histogram, occupancy summary and correlations of metrics with the nuisance."""
        k, decoded = self.config.hmm.K, self.decoded()
        metrics = self.metrics_global()
        pairs = statistics.long_metrics(metrics, ["fd"], numeric_columns(metrics)).where("fd is not null and y is not null")
        made = {
            "posterior_sharpness": lambda: posterior.sharpness(decoded, k),
            "posterior_hist": lambda: posterior.histogram(decoded, k, self.config.qc.bins),
            "fo_summary": lambda: sequences.occupancy_summary(sequences.occupancy(decoded, k)),
            "fd_correlations": lambda: pairs.groupBy("metric").agg(safe_corr(F.col("y"), F.col("fd")).alias("r_with_fd")),
        }
        return {name: self._stage(f"qc_{name}", make, bins=self.config.qc.bins, **self._all) for name, make in made.items()}

    def maps(self) -> DataFrame:
        """sid, s, p, beta, z: regression maps of the series on the posterior, and their z-scores over features."""

        def make() -> DataFrame:
            rows = self.series.join(self.decoded().select("sid", "t", "g"), ["sid", "t"])
            return matrices.zscore(matrices.beta_maps_soft(rows), ["sid", "s"], "beta")

        return self._stage("maps", make, **self._fit)

    def group_maps(self) -> DataFrame:
        return self._stage("group_maps", lambda: matrices.group_mean_sd(self.maps().withColumnRenamed("z", "value")), **self._fit)

    def write_maps(self) -> str:
        """Matrix files under root/map_files: of each subject its maps (a line for each state) and their z-scores, by parcel too (a
        line for each parcel), and of each state the group's mean, deviation and stack (a line for each subject of the design)."""
        folder, k = f"{self.root.rstrip('/')}/map_files", self.config.hmm.K

        def lines(rows: DataFrame, name, line: str, place: str, value: str) -> DataFrame:
            out = rows.groupBy(name.alias("name"), F.col(line).alias("t")).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("i"), F.col(value).alias("v")))).alias("y"))
            return out.select("name", "t", F.transform("y", lambda x: x["v"]).alias("y"))

        def named(column: str, ending: str):
            return F.concat(F.col(column).cast("string"), F.lit(ending))

        maps, group = self.maps(), self.group_maps().withColumn("name", F.concat(F.lit("state"), F.col("s").cast("string")))
        matrix_files.write(lines(maps, named("sid", "_beta.txt"), "s", "p", "beta").union(lines(maps, named("sid", "_z.txt"), "s", "p", "z")), f"{folder}/subjects")
        matrix_files.write(lines(maps, named("sid", f"_z_parcels_{k}S.txt"), "p", "s", "z"), f"{folder}/parcels")
        matrix_files.write(lines(group, named("name", "_mean.txt"), "s", "p", "mean").union(lines(group, named("name", "_sd.txt"), "s", "p", "sd")), f"{folder}/group")
        if self.subjects().limit(1).count():
            stacks = self.stacks().withColumn("name", F.concat(F.lit("state"), F.col("state").cast("string")))
            matrix_files.write(lines(stacks, named("name", "_stack.txt"), "col_index", "p", "value"), f"{folder}/stacks")
        return folder

    def mean_patterns(self) -> DataFrame:
        """s, p, mean: the model's means."""
        rows = [(s, p, float(v)) for s, row in enumerate(self.model().means) for p, v in enumerate(row)]
        return self._stage("mean_patterns", lambda: self.spark.createDataFrame(rows, "s int, p int, mean double"), **self._fit)

    def _long(self, wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
        return statistics.long_metrics(wide.withColumnRenamed("age_group", "age"), [*keys, "sid", "sex", "age", "fd"], metrics)

    def effects_state(self) -> DataFrame:
        n = self.config.stats.n_perm_rm
        return self._stage("stats_state", lambda: statistics.effects(self._long(self.metrics_state(), ["s"], STATE_METRICS), ("metric", "s"), n), n_perm=n, **self._all)

    def effects_between(self) -> DataFrame:
        n, wide = self.config.stats.n_perm_between, self.metrics_global()
        return self._stage("stats_between", lambda: statistics.effects(self._long(wide, [], numeric_columns(wide)), ("metric",), n), n_perm=n, **self._all)

    def omnibus(self) -> DataFrame:
        """State, age, sex and their interactions on every state metric."""
        n, k = self.config.stats.n_perm_rm, self.config.hmm.K
        return self._stage("stats_omnibus", lambda: statistics.rm_omnibus(self._long(self.metrics_state(), ["s"], STATE_METRICS), k, n), n_perm=n, **self._all)

    def subjects(self) -> DataFrame:
        """pos, sid, sex, age_group, fd: the sequences with known sex, in their order, as rows of the design."""

        def make() -> DataFrame:
            order = self.segments().select("sid", F.col("start").alias("pos"))
            known = self._covariates(order).where(F.col("sex").isin("M", "F"))
            return sequences.numbered(known, "pos").select("pos", "sid", "sex", "age_group", "fd")

        return self._stage("subjects", make, **self._series, **self._known)

    def design(self) -> tuple[DataFrame, list[str]]:
        """row_key, sid, state and the design's columns, one row for each subject and state, and the columns' names."""
        d, k = self.config.group_design, self.config.hmm.K
        subjects = self.subjects()
        levels = [r["level"] for r in design.levels_in_order(subjects, "age_group", "pos").orderBy("place").collect()]
        rows = design.mapping(subjects.select("pos", "sid"), k, d.state_major).join(subjects.drop("pos"), "sid")
        columns = {"intercept": F.lit(1.0)}
        columns |= {f"age[{x}]": F.when(F.col("age_group") == x, 1.0).otherwise(0.0) for x in levels[1:]}
        columns["sex"] = F.when(F.col("sex") == "M", 1.0).otherwise(0.0)
        if d.include_fd is not False:
            columns["fd"] = F.coalesce("fd", F.lit(0.0))
        columns |= {f"state[{i}]": F.when(F.col("state") == i, 1.0).otherwise(0.0) for i in range(2, k + 1)}
        coded = rows.select("row_key", "sid", "state", *[c.alias(name) for name, c in columns.items()])
        return design.demeaned(coded, [c for c in d.demean if c in columns]), list(columns)

    def write_design(self) -> str:
        """The design's files under root/design: matrix, contrast, groups, blocks, mapping, columns, subjects and levels, and the
        matrix and contrast of subjects alone."""
        folder = f"{self.root.rstrip('/')}/design"
        rows, names = self.design()
        blocks = design.exchange_blocks(design.mapping(self.subjects().select("pos", "sid"), self.config.hmm.K, self.config.group_design.state_major))
        writers.matrix_file(rows, "row_key", names, f"{folder}/design.mat")
        writers.lines(blocks.select("row_key", F.col("block").cast("string").alias("value")), f"{folder}/eb.txt")
        writers.lines(rows.select("row_key", F.concat_ws("\t", "row_key", "sid", "state").alias("value")), f"{folder}/mapping.tsv", ["row\tsubid\tstate"])
        writers.lines(rows.select("row_key", F.lit("1").alias("value")), f"{folder}/design.grp", ["/NumWaves 1", f"/NumPoints {rows.count()}", "/Matrix"])
        used = self.subjects()
        writers.lines(used.select(F.col("pos").alias("row_key"), F.concat_ws("\t", F.col("pos") + 1, "sid", F.coalesce("age_group", F.lit("")), "sex", F.coalesce(F.col("fd").cast("string"), F.lit(""))).alias("value")), f"{folder}/subjects_used.csv", ["row\tsid\tage\tsex\tfd"])
        levels = design.levels_in_order(used, "age_group", "pos")
        writers.lines(levels.select(F.col("place").alias("row_key"), F.col("level").alias("value")), f"{folder}/age_levels.txt")
        own = [c for c in names if not c.startswith("state")]
        writers.matrix_file(rows.where("state = 1"), "row_key", own, f"{folder}/design_subjects.mat")
        for columns, name in ((names, "design"), (own, "design_subjects")):
            wanted = self.config.group_design.contrast
            weights = design.contrast(columns, wanted)
            writers.text_file(self.spark, writers.contrast_text([columns[weights.index(1)]], [weights]), f"{folder}/{name}.con")
            writers.text_file(self.spark, "\n".join(columns) + "\n", f"{folder}/{name}_cols.txt")
        return folder

    def stacks(self) -> DataFrame:
        """state, col_index, sid, p, value: each state's maps of all used subjects, in the design's order."""
        values = "z" if self.config.palm.use_zscored else "beta"
        make = lambda: design.stacked(self.maps().select("sid", "s", "p", F.col(values).alias("value")), self.subjects(), self.config.hmm.K)
        return self._stage("stacks", make, values=values, **self._all)

    def columns_map(self) -> DataFrame:
        """state, col_index, sid of the stacks, checked against the order of the design: a mismatch is an error."""
        found = self._stage("columns_map", lambda: self.stacks().select("state", "col_index", "sid").distinct(), **self._all)
        expected = design.columns_of(self.subjects(), self.config.hmm.K).withColumnRenamed("col_index", "pos")
        wrong = design.aligned(expected, found.withColumnRenamed("col_index", "pos"), 10).orderBy("state", "pos").limit(10).collect()
        if wrong:
            raise ValueError(f"the stacks' columns differ from the design: {wrong}")
        return found

    def parcel_tests(self) -> DataFrame | None:
        """state, p, t, p_fwe of the stacks: the contrast of the subjects' design, by permutation or, for one sample, sign flips."""
        t = self.config.palm
        if not t.enabled:
            return None
        rows, names = self.design()
        own = [c for c in names if not c.startswith("state")]
        wanted = self.config.group_design.contrast
        wanted = wanted if wanted in own else "intercept" if t.one_sample else None
        weights = design.contrast(own, wanted)
        make = lambda: glm.parcel_design_test(self.stacks(), rows.where("state = 1").select("sid", *[F.col(f"`{c}`") for c in own]), own, weights, t.n_perm, ("state",), t.one_sample, t.two_tailed)
        return self._stage("parcel_tests", make, n_perm=t.n_perm, one_sample=t.one_sample, two_tailed=t.two_tailed, contrast=weights.index(1), **self._all)

    def parcel_stats(self) -> DataFrame:
        """s, p, n, mean, sd, mean_m, mean_f of the subjects' maps."""
        values = "z" if self.config.palm.use_zscored else "beta"

        def make() -> DataFrame:
            maps = self.maps().select("sid", "s", "p", F.col(values).alias("value"))
            return matrices.parcel_summary(self._covariates(maps).select("sid", "s", "p", "value", "sex"))

        return self._stage("parcel_stats", make, values=values, **self._all)

    def selection(self) -> DataFrame | None:
        """The scorecard by number of states. Each fit is a stage of its own with its detectors' tables, so that a run that was
        stopped goes on after the last one; a fit that failed is tried again."""
        e, h = self.config.evaluation, self.config.hmm
        if not e.enabled:
            return None
        how = {"order": h.ar_order, "max_iter": h.max_iter}
        limits = {k: v for k, v in asdict(e).items() if k not in ("enabled", "K_values", "seeds")}
        rows = []
        for k, seed in itertools.product(sorted(set(e.K_values)), sorted(set(e.seeds))):
            params = {"K": k, "seed": seed, **how, "limits": fingerprint(self.spark.createDataFrame([(json.dumps(limits, sort_keys=True),)], "x string")), **self._series}
            done = None if self.force else existing(self.spark, self.root, "selection_run", **params)
            if done is not None:
                rows += [r.asDict() for r in done.collect()]
                continue
            row = scored(arhmm.sequences(self.training()), k, seed, settings=e, keep=lambda name, df, p=params: keyed_table(df, self.root, f"selection_{name}", **p), **how)
            rows.append(row)
            LOG.info("selection: %d states, seed %d: %s", k, seed, row.get("error", "done"))
            if "error" not in row:
                keyed_table(scorecard(self.spark, [row]), self.root, "selection_run", **params)
        card = scorecard(self.spark, rows)  # one row a fit
        writers.text_file(self.spark, writers.scorecard_json(card), f"{self.root.rstrip('/')}/selection_scorecard.json")
        for row in rows:
            page = report(f"{row['k']:.0f} states, seed {row['seed']:.0f}", {"scorecard": scorecard(self.spark, [row])})
            writers.text_file(self.spark, page, f"{self.root.rstrip('/')}/selection_pages/K={row['k']:.0f}/seed={row['seed']:.0f}")
        return summary_by_k(card)

    def write_texts(self) -> None:
        """States and probabilities of each sequence as text, under root/text."""
        writers.state_text(sequences.state_text(self.decoded()), f"{self.root.rstrip('/')}/text/states")
        writers.posterior_text(self.decoded(), f"{self.root.rstrip('/')}/text/gamma")

    def all(self) -> str:
        """Every stage in order; returns the report's HTML."""
        self.segments()
        self.mean_patterns()
        tables = {"state metrics": self.metrics_state(), "global metrics": self.metrics_global(), **self.quality()}
        self.transitions()
        self.write_texts()
        self.group_maps()
        self.write_maps()
        tables["parcels"] = self.parcel_stats()
        tables |= {"omnibus": self.omnibus(), "state effects": self.effects_state(), "between effects": self.effects_between()}
        if self.subjects().limit(1).count():
            self.write_design()
            self.stacks()
            self.columns_map()
        for name, found in (("parcel tests", self.parcel_tests()), ("selection", self.selection())):
            if found is not None:
                tables[name] = found
        return report("Sequence states", tables)
