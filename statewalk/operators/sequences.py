"""Metrics of hard state sequences: rows (sid, t, s) with s in 0..k-1 and t the step within a sequence."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from statewalk.functions.expressions import plogp
from statewalk.operators.numbering import places, running_sum, settled
from statewalk.operators.quantiles import quantiles


def by_step():
    return W.partitionBy("sid").orderBy("t")


#: Steps of a sequence that one window holds. Windows are by sequence and chunk, so a sequence of any length is many tasks' work.
CHUNK = 1 << 16


def by_chunk():
    return W.partitionBy("sid", "_c").orderBy("t")


def beside_borders(seq: DataFrame, chunk: int, ahead: bool = False) -> DataFrame:
    """seq with _c, the chunk of each step, and _own. The step before a chunk (after it, with ahead) is in it too, not as its own,
    so that a window of the chunk sees over its border. t counts from 0 without gaps."""
    c = F.floor(F.col("t") / chunk).cast("int")
    border = (F.col("t") % chunk == 0) & (c > 0) if ahead else F.col("t") % chunk == chunk - 1
    both = F.when(border, F.array(c, c - 1 if ahead else c + 1)).otherwise(F.array(c))
    return seq.select("*", F.explode(both).alias("_c")).withColumn("_own", F.col("_c") == c)


def with_previous(seq: DataFrame, column: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """seq with the column's value one step before; null at a sequence's first step."""
    return beside_borders(seq, chunk).withColumn(name, F.lag(column).over(by_chunk())).where("_own").drop("_c", "_own")


def with_next(seq: DataFrame, column: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """seq with the column's value one step later; null at a sequence's last step."""
    return beside_borders(seq, chunk, ahead=True).withColumn(name, F.lead(column).over(by_chunk())).where("_own").drop("_c", "_own")


def positions(rows: DataFrame, sid: str, order: list[str], state: str, states: list[str]) -> DataFrame:
    """(sid, t, s) from rows: t numbers each sequence's rows in `order` from 0, s is the place of the state in `states`.

    `order` has to be unique within a sequence. States that are not listed are left out before numbering.
    """
    s = (F.array_position(F.array(*[F.lit(x) for x in states]), F.col(state)) - 1).cast("int")
    w = W.partitionBy("sid").orderBy(*order)
    kept = rows.select(F.col(sid).alias("sid"), *order, s.alias("s")).where("s >= 0")
    return kept.withColumn("t", (F.row_number().over(w) - 1).cast("int")).select("sid", "t", "s")


def positions_in_ranges(rows: DataFrame, sid: str, order: list[str], state: str, states: list[str]) -> DataFrame:
    """`positions` where a sequence may hold most of all rows: they are numbered in ranges, whichever sequence they are of."""
    s = (F.array_position(F.array(*[F.lit(x) for x in states]), F.col(state)) - 1).cast("int")
    kept = rows.select(F.col(sid).alias("sid"), *order, s.alias("s")).where("s >= 0")
    return places(kept, order, ["sid"], "t").select("sid", F.col("t").cast("int").alias("t"), "s")


def every_state(steps: DataFrame, k: int, name: str = "s") -> DataFrame:
    """Each row of steps with each state."""
    return steps.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def occupancy(seq: DataFrame, k: int) -> DataFrame:
    """sid, s, n, fo: visits and share of steps of all k states. One aggregation by sid, with one sum for each state."""
    sums = [F.sum((F.col("s") == i).cast("long")).alias(f"n{i}") for i in range(k)]
    wide = seq.groupBy("sid").agg(F.count("*").alias("steps"), *sums)
    long = wide.select("sid", "steps", F.posexplode(F.array(*[f"n{i}" for i in range(k)])).alias("s", "n"))
    return long.select("sid", "s", "n", (F.col("n") / F.greatest("steps", F.lit(1))).alias("fo"))


def occupancy_summary(occ: DataFrame) -> DataFrame:
    """By state: count, mean, std, min, quartiles and max of the sequences' shares."""
    occ = settled(occ)
    found = quantiles(occ, ["s"], "fo", [0.25, 0.5, 0.75]).withColumnRenamed("s", "_s")
    out = occ.groupBy("s").agg(F.count("*").alias("n"), F.avg("fo").alias("mean"), F.stddev_samp("fo").alias("std"), F.min("fo").alias("least"), F.max("fo").alias("most"))
    return out.join(found, F.col("s").eqNullSafe(F.col("_s")), "left").select("s", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "most")


def runs(seq: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """sid, s, t0, length: maximal runs of one state.

    A run is known by its first step. Within a chunk that is the last step so far at which the state changed; steps before any
    change go on with a run of an earlier chunk, whose first step comes from the chunks' own last changes, one row a chunk.
    """
    new = F.when(F.lag("s").over(by_chunk()).eqNullSafe(F.col("s")), None).otherwise(F.col("t"))
    steps = beside_borders(seq, chunk).withColumn("_new", new).where("_own")
    latest = F.max("_new").over(by_chunk().rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = steps.withColumn("_t0", latest).groupBy("sid", "_c", "s", "_t0").agg(F.count("*").alias("length"))
    # at most one group of a chunk has no first step of its own
    ends = inside.groupBy("sid", "_c").agg(F.max("_t0").alias("_last"))
    carried = ends.withColumn("_from", F.last("_last", ignorenulls=True).over(W.partitionBy("sid").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).where("_from is not null").select("sid", "_c", "_from")
    found = inside.join(carried, ["sid", "_c"], "left").withColumn("t0", F.coalesce("_t0", "_from"))
    return found.groupBy("sid", "s", "t0").agg(F.sum("length").alias("length"))


def dwell(seq: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """sid, s, dt_mean, dt_median, dt_var, n_visits, iv_mean of all k states; zeros for states without a visit.

    dt_var has one degree of freedom less and is 0 for one visit; iv_mean is the mean step between starts of successive
    visits, 0 for fewer than two.
    """
    # the gaps between starts add up to the way from the first start to the last
    between = (F.max("t0") - F.min("t0")) / F.when(F.count("*") > 1, F.count("*") - 1)
    by = runs(seq, chunk).groupBy("sid", "s").agg(
        F.avg("length").alias("dt_mean"), F.percentile("length", F.lit(0.5)).alias("dt_median"), F.var_samp("length").alias("dt_var"), F.count("*").alias("n_visits"), between.alias("iv_mean")
    )
    grid = every_state(seq.select("sid").distinct(), k)
    joined = grid.join(by, ["sid", "s"], "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dt_mean", "dt_median", "dt_var")]
    return joined.select("sid", "s", *zero, F.coalesce("n_visits", F.lit(0)).alias("n_visits"), F.coalesce("iv_mean", F.lit(0.0)).alias("iv_mean"))


def switch_global(seq: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """sid, steps, switches, sr_global: share of steps at which the state changes, 0 for sequences of one step."""
    changed = (F.col("s") != F.col("_p")).cast("long")
    by = with_previous(seq, "s", "_p", chunk).withColumn("changed", changed).groupBy("sid").agg(F.count("*").alias("steps"), F.coalesce(F.sum("changed"), F.lit(0)).alias("switches"))
    return by.withColumn("sr_global", F.col("switches") / F.greatest(F.col("steps") - 1, F.lit(1)))


def pairs(seq: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """sid, from_s, to_s of consecutive steps."""
    return with_previous(seq, "s", "_p", chunk).where("_p is not null").select("sid", F.col("_p").alias("from_s"), F.col("s").alias("to_s"))


def switch_state(seq: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """sid, s, sr_state: entries and exits of a state over the steps less one; 0 for sequences of one step."""
    moves = pairs(seq, chunk).where("from_s <> to_s")
    ends = moves.select("sid", F.explode(F.array("from_s", "to_s")).alias("s")).groupBy("sid", "s").agg(F.count("*").alias("moves"))
    grid = every_state(seq.groupBy("sid").agg(F.count("*").alias("steps")), k)
    rate = F.coalesce("moves", F.lit(0)) / F.greatest(F.col("steps") - 1, F.lit(1))
    return grid.join(ends, ["sid", "s"], "left").select("sid", "s", rate.alias("sr_state"))


def transition_counts(seq: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """sid, from_s, to_s, n of all k * k pairs."""
    found = pairs(seq, chunk).groupBy("sid", "from_s", "to_s").agg(F.count("*").alias("n"))
    grid = every_state(every_state(seq.select("sid").distinct(), k, "from_s"), k, "to_s")
    return grid.join(found, ["sid", "from_s", "to_s"], "left").select("sid", "from_s", "to_s", F.coalesce("n", F.lit(0)).alias("n"))


def transition_probs(seq: DataFrame, k: int) -> DataFrame:
    """sid, from_s, to_s, n, p: counts smoothed by one for each cell, so an unvisited row is uniform."""
    row = F.sum("n").over(W.partitionBy("sid", "from_s"))
    return transition_counts(seq, k).withColumn("p", (F.col("n") + 1) / (row + k))


def row_entropy(probs: DataFrame) -> DataFrame:
    """sid, s, row_entropy_bits: entropy of each row of transition probabilities, clipped and not normalised again."""
    return probs.groupBy("sid", F.col("from_s").alias("s")).agg(F.sum(plogp(F.col("p"))).alias("row_entropy_bits"))


def self_transition(probs: DataFrame) -> DataFrame:
    """sid, s, self_transition."""
    return probs.where("from_s = to_s").select("sid", F.col("from_s").alias("s"), F.col("p").alias("self_transition"))


def state_metrics(seq: DataFrame, k: int) -> DataFrame:
    """One row for each sequence and state with all state-level metrics."""
    probs = transition_probs(seq, k)
    out = occupancy(seq, k).select("sid", "s", "fo")
    for part in (dwell(seq, k), switch_state(seq, k), row_entropy(probs), self_transition(probs)):
        out = out.join(part, ["sid", "s"])
    return out


class History:
    """The substrings of a growing binary string, as its suffix automaton: two transitions a state, -1 where there is none."""

    def __init__(self) -> None:
        self.size, self.link, self.go, self.last = [0], [-1], ([-1], [-1]), 0

    def _state(self, size: int, link: int, zero: int, one: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.go[0].append(zero)
        self.go[1].append(one)
        return len(self.size) - 1

    def append(self, bit: int) -> None:
        go, new = self.go[bit], self._state(self.size[self.last] + 1, 0, -1, -1)
        at, self.last = self.last, new
        while at >= 0 and go[at] < 0:
            go[at] = new
            at = self.link[at]
        if at < 0:
            return
        to = go[at]
        if self.size[to] != self.size[at] + 1:  # what ends here is shorter than what `to` stands for: part it
            part = self._state(self.size[at] + 1, self.link[to], self.go[0][to], self.go[1][to])
            self.link[to] = part
            while at >= 0 and go[at] == to:
                go[at] = part
                at = self.link[at]
            to = part
        self.link[new] = to

    def longest(self, bits: list[int], start: int) -> int:
        """Length of the longest prefix of bits[start:] that occurs in the history."""
        at, end = 0, start
        while end < len(bits) and (at := self.go[bits[end]][at]) >= 0:
            end += 1
        return end - start


def lz_complexity(signal: str) -> float:
    """Number of phrases of a binary string over n / log2 n; the number itself for n of at most 1.

    A phrase is the longest that occurs in the history before it, and one symbol more. The first history is empty and the
    first phrase begins at the second symbol; each later phrase begins where the history, extended by the phrase, ends. Every
    symbol is appended to the history once and read once, so the time is in proportion to the length.
    """
    bits, history = [int(x) for x in signal], History()
    n, count, end, start = len(bits), 1, 0, 1
    while True:
        size = history.longest(bits, start) + 1
        count += 1
        for bit in bits[end : end + size]:
            history.append(bit)
        end += size
        if start + size > n or end >= n:
            return count / (n / math.log2(n)) if n > 1 else float(count)
        start = end


def lzc(seq: DataFrame) -> DataFrame:
    """sid, lzc_switches: complexity of the string of state changes; 0 for sequences of one step."""
    def score(signals: pd.Series) -> pd.Series:
        return pd.Series([lz_complexity(x) if x else 0.0 for x in signals], dtype="float64")

    changed = F.when(F.col("s") != F.lag("s").over(by_step()), "1").when(F.lag("s").over(by_step()).isNotNull(), "0")
    bits = seq.withColumn("bit", changed).groupBy("sid").agg(F.sort_array(F.collect_list(F.when(F.col("bit").isNotNull(), F.struct("t", "bit")))).alias("bits"))
    signal = F.concat_ws("", F.transform("bits", lambda x: x["bit"]))
    return bits.select("sid", F.pandas_udf(score, T.DoubleType())(signal).alias("lzc_switches"))


def segment_index(steps: DataFrame) -> DataFrame:
    """sid, start, end (exclusive), n_tr: where each sequence's rows stand if all sequences follow each other by sid."""
    lengths = steps.groupBy("sid").agg(F.count("*").alias("n_tr"))
    return running_sum(lengths, ["sid"], "n_tr", "end").select("sid", (F.col("end") - F.col("n_tr")).alias("start"), "end", "n_tr")


def state_text(seq: DataFrame) -> DataFrame:
    """sid, value: a sequence's states in order, one a line."""
    rows = seq.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("rows"))
    return rows.select("sid", F.array_join(F.transform("rows", lambda r: r["s"].cast("string")), "\n").alias("value"))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column replaced by its place from 0."""
    return places(rows, [column], name="_place").withColumn(column, F.col("_place")).drop("_place")
