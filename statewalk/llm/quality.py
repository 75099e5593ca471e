"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier on a document's surface statistics gives its own evidence: the log-likelihood ratio of good to bad.
Sites add theirs. The good documents of a host are beta-binomial around the global rate, those of a path around their
host's rate; the strengths of both priors are estimated from all hosts and all paths by moments, so that a sparse site is
shrunk towards the level above it and a large one speaks for itself. A document is judged by its own evidence and the
posterior of its path without the document itself. Site counts are grouped aggregates of slim rows; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import bounded_batches, checkpointed, first_rows, is_space, mix, released, segment_sums, span_hashes, text_chunks, word_spans
from statewalk.llm.languages import remainder
from statewalk.llm.training import keyed, labelled, without

#: Groups of bytes whose shares of the text are features.
GROUPS = tuple(
    np.isin(np.arange(256), list(g))
    for g in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b"\n", bytes(range(128, 256)))
)
NAMES = ("upper", "digit", "point", "exclaim", "bar", "symbol", "line", "wide", "word_length", "distinct_words", "repeated_pairs", "marked_words", "words")
STEPS, RATE, DECAY = 400, 0.1, 1e-3
#: Steps of a document's probability: sums of whole steps don't depend on the order in which they are added.
UNIT = 1 << 30
#: Sites that are broadcast, at most; more are joined by a shuffle.
BROADCAST_SITES = 1 << 16


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) features for each text; an empty text's are 0."""
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    if not len(data):
        return out
    for i, group in enumerate(GROUPS):
        out[:, i] = segment_sums(group[data].astype(np.int64), offsets) / size
    starts, ends, at = word_spans(data, offsets, is_space(data))
    n = np.maximum(np.diff(at), 1).astype(np.float64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    h = span_hashes(data, starts, ends)
    pair = h[:-1] + mix(h[1:]) if len(h) > 1 else h[:0]
    pair_text = text[:-1][text[:-1] == text[1:]]
    pair = pair[text[:-1] == text[1:]]

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        new = first_rows(values[order]) | first_rows(owner[order])
        return np.bincount(owner[order][new], minlength=len(out)).astype(np.float64)

    letters = np.concatenate(([0], np.cumsum((((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 128) | GROUPS[2][data])))
    marked = letters[ends] - letters[starts] < ends - starts
    out[:, 8] = np.log1p(segment_sums((ends - starts).astype(np.float64), at) / n)
    out[:, 9] = distinct(h, text) / n
    pairs = np.maximum(np.bincount(pair_text, minlength=len(out)), 1)
    out[:, 10] = 1 - np.maximum(distinct(pair, pair_text), np.bincount(pair_text, minlength=len(out)) == 0) / pairs
    out[:, 11] = np.bincount(text[marked], minlength=len(out)) / n
    out[:, 12] = np.log1p(np.diff(at))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # for the features, then for their squares
    bias: float
    rate: float  # share of good documents in training

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good to bad: log-odds less those of the training rate."""
        if not len(self.weights):
            return np.zeros(len(x))
        prior = np.log(self.rate / (1 - self.rate))
        return np.clip(design(x, self.mean, self.scale) @ self.weights + self.bias - prior, -30, 30)


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z * z], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None) -> Model:
    """Fit on the bounded sample of `labelled`; without labels of both kinds the evidence of every document is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                x = statistics(chunk.data, chunk.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), batch.column(2).slice(chunk.lo, len(chunk)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = labelled(docs, labels, label, keep).select("doc_id", "text", "label").mapInArrow(released(run), "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.float64)
    k = len(NAMES)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(k), np.ones(k), np.zeros(0), 0.0, 0.5)
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = design(x, mean, scale)
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(z @ w + b, -40, 40))) - y
        g = np.append(z.T @ error / len(y) + DECAY * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(mean, scale, w, b, float(y.mean()))


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, row_key, host, path, llr, p: each row's own evidence, and its probability at the training rate."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    prior = float(np.log(model.rate / (1 - model.rate)))
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row_key", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            llr = [np.zeros(0)]
            for chunk in text_chunks(batch.column(1)):
                llr.append(shared.value.evidence(statistics(chunk.data, chunk.offsets)))
            llr = np.concatenate(llr)
            p = np.rint(UNIT / (1 + np.exp(-(llr + prior)))) / UNIT
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(llr), pa.array(p)], ["doc_id", "row_key", "host", "path", "llr", "p"])

    return rows.mapInArrow(released(run), "doc_id long, row_key long, host string, path string, llr double, p double")


def strength(groups: DataFrame, n: str, good: str, above: Column) -> float:
    """The strength of a beta prior around `above`, by moments over all groups; at least 1 and at most 10,000 documents.

    The spread of the groups' rates in excess of what binomial sampling gives is r (1 - r) / (strength + 1). Both sums are of
    decimals, so that they are the same in whatever order the groups come.
    """
    off = F.col(good) / F.col(n) - above
    row = groups.where(F.col(n) > 1).agg(*[
        F.sum(x.cast("decimal(32,15)")).alias(name)
        for name, x in (("excess", F.col(n) * off * off - above * (1 - above)), ("most", (F.col(n) - 1) * above * (1 - above)))
    ]).first()
    if row["most"] is None or row["most"] <= 0:
        return 1.0
    share = max(float(row["excess"]), 0.0) / float(row["most"])  # 1 / (strength + 1)
    return float(min(10_000.0, max(1.0, 1 / share - 1))) if share > 0 else 10_000.0


def posterior(scored: DataFrame) -> DataFrame:
    """scored (of `evidence`, written) with host_rate, path_rate (both with the site's own documents), score and accepted.

    score is the probability from llr and from the path's posterior mean without the document itself.
    """
    good = F.sum(F.round(F.col("p") * UNIT).cast("long")) / F.lit(float(UNIT))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), good.alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_good")).first()
    rate = min(max((total[1] or 0.0) / max(total[0] or 0, 1), 1e-6), 1 - 1e-6)
    k_host = strength(hosts, "host_n", "host_good", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host))
    sites = paths.join(hosts, "host")
    k_path = strength(sites, "n", "good", F.col("host_rate"))
    sites = sites.withColumn("path_rate", (F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path))
    # a host or path of a third of the rows isn't brought to one task: few sites go to where the rows are
    rows = scored.join(F.broadcast(sites) if paths.count() <= BROADCAST_SITES else sites, ["host", "path"])
    host_less = (F.col("host_good") - F.col("p") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    less = (F.col("good") - F.col("p") + k_path * host_less) / (F.col("n") - 1 + k_path)
    less = F.least(F.greatest(less, F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("llr") + F.ln(less / (1 - less)))))
    return rows.select("doc_id", "row_key", "host", "path", "llr", "host_rate", "path_rate", score.alias("score"), (score >= 0.5).alias("accepted"))


def default_path() -> Column:
    return F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep=None) -> DataFrame:
    """One row for each document: the columns of `posterior`. By default the host is source and the path source/lang.

    Null hosts and paths form a site of their own (''). Null and empty texts have all-zero statistics. Repeated rows count
    as often as they occur. The evidence of all rows is written once, to the checkpoint folder, as it is read three times.
    """
    model = fit(docs, labels, keep=keep)
    scored = checkpointed(evidence(docs, model, F.col("source") if host is None else host, default_path() if path is None else path))
    return posterior(scored)


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, that `judge` accepts.

    Null and empty texts are judged like others, by statistics of zero; equal rows stay or go together, as do ties at 0.5, which
    stay. Without labels of both kinds only the sites' rates of 0.5 speak, and all rows stay. An empty table stays empty.
    """
    return without(docs, judge(docs, labels, **how).where(~F.col("accepted")))


def fold(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of `posterior` and held_out, learned from labels of rows whose remainder modulo 5 is not 0."""
    out = judge(docs, labels, keep=remainder(5) != 0)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), *[c for c in out.columns if c not in ("doc_id", "row_key")])
