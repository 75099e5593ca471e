"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the weights of its words and of their beginnings
(so that unseen forms of a known stem count); the document's is the noisy-or
of its sentences', 1 - prod(1 - p). Only document labels are known; the gradient of the document likelihood reaches each
sentence in proportion to its own probability, so the weights settle on the words of offending sentences, which are then
located by their own scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import bounded_batches, checkpointed, first_rows, lower_ascii, mix, released, segment_sums, span_hashes, text_chunks, texts_of, word_spans
from statewalk.llm.languages import letters_only, remainder
from statewalk.llm.training import labelled

#: Words and their first bytes (PREFIXES of them) are hashed to 2**BITS cells, of which the WORDS most telling get a weight.
BITS, WORDS, LEAST_DOCUMENTS = 20, 4096, 4
PREFIXES, SLICES = (3, 4, 5, 6), 64
PER_WORD = 1 + len(PREFIXES)
STEPS, RATE, DECAY, START = 300, 0.15, 1e-4, -6.0
#: Bytes of the labelled sample that a task counts, about.
SAMPLE_BYTES = 4 << 20
#: The bytes . ! ? and newline end a sentence.
ENDERS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, one for each cell


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all words, PER_WORD each, the first cell of each sentence, the first sentence of each text, and each
    sentence's first and last byte. A sentence without a word is none.
    """
    starts, ends, at = word_spans(data, offsets, letters_only(data))
    low = lower_ascii(data)
    hashes = [span_hashes(low, starts, ends), *(mix(span_hashes(low, starts, np.minimum(starts + n, ends)) + np.uint64(n)) for n in PREFIXES)]
    cell = (np.stack(hashes, axis=1) >> np.uint64(64 - BITS)).astype(np.int64).ravel()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    stop = np.cumsum(ENDERS[data])[starts] if len(starts) else np.zeros(0, np.int64)
    first = np.flatnonzero(first_rows(text) | first_rows(stop))
    last = np.append(first[1:], len(starts)) - 1
    return cell, PER_WORD * first, np.searchsorted(text[first], np.arange(len(offsets))), starts[first], ends[last] if len(first) else ends


def sentence_scores(cell: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Log-odds of each sentence."""
    return model.bias + (np.add.reduceat(model.weights[cell].astype(np.float64), first) if len(first) else np.zeros(0))


def noisy_or(log_odds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's probability, from the log of the product of its sentences' complements."""
    return -np.expm1(segment_sums(-np.logaddexp(0, log_odds), at))


def cell_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents, and in how many of label 1, each cell occurs: arrays of fixed size, summed slice by slice."""
    size = (1 << BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            for chunk in text_chunks(batch.column(1)):
                cell, first, at, _, _ = sentences(chunk.data, chunk.offsets)
                size_of = np.diff(np.append(first, len(cell))[at])
                pair = np.unique(np.repeat(np.arange(len(chunk)), size_of) << BITS | cell)
                seen = pair & ((1 << BITS) - 1)
                total[0] += np.bincount(seen, minlength=1 << BITS)
                total[1] += np.bincount(seen[labels[chunk.lo : chunk.hi][pair >> BITS] > 0], minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([np.ascontiguousarray(total[:, i * size : (i + 1) * size]).astype("<i4").tobytes() for i in range(SLICES)], pa.binary())], ["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i4") for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [total.astype("<i4").tobytes()]})

    schema = "slice int, counts binary"
    rows = docs.select("doc_id", "text", "label").mapInArrow(released(run), schema).groupBy("slice").applyInPandas(add, schema).collect()
    out = np.zeros((2, 1 << BITS), np.int64)
    for r in rows:
        out[:, r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], "<i4").reshape(2, -1)
    return out[0], out[1]


def features(docs: DataFrame, number: np.ndarray) -> DataFrame:
    """doc_id, label, n (sentences), sentence and feature (binary int32): where in the document the chosen cells occur.

    number: each cell's feature, or -1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(number.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                cell, first, at, _, _ = sentences(chunk.data, chunk.offsets)
                found = shared.value[cell]
                place = np.flatnonzero(found >= 0)
                sentence = np.searchsorted(first, place, "right") - 1
                cut = np.searchsorted(sentence, at)
                where = [(sentence[a:b] - at[i]).astype(np.int32).tobytes() for i, (a, b) in enumerate(zip(cut, cut[1:]))]
                what = [found[place[a:b]].tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, len(chunk)), batch.column(2).slice(chunk.lo, len(chunk)), pa.array(np.diff(at), pa.int64()), pa.array(where, pa.binary()), pa.array(what, pa.binary())],
                    ["doc_id", "label", "n", "sentence", "feature"],
                )

    return docs.select("doc_id", "text", "label").mapInArrow(released(run), "doc_id long, label int, n long, sentence binary, feature binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None) -> Model:
    """Fit on the bounded sample of `labelled`, which is written once; the driver holds counts of fixed size and where the
    chosen cells occur in the sample.

    Without labels, or with labels of one kind only, the weights are 0 and the bias stays low or high accordingly.
    """
    sample = checkpointed(labelled(docs, labels, label, keep))
    # of a bounded number of rows: as many tasks as their bytes need, as each has counts of a fixed size
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = sample.coalesce(max(1, min(SLICES, -(-size // SAMPLE_BYTES))))
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weights = np.zeros(1 << BITS, np.float32)
    if len(kinds) < 2:
        return Model(-START if 1 in kinds else START, weights)
    n, k = cell_counts(sample)
    rate = kinds[1] / sum(kinds.values())
    telling = np.where(n >= LEAST_DOCUMENTS, (k - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9), 0)
    chosen = np.argsort(-telling, kind="stable")[:WORDS]
    chosen = np.sort(chosen[telling[chosen] > 6.6])  # one in a hundred by chance
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    rows = sorted(features(sample, number).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.float64)
    count = np.array([r["n"] for r in rows])
    at = np.concatenate(([0], np.cumsum(count)))
    f = np.frombuffer(b"".join(r["feature"] for r in rows), np.int32)
    s = np.frombuffer(b"".join(r["sentence"] for r in rows), np.int32) + np.repeat(at[:-1], [len(r["feature"]) // 4 for r in rows])
    text = np.repeat(np.arange(len(y)), count)
    # sentences without a chosen word are alike: one number for each text stands for them
    own, s = np.unique(s, return_inverse=True)
    owner = text[own]
    plain = np.diff(at) - np.bincount(owner, minlength=len(y))
    w, b = np.zeros(len(chosen)), START
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(s, weights=w[f], minlength=len(own))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        log_q = np.bincount(owner, weights=-np.logaddexp(0, z), minlength=len(y)) - plain * np.logaddexp(0, b)
        q = np.exp(log_q)
        pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-12), 1.0)
        each = pull[owner] * p
        g = np.append(np.bincount(f, weights=each[s], minlength=len(chosen)) / len(y) + DECAY * w, (each.sum() + (pull * plain).sum() * p0) / len(y))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[chosen] = w
    return Model(float(b), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_sentences, n_offending, worst_start, worst_length (bytes of the sentence of highest score).

    Null and empty texts have no sentence: score 0, worst_start null. Ties: the first sentence. No row is moved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                cell, first, at, start, end = sentences(chunk.data, chunk.offsets)
                z = sentence_scores(cell, first, shared.value)
                p = np.clip(noisy_or(z, at), 0.0, 1.0)
                n = np.diff(at)
                worst = np.zeros(len(chunk), np.int64)
                some = n > 0
                if some.any():
                    top = np.repeat(np.maximum.reduceat(z, at[:-1][some]), n[some])
                    text = np.repeat(np.arange(len(chunk)), n)
                    best = np.flatnonzero(z == top)
                    best = best[first_rows(text[best])]
                    worst[some] = best
                    begin = np.where(some, start[worst] - chunk.offsets[:-1], 0)
                    length = np.where(some, (end - start)[worst], 0)
                else:
                    begin = length = worst
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.lo, len(chunk)),
                        pa.array(p),
                        pa.array((p >= 0.5).astype(np.int32)),
                        pa.array(n.astype(np.int64)),
                        pa.array(segment_sums((z >= 0).astype(np.int64), at)),
                        pa.array(begin, pa.int64(), mask=~some),
                        pa.array(length, pa.int64(), mask=~some),
                    ],
                    ["doc_id", "score", "predicted", "n_sentences", "n_offending", "worst_start", "worst_length"],
                )

    return texts_of(docs).mapInArrow(released(run), "doc_id long, score double, predicted int, n_sentences long, n_offending long, worst_start long, worst_length long")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5. No row is moved.

    Null and empty texts score 0 and stay; equal texts stay or go together; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for chunk in text_chunks(batch.column(at_text)):
                cell, first, at, _, _ = sentences(chunk.data, chunk.offsets)
                keep.append(noisy_or(sentence_scores(cell, first, shared.value), at) < 0.5)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(released(run), docs.schema)


def training_fold() -> F.Column:
    return remainder(5) != 0


def fold(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model learned from rows whose remainder modulo 5 is not 0, with held_out."""
    out = score(docs, fit(docs, labels, keep=training_fold()))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "n_sentences", "n_offending", "worst_start", "worst_length")
