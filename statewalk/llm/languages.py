"""Language identification by multilingual mixture inference.

Training counts byte trigrams of lower-cased words by language, over all training documents, in arrays of a fixed size that
are summed by grouped aggregation. A word's likelihood under a language is the product of its smoothed trigram
probabilities. A document is a mixture: expectation-maximisation estimates each language's share from its words'
likelihoods. The language set is chosen by penalised likelihood: the document's best single language is extended by the
language of next greatest share as long as twice the gain in log-likelihood is more than the penalty for one more share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import CHUNK_BYTES, bounded_batches, checkpointed, lower_ascii, released, segment_sums, text_chunks, texts_of, word_spans

#: Trigrams are hashed to 2**BITS cells; counts travel in SLICES pieces of a language's array.
BITS, SLICES, SMOOTHING = 16, 16, 0.5
ITERATIONS = 12
#: Languages with 2**BITS cells each. With more, cells are joined so that a model keeps to 4 * 2**BITS * LANGUAGES bytes; no
#: language is left out. Languages whose counts a task holds before it sends them on.
LANGUAGES, HELD = 256, 64
UNDETERMINED = "und"


def remainder(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo the divisor; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def letters_only(data: np.ndarray) -> np.ndarray:
    """True for bytes outside words: all but ASCII letters and the bytes of longer code points."""
    return ~(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of the words (a blank on both sides), the first trigram of each word, and of each text the first word.

    A word of n bytes has n trigrams, centred on its bytes.
    """
    outside = letters_only(data)
    starts, ends, at = word_spans(data, offsets, outside)
    low = np.where(outside, np.uint8(32), lower_ascii(data)).astype(np.uint32)
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[starts] = 32
    after[ends - 1] = 32
    inside = np.flatnonzero(~outside)
    cell = (before[inside] << 16 | low[inside] << 8 | after[inside]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    size = ends - starts
    return cell.astype(np.int64), np.cumsum(size) - size, at


def count(docs: DataFrame) -> DataFrame:
    """lang, slice, counts (binary, unsigned 64-bit): trigram counts of all rows of docs(text, lang) with a language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, i, piece.tobytes()) for lang, c in held.items() for i, piece in enumerate(np.split(c, SLICES)) if piece.any()]
            held.clear()
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["lang", "slice", "counts"])

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for chunk in text_chunks(batch.column(0)):
                cell, _, _ = trigrams(chunk.data, chunk.offsets)
                inside = np.concatenate(([0], np.cumsum(~letters_only(chunk.data))))[chunk.offsets]
                names, which = np.unique(langs[chunk.lo : chunk.hi].astype(str), return_inverse=True)
                all_counts = np.bincount(np.repeat(which, np.diff(inside)) << BITS | cell, minlength=len(names) << BITS)
                for name, c in zip(names, all_counts.reshape(len(names), -1)):
                    held[name] = held[name] + c if name in held else c
                if len(held) > HELD:
                    yield flush()
        yield flush()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << BITS) // SLICES, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "slice": [pdf["slice"].iloc[0]], "counts": [total.tobytes()]})

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = "lang string, slice int, counts binary"
    parts = rows.mapInArrow(released(partial), schema)
    # twice: a slice's partial arrays are first summed in groups of a bounded number, then those sums
    salted = parts.withColumn("salt", F.spark_partition_id() % 64)
    once = salted.groupBy("lang", "slice", "salt").applyInPandas(lambda pdf: add(pdf), schema)
    return once.groupBy("lang", "slice").applyInPandas(add, schema)


def model_bits(languages: int) -> int:
    """Bits of a trigram's cell in a model of so many languages."""
    bits = BITS
    while languages > LANGUAGES << (BITS - bits):
        bits -= 1
    return bits


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each trigram cell (rows) in each of them."""
    counted = checkpointed(count(docs))
    names = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    bits = model_bits(len(names))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            less = [np.frombuffer(x, np.int64).reshape(-1, 1 << (BITS - bits)).sum(1).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(less, pa.binary())], ["lang", "slice", "counts"])

    counts = np.zeros((len(names), 1 << bits))
    size = (1 << bits) // SLICES
    place = {name: i for i, name in enumerate(names)}
    for r in counted.mapInArrow(joined, "lang string, slice int, counts binary").toLocalIterator():
        counts[place[r["lang"]], r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    used = max(1, int((counts.sum(0) > 0).sum()))
    log_p = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * used)
    return names, np.ascontiguousarray(log_p.T.astype(np.float32))


def shares(log_word: np.ndarray, at: np.ndarray, allowed: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language shares and log-likelihood by expectation-maximisation, using the allowed languages only."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    top = log_word.max(1, keepdims=True)
    p = np.exp(log_word - top)
    pi = allowed / allowed.sum(1, keepdims=True)
    words = np.maximum(np.diff(at), 1)[:, None]
    for _ in range(iterations):
        joint = pi[text] * p
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        pi = segment_sums(joint, at) / words
    mixed = np.log(np.maximum((pi[text] * p).sum(1), 1e-300)) + top[:, 0]
    return pi, segment_sums(mixed, at)


def infer(data: np.ndarray, offsets: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's shares in its chosen language set, the posterior of the best single language, and whether it has words."""
    cell, first, at = trigrams(data, offsets)
    cell >>= BITS - (len(log_p).bit_length() - 1)  # a model of very many languages has fewer cells
    n, k = len(offsets) - 1, log_p.shape[1]
    has = np.diff(at) > 0
    if not len(first):
        return np.zeros((n, k)), np.zeros(n), has
    log_word = np.add.reduceat(log_p[cell], first, axis=0).astype(np.float64)
    single = segment_sums(log_word, at)  # log-likelihood with one language
    best = single.argmax(1)
    post = np.exp(single - single.max(1, keepdims=True))
    posterior = 1 / post.sum(1)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    like = single[np.arange(n), best]
    pi = chosen.astype(np.float64)
    if k > 1:
        full, _ = shares(log_word, at, np.ones((n, k)))
        penalty = np.log(np.maximum(np.diff(at), 2))
        order = np.argsort(-np.where(chosen, -1.0, full), axis=1, kind="stable")
        text = np.repeat(np.arange(n), np.diff(at))
        top = log_word.max(1, keepdims=True)
        p = np.exp(log_word - top)
        growing = has.copy()
        for j in range(k - 1):
            # the log-likelihood is concave in the shares: if its slope towards the next language isn't positive, there is no gain
            mixed = np.maximum((pi[text] * p).sum(1), 1e-300)
            slope = segment_sums(p[np.arange(len(p)), order[text, j]] / mixed, at) - np.diff(at)
            growing &= slope > 0
            grow = np.flatnonzero(growing)
            if not len(grow):
                break
            words = np.concatenate([np.arange(at[i], at[i + 1]) for i in grow])
            trial = chosen[grow].copy()
            trial[np.arange(len(grow)), order[grow, j]] = True
            share, value = shares(log_word[words], np.concatenate(([0], np.cumsum(np.diff(at)[grow]))), trial.astype(np.float64))
            better = 2 * (value - like[grow]) > penalty[grow]
            won = grow[better]
            chosen[won], like[won], pi[won] = trial[better], value[better], share[better]
            growing[grow[~better]] = False
    return pi, posterior, has


def has_letter(texts: list[str | None], unsure: np.ndarray) -> np.ndarray:
    """Whether a text has a letter; only texts whose words hold no ASCII letter are looked at one by one."""
    return np.array([bool(t) and (not u or any(c.isalpha() for c in t)) for t, u in zip(texts, unsure)], bool)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages: the best language, its probability, and the set as 'de:0.61,en:0.39'.

    lang_pred has the greatest share of the set (ties: first by name) and is 'und' with score 0 where the text is null or
    has no letter, or nothing was learned. score is the share of lang_pred times the posterior of the best single language
    where the set has one language. Repeated rows are judged as often as they occur. No row is moved.
    """
    names, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast((names, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shared.value
        for batch in batches:
            texts = batch.column(1)
            for chunk in text_chunks(texts, CHUNK_BYTES // (1 + len(names) // 8)):
                n = len(chunk)
                pred, score, sets = [UNDETERMINED] * n, np.zeros(n), [""] * n
                if names:
                    pi, posterior, has = infer(chunk.data, chunk.offsets, log_p)
                    ascii_letters = segment_sums(((((chunk.data | 32) >= 97) & ((chunk.data | 32) <= 122))).astype(np.int64), chunk.offsets) > 0
                    sure = has & ascii_letters
                    if (has & ~ascii_letters).any():
                        sure |= has & has_letter(texts.slice(chunk.lo, n).to_pylist(), ~ascii_letters)
                    top = pi.argmax(1)
                    for i in np.flatnonzero(sure):
                        here = np.flatnonzero(pi[i] > 0)
                        pred[i] = names[top[i]]
                        score[i] = min(1.0, posterior[i] if len(here) == 1 else pi[i, top[i]])
                        sets[i] = ",".join(f"{names[j]}:{pi[i, j]:.2f}" for j in here)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, n), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.string())], ["doc_id", "lang_pred", "score", "languages"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, lang_pred string, score double, languages string")


def fold(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, learned from the documents whose remainder modulo 4 is not 2."""
    model = fit(docs.where(remainder(4) != 2))
    out = identify(docs, model)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "languages")

