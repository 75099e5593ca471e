"""Homomorphic multiset fingerprints of documents.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo powers of two. So it does not depend on the order of the paragraphs, and a paragraph is inserted or deleted by adding
or subtracting its vector. The vector has two parts:

* EXACT lanes modulo 2**64, each from its own 64 bits of a cryptographic digest of the whole paragraph: equal multisets of
  paragraphs give equal lanes, and others differ but for a chance of about 2**-64 in each lane;
* SKETCH lanes modulo 2**32, to which each shingle of three words of the paragraph (in a short paragraph, each block of a
  few bytes and its place) adds +1 or -1 at a hashed lane. Texts that share shingles share additions, so the cosine of two
  sketches estimates the share in common, which a plain sum of hashes can't show.

A text's last paragraph ends with the text; the empty text has no paragraph and the zero vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import is_space, mix, released, segment_sums, span_hashes, text_chunks, texts_of, word_spans

EXACT, SKETCH, SHINGLE = 4, 128, 3
#: A paragraph of fewer bytes is sketched by its blocks of BLOCK bytes; a word is cut into pieces of LONGEST bytes.
SHORT, BLOCK, LONGEST = 64, 4, 12
NEWLINE = 10


#: Bytes of whole paragraphs that are hashed at once; a longer paragraph is hashed alone.
PIECE_BYTES = 1 << 19


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EXACT lanes (uint64) and SKETCH lanes (uint32) of each text of a chunk.

    Vectors add up over paragraphs, so a long text is hashed in pieces of whole paragraphs.
    """
    n = len(offsets) - 1
    if len(data) <= PIECE_BYTES:
        return vectors_at_once(data, offsets)
    exact, sketch = np.zeros((n, EXACT), np.uint64), np.zeros((n, SKETCH), np.uint32)
    breaks = np.union1d(np.flatnonzero(data == NEWLINE) + 1, offsets)
    a = 0
    while a < len(data):
        i = np.searchsorted(breaks, a + PIECE_BYTES, "right") - 1
        b = int(breaks[i] if breaks[i] > a else breaks[i + 1])
        lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        more = vectors_at_once(data[a:b], np.clip(offsets[lo : hi + 1], a, b) - a)
        exact[lo:hi] += more[0]
        sketch[lo:hi] += more[1]
        a = b
    return exact, sketch


def vectors_at_once(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, EXACT), np.uint64), np.zeros((n, SKETCH), np.uint32)
    starts, ends, at = word_spans(data, offsets, data == NEWLINE)
    exact = segment_sums(digests(data, starts, ends), at)
    of_text = np.repeat(np.arange(n), np.diff(at))
    short = ends - starts < SHORT

    # short paragraphs: blocks of BLOCK bytes, told apart by their place in the paragraph
    owner, place, begin, end = cut(starts[short], ends[short], BLOCK)
    units = [mix(span_hashes(data, begin, end) + mix(place.astype(np.uint64) + np.uint64(1)))]
    texts = [of_text[short][owner]]

    # others: shingles of words within the paragraph, the last ones of fewer words; very long words count as several
    begin, end, _ = word_spans(data, offsets, is_space(data))
    paragraph = np.searchsorted(starts, begin, "right") - 1
    use = ~short[paragraph]
    owner, _, begin, end = cut(begin[use], end[use], LONGEST)
    paragraph = paragraph[use][owner]
    w = span_hashes(data, begin, end)
    unit = w * np.uint64(3)
    for k in range(1, SHINGLE):
        same = np.flatnonzero(paragraph[k:] == paragraph[:-k])
        unit[same] += mix(w[same + k] + np.uint64(k)) * np.uint64(2 * k + 3)
    units.append(mix(unit))
    texts.append(of_text[paragraph])
    unit, text = np.concatenate(units), np.concatenate(texts)
    lane = (unit % np.uint64(SKETCH)).astype(np.int64)
    sign = 1 - 2 * (unit >> np.uint64(63)).astype(np.int64)
    sketch = np.bincount(text * SKETCH + lane, weights=sign, minlength=n * SKETCH)
    return exact, (sketch.astype(np.int64) % (1 << 32)).astype(np.uint32).reshape(n, SKETCH)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """EXACT numbers of 64 bits for each span, all of one digest of its bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=8 * EXACT).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, "<u8").reshape(-1, EXACT)


def cut(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans cut into pieces of `size` bytes: each piece's span, place in it, start and end."""
    pieces = -(-(ends - starts) // size)
    owner = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[owner] + size * place
    return owner, place, begin, np.minimum(begin + size, ends[owner])


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of both documents' paragraphs together: insertion."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint without b's paragraphs: deletion."""
    return a[0] - b[0], a[1] - b[1]


def as_text(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    rows = np.concatenate([exact.astype(">u8").view(np.uint8).reshape(len(exact), -1), sketch.astype(">u4").view(np.uint8).reshape(len(exact), -1)], axis=1)
    return [r.tobytes().hex() for r in rows]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosine of the sketches from 0 to 1, on a log scale, so that one line repeated often doesn't drown the rest; 1 where the exact
    lanes are equal. A lane's sign holds up to 2**31 shingles, more than the longest text has."""
    x, y = (v.astype(np.int32).astype(np.float64) for v in (a[1], b[1]))
    x, y = np.sign(x) * np.log1p(np.abs(x)), np.sign(y) * np.log1p(np.abs(y))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    out = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a[0] == b[0]).all(1), 1.0, np.clip(out, 0.0, 1.0))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, a hex string of 2 * (8 * EXACT + 4 * SKETCH) digits; null and empty texts give zeros. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(as_text(*vectors(chunk.data, chunk.offsets)))], ["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, fingerprint string")


#: Rows of a part, parts of a partition, the most parts (two numbers each on the driver), and sampled rows for each part.
PART_ROWS, PARTITION_PARTS, MOST_PARTS, SAMPLED = 1000, 4, 1 << 20, 4
NULL_ID = -(1 << 63)


def part_of(ids: np.ndarray, h: np.ndarray, bound_ids: np.ndarray, bound_h: np.ndarray) -> np.ndarray:
    """How many of the bounds, which ascend by (id, h), are at or below each (id, h)."""
    left, right = np.searchsorted(bound_ids, ids, "left"), np.searchsorted(bound_ids, ids, "right")
    out = left.copy()
    one = np.flatnonzero(right - left == 1)
    out[one] += h[one] >= bound_h[left[one]]
    many = np.flatnonzero(right - left > 1)  # an id of so many rows that several bounds fall on it
    for at in np.unique(left[many]):
        rows = many[left[many] == at]
        out[rows] += np.searchsorted(bound_h[at : right[rows[0]]], h[rows], "right")
    return out


def with_next(docs: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """part, tail, doc_id, text: each part holds a range of rows and, marked as tail, the row that follows its last one.

    Rows follow each other by descending doc_id, null ids last, those of one id by descending hash of their text, then by text;
    the first row follows the last. Only ids and hashes are read to find the ranges; the texts are moved once. The driver holds
    a sample of a few rows for each part, which decides where rows are worked on and never the result, and each part's first.
    """
    keys = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("h"))
    total = keys.count()
    parts = min(MOST_PARTS, max(1, -(-total // rows)))
    wanted = SAMPLED * parts / max(total, 1)
    found = (keys if wanted >= 0.5 else keys.sample(wanted, seed=1)).toPandas() if parts > 1 else pd.DataFrame({"id": [], "h": []}, dtype=np.int64)
    order = np.lexsort((found["h"], found["id"]))
    order = order[np.unique((len(order) * np.arange(1, parts) / parts).astype(np.int64))] if len(order) else order
    bound_ids, bound_h = found["id"].to_numpy(np.int64)[order], found["h"].to_numpy(np.int64)[order]

    def own(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(part_of(ids.to_numpy(), h.to_numpy(), bound_ids, bound_h).astype(np.int32))

    # the first row of each part also goes to the next part above; the first of all to the lowest
    tops = sorted((r["part"], r["top"]["id"], r["top"]["h"]) for r in keys.groupBy(F.pandas_udf(own, "int")("id", "h").alias("part")).agg(F.max(F.struct("id", "h")).alias("top")).collect())
    top_part, top_id, top_h = (np.array([t[i] for t in tops], np.int64) for i in range(3))
    above = np.roll(top_part, -1)

    def places(ids: pd.Series, h: pd.Series) -> pd.Series:
        part = part_of(ids.to_numpy(), h.to_numpy(), bound_ids, bound_h)
        i = np.searchsorted(top_part, part)
        first = (top_id[i] == ids.to_numpy()) & (top_h[i] == h.to_numpy())
        return pd.Series([[2 * a, 2 * b + 1] if f else [2 * a] for a, b, f in zip(part.tolist(), above[i].tolist(), first.tolist())])

    placed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("h"))
    placed = placed.withColumn("to", F.explode(F.pandas_udf(places, "array<int>")("id", "h")))
    placed = placed.select(F.shiftright("to", 1).alias("part"), (F.col("to") % 2 == 1).alias("tail"), "doc_id", "text", "h")
    dealt = placed.repartition(-(-parts // PARTITION_PARTS), "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.desc("h"), "text")
    return dealt.select("part", "tail", "doc_id", "text")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; columns as op10 asks.

    Edited: the last floor(n / 3) code points are replaced by the first as many (or all) of the next document. Null texts
    count as empty, and so do empty ones. A lone document follows itself. Rows that repeat a doc_id, or have none, follow each other
    by descending hash of their texts, however many there are; equal rows are reported as often as they occur. Other columns are
    dropped, and an empty table gives no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(ids: list, texts: list[str], following: list[str]) -> Iterator[pa.RecordBatch]:
        changed = []
        for a, b in zip(texts, following):
            k = len(a) // 3
            changed.append(a[: len(a) - k] + b[:k])
        # what follows a text is the next one, but for the last
        own, new = (next(vectors(c.data, c.offsets) for c in text_chunks(pa.array(x, pa.large_string()), 1 << 62)) for x in (texts + following[-1:], changed))
        three = [tuple(v[:-1] for v in own), new, tuple(v[1:] for v in own)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in changed]),
                pa.array(as_text(*three[0])),
                pa.array(as_text(*three[1])),
                pa.array(likeness(three[0], three[1])),
                pa.array(likeness(three[0], three[2])),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []  # held: (id, text) in order; the last waits for the row that follows it
        size = 0
        for batch in batches:
            parts, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ended = False
            for p, tail, i, t in zip(parts, tails, ids, texts):
                t = t or ""
                if p != part:
                    part, held, size, ended = p, [], 0, False
                if tail:
                    if held and not ended:  # of repeated ids the first in order is the one that follows
                        yield from results([x[0] for x in held], [x[1] for x in held], [x[1] for x in held[1:]] + [t])
                        held, size = [], 0
                    ended = True
                    continue
                held.append((i, t))
                size += len(t)
                if size > 1 << 19 and len(held) > 1:
                    yield from results([x[0] for x in held[:-1]], [x[1] for x in held[:-1]], [x[1] for x in held[1:]])
                    held = held[-1:]
                    size = len(t)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(texts_of(docs)).mapInArrow(released(run), schema)
