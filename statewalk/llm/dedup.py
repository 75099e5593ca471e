"""Suffix-array deduplication: bytes of documents covered by long strings that also start in an earlier document.

Documents are packed, compressed, into buckets by a hash of their id: the one time that texts are moved, as the plan's three
readers of the buckets share that exchange. Every window of LENGTH bytes has
an anchor, the ANCHOR-byte string of least hash in it, so windows that are equal have equal anchors. Three exchanges follow,
none of which moves whole texts:

1. each bucket sends the distinct hashes of its anchors by ranges of hashes, and gets back a state for each: whether the
   anchor occurs in several documents, and in very many contexts;
2. the segments around those anchors (all windows with the same anchor occurrence, at most 2 * LENGTH - ANCHOR bytes) go to
   shards by anchor. A bucket sends each distinct segment once, with the least and the greatest doc_id that has it there. A
   shard strings its distinct segments together, sorts their suffixes by induced sorting, computes permuted common prefixes,
   and takes runs of suffixes with LENGTH bytes in common as equal windows, whose owner is the smallest doc_id of a run;
3. the owners of windows go back to the buckets in which a greater doc_id has the segment. A bucket decides on its own
   occurrences, which travel beside, to itself only.

So what a line in every document sends to its shard grows with the buckets, not with its occurrences. An anchor with very many
contexts is sent window by window, each to the shard of its own hash, so that no shard holds all contexts of a frequent phrase.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import BASE, bounded_batches, first_rows, hash_of_words, mix, released, runs, words_of
from statewalk.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 16
#: Bytes of a bucket's texts, bytes of text for each shard and each range of anchors (less where the cluster has tasks to
#: spare, but not below the least), and bytes of one suffix sort.
BUCKET_BYTES, SHARD_BYTES, LEAST_BYTES, SORT_BYTES = 3 << 20, 16 << 20, 1 << 20, 1 << 20
#: An anchor with so many contexts is sent by windows. Contexts are told apart by the eight bytes on both sides, within a bucket.
FREQUENT, SATURATED = 1024, 255
LAST = (1 << 63) - 1  # the id that stands for null: after all others
#: Windows of a block of anchors, and the bits that hold a place in it.
BLOCK, INDEX_BITS = 1 << 15, 17


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; wide numbers byte plane by byte plane, as their upper planes are mostly alike."""
    raw = b"".join(np.array([len(a), a.dtype.itemsize], "<i8").tobytes() + np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    """The arrays, as uint8 or int64."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, size = np.frombuffer(raw, "<i8", 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * size, at + 16)
        out.append(planes if size == 1 else np.ascontiguousarray(planes.reshape(size, n).T).view(np.int64 if size == 8 else np.uint32).ravel().astype(np.int64))
        at += 16 + n * size
    return out


def window_anchors(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor in a block, and the hash at each place. Hashes depend on the bytes only."""
    n, w = len(data), length - anchor + 1
    view = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    h, factor = np.zeros(n - anchor + 1, np.uint64), BASE
    for at in range(0, anchor, 8):
        word = view[at : at + len(h)]
        h += (word if anchor - at >= 8 else word & np.uint64((1 << 8 * (anchor - at)) - 1)) * np.uint64(factor)
        factor = factor * BASE % (1 << 64)
    h = mix(h)
    low = np.uint64((1 << INDEX_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < w:
        least = np.minimum(least[: len(h) - w + 1], least[w - step :])
    return (least & low).astype(np.int64), h


class Bucket:
    """The documents of a bucket by id, then text: ids (LAST for null), their text as one array of bytes, offsets.

    The order depends on the documents only, so that every reader of a bucket, and a repeated one, sees the same places.
    """

    def __init__(self, parts: list[bytes]):
        rows = []
        for part in parts:
            ids, size, data, note_size, notes = unsqueeze(part)
            cut, note_cut = (np.concatenate(([0], np.cumsum(x))).tolist() for x in (size, note_size))
            data, notes = data.tobytes(), notes.tobytes()
            rows += [(i, data[a:b], notes[c:d]) for i, a, b, c, d in zip(ids.tolist(), cut, cut[1:], note_cut, note_cut[1:])]
        rows.sort()
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.data = np.frombuffer(b"".join([r[1] for r in rows]), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int64)
        self._notes = [r[2] for r in rows]

    def notes(self) -> list[str]:
        """What was carried with each document."""
        return [x.decode("utf-8") for x in self._notes]

    def anchors(self, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of each anchor occurrence, and the first window and number of windows that have it, in text order.

        Windows of one occurrence are consecutive. Of equal hashes in a window the leftmost is taken, as hashes are compared
        by their leading bits and then by place. An anchor is the least of many hashes, so its hash is mixed again: ranges of
        what is returned hold equal shares.
        """
        data, n = self.data, len(self.data)
        none = np.zeros(0, np.int64)
        if n < length:
            return none.astype(np.uint64), none, none, none
        place, value = np.empty(n - length + 1, np.int32 if n < 1 << 31 else np.int64), np.empty(n - anchor + 1, np.uint64)
        for a in range(0, len(place), BLOCK):  # small blocks, whose arrays stay in the processor's cache
            b = min(a + BLOCK, len(place))
            at, h = window_anchors(data[a : b + length - 1], length, anchor)
            place[a:b] = at + a
            value[a : a + len(h)] = h
        size = np.diff(self.offsets)
        valid = np.zeros(n + 1, np.int8)
        long = size >= length
        np.add.at(valid, self.offsets[:-1][long], 1)
        np.add.at(valid, self.offsets[1:][long] - length + 1, -1)
        window = np.flatnonzero(np.cumsum(valid[: n - length + 1]) > 0)
        place = place[window]
        new = np.flatnonzero(first_rows(place) | np.concatenate(([True], window[1:] != window[:-1] + 1)) if len(window) else place)
        return mix(value[place[new]]), place[new].astype(np.int64), window[new], np.diff(np.append(new, len(window)))

    def document(self, at: np.ndarray) -> np.ndarray:
        """Row of the document at each place."""
        return np.searchsorted(self.offsets, at, "right") - 1


def pack(docs: DataFrame, buckets: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """bucket, parts: all documents, compressed and hash-partitioned by bucket; the carried columns travel as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            order = np.argsort(bucket, kind="stable")
            texts, notes = (batch.column(i).take(pa.array(order)).to_pylist() for i in (2, 3))
            ids = batch.column(1).to_numpy()[order]
            cut = np.append(np.flatnonzero(first_rows(bucket[order])), len(order))
            names, blobs = [], []
            for a, b in zip(cut, cut[1:]):
                columns = [ids[a:b].astype(np.int64)]
                for column in (texts, notes):
                    raw = [t.encode("utf-8") for t in column[a:b]]
                    columns += [np.array([len(x) for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)]
                blobs.append(squeeze(*columns))
                names.append(bucket[order[a]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "part"])

    bounded_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    # by id and text, so that neither rows without an id, nor those of one id, nor copies of one text meet in a bucket
    rows = docs.select(F.pmod(F.xxhash64(key, F.col("text").cast("string")), F.lit(buckets)).cast("int").alias("bucket"), key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.to_json(F.struct(*carry)).alias("note") if carry else F.lit("").alias("note"))
    packed = rows.mapInArrow(released(run), "bucket int, part binary")
    parts = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packed.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list("part").alias("parts"))


def repeated_anchors(packed: DataFrame, ranges: int, length: int, anchor: int) -> DataFrame:
    """bucket, range, bits: for each distinct anchor hash of a bucket in ascending order, 0 in one document only, 1 in several,
    2 with FREQUENT contexts or more. A bucket sends at most one message for each of its anchors, whatever the ranges."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = Bucket(parts)
                h, place, first, _ = b.anchors(length, anchor)
                values, several, contexts = distinct_anchors(h, b.ids[b.document(first)], b.data, place, anchor)
                some, cut = in_ranges(values, ranges)
                blobs = [six_bytes(values[i:j]) + contexts[i:j].tobytes() + np.packbits(several[i:j]).tobytes() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name, np.int32)), pa.array(some.astype(np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "range", "n", "hashes"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        values = np.concatenate([from_six_bytes(x[: 6 * k]) for x, k in zip(pdf["hashes"], n)])
        contexts = np.concatenate([np.frombuffer(x, np.uint8, k, 6 * k) for x, k in zip(pdf["hashes"], n)])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8)[7 * k :], count=k) for x, k in zip(pdf["hashes"], n)])
        order = np.argsort(values, kind="stable")
        new = np.flatnonzero(first_rows(values[order]))
        size = np.diff(np.append(new, len(order)))
        many = np.repeat(np.add.reduceat(contexts[order].astype(np.int64), new), size)
        state = np.empty(len(values), np.uint8)
        state[order] = np.where(np.repeat(size, size) > 1, 1, several[order])
        frequent = np.zeros(len(values), bool)
        frequent[order] = many >= FREQUENT
        state[frequent & (state > 0)] = 2
        return pd.DataFrame({"bucket": pdf["bucket"], "range": pdf["range"], "bits": [x.tobytes() for x in np.split(state, np.cumsum(n)[:-1])]})

    sent = packed.mapInArrow(released(send), "bucket int, range int, n int, hashes binary")
    return sent.groupBy("range").applyInPandas(judge, "bucket int, range int, bits binary")


def distinct_anchors(h: np.ndarray, ids: np.ndarray, data: np.ndarray, place: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of the leading 48 bits of hashes in order, whether each is in documents of different ids, and in how
    many contexts it is (uint8, SATURATED at most)."""
    value = h >> np.uint64(16)
    order = np.lexsort((ids, value))
    value, ids, place = value[order], ids[order], place[order]
    new = np.flatnonzero(first_rows(value))
    if not len(new):
        return value, np.zeros(0, bool), np.zeros(0, np.uint8)
    size = np.diff(np.append(new, len(value)))
    contexts = np.ones(len(new), np.int64)
    again = np.flatnonzero(np.repeat(size > 1, size))
    if len(again):
        view = np.ndarray((len(data) + 8,), "<u8", np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]), 0, (1,))
        around = mix(view[place[again]] + mix(view[np.minimum(place[again] + 8 + anchor, len(data))]))
        own = np.repeat(np.arange(len(new)), size)[again]
        by = np.lexsort((around, own))
        own, around = own[by], around[by]
        contexts[size > 1] = np.bincount(own[first_rows(own) | first_rows(around)], minlength=len(new))[size > 1]
    return value[new], ids[new] != ids[new + size - 1], np.minimum(contexts, SATURATED).astype(np.uint8)


def in_ranges(values: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that hold any of the ascending 48-bit values, and where in values each begins, the end last."""
    own = ((values >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)
    new = np.flatnonzero(first_rows(own))
    return own[new].astype(np.int64), np.append(new, len(own)).tolist()


def six_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def segments(bucket: Bucket, states: dict[int, bytes], ranges: int, shards: int, length: int, anchor: int) -> tuple[list[int], list[bytes], bytes]:
    """What a bucket sends to each shard: distinct segments, numbered over all shards, with the least and greatest id that has
    each. And what it keeps: the number of occurrences of each segment, and their places by segment."""
    h, place, first, windows = bucket.anchors(length, anchor)
    values = np.unique(h >> np.uint64(16))
    some, _ = in_ranges(values, ranges)
    state = np.concatenate([np.frombuffer(states[r], np.uint8) for r in some.tolist()] or [np.zeros(0, np.uint8)])
    own = state[np.searchsorted(values, h >> np.uint64(16))] if len(h) else state
    plain, frequent = own == 1, own == 2
    start, size, key = first[plain], windows[plain] + length - 1, h[plain]
    if frequent.any():  # each window on its own, by its own hash
        n = windows[frequent]
        each = np.repeat(first[frequent] - np.cumsum(n) + n, n) + np.arange(n.sum())
        start, size = np.concatenate([start, each]), np.concatenate([size, np.full(len(each), length)])
        whole = np.full(len(each), length)
        key = np.concatenate([key, hash_of_words(words_of(bucket.data, each, whole, -(-length // 8)), whole)])
    if not len(start):
        return [], [], b""
    words = words_of(bucket.data, start, size, -(-int(size.max()) // 8))
    content = hash_of_words(words, size)
    shard = (mix(key) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((start, content, key, shard))
    start, size, key, shard = start[order], size[order], key[order], shard[order]
    lead = np.flatnonzero(unlike_before(words[order], size, first_rows(key)))
    ids = bucket.ids[bucket.document(start)]
    least, most = np.minimum.reduceat(ids, lead), np.maximum.reduceat(ids, lead)
    own = squeeze(np.diff(np.append(lead, len(start))), start)
    start, size, key, shard = start[lead], size[lead], key[lead], shard[lead]
    names, blobs = [], []
    edges = np.append(np.flatnonzero(first_rows(shard)), len(shard))
    for a, b in zip(edges, edges[1:]):
        n = size[a:b]
        at = np.repeat(start[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        blobs.append(squeeze(bucket.data[at], n, key[a:b].astype(np.uint32), np.array([a]), least[a:b], most[a:b] - least[a:b]))
        names.append(int(shard[a]))
    return names, blobs, own


def unlike_before(words: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """new, and where else a span's bytes (as words_of) are not those of the span before it."""
    out = new.copy()
    out[1:] |= (size[1:] != size[:-1]) | (words[1:] != words[:-1]).any(1)
    return out


def send_segments(packed: DataFrame, bits: DataFrame, ranges: int, shards: int, length: int, anchor: int) -> DataFrame:
    """shard, bucket, blob: what shards get, and under shard -1 - bucket what the bucket is to get back as it is."""
    gathered = bits.groupBy("bucket").agg(F.collect_list(F.struct("range", "bits")).alias("states"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts, states in zip(*(batch.column(i) for i in range(3))):
                found = {s["range"]: s["bits"] for s in states.as_py() or ()}
                names, blobs, own = segments(Bucket(parts.as_py()), found, ranges, shards, length, anchor)
                if names:
                    names, blobs = [*names, -1 - name.as_py()], [*blobs, own]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([name.as_py()] * len(names), pa.int32()), pa.array(blobs, pa.binary())], ["shard", "bucket", "blob"])

    return packed.join(gathered, "bucket", "left").select("bucket", "parts", "states").mapInArrow(released(run), "shard int, bucket int, blob binary")


#: What stands for an owner at bytes that begin no window.
END = np.iinfo(np.int32).max


def equal_windows(texts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the segments in `texts`, the smallest owner (int32) of a segment in which the window that starts there
    also starts. Bytes with less than a window before their segment's end have END.
    """
    ends = np.cumsum(sizes + 1) - 1
    raw = np.full(len(texts) + len(sizes), 0xFF, np.uint8)  # 0xFF ends a segment: it is in no UTF-8 text
    body = np.ones(len(raw), bool)
    body[ends] = False
    raw[body] = texts
    sa = suffix_array(np.append(raw.astype(np.uint16) + 1, 0).astype(np.uint16), 258, length)
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    common = permuted_common_prefixes(raw, sa, ends[segment])
    order = sa[1:]
    new = np.flatnonzero(common[order] < length)
    least = np.minimum.reduceat(owner[segment[order]], new)
    out = np.empty(len(raw), np.int32)
    out[order] = np.repeat(least, np.diff(np.append(new, len(order))))
    out[ends[segment] - np.arange(len(raw)) < length] = END
    return out[body]


#: Runs of windows that are looked at in one step.
STEP_RUNS = 1 << 20


def resolve(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """bucket, own, blob: a shard's answers by bucket, or (own) what a bucket keeps.

    An answer holds numbers of segments, and for each a run of windows: its first byte in the segment, how many windows it has,
    and the smallest id in which they start. Only runs that a greater id of the bucket has are answered.
    """
    if pdf["shard"].iloc[0] < 0:
        return pd.DataFrame({"bucket": pdf["bucket"], "own": True, "blob": pdf["blob"]})
    texts, sizes, keys, numbers, leasts, mosts, bucket = [], [], [], [], [], [], []
    for name, blob in zip(pdf["bucket"], pdf["blob"]):
        t, s, k, number, least, more = unsqueeze(blob)
        texts.append(t)
        sizes.append(s)
        keys.append(k)
        numbers.append(np.arange(len(s)) + number[0])
        leasts.append(least)
        mosts.append(least + more)
        bucket.append(np.full(len(s), name, np.int64))
    text, size, key = np.concatenate(texts), np.concatenate(sizes), np.concatenate(keys)
    del texts
    number, least, most, bucket = (np.concatenate(x) for x in (numbers, leasts, mosts, bucket))
    # equal segments of different buckets are sorted once
    begin = np.cumsum(size) - size
    words = words_of(text, begin, size, -(-int(size.max()) // 8))
    order = np.lexsort((hash_of_words(words, size), key))
    new = unlike_before(words[order], size[order], first_rows(key[order]))
    del words
    segment = np.empty(len(size), np.int64)
    segment[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(least[order], np.flatnonzero(new))
    lead = order[new]  # by key
    size, key, begin = size[lead], key[lead], begin[lead]
    # sorts of bounded size, none of which parts the segments of an anchor
    done = np.cumsum(size)
    last = np.append(key[1:] != key[:-1], True)
    block = np.zeros(len(size), np.int64)
    at, sort = 0, 0
    while at < len(size):
        stop = int(np.searchsorted(done, (done[at - 1] if at else 0) + SORT_BYTES))
        stop = min(len(size) - 1, stop)
        stop = stop + int(np.argmax(last[stop:]))
        block[at : stop + 1] = sort
        at, sort = stop + 1, sort + 1
    # owners as their places among all owners, which take half the room of ids and compare as they do
    owners, least = np.unique(least, return_inverse=True)
    least, rank = least.astype(np.int32), np.searchsorted(owners, most, "left").astype(np.int32)
    windows, low = np.empty(int(done[-1]), np.int32), np.empty(len(size), np.int32)
    edges = np.append(np.flatnonzero(first_rows(block)), len(size))
    first = done - size
    for a, b in zip(edges, edges[1:]):
        n = size[a:b]
        take = np.repeat(begin[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        w = equal_windows(text[take], n, least[a:b], length)
        windows[first[a] : done[b - 1]] = w
        low[a:b] = np.minimum.reduceat(w, first[a:b] - first[a])
    edge = first_rows(windows)
    edge[first] = True
    edge = np.flatnonzero(edge)
    width, value = np.diff(np.append(edge, len(windows))), windows[edge]
    edge, width, value = (x[value != END] for x in (edge, width, value))
    one = np.searchsorted(edge, first)
    count = np.diff(np.append(one, len(edge)))
    some = np.flatnonzero(rank > low[segment])
    some = some[np.lexsort((number[some], bucket[some]))]
    held = np.cumsum(count[segment[some]])
    found = [(np.zeros(0, np.int64),) * 5]
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + STEP_RUNS, "right")))
        step = some[lo:hi]
        s = segment[step]
        n = count[s]
        run, of = np.repeat(one[s] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(step)), n)
        less = value[run] < rank[step[of]]
        run, of = run[less], of[less]
        found.append((bucket[step[of]], number[step[of]], edge[run] - first[s[of]], width[run], owners[value[run]]))
        lo = hi
    bucket, number, at, width, owner = (np.concatenate(x) for x in zip(*found))
    cut = np.append(np.flatnonzero(first_rows(bucket)), len(bucket))
    pieces = [(int(bucket[a]), squeeze(np.diff(number[a:b], prepend=0), at[a:b], width[a:b], owner[a:b])) for a, b in zip(cut, cut[1:]) if b > a]
    return pd.DataFrame({"bucket": pd.Series([p[0] for p in pieces], dtype="int32"), "own": False, "blob": [p[1] for p in pieces]})


def removed(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """bucket, parts, answers: every bucket with what shards know of its windows, for a last pass over the texts."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(total / SHARD_BYTES), min(tasks, math.ceil(total / LEAST_BYTES)))
    packed = pack(docs, buckets, carry)
    bits = repeated_anchors(packed, shards, length, anchor)
    sent = send_segments(packed, bits, shards, shards, length, anchor)
    known = sent.groupBy("shard").applyInPandas(lambda pdf: resolve(pdf, length), "bucket int, own boolean, blob binary")
    gathered = known.groupBy("bucket").agg(F.collect_list(F.struct("own", "blob")).alias("answers"))
    return packed.join(gathered, "bucket", "left").select("bucket", "parts", "answers")


def keep_mask(bucket: Bucket, own: bytes | None, answers: list[bytes], length: int) -> np.ndarray:
    """True for the bytes that stay: an occurrence loses the windows that also start in a document of smaller id."""
    depth = np.zeros(len(bucket.data) + 1, np.int64)
    if own and answers:
        count, start = unsqueeze(own)
        one, ids = np.cumsum(count) - count, bucket.ids[bucket.document(start)]
        for blob in answers:
            step, at, width, owner = unsqueeze(blob)
            number = np.cumsum(step)
            n = count[number]
            each, of = np.repeat(one[number] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)
            gone = ids[each] > owner[of]
            begin = (start[each] + at[of])[gone]
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + width[of[gone]] - 1 + length, -1)
    return np.cumsum(depth[:-1]) == 0


def _last_pass(rows: DataFrame, output, schema: str, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, answers in zip(batch.column(1), batch.column(2)):
                bucket = Bucket(parts.as_py())
                if len(bucket.ids):
                    known = answers.as_py() or ()
                    own = next((x["blob"] for x in known if x["own"]), None)
                    yield output(bucket, keep_mask(bucket, own, [x["blob"] for x in known if not x["own"]], length))

    return rows.mapInArrow(released(run), schema)


def _ids(bucket: Bucket) -> pa.Array:
    return pa.array(bucket.ids, pa.int64(), mask=bucket.ids == LAST)


def report(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    A byte goes if a string of `length` bytes that covers it also starts in a document of smaller doc_id, judged on the
    input. Null and empty texts have no bytes; texts shorter than `length` stay whole. Rows that repeat a doc_id don't remove
    from each other. A null doc_id comes after all others.
    """

    def output(bucket: Bucket, keep: np.ndarray) -> pa.RecordBatch:
        raw, o = bucket.data, bucket.offsets
        kept = np.concatenate(([0], np.cumsum(keep)))[o]
        begin, _ = runs(~keep)
        gone = ~keep
        fresh = np.zeros(len(keep), bool)
        fresh[begin] = True
        inner = o[1:-1][o[1:-1] < len(keep)]
        fresh[inner] = gone[inner]  # a run that goes on in the next document is one of its own there
        spans = np.concatenate(([0], np.cumsum(fresh)))[o]
        left = raw[keep].tobytes()
        digests = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(kept, kept[1:])]
        size = np.diff(o)
        return pa.RecordBatch.from_arrays([_ids(bucket), pa.array(size), pa.array(size - np.diff(kept)), pa.array(np.diff(spans)), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _last_pass(removed(docs, length, anchor), output, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def kept_texts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows of docs, with the columns of documents, each text being what is left of it and n_chars its code points.

    A code point that lost some of its bytes goes whole. A document of which nothing is left stays, with an empty text; null
    texts become empty.
    """
    carry = docs.select("lang", "source")

    def output(bucket: Bucket, keep: np.ndarray) -> pa.RecordBatch:
        kept = np.concatenate(([0], np.cumsum(keep)))[bucket.offsets]
        left = bucket.data[keep].tobytes()
        texts = [left[a:b].decode("utf-8", errors="ignore") for a, b in zip(kept, kept[1:])]
        return pa.RecordBatch.from_arrays([_ids(bucket), pa.array(texts, pa.string()), pa.array(bucket.notes(), pa.string())], ["doc_id", "text", "note"])

    out = _last_pass(removed(docs, length, anchor, ("lang", "source")), output, "doc_id long, text string, note string", length)
    note = F.from_json("note", carry.schema)
    return out.select("doc_id", "text", note["lang"].alias("lang"), note["source"].alias("source"), F.length("text").cast("long").alias("n_chars"))
