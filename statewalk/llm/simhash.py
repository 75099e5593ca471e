"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets a table of its Hamming distances to many reference fingerprints (pivots). By the triangle
inequality two fingerprints within r bits differ by at most r in every coordinate, so a pair whose greatest coordinate
difference is more is discarded without being compared; survivors are verified bit by bit. Pairs are dealt to workers by
blocks of equal bits: of b blocks, two fingerprints within r bits agree in at least b - r, so they meet in one of the
choose(b, b - r) tables of b - r blocks. That finds all pairs; what meets in a table is left to the pivots.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.llm.blocks import Forest, dealt, star
from statewalk.llm.common import BASE, checkpointed, first_rows, is_space, lower_ascii, mix, released, span_hashes, text_chunks, texts_of, word_spans
from statewalk.llm.components import components
from statewalk.llm.training import keyed, without

SHINGLE, RADIUS, PIVOTS, SEED = 3, 3, 24, 42
#: Fingerprints that a task works on, about.
TASK_ROWS = 20_000


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: mixed numbers, so that their coordinates are as good as independent."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_bounds(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each text's shingles, and each text's first shingle: fewer words than size give one shingle."""
    words = np.diff(at)
    n = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n)))
    first = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], n)
    last = np.minimum(first + size, np.repeat(at[1:], n)) - 1
    return first, last, bounds


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed SEED) of each shingle's words joined by one blank, and each text's first shingle."""
    low = lower_ascii(data)
    starts, ends, at = word_spans(data, offsets, is_space(data))
    first, last, bounds = shingle_bounds(starts, ends, at, size)
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    # words written one after another with one blank between them: a shingle is then one slice
    length = ends - starts + 1
    place = np.cumsum(length) - length
    joined = np.full(int(length.sum()), 32, np.uint8)
    inside = np.repeat(starts - place, length) + np.arange(len(joined))
    body = np.ones(len(joined), bool)
    body[place + length - 1] = False
    joined[body] = low[inside[body]]
    raw = joined.tobytes()
    a, b = place[first].tolist(), (place[last] + length[last] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a)), bounds


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's fingerprint: bit i is set where more than half of its hashes have it."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    counts = np.zeros((len(some), 64), np.int64)
    step = 1 << 16
    for lo in range(0, len(h), step):  # a bounded matrix of bits at a time
        hi = min(lo + step, len(h))
        bits = np.unpackbits(h[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        a, b = np.searchsorted(bounds[1:][some], lo, "right"), np.searchsorted(bounds[:-1][some], hi, "left")
        edges = np.maximum(bounds[:-1][some[a:b]] - lo, 0)
        counts[a:b] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > n[some][:, None], axis=1).view(">u8").ravel()
    out[some] = packed
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), n_shingles. Null texts and texts without words: 0 and 0 shingles. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                h, bounds = shingle_hashes(chunk.data, chunk.offsets, shingle)
                fp = majority(h, bounds).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(fp), pa.array(np.diff(bounds), pa.int64())], ["doc_id", "fp", "n_shingles"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, fp long, n_shingles long")


def tables(n: int, radius: int) -> list[int]:
    """Bit masks of the tables: b - radius of b blocks, with b so large that a table's key tells n fingerprints apart."""
    b = radius + 1
    while 64 * (b - radius) / b < np.log2(max(n, 2)) - 6 and b < radius + 4:
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(x) for x in itertools.combinations(block, b - radius)]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked_pairs(fp: np.ndarray, key: np.ndarray, side: np.ndarray | None, radius: int, pivot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints of equal key within radius bits; of different sides only, where side is given.

    Rows are in the order of their keys. Row i is compared with row i + d for d = 1, 2, ... as long as keys are equal, whole
    diagonals at a time; the pivot coordinates discard most pairs before bits are counted. Pairs come in pieces of about a
    million, so that dense groups need no memory for all of theirs.
    """
    table = np.stack([popcount(fp ^ p) for p in pivot], axis=0).astype(np.int8)
    left, right, held = [], [], 0
    i = np.arange(len(fp))
    d = 1
    while True:
        i = i[i + d < len(fp)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        a, b = i, i + d
        if side is not None:
            apart = side[a] != side[b]
            a, b = a[apart], b[apart]
        for coordinate in table:
            if not len(a):
                break
            near = np.abs(coordinate[a] - coordinate[b]) <= radius
            if np.count_nonzero(near) > 0.9 * len(near):  # a pivot discards little: the rest are like, or the radius is wide
                break
            a, b = a[near], b[near]
        near = popcount(fp[a] ^ fp[b]) <= radius
        left.append(a[near])
        right.append(b[near])
        held += len(left[-1])
        if held > 1 << 20:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
        d += 1
    if held:
        yield np.concatenate(left), np.concatenate(right)


def links(values: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS) -> DataFrame:
    """a, b: edges that join all values (distinct longs in column fp) within radius bits, directly or through others.

    Each task returns the forest of the pairs it finds, not the pairs: a group of g near copies gives fewer than g edges a
    table, and no link is lost. A group larger than a block is worked on in pairs of blocks.
    """
    n = values.count()
    masks = np.array(tables(n, radius), np.uint64)
    pivot = pivots(n_pivots)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = mix((fp.view(np.uint64)[None, :] & masks[:, None]) + (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(fp, len(masks)))], ["key", "fp"])

    rows = values.select("fp").mapInArrow(spread, "key long, fp long")
    tasks = max(1, -(-n * len(masks) // TASK_ROWS))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, piece, side, _ = in_order(pdf)
        ids, at = np.unique(fp.view(np.int64), return_inverse=True)
        forest = Forest(len(ids))
        for a, b in linked_pairs(fp, piece, side, radius, pivot):
            forest.join(at[a], at[b])
        inner, root = star(forest)
        return pd.DataFrame({"a": ids[inner], "b": ids[root]})

    placed = dealt(rows, ["key"], F.col("fp"))
    task = F.pmod(F.xxhash64("key", "left", "right"), F.lit(tasks)).cast("int").alias("task")
    return placed.select(task, "key", "fp", "left", "right", "side").groupBy("task").applyInPandas(inside, "a long, b long")


def in_order(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """A task's fingerprints, pieces and sides in the order of pieces, and that order; side None if no piece has two blocks."""
    fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
    left, right = (pdf[c].to_numpy().astype(np.uint64) for c in ("left", "right"))
    piece = mix(pdf["key"].to_numpy().view(np.uint64) + left * np.uint64(0x9E3779B97F4A7C15) + right)
    order = np.lexsort((fp, piece))
    two = (left != right)[order]
    # members of a piece of one block are all of side 0, so a side of their own makes every pair count
    side = np.where(two, side[order], np.arange(len(side)) + 2) if two.any() else None
    return fp[order], piece[order], side, order


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_shingles.

    Texts without words have fingerprint zero and are linked like any other. Copies share a fingerprint and are one node of
    the graph. Repeated rows give repeated rows. A null doc_id belongs to its fingerprint's component but never names it,
    unless no other id is in the component, which is then null.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, radius))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_shingles")


#: For near-duplicates by similarity: words of a shingle, and the similarity.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a set's fingerprint, how many of them two similar sets differ in at most, and the reference fingerprints of a piece.
#: A bit of sets of similarity 0.8 differs with a chance of at most 0.1875 (a set of four, and one of five), so that 92 of 256
#: is seven deviations above the mean: the chance to discard a pair of that similarity is below 1e-10.
SET_BITS, SET_RADIUS, SET_PIVOTS = 256, 92, 8
#: Sets of a block and of a task, about, reference sets of a large component, and bits of a bit map of rows.
SET_BLOCK, TASK_SETS, REFERENCES, MAP_BITS = 512, 2_000, 16, 24
#: Shingles of prefixes that a task works on, about; texts that are sampled for the order of shingles, and the most common
#: shingles of the sample that are put last.
TASK_SHINGLES, ORDER_TEXTS, LAST_SHINGLES = 1 << 20, 50_000, 1 << 19
#: Sets whose counts of shared shingles a task adds up, about.
TASK_NODES = 1 << 15
#: Sets of one shingle up to which all their pairs are looked at by whole diagonals, and pairs that are looked at at once.
SMALL_GROUP, PAIRS = 32, 1 << 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes of their words, and each text's first."""
    low = lower_ascii(data)
    starts, ends, at = word_spans(low, offsets, is_space(low))
    first, last, bounds = shingle_bounds(starts, ends, at, size)
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    word = span_hashes(low, starts, ends)
    h = np.zeros(len(first), np.uint64)
    for k in range(size):
        some = first + k <= last
        if some.all():
            h = mix(h * np.uint64(BASE) + word[first + k])
        else:
            h[some] = mix(h[some] * np.uint64(BASE) + word[first[some] + k])
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = first_rows(h) | first_rows(owner)
    return h[new], np.searchsorted(owner[new], np.arange(len(at)))


def set_names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set: equal sets have equal numbers."""
    total = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        total[some] = np.add.reduceat(mix(h ^ np.uint64(BASE)), bounds[:-1][some])
    return mix(total + mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def packs(rows: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two columns of longs, of a bounded number of rows, on the driver: a pair of arrays for each batch, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for i in range(2)], ["a", "b"])

    for r in rows.mapInArrow(run, "a binary, b binary").collect():
        yield np.frombuffer(r["a"], "<i8"), np.frombuffer(r["b"], "<i8")


def row_map(rows: DataFrame) -> Broadcast:
    """A bit map of fixed size of the rows' keys (row_key), by their leading bits."""
    place = F.shiftrightunsigned("row_key", 64 - MAP_BITS)
    words = rows.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(row_key, {64 - MAP_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for word, value in packs(words):
        bits[word] = value
    return rows.sparkSession.sparkContext.broadcast(bits)


def from_sets(docs: DataFrame, output: Callable, schema: str, size: int, among: Broadcast | None = None) -> DataFrame:
    """output(doc_ids, row_keys, names, hashes, bounds) of the texts' shingle sets, in one pass that moves no row.

    among: a row_map; rows that aren't in it are passed by, before their text is looked at. Of others a few pass too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if among is not None:
                place = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
                found = (among.value.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                batch = batch.filter(pa.array(found.astype(bool)))
            for chunk in text_chunks(batch.column(1)):
                h, bounds = shingle_sets(chunk.data, chunk.offsets, size)
                yield output(batch.column(0).slice(chunk.lo, len(chunk)), batch.column(2).slice(chunk.lo, len(chunk)), set_names(h, bounds), h, bounds)

    return texts_of(keyed(docs), "row_key").mapInArrow(released(run), schema)


def common_shingles(docs: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in several texts of a sample, ascending, and their ranks from 1, the most common last.

    The sample only decides in which order shingles are taken for prefixes. Any order finds all pairs; one that puts common
    shingles last finds few others.
    """

    def output(_ids, _keys, _names, h: np.ndarray, _bounds) -> pa.RecordBatch:
        values, count = np.unique(h, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count, pa.int64())], ["h", "c"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(max(1, -(-n // ORDER_TEXTS)))) == 0)
    counts = checkpointed(from_sets(sample, output, "h long, c long", size).groupBy("h").agg(F.sum("c").alias("c")).where("c > 1"))
    held, least = 0, 2
    for c, k in sorted(((r["c"], r["k"]) for r in counts.groupBy(F.least("c", F.lit(1000)).alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True):
        held += k
        if held > LAST_SHINGLES:
            least = c + 1
            break
    found = [*packs(counts.where(F.col("c") >= least)), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    h, c = np.concatenate([x for x, _ in found]).view(np.uint64), np.concatenate([x for _, x in found])
    order = np.argsort(h)
    h, c = h[order], c[order]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(1, len(h) + 1)
    return h, rank


def least_overlap(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles of a set of n that any set of the similarity has too, at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def further(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shared shingles that are asked for in a long prefix: one, and as many as a short prefix has besides its first."""
    return 1 + np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def spread_prefixes(docs: DataFrame, length: Callable, order: Broadcast, tasks: int, size: int, among: Broadcast, prints: bool = False) -> DataFrame:
    """task, key, node (binary): the first length(n) shingles of each set of n, packed by the task that has a shingle.

    prints: with print (binary), the fingerprint of the shingle's set.
    """
    packed = ["key", "node", "print"][: 2 + prints]

    def output(_ids, _keys, names: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        common, ranks = order.value
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        rank = np.zeros(len(h), np.int32)
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            rank = np.where(common[at] == h, ranks[at], 0).astype(np.int32)
        taken = np.lexsort((rank, owner))[np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(length(n), n)]
        key, node = h[taken], names[owner[taken]]
        task = (mix(key) % np.uint64(tasks)).astype(np.int64)
        by = np.argsort(task, kind="stable")
        columns = [key[by], node[by], *([set_fingerprints(h, bounds)[owner[taken][by]]] if prints else [])]
        edges = np.searchsorted(task[by], np.arange(tasks + 1))
        some = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array([c[edges[t] : edges[t + 1]].tobytes() for t in some], pa.binary()) for c in columns]], ["task", *packed])

    return from_sets(docs, output, ", ".join(["task long", *[f"{c} binary" for c in packed]]), size, among)


def shared_keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A task's shingles and nodes, each pair once, of the shingles that several nodes have, in the order of shingles."""
    key, node = np.frombuffer(b"".join(pdf["key"]), "<u8"), np.frombuffer(b"".join(pdf["node"]), "<i8")
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    once = first_rows(key) | first_rows(node)
    key, node = key[once], node[once]
    again = ~first_rows(key)
    some = again | np.concatenate((again[1:], [False]))
    return key[some], node[some]


def group_labels(prints: np.ndarray) -> np.ndarray:
    """Labels of one shingle's sets, equal where fingerprints within SET_RADIUS join them, directly or through others.

    Each set outside the largest class is compared with all of other classes, once: many near copies take about one round.
    """
    label = np.arange(len(prints))
    done = np.zeros(len(prints), bool)
    while True:
        outside = np.flatnonzero((label != np.bincount(label).argmax()) & ~done)
        if not len(outside):
            return label
        i = outside[0]
        done[i] = True
        others = np.flatnonzero((label != label[i]) & ~done)
        linked = others[differing(prints[others], prints[i]) <= SET_RADIUS]
        if len(linked):
            label[np.isin(label, label[linked])] = label[i]


def join_near(forest: Forest, key: np.ndarray, at: np.ndarray, prints: np.ndarray) -> None:
    """Join in the forest the sets (at: their places in prints) that share a key, where fingerprints within SET_RADIUS do.

    Rows are in the order of their keys, a set once a key. What is of one tree already needs no look.
    """
    starts = np.flatnonzero(first_rows(key))
    n = np.diff([*starts, len(key)])
    i = np.flatnonzero(np.repeat(n <= SMALL_GROUP, n))
    d = 1
    while True:
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        for lo in range(0, len(i), PAIRS):
            a, b = at[i[lo : lo + PAIRS]], at[i[lo : lo + PAIRS] + d]
            apart = forest.roots(a) != forest.roots(b)
            a, b = a[apart], b[apart]
            near = differing(prints[a], prints[b]) <= SET_RADIUS
            forest.join(a[near], b[near])
        d += 1
    for lo, m in zip(starts[n > SMALL_GROUP], n[n > SMALL_GROUP]):
        members = at[lo : lo + m]
        if len(np.unique(forest.roots(members))) > 1:
            _, lead, own = np.unique(group_labels(prints[members]), return_index=True, return_inverse=True)
            forest.join(members, members[lead[own]])


def prefix_links(docs: DataFrame, nodes: DataFrame, similarity: float, size: int) -> DataFrame:
    """a, b: edges that join any two nodes whose sets can have the similarity, directly or through others.

    Two sets of similarity t share t of the greater one's shingles. In an order of all shingles they then share k of the first
    n - t n + k of each set's n, for any k. First, with k about (1 - t) n, sets go that have too few shingles in common with any
    others: whatever shares a line or a passage only. Of the rest, two are joined where they share one with k = 1 and their
    fingerprints are within SET_RADIUS, as `alike` asks of them too. Sets that share a shingle by chance are not: their number
    grows with the square of the table's size, and would join all of it to one component.
    nodes: node, n, row_key of one row that has the set.
    """
    total = nodes.agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).first()
    tasks = max(1, int(2 * (total["shingles"] or 0) * (1 - similarity) + total["n"]) // TASK_SHINGLES)
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, max(1, total["n"]), size))

    def long(n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n - least_overlap(n, similarity) + further(n, similarity), 0)

    def short(n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n - least_overlap(n, similarity) + 1, 0)

    targets = max(1, total["n"] // TASK_NODES)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """A task's counts, packed by the task that adds up a node's: a node is in many tasks, but in as many packs as there are."""
        ids, c = np.unique(shared_keys(pdf)[1], return_counts=True)
        target = (mix(ids.view(np.uint64)) % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        edges = np.searchsorted(target[order], np.arange(targets + 1))
        some = np.flatnonzero(np.diff(edges))
        return pd.DataFrame({"target": some, **{name: [x[order][edges[t] : edges[t + 1]].tobytes() for t in some] for name, x in (("node", ids), ("c", c.astype("<i8")))}})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        node, c = (np.frombuffer(b"".join(pdf[name]), "<i8") for name in ("node", "c"))
        ids, at = np.unique(node, return_inverse=True)
        return pd.DataFrame({"node": ids, "c": np.bincount(at, weights=c, minlength=len(ids)).astype(np.int64)})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node = shared_keys(pdf)
        ids, at = np.unique(node, return_inverse=True)
        every, first = np.unique(np.frombuffer(b"".join(pdf["node"]), "<i8"), return_index=True)
        prints = np.frombuffer(b"".join(pdf["print"]), "<u8").reshape(-1, SET_BITS // 64)[first[np.searchsorted(every, ids)]]
        forest = Forest(len(ids))
        join_near(forest, key, at, prints)
        inner, root = star(forest)
        return pd.DataFrame({"a": ids[inner], "b": ids[root]})

    # the other set may be as small as t n, and its prefix is the shorter
    smaller = F.ceil(F.col("n") * similarity - 1e-9)
    asked = 1 + F.floor(smaller * (1 - similarity) + 1e-9)
    counts = spread_prefixes(docs, long, order, tasks, size, row_map(nodes)).groupBy("task").applyInPandas(count, "target long, node binary, c binary").groupBy("target").applyInPandas(add, "node long, c long")
    alive = checkpointed(counts.join(nodes, "node").where(F.col("c") >= asked).select("row_key"))
    return spread_prefixes(docs, short, order, tasks, size, row_map(alive), prints=True).groupBy("task").applyInPandas(link, "a long, b long")


def set_fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each set, SET_BITS / 64 numbers each: bit i is set where more than half of the shingles' i-th bits are."""
    return np.stack([majority(mix(h + np.uint64(i) * np.uint64(BASE)), bounds) for i in range(1, SET_BITS // 64 + 1)], axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ, along the last axis."""
    return popcount(a ^ b).sum(-1, dtype=np.int16)


def alike(sets: list[np.ndarray], prints: np.ndarray, label: np.ndarray, side: np.ndarray | None, similarity: float) -> np.ndarray:
    """Labels of the sets, equal where links join them: pairs of different sides (where side is given) with the similarity.

    The sets come by growing size, with the labels that earlier links gave them; pairs of one label need no look. A pair is
    discarded if its sizes differ too much, or if its distances to one of the reference fingerprints differ by more than
    SET_RADIUS; what is left is compared by fingerprint, then on the whole sets.
    """
    n = np.array([len(x) for x in sets])
    bounds = np.concatenate(([0], np.cumsum(n)))
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    have = np.zeros(len(at), bool)
    label = label.copy()
    ends = np.searchsorted(similarity * n - 1e-9, n, "right")
    some = np.flatnonzero(n)
    chosen = some[np.linspace(0, len(some) - 1, min(SET_PIVOTS, len(some))).astype(int)] if len(some) else some
    table = np.stack([differing(prints, prints[i]) for i in chosen], axis=0) if len(chosen) else np.zeros((0, len(n)), np.int16)
    for i in range(int(np.searchsorted(n, 0, "right")), len(sets)):
        others = np.arange(i + 1, ends[i])
        others = others[label[others] != label[i]]
        if side is not None:
            others = others[side[others] != side[i]]
        for coordinate in table:
            if not len(others):
                break
            others = others[np.abs(coordinate[others] - coordinate[i]) <= SET_RADIUS]
        others = others[differing(prints[others], prints[i]) <= SET_RADIUS]
        if not len(others):
            continue
        own = at[bounds[i] : bounds[i + 1]]
        have[own] = True
        while len(others):  # a link found on the way spares the rest of that label
            part, others = others[:64], others[64:]
            take = np.repeat(bounds[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(n[part].sum())
            both = np.add.reduceat(have[at[take]], np.cumsum(n[part]) - n[part], dtype=np.int64)
            linked = part[both / (n[i] + n[part] - both) >= similarity]
            if len(linked):
                label[np.isin(label, label[linked])] = label[i]
                others = others[label[others] != label[i]]
        have[own] = False
    return label


def set_pieces(docs: DataFrame, pieces: DataFrame, similarity: float, size: int) -> DataFrame:
    """a, b: edges that join, piece by piece, all nodes whose sets have the similarity, directly or through others.

    pieces: row_key, node, label, and the piece's name (component, left, right) and the node's side in it (where left and
    right differ, only pairs of different sides count).
    """
    tasks = max(1, -(-pieces.count() // TASK_SETS))

    def output(_ids, keys, names: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array(names), pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["row_key", "node", "shingles"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[c].to_numpy().astype(np.uint64) for c in ("left", "right"))
        piece = mix(pdf["component"].to_numpy().view(np.uint64) + left * np.uint64(BASE) + mix(right))
        raw, node, side, label = pdf["shingles"].to_numpy(), pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["label"].to_numpy()
        order = np.lexsort((node, np.array([len(x) for x in raw]), piece))
        starts = np.flatnonzero(first_rows(piece[order]))
        a, b = [node[:0]], [node[:0]]
        for lo, hi in zip(starts, [*starts[1:], len(order)]):
            at = order[lo:hi]
            sets = [np.frombuffer(raw[i], "<u8") for i in at]
            prints = set_fingerprints(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
            ids, before = np.unique(label[at], return_inverse=True)
            after = alike(sets, prints, before, side[at] if left[at[0]] != right[at[0]] else None, similarity)
            lead = np.full(len(ids), -1)
            lead[after[::-1]] = np.arange(len(at))[::-1]  # the first of each label
            inner = lead[after] != np.arange(len(at))
            inner &= before != before[lead[after]]
            a.append(node[at[inner]])
            b.append(node[at[lead[after][inner]]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    rows = from_sets(docs, output, "row_key long, node long, shingles binary", size, row_map(pieces.select("row_key").distinct()))
    task = F.pmod(F.xxhash64("component", "left", "right"), F.lit(tasks)).cast("int").alias("task")
    names = ("component", "left", "right", "side", "node", "label")
    joined = pieces.join(rows.dropDuplicates(["row_key", "node"]), ["row_key", "node"])
    return joined.select(task, *names, "shingles").groupBy("task").applyInPandas(inside, "a long, b long")


def verified(docs: DataFrame, parts: DataFrame, similarity: float, size: int) -> DataFrame:
    """a, b: edges that join all nodes of a component of parts (node, component, row_key) whose sets have the similarity,
    directly or through others.

    A component of at most SET_BLOCK nodes is one piece. A larger one is dealt to blocks, each of which also gets the component's
    reference sets, and is linked within its blocks and through them; in a group of copies of one text hardly a node is left
    after that. Then all nodes that aren't in the component's largest class are compared with every node of another class, in
    pairs of blocks. So every pair is compared, unless other links join it.
    """
    sizes = parts.groupBy("component").agg(F.count("*").alias("m"))
    parts = checkpointed(parts.join(sizes, "component"))
    blocks = F.ceil(F.col("m") / F.lit(float(SET_BLOCK))).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "node"), blocks).cast("int")
    columns = ["row_key", "node", F.col("node").alias("label"), "component"]
    members = parts.select(*columns, own.alias("left"), own.alias("right"), F.lit(0).alias("side"))
    large = parts.where(F.col("m") > SET_BLOCK)
    order = F.row_number().over(W.partitionBy("component").orderBy(F.xxhash64(F.lit(11), "node"), "node"))
    chosen = large.where(F.pmod(F.xxhash64(F.lit(13), "node"), F.floor(F.col("m") / F.lit(8 * REFERENCES))) == 0)  # some 8 REFERENCES of a component
    chosen = chosen.withColumn("_n", order).where(F.col("_n") <= REFERENCES)
    references = chosen.select("row_key", "node", "component", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("left")).where("left <> _own")
    references = references.select("row_key", "node", F.col("node").alias("label"), "component", "left", F.col("left").alias("right"), F.lit(0).alias("side"))
    first = checkpointed(set_pieces(docs, checkpointed(members.union(references)), similarity, size))
    if not large.limit(1).count():
        return first
    classes_ = components(first)
    now = large.join(classes_.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    counted = now.groupBy("component", "class").agg(F.count("*").alias("k"))
    most = counted.groupBy("component").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("k"))
    most = most.where("all > k").select("component", "main", F.ceil((F.col("all") - F.col("k")) / F.lit(float(SET_BLOCK))).cast("int").alias("others"), F.ceil(F.col("k") / F.lit(float(SET_BLOCK))).cast("int").alias("mains"))
    now = now.join(most, "component")
    apart = F.col("class") != F.col("main")
    # blocks of other classes come first, from 0; those of the main class after them, which meet only the former
    block = F.when(apart, F.pmod(F.xxhash64(F.lit(17), "node"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64(F.lit(17), "node"), F.col("mains"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(apart, F.col("others") + F.col("mains") - 1).otherwise(F.col("others") - 1)))
    rest = now.withColumn("_own", block).withColumn("_other", other)
    rest = rest.select("row_key", "node", F.col("class").alias("label"), "component", F.least("_own", "_other").alias("left"), F.greatest("_own", "_other").alias("right"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))
    return first.union(set_pieces(docs, checkpointed(rest), similarity, size))


def near_duplicates(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row_key of the rows to drop: of each group of near duplicates all but the first by (doc_id, row_key).

    Texts whose prefixes share a shingle and whose SimHashes are near are candidates, which leaves out no pair of the similarity.
    Pairs of candidates within a connected component are discarded by their SimHash's distances to reference fingerprints, and
    the survivors verified on their whole shingle sets. Groups are the connected components of the verified links. Texts with equal sets are one node;
    texts without words are copies of each other. Rows equal in all columns are one document: they stay or go together. Null
    ids come last; an empty table drops nothing.
    """
    last = F.lit((1 << 63) - 1)

    def output(ids, keys, names: np.ndarray, _h, bounds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, keys, pa.array(names), pa.array(np.diff(bounds), pa.int64())], ["doc_id", "row_key", "node", "n"])

    rows = checkpointed(from_sets(docs, output, "doc_id long, row_key long, node long, n long", shingle))
    rank = F.struct(F.coalesce("doc_id", last).alias("d"), F.col("row_key").alias("k"))
    nodes = checkpointed(rows.groupBy("node", "n").agg(F.min(rank).alias("least")).select("node", "n", "least", F.col("least")["k"].alias("row_key")))
    candidates = components(prefix_links(docs, nodes.select("node", "n", "row_key"), similarity, shingle))
    linked = verified(docs, candidates.join(nodes.select("node", "row_key"), "node"), similarity, shingle)
    parts = components(linked)
    named = nodes.select("node", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    of_node = named.join(first, "component").select("node", "first")
    return rows.select("doc_id", "row_key", "node").join(of_node, "node").where(rank != F.col("first")).select("doc_id", "row_key")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, that `near_duplicates` doesn't drop."""
    return without(docs, near_duplicates(docs, **how))
