"""Embedding near-duplicates by collision-counting projections.

Within a cell of like vectors, every vector is projected on many random lines and each projection is sorted; a window centred
on each vector's own value finds its neighbours on that line, and the windows in which a pair meets are counted. Pairs whose
count passes a threshold calibrated for recall are verified by their cosine in double precision.

All pairs of a table can't be counted, so distinct vectors are first dealt to cells by the signs of random projections, in
several tables: a pair at the threshold shares a cell in some table with a calibrated chance, and is judged in the first one.
What travels to a cell is the vector in 16-bit steps with a bound on its error, half of the input's four bytes a component.
The bound decides almost every pair that passes the count; the few within it of the threshold fetch both vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.blocks import Forest, dealt, star
from statewalk.llm.common import checkpointed, released
from statewalk.llm.components import components

THRESHOLD = 0.9
#: Lines of a cell, the chance that a pair at the threshold meets in one window (and its place on the normal distribution),
#: and the recalls aimed at, by cells and by counts.
LINES, WINDOW_CHANCE, WINDOW_DEVIATIONS, CELL_RECALL, COUNT_RECALL = 24, 0.98, 2.326, 0.998, 0.999
#: Lines that are counted for all pairs of a cell before those that can't reach the count are left out.
DENSE_LINES = 16
#: Vectors of a cell, about, members of a block of a larger cell, and vectors of a task.
CELL_ROWS, BLOCK, TASK_ROWS, SEED = 1024, 1024, 8_192, 20_240_601
#: Steps of a quantised component, and of a cell's planes, whose products are then exact in any order of summation.
STEPS, PLANE_STEPS = 32_767, 127


@lru_cache(64)
def directions(n: int, dim: int, stream: int) -> np.ndarray:
    """Random directions, rows of unit length; each dim of them are at right angles, so that their estimates vary less."""
    rng = np.random.default_rng([SEED, stream, dim])
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-n // dim))]
    return np.concatenate(blocks or [np.zeros((0, dim))])[:n]


def calibrate(n: int, dim: int, threshold: float) -> tuple[int, int, float, int]:
    """Bits of a cell, tables, half a window and the least count of collisions, for n vectors.

    A random plane parts a pair at angle t with chance t / pi. The projections of two unit vectors at distance d on a random
    unit direction differ by about a normal of deviation d / sqrt(dim).
    """
    together = 1 - math.acos(threshold) / math.pi
    bits = max(0, min(60, round(math.log2(max(n, 1) / CELL_ROWS))))
    tables = 1 if bits == 0 else math.ceil(math.log(1 - CELL_RECALL) / math.log1p(-(together**bits)))
    half = math.sqrt(2 - 2 * threshold) / math.sqrt(dim) * WINDOW_DEVIATIONS
    least, tail = LINES, WINDOW_CHANCE**LINES
    while tail < COUNT_RECALL and least > 0:
        least -= 1
        tail += math.comb(LINES, least) * WINDOW_CHANCE**least * (1 - WINDOW_CHANCE) ** (LINES - least)
    return bits, tables, half, least


def candidates(unit: np.ndarray, lines: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a < b of vectors that meet in the windows of at least `least` lines."""
    n = len(unit)
    count = np.zeros((n, n), np.int8)
    ranks = []
    for values in (unit @ lines.T).T:
        order = np.argsort(values, kind="stable")
        inside = values[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        ranks.append((rank, np.searchsorted(inside, values - half, "left").astype(np.int32), np.searchsorted(inside, values + half, "right").astype(np.int32)))
    for rank, lo, hi in ranks[:DENSE_LINES]:
        count += (rank[None, :] >= lo[:, None]) & (rank[None, :] < hi[:, None])
    a, b = np.nonzero(np.triu(count >= least - max(0, len(ranks) - DENSE_LINES), 1))
    met = count[a, b].astype(np.int16)
    for i, (rank, lo, hi) in enumerate(ranks[DENSE_LINES:]):
        at = rank[b]
        met += (at >= lo[a]) & (at < hi[a])
        left = met >= least - (len(ranks) - DENSE_LINES - 1 - i)
        a, b, met = a[left], b[left], met[left]
    return a, b


def cells_of(steps: np.ndarray, dim: int, bits: int, tables: int) -> np.ndarray:
    """Cell of each vector (in steps) in each table. Sums of whole numbers below 2**53: the same wherever they are taken."""
    if not bits:
        return np.zeros((len(steps), tables), np.int64)
    planes = np.clip(np.rint(directions(bits * tables, dim, 1) * (PLANE_STEPS / 4) * math.sqrt(dim)), -PLANE_STEPS, PLANE_STEPS)
    sign = (steps.astype(np.float64) @ planes.T > 0).reshape(len(steps), tables, bits)
    return sign @ (1 << np.arange(bits, dtype=np.int64))


def decoded(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of dim components from their bytes: 4 or 8 a component."""
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8").astype(np.float64) for x in raw]) if raw else np.zeros((0, dim))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first by the greatest, as squares of very large or small ones don't fit
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in whole steps (int16), and a bound on how far each one's direction, as a unit vector, then is from its own."""
    steps = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * STEPS).astype("<i2")
    return steps, np.linalg.norm(units(steps.astype(np.float64)) - unit, axis=1) * (1 + 1e-6) + 1e-12


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, raw: each vector's bytes (4 a component for floats, else 8), null where it can't link.

    It can link if the row has an id and the vector is neither null nor all zero and has no null or non-finite component.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    wide = kind != "array<float>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else kind).alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components are not a number
            flat = np.ascontiguousarray(flat + flat.dtype.type(0), "<f8" if wide else "<f4")  # negative zeros are zeros
            at = np.concatenate(([0], np.cumsum(size)))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[at]
            zero = np.concatenate(([0], np.cumsum(flat != 0)))[at]
            good = (np.diff(bad) == 0) & (np.diff(zero) > 0) & np.asarray(ids.is_valid())
            raw, width = flat.tobytes(), flat.dtype.itemsize
            out = [raw[a * width : b * width] if g else None for a, b, g in zip(at.tolist(), at[1:].tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "raw"])

    return base.mapInArrow(released(run), "vec_id long, dim int, raw binary")


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """kind 0: node a links copies b (sums); kind 1: an edge a - b of a spanning forest; kind 2: a pair a, b whose cosine is within
    the quantisation's bound of the threshold, not judged yet, with the copies of both (wa, wb).

    nodes: node (long), copies (long), dim (int), raw (binary), each vector once. Pairs are not returned, as a group of g near
    copies has g * g of them: a task returns each node's sum and the forest of its pairs.
    """
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of a vector
    plan = {dim: calibrate(n, dim, threshold) for dim, n in sizes.items()}
    total = sum(n * plan[dim][1] for dim, n in sizes.items())

    def placed(batch: pa.RecordBatch, with_vector: bool) -> Iterator[pa.RecordBatch]:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            bits, tables, _, _ = plan[dim]
            part = batch.filter(pa.array(dims == dim))
            for lo in range(0, part.num_rows, 2000):
                rows = part.slice(lo, 2000)
                steps, error = quantised(units(decoded(rows.column(3).to_pylist(), dim)))
                cells = cells_of(steps, dim, bits, tables)
                raw = pa.array([x.tobytes() for x in steps], pa.binary())
                for t in range(tables):
                    key = [pa.array(np.full(len(cells), dim, np.int32)), pa.array(np.full(len(cells), t, np.int32)), pa.array(cells[:, t])]
                    names = ["dim", "slot", "cell"]
                    if with_vector:
                        key += [rows.column(0), rows.column(1), raw, pa.array(error.astype(np.float32))]
                        names += ["node", "copies", "steps", "error"]
                    yield pa.RecordBatch.from_arrays(key, names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from placed(batch, True)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from placed(batch, False)

    def piece(pdf: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
        """(kind, a, b, wa, wb) of a piece."""
        dim, slot = int(pdf["dim"].iloc[0]), int(pdf["slot"].iloc[0])
        bits, tables, half, least = plan[dim]
        steps = np.frombuffer(b"".join(pdf["steps"]), "<i2").reshape(-1, dim)
        unit, error = units(steps.astype(np.float64)), pdf["error"].to_numpy(np.float64)
        node, copies, side = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        a, b = candidates(unit, directions(LINES, dim, 2), half, least)
        if pdf["left"].iloc[0] != pdf["right"].iloc[0]:
            apart = side[a] != side[b]
            a, b = a[apart], b[apart]
        cosine = np.empty(len(a))
        for lo in range(0, len(a), 1 << 16):
            cosine[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", unit[a[lo : lo + (1 << 16)]], unit[b[lo : lo + (1 << 16)]])
        bound = error[a] + error[b] + error[a] * error[b] + 1e-6  # errors travel in 32 bits
        sure, open_ = cosine - bound >= threshold, np.abs(cosine - threshold) <= bound
        forest = Forest(len(node))
        forest.join(a[sure], b[sure])
        if slot:  # what met before is left to the first table they share
            codes = cells_of(steps, dim, bits, tables)[:, :slot]
            new = np.concatenate([~(codes[a[lo : lo + (1 << 16)]] == codes[b[lo : lo + (1 << 16)]]).any(1) for lo in range(0, len(a), 1 << 16)] or [np.zeros(0, bool)])
            sure, open_ = sure & new, open_ & new
        linked = np.bincount(a[sure], weights=copies[b[sure]], minlength=len(node)) + np.bincount(b[sure], weights=copies[a[sure]], minlength=len(node))
        inner, root = star(forest)
        some = np.flatnonzero(linked)
        a, b = a[open_], b[open_]
        zeros = np.zeros(max(len(some), len(inner)), np.int64)
        return [
            (np.zeros(len(some), np.int32), node[some], linked[some].astype(np.int64), zeros[: len(some)], zeros[: len(some)]),
            (np.ones(len(inner), np.int32), node[inner], node[root], zeros[: len(inner)], zeros[: len(inner)]),
            (np.full(len(a), 2, np.int32), node[a], node[b], copies[a], copies[b]),
        ]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [tuple(np.zeros(0, np.int32 if i == 0 else np.int64) for i in range(5))]
        for _, group in pdf.groupby(["dim", "slot", "cell", "left", "right"], sort=False):
            if len(group) > 1:
                found += piece(group)
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("kind", "a", "b", "wa", "wb"), zip(*found))})

    own = nodes.select("node", "copies", "dim", "raw")
    cell = "dim int, slot int, cell long"
    rows = own.mapInArrow(released(spread), f"{cell}, node long, copies long, steps binary, error float")
    pieces = dealt(rows, ["dim", "slot", "cell"], F.col("node"), BLOCK, own.mapInArrow(released(keys), cell))
    task = F.pmod(F.xxhash64("dim", "slot", "cell", "left", "right"), F.lit(max(1, -(-total // TASK_ROWS)))).cast("int").alias("task")
    return pieces.select(task, *pieces.columns).groupBy("task").applyInPandas(inside, "kind int, a long, b long, wa long, wb long")


def judged(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, wa, wb) of nodes whose cosine in double precision reaches the threshold."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), "dim", F.col("raw").alias("ra")), "a").join(nodes.select(F.col("node").alias("b"), F.col("raw").alias("rb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_pylist()
            keep = []
            for dim, x, y in zip(dims, batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                u, v = units(decoded([x, y], dim))
                keep.append(bool(u @ v >= threshold))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "wa", "wb", "dim", "ra", "rb").mapInArrow(released(run), "a long, b long, wa long, wb long")


def classes(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Copies of a vector are one node, so c of them give each c - 1 links at once and no pairs. Vectors that are null, zero or
    hold null or non-finite components have no link and are a component of their own; vectors of different lengths never link.
    Rows without a vec_id have no link either and a null component. Rows that repeat a vec_id count as vectors of their own,
    whether the vectors are alike or not. An empty table gives no rows; other columns are dropped.
    """
    rows = packed(vectors)
    nodes = rows.where("raw is not null").groupBy("dim", "raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers of what is written stay
    found = checkpointed(links(nodes, threshold))
    extra = checkpointed(judged(found.where("kind = 2").select("a", "b", "wa", "wb"), nodes, threshold))
    sums = found.where("kind = 0").select("a", "b").union(extra.select("a", F.col("wb").alias("b"))).union(extra.select(F.col("b").alias("a"), F.col("wa").alias("b")))
    degree = sums.groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    parts = components(found.where("kind = 1").select("a", "b").union(extra.select("a", "b")))
    named = nodes.select("dim", "raw", "node", "copies", "least").join(degree, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(names, "component").select("dim", "raw", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("raw is not null").join(of_node, ["dim", "raw"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
