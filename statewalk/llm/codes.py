"""Vector codes: each part of a vector is replaced by the nearest of a few codebook entries, fitted by rounds of reassignment.

Components become integers, so every sum is exact and no result depends on the order of rows. The distances of a batch come from
per-dimension value dictionaries: for each dimension the squared differences of every distinct integer to all entries are
tabulated once, and the distances of a part are gathers from these tables, added over its dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import bounded_batches, released
from statewalk.llm.training import BROADCAST_ROWS

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this in magnitude are summed and squared as 64-bit numbers; others as numbers of any size.
SAFE = 1 << 28
#: Rows whose distances are held at once, and cells of components that are tabulated at once.
STEP_ROWS = 4096
MOST = (1 << 63) - 1
#: Sums travel as digits of so many bits, so that totals over any number of tasks are exact.
DIGIT = 40


@dataclass(frozen=True)
class Codebooks:
    """entries: PARTS lists of up to ENTRIES entries, each a tuple of integers; width: components of a part."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    width: int

    @property
    def digest(self) -> str:
        """Of all components in decimal, by part, entry and place in the part, with commas between."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    numerator, denominator = x.as_integer_ratio()
    return numerator * SCALE // denominator


def integers(values: pa.ListArray, dims: int) -> np.ndarray:
    """The vectors as rows of floor(SCALE * x): 64-bit, or objects where a value is large. Short vectors end in zeros."""
    lengths = np.diff(values.offsets.to_numpy()).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    small = not len(flat) or float(np.abs(flat).max()) < SAFE // SCALE
    cells = np.floor(flat * SCALE).astype(np.int64) if small else np.array([whole(x) for x in flat.tolist()], object)
    if len(lengths) and (lengths == dims).all():
        return cells.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), cells.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = cells
    return out


def assigned(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row's parts (ties to the lower index) and its squared distance."""
    n, width = len(rows), books.width
    wide = rows.dtype == object or any(abs(x) >= SAFE for part in books.entries for e in part for x in e)
    kind = object if wide else np.int64
    code, apart = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), kind)
    for part, entries in enumerate(books.entries):
        tables, places = [], []
        for j in range(width):
            value, place = np.unique(rows[:, part * width + j], return_inverse=True)
            own = np.array([e[j] for e in entries], kind)
            tables.append((value.astype(kind)[:, None] - own[None]) ** 2)
            places.append(place)
        for lo in range(0, n, STEP_ROWS):
            far = np.zeros((min(STEP_ROWS, n - lo), len(entries)), kind)
            for table, place in zip(tables, places):
                far += table[place[lo : lo + STEP_ROWS]]
            best = far.argmin(1)
            code[lo : lo + STEP_ROWS, part] = best
            apart[lo : lo + STEP_ROWS, part] = far[np.arange(len(far)), best]
    return code, apart


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), label of the rows whose vector has only finite components."""
    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & finite)


def started(rows: DataFrame) -> Codebooks:
    """Codebooks of the first rows by id (missing ids last, then by components)."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = -(-longest // PARTS) * PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    width = dims // PARTS
    vectors = [tuple(whole(x) for x in r[0]) + (0,) * (dims - len(r[0])) for r in first]
    return Codebooks(tuple(tuple(v[p * width : (p + 1) * width] for v in vectors) for p in range(PARTS)), width)


def digits(x: int) -> Iterator[tuple[int, int]]:
    """The digits of a number that aren't 0, with their places; all have its sign."""
    sign, x, place = (1, x, 0) if x >= 0 else (-1, -x, 0)
    while x:
        if d := x & ((1 << DIGIT) - 1):
            yield place, sign * d
        x >>= DIGIT
        place += 1


def totals(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """Sums of all parts that an entry is nearest to, by (part, entry, place in the part); at place -1 their number.

    A task sends its own sums, as many as the codebooks have components; they are added where they are shuffled to, and the
    driver gets one row for each component and digit.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, own = shared.value, {}
        dims = books.width * PARTS
        for batch in batches:
            cells = integers(batch.column(0), dims)
            code, _ = assigned(cells, books)
            for part in range(PARTS):
                order = np.argsort(code[:, part], kind="stable")
                used, first, count = np.unique(code[order, part], return_index=True, return_counts=True)
                if not len(used):
                    continue
                sums = np.add.reduceat(cells[order, part * books.width : (part + 1) * books.width], first, axis=0)
                for e, n, row in zip(used.tolist(), count.tolist(), sums.tolist()):
                    for j, x in enumerate([n, *row], -1):
                        own[part, e, j] = own.get((part, e, j), 0) + int(x)
        sent = [(*key, place, d) for key, x in own.items() for place, d in digits(x)]
        columns = list(zip(*sent)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "digit", "x"])

    parts = rows.select("embedding").mapInArrow(released(run), "part long, entry long, place long, digit long, x long")
    out: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("part", "entry", "place", "digit").agg(F.sum("x").alias("x")).collect():  # bounded by the codebooks
        key = (r["part"], r["entry"], r["place"])
        out[key] = out.get(key, 0) + (r["x"] << (DIGIT * r["digit"]))
    return out


def moved(books: Codebooks, sums: dict[tuple[int, int, int], int]) -> Codebooks:
    """Every entry at the floor of the mean of its parts; entries without any stay."""

    def entry(part: int, e: int, old: tuple[int, ...]) -> tuple[int, ...]:
        n = sums.get((part, e, -1), 0)
        return tuple(sums.get((part, e, j), 0) // n for j in range(books.width)) if n else old

    return Codebooks(tuple(tuple(entry(p, e, old) for e, old in enumerate(part)) for p, part in enumerate(books.entries)), books.width)


def fit(embeddings: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after `rounds` rounds over all kept rows: each is one scan and one grouped sum."""
    rows = kept(embeddings)
    books = started(rows)
    for _ in range(rounds if books.width else 0):
        books = moved(books, totals(rows, books))
    return books


def encode(embeddings: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances summed over parts) of the kept rows."""
    rows = kept(embeddings)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            code, apart = assigned(integers(batch.column(1), books.width * PARTS), books)
            raw = code.astype(np.uint8).tobytes().hex()
            error = [min(int(x), MOST) for x in apart.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(code))], pa.string()), pa.array(error, pa.int64()), batch.column(2)], ["vec_id", "code", "error", "label"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "embedding", "label").mapInArrow(released(run), f"vec_id long, code string, error long, label {kind}")


def compressed(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, missing ones together), codebooks_sha256.

    Rows whose vector is null or has a null or non-finite component are left out. Each row counts, repeated ones too; rows
    without an id come last among those the codebooks start from. With fewer than ENTRIES rows the codebooks have as many
    entries as there are rows; an empty table gives no rows. Vectors shorter than the longest, rounded up to a multiple of
    PARTS components, count as ending in zeros. Numbers of any size are exact, but for errors beyond a long, which are given
    as its largest. Labels' sums are added before they are shuffled, so a label that most rows share costs no more than
    others; they are broadcast up to BROADCAST_ROWS labels and joined beyond it. Other columns are dropped.
    """
    books = fit(embeddings, rounds)
    rows = encode(embeddings, books)
    most = F.lit(MOST).cast("decimal(38,0)")
    sums = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    few = embeddings.select(F.approx_count_distinct("label")).first()[0] <= BROADCAST_ROWS // 2
    out = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """compressed of table embeddings in DuckDB SQL: the rounds one after another."""
    near = "SELECT c.r, c.part, c.v, arg_min(b.e, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.e) AS e, min(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM c JOIN {book} b ON b.part = c.part GROUP BY c.r, c.part, c.v"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(book=f'b{i}')})")
        steps.append(f"u{i} AS (SELECT part, e, j, count(*) AS n, sum(v[j]) AS s FROM (SELECT part, e, v, unnest(range(1, len(v) + 1)) AS j FROM a{i}) GROUP BY part, e, j)")
        steps.append(f"m{i} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM u{i} GROUP BY part, e)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.e = b.e)")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (SELECT r, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k, (SELECT CAST(unnest(range({PARTS})) AS BIGINT) AS part)),
b0 AS MATERIALIZED (SELECT part, r AS e, v FROM c WHERE r < {ENTRIES}),
{", ".join(steps)},
f AS ({near.format(book=f"b{rounds}")}),
g AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT CAST(k.vec_id AS BIGINT) AS vec_id, g.code, g.error, CAST(sum(g.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM g JOIN k ON k.r = g.r CROSS JOIN h"""
