"""Shared pieces of the corpus operators: table access, Arrow text chunks, hashing and checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text forms a step of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of rows that travel to Python at once, about; a longer row travels alone.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what travels to Python at once by bytes, so that long rows don't make batches of any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, f"{1 << 26}").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the extra columns under their own names; other columns never reach an operator."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: the one already set, else the one that spark.checkpoint.dir names.

    Where neither is set, one is made up if all of Spark runs in this process. A folder of one machine would lose rows on a
    cluster, so there it is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    give_back()
    return df.checkpoint(eager=True)


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def released(run: Callable) -> Callable:
    """A function of a task's batches that gives the memory it no longer uses back to the system at the end.

    Python workers live on after a task, and would keep what a large batch once took while others need it.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class TextChunk:
    """Texts [lo, hi) of a batch: their bytes, and len(self) + 1 offsets into them. Null texts are empty."""

    __slots__ = ("data", "hi", "lo", "offsets")

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[TextChunk]:
    """Cut a string column into chunks of whole texts of about max_bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield TextChunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of longer code points stay."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.view(np.uint8) << 5)


#: Odd multiplier of the hashes.
BASE = 0x9E3779B97F4A7C15
#: Words of eight bytes in a span that is hashed by whole arrays; a longer span is hashed on its own.
WORDS = 4
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray, starts: np.ndarray, size: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The bytes of spans of at most 8 * words bytes as that many numbers each, padded with zeros."""
    view = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out = np.zeros((len(starts), words), np.uint64)
    for w in range(words):
        some = np.flatnonzero(size > 8 * w)
        if not len(some):
            break
        out[some, w] = view[starts[some] + 8 * w] & _MASKS[np.minimum(size[some] - 8 * w, 8)]
    return out


def hash_of_words(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of words_of."""
    h = mix(size.astype(np.uint64) + np.uint64(BASE))
    for w in range(words.shape[1]):
        some = np.flatnonzero(size > 8 * w)
        if not len(some):
            break
        h[some] = mix(h[some] * np.uint64(BASE) + words[some, w])
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: equal bytes give equal hashes wherever they stand."""
    size = ends - starts
    h = np.zeros(len(size), np.uint64)
    long = np.flatnonzero(size > 8 * WORDS)
    if len(long):
        raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        h[long] = np.fromiter((digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    short = np.flatnonzero(size <= 8 * WORDS)
    if len(short):
        h[short] = hash_of_words(words_of(data, starts[short], size[short]), size[short])
    return h


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes not marked outside) and, for each text, the index of its first word.

    A word never crosses from one text into the next.
    """
    inside = ~outside
    begin = inside.copy()
    begin[1:] &= outside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] |= inside[first]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= outside[1:] | begin[1:]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along axis 0; empty segments give 0."""
    shape = (len(bounds) - 1, *values.shape[1:])
    out = np.zeros(shape, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


def first_rows(a: np.ndarray) -> np.ndarray:
    """True where a sorted array begins a new value."""
    out = np.ones(len(a), bool)
    if len(a):
        out[1:] = a[1:] != a[:-1]
    return out
