"""Harmonic packing of token sequences.

A sequence of C tokens is a bin. A document first fills as many whole bins as it can; what is left of it, of n tokens, belongs
to the reciprocal class k with C / (k + 1) < n <= C / k, whose bins take k documents each, whatever their lengths within the
class. Classes don't depend on each other and no bin on another worker's, so workers fill bins on their own, with no exchange.

A bin that has its k documents is less than full by a part of each document's length. That gap is filled by the first tokens
of the documents that come next, so that no token of padding is left. Bins that are still open at the end of a worker's input
are poured into full sequences, and what remains of that into sequences of a power of two.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statewalk.llm.bpe import encode_chunk, vocabulary
from statewalk.llm.common import released, text_chunks, texts_of

CAPACITY = 2048
#: The id that ends each document.
END_ID = 1
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

#: Tokens of a document that stay together: its id, the tokens before them, the tokens (4 bytes each), the document's number.
Piece = tuple[int | None, int, bytes, int]


def reciprocal_class(n: int, capacity: int = CAPACITY) -> int:
    """The k with capacity / (k + 1) < n <= capacity / k."""
    return capacity // n


class Bins:
    """The open bins of one worker: fewer than k documents for each class k, and the full bins whose gap isn't filled yet."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        if capacity < 1 or capacity & (capacity - 1) or worker < 0:
            raise ValueError("the capacity has to be a power of two")
        self.capacity, self.next = capacity, worker << 40
        self.open: dict[int, list[Piece]] = {}
        self.gaps: deque[tuple[list[Piece], int]] = deque()  # pieces, and tokens that are missing
        self.done: list[tuple] = []

    def add(self, doc: int | None, tokens: bytes) -> None:
        n, at = len(tokens) // 4, 0

        def take(size: int) -> Piece:
            nonlocal at
            at += size
            return (doc, at - size, tokens[4 * (at - size) : 4 * at], n)

        while self.gaps and at < n:
            pieces, gap = self.gaps.popleft()
            size = min(gap, n - at)
            pieces.append(take(size))
            if size < gap:
                self.gaps.appendleft((pieces, gap - size))
            else:
                self._close(pieces)
        while n - at >= self.capacity:
            self._close([take(self.capacity)])
        if at < n:
            k = reciprocal_class(n - at, self.capacity)
            pieces = self.open.setdefault(k, [])
            pieces.append(take(n - at))
            if len(pieces) == k:
                del self.open[k]
                gap = self.capacity - sum(len(p[2]) for p in pieces) // 4
                if gap:
                    self.gaps.append((pieces, gap))
                else:
                    self._close(pieces)

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc, start, tokens, n in pieces:
            size = len(tokens) // 4
            self.done.append((doc, start, size, zlib.crc32(tokens), n, self.next, offset))
            offset += size
        self.next += 1

    def finish(self) -> None:
        """Pour what is left into full sequences, then into one for each binary digit of the rest, pieces being cut where one ends."""
        left = deque(p for pieces in [*(g[0] for g in self.gaps), *self.open.values()] for p in pieces)
        self.gaps.clear()
        self.open.clear()
        total = sum(len(p[2]) for p in left) // 4
        rest = total % self.capacity
        for room in [self.capacity] * (total // self.capacity) + [1 << j for j in reversed(range(rest.bit_length())) if rest >> j & 1]:
            pieces: list[Piece] = []
            while room:
                doc, start, tokens, n = left.popleft()
                size = min(room, len(tokens) // 4)
                pieces.append((doc, start, tokens[: 4 * size], n))
                if 4 * size < len(tokens):
                    left.appendleft((doc, start + size, tokens[4 * size :], n))
                room -= size
            self._close(pieces)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * len(COLUMNS)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COLUMNS))


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A special token's name within a text is that token, as the tokenizer's library has it by default, or with special_as_text
    ordinary text. Every document has at least the end id, so null and empty texts give one piece of one token. Repeated rows
    are packed as often as they occur, rows without an id like others. Very long texts are cut as they fill sequences. An empty
    table has no pieces; other columns are dropped. Sequence ids are unique over all workers (the worker's partition number in
    the high bits); which documents share a sequence depends on how the rows are partitioned, the pieces' tokens do not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, last = vocabulary(vocabulary_path, special_as_text), np.array([end_id], "<u4").tobytes()
        bins = Bins(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in text_chunks(batch.column(1)):
                for doc, tokens in zip(ids[chunk.lo : chunk.hi], encode_chunk(chunk, vocab)):
                    bins.add(doc, tokens + last)
                if len(bins.done) > 20_000:
                    yield bins.take()
        bins.finish()
        yield bins.take()

    return texts_of(docs).mapInArrow(released(run), ", ".join(f"{c} long" for c in COLUMNS))
