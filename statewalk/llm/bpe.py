"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point is mapped to a class by a lookup table; a small automaton
over these classes marks where a token begins. The automaton's transition functions form a finite monoid, so the state at
every position comes from an associative scan over function numbers, run on whole chunks of text at once. The slices it
finds are merged by rank, each distinct slice once, through a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statewalk.llm.common import BASE, WORDS, TextChunk, first_rows, mix, released, text_chunks, texts_of, words_of

LETTER, NUMBER, SPACE, OTHER = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Input symbols of the automaton. GAP: a blank before a visible character; BREAK: other white space before one;
# INNER: white space before white space or the end; SHORT, LONG: an apostrophe before one, or two, contraction letters.
L, N, O, GAP, BREAK, INNER, SHORT, LONG = range(8)
# States after a symbol: within a run of letters, numbers, others; after a blank that joins what follows; within white
# space; at a token's end; before the last, or the last two, letters of a contraction.
IN_L, IN_N, IN_O, JOIN, IN_SPACE, END, LEFT1, LEFT2 = range(8)
STATES, SYMBOLS, FIRST = 8, 16, 8  # symbol + FIRST: the same as the first of its text


def _step(state: int, symbol: int) -> tuple[int, int]:
    """The next state, and whether the symbol begins a token."""
    if symbol >= FIRST:
        state, symbol = END, symbol - FIRST
    if state in (LEFT1, LEFT2):
        return (END if state == LEFT1 else LEFT1), 0
    if symbol in (SHORT, LONG):
        if state in (IN_L, IN_N, END):
            return (LEFT1 if symbol == SHORT else LEFT2), 1
        symbol = O
    if symbol in (L, N, O):
        return (IN_L, IN_N, IN_O)[symbol], int(state not in (JOIN, (IN_L, IN_N, IN_O)[symbol]))
    if symbol == INNER:
        return IN_SPACE, int(state != IN_SPACE)
    return (JOIN if symbol == GAP else END), 1


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol; composition (first, then second); function applied to state; token begins (state, symbol)."""
    of_symbol = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    known = {f: i for i, f in enumerate(dict.fromkeys(of_symbol))}
    queue = list(known)
    for f in queue:
        for g in of_symbol:
            fg = tuple(g[s] for s in f)
            if fg not in known:
                known[fg] = len(known)
                queue.append(fg)
    m = len(known)
    compose = np.zeros((m, m), np.int16)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[s] for s in f)]
    begins = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)], bool)
    return np.array([known[f] for f in of_symbol], np.int16), compose, np.array(list(known), np.int8), begins


def scan(functions: np.ndarray, compose: np.ndarray, lane: int = 64) -> np.ndarray:
    """Inclusive scan of function numbers under composition: lanes in step, then the lanes' totals, then both joined."""
    n, m = len(functions), len(compose)
    if n <= lane:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    lanes = -(-n // lane)
    grid = np.zeros(lanes * lane, np.int16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    flat = compose.ravel()
    for t in range(1, lane):
        grid[t] = flat[grid[t - 1].astype(np.int32) * m + grid[t]]
    before = scan(grid[-1], compose, lane)
    grid[:, 1:] = flat[before[None, :-1].astype(np.int32) * m + grid[:, 1:]]
    return grid.T.ravel()[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin, in a chunk of UTF-8 texts cut at offsets."""
    if not len(data):
        return np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(code)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True
    first[n] = True
    symbol = np.array([L, N, INNER, O], np.uint8)[kind]
    space = np.flatnonzero(kind == SPACE)
    seen = space[~first[space + 1]]
    seen = seen[kind[seen + 1] != SPACE]
    symbol[seen] = np.where(code[seen] == 32, GAP, BREAK)
    quote = np.flatnonzero(code == 39)
    quote = quote[~first[quote + 1]]
    if len(quote):
        one = code[quote + 1]
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        more = ~first[quote + 2]
        quote, one = quote[more], one[more]
        two = code[quote + 2]
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quote[pairs]] = LONG
    symbol[first[:n]] += FIRST
    of_symbol, compose, apply, begins = _monoid()
    state = apply[:, END][scan(of_symbol[symbol], compose)]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, state[:-1]
    return lead[begins[before, symbol]]


class Table:
    """Open-addressing map from uint64 (not 0) to int64, looked up and filled by whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(BASE)) >> np.uint64(64 - self.bits)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        slot = self._slots(keys).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], missing)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there, want = self.keys[slot[left]], keys[left]
            hit = there == want
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys are distinct and not yet there."""
        self.count += len(keys)
        slot = self._slots(keys).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]  # the slot was taken, or another key of this call won it
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


class Vocabulary:
    """Tokens and their ranks, with a cache of merged slices that is emptied when `limit` slices are in it.

    added: tokens that stand outside the merges, found in the raw text before it is cut into pre-tokens.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 250_000, added: dict[bytes, int] | None = None):
        self.ranks, self.limit = ranks, limit
        self.added = added or {}
        self.added_pattern = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        tokens = ranks | self.added
        size = max(tokens.values(), default=0) + 1
        self.tokens = {i: t for t, i in tokens.items()}
        self.lengths = np.zeros(size, np.int64)
        for t, i in tokens.items():
            self.lengths[i] = len(t)
        pairs: dict[int, int] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None:
                    pairs[(x << 32 | y) + 1] = i
        self.pairs = Table(max(4, (2 * len(pairs)).bit_length()))
        self.pairs.put(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int64))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._empty()

    def _empty(self) -> None:
        self.table = Table(max(4, (2 * self.limit).bit_length()))
        # rows of the cache: the slice's bytes as words, its size, and where its ids are; only used rows take memory
        self.text, self.size = np.empty((self.limit, WORDS), np.uint64), np.empty(self.limit, np.int64)
        self.begin, self.count = np.empty(self.limit, np.int64), np.empty(self.limit, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode_slices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All slices' ids in one array, and each slice's number of ids.

        Slices of at most 8 * WORDS bytes are looked up in the cache by a hash and taken only if all their bytes agree; longer
        ones, and those that meet another slice of equal hash, are merged without it.
        """
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = ends - starts
        begin, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        small = np.flatnonzero(size <= 8 * WORDS)
        text, own = words_of(data, starts[small], size[small]), size[small]
        key = own.astype(np.uint64)
        for w in range(WORDS):
            key = mix(text[:, w] + key * np.uint64(BASE))
        key[key == 0] = 1
        at = self.table.get(key)
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.unique(key[new], return_index=True)[1]]
            if self.table.count and self.table.count + len(new) > self.limit:
                self._empty()
                new = np.unique(key, return_index=True)[1]
            new = new[: self.limit - self.table.count]
            self._learn(data, starts[small[new]], own[new], key[new], text[new])
            at = self.table.get(key)
        known = np.flatnonzero(at >= 0)
        row = at[known]
        same = (self.size[row] == own[known]) & (self.text[row] == text[known]).all(1)
        known, row = known[same], row[same]
        begin[small[known]], count[small[known]] = self.begin[row], self.count[row]
        flat, odd = self.flat, np.ones(len(size), bool)
        odd[small[known]] = False
        odd = np.flatnonzero(odd)
        if len(odd):
            more, n = self.merge(data, starts[odd], ends[odd])
            begin[odd], count[odd] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, more])
        out = np.cumsum(count)
        return flat[np.repeat(begin - out + count, count) + np.arange(out[-1])], count

    def _learn(self, data, starts, size, key, text) -> None:
        ids, n = self.merge(data, starts, starts + size)
        row = np.arange(self.table.count, self.table.count + len(key))
        self.table.put(key, row)
        self.text[row], self.size[row] = text, size
        self.begin[row], self.count[row] = len(self.flat) + np.cumsum(n) - n, n
        self.flat = np.concatenate([self.flat, ids])

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each slice, join the neighbours of least rank, leftmost first, until none has a rank; all slices in step."""
        size = ends - starts
        out: list[list[int] | np.ndarray] = [()] * len(starts)
        long = np.flatnonzero(size > 64)
        for i in long:
            out[i] = self._merge_long(data[starts[i] : ends[i]].tobytes())
        short = np.flatnonzero(size <= 64)
        n = size[short]
        done = np.cumsum(n)
        owner = np.repeat(np.arange(len(short)), n)
        token = self.single[data[np.repeat(starts[short] - done + n, n) + np.arange(done[-1] if len(done) else 0)]]
        ids, owners = [], []
        rank = np.full(len(token), NONE)
        rank[:-1] = self._rank(token[:-1], token[1:], owner[:-1] == owner[1:])
        while len(token):
            begin = np.flatnonzero(first_rows(owner))
            least = np.minimum.reduceat(rank, begin)
            busy = np.repeat(least < NONE, np.diff(np.append(begin, len(token))))
            if not busy.all():
                ids.append(token[~busy])
                owners.append(owner[~busy])
                token, owner, rank = token[busy], owner[busy], rank[busy]
                if not len(token):
                    break
                begin = np.flatnonzero(first_rows(owner))
                least = np.minimum.reduceat(rank, begin)
            at = np.flatnonzero(rank == np.repeat(least, np.diff(np.append(begin, len(token)))))
            at = at[first_rows(owner[at])]
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            token, owner, rank = token[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                follows = i + 1 < len(token)
                rank[i] = NONE
                i = i[follows]
                rank[i] = self._rank(token[i], token[i + 1], owner[i] == owner[i + 1])
        if ids:
            ids, owners = np.concatenate(ids), np.concatenate(owners)
            order = np.argsort(owners, kind="stable")
            ids, count = ids[order], np.bincount(owners, minlength=len(short))
        else:
            ids, count = np.zeros(0, np.int64), np.zeros(len(short), np.int64)
        if not len(long):
            return ids.astype(np.uint32), count
        for i, x in zip(short, np.split(ids, np.cumsum(count)[:-1])):
            out[i] = x
        return np.concatenate([np.asarray(x, np.uint32) for x in out]), np.array([len(x) for x in out])

    def _rank(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> np.ndarray:
        out = np.full(len(left), NONE)
        i = np.flatnonzero(joined)
        out[i] = self.pairs.get((left[i].astype(np.uint64) << np.uint64(32) | right[i].astype(np.uint64)) + np.uint64(1), NONE)
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and links, where a scan for each merge would cost the square of the length."""
        ranks, n = self.ranks, len(piece)
        end, after, back = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] != e:
                continue
            gone[j], end[i], after[i] = 1, e, after[j]
            if after[i] < n:
                back[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (b := back[i]) >= 0 and (r := ranks.get(piece[b:e])) is not None:
                heapq.heappush(heap, (r, b, e))
        return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]


NONE = 1 << 62


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def vocabulary(path: str, special_as_text: bool = False) -> Vocabulary:
    """From a rank file (token in base64, rank) or a tokenizers JSON file (whose merges follow its ids).

    Added tokens of a JSON file are found in a text wherever they stand, as that library does by default; with
    special_as_text they are ordinary text. Ones that look at what surrounds them are refused.
    """
    added: dict[bytes, int] = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        byte = _byte_characters()
        named = content.get("added_tokens", [])
        if any(t.get(k) for t in named for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        special = {t["content"] for t in named}
        if not special_as_text:
            added = {t["content"].encode("utf-8"): t["id"] for t in named}
        ranks = {bytes(byte[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Vocabulary(ranks, added=added)


def added_spans(chunk: TextChunk, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ids of the added tokens in a chunk's texts: leftmost first, of those the longest, none across texts."""
    found: list[tuple[int, int, int]] = []
    if vocab.added_pattern is not None and len(chunk.data):
        raw = chunk.data.tobytes()
        if vocab.added_pattern.search(raw):
            for a, b in zip(chunk.offsets.tolist(), chunk.offsets[1:].tolist()):
                found += [(m.start(), m.end(), vocab.added[m.group()]) for m in vocab.added_pattern.finditer(raw, a, b)]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def encode_chunk(chunk: TextChunk, vocab: Vocabulary) -> list[bytes]:
    """The ids of each text of a chunk, as little-endian unsigned 32-bit integers."""
    lo, hi, special = added_spans(chunk, vocab)
    offsets = np.unique(np.concatenate([chunk.offsets, lo, hi])) if len(lo) else chunk.offsets
    starts = token_starts(chunk.data, offsets)  # what is between two added tokens is cut as a text of its own
    ends = np.append(starts[1:], len(chunk.data)) if len(starts) else starts
    if len(lo):
        inside = np.searchsorted(lo, starts, "right") - 1
        inside = np.where((inside >= 0) & (starts < hi[inside]), inside, -1)
        lead = np.searchsorted(starts, lo)
        keep = inside < 0
        plain, n = vocab.encode_slices(chunk.data, starts[keep], ends[keep])
        count = np.zeros(len(starts), np.int64)
        count[keep] = n
        count[lead] = 1
        ids = np.empty(int(count.sum()), np.uint32)
        place = (np.cumsum(count) - count)[lead]
        rest = np.ones(len(ids), bool)
        rest[place] = False
        ids[place], ids[rest] = special, plain
    else:
        ids, count = vocab.encode_slices(chunk.data, starts, ends)
    at = 4 * np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, chunk.offsets)]
    raw, at = ids.astype("<u4", copy=False).tobytes(), at.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def token_ends(ids: bytes, vocab: Vocabulary) -> np.ndarray:
    """The byte of the text at which each token ends."""
    return np.cumsum(vocab.lengths[np.frombuffer(ids, "<u4")])


def decode(ids: bytes, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and ends (the same, byte offset at which each token ends).

    A null text counts as empty and has no ids; repeated rows give repeated rows; other columns are dropped. Very long
    texts are encoded whole, in a step of their own. No row is moved: one pass over the input, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids = encode_chunk(chunk, vocab)
                ends = [token_ends(x, vocab).astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], ["doc_id", "ids", "ends"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, ids binary, ends binary")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip (the decoded bytes equal the text): encoding, then decoding.

    Null and empty texts give no tokens and the digests of nothing.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids = encode_chunk(chunk, vocab)
                joined = b"".join(ids)
                decoded = decode(joined, vocab)
                bounds = np.cumsum([0] + [len(x) // 4 for x in ids])
                ends = np.concatenate(([0], token_ends(joined, vocab)))[bounds].tolist()
                same = np.array_equal(ends, chunk.offsets)
                raw = chunk.data.tobytes()
                out = [decoded[a:b] for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.lo, len(chunk)),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in out]),
                        pa.array([same and x == raw[a:b] for x, a, b in zip(out, ends, ends[1:])]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    return texts_of(docs).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
