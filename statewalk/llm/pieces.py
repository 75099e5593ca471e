"""SentencePiece encoding and decoding of BPE models with byte fallback, every piece with its span of original bytes.

A text is normalised by longest prefixes: at every character the compiled character map (a double-array trie) is walked, all
characters of a chunk in step, and the longest rule that matches replaces what it covers. Each normalised byte keeps the place
its rule began at, so that pieces, whose bytes in normalised text are known, are projected to spans of the original.

Pieces are joined over whole texts, not within words. A text is nevertheless cut, wherever two neighbouring characters stand
side by side in no piece of the model: no join can cross such a place. The slices between are merged once each, through a
bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statewalk.llm.bpe import NONE, Table, Vocabulary
from statewalk.llm.common import TextChunk, first_rows, released, text_chunks, texts_of

#: The visible stand-in for a blank.
MARK = "▁"
BLANK = 32
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of a slice that is merged in step with others; longer ones are merged one by one.
IN_STEP = 64


def leads(data: np.ndarray) -> np.ndarray:
    """Bytes at which characters begin."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class CharacterMap:
    """A compiled map: a double-array trie of keys and the strings they become, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
        self.strings = np.frombuffer(compiled, np.uint8, offset=4 + size)
        self.stops = np.flatnonzero(self.strings == 0)

    def longest(self, data: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place the length of the longest key (0: none) that ends before its limit, and where its string begins."""

        def offset(unit: np.ndarray) -> np.ndarray:
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        node = np.full(len(at), int(offset(self.units[:1])[0]))
        depth = 0
        while len(alive):
            inside = at[alive] + depth < limit[alive]
            alive, node = alive[inside], node[inside]
            key = data[at[alive] + depth].astype(np.int64)
            node = node ^ key
            unit = self.units[node]
            match = (unit & (1 << 31 | 0xFF)) == key
            alive, node, unit = alive[match], node[match] ^ offset(unit[match]), unit[match]
            depth += 1
            leaf = np.flatnonzero((unit >> 8) & 1)
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def sizes(self, value: np.ndarray) -> np.ndarray:
        return self.stops[np.searchsorted(self.stops, value)] - value


class Normalized:
    """data, offsets: the normalised bytes of a chunk's texts. source: of each byte, and stop: of each text's end, the place in
    the original bytes."""

    __slots__ = ("data", "offsets", "source", "stop")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, source: np.ndarray, stop: np.ndarray):
        self.data, self.offsets, self.source, self.stop = data, offsets, source, stop


class Normalizer:
    def __init__(self, compiled: bytes, prefix: bool, single_blanks: bool, marked: bool):
        """prefix: a blank goes before a text. single_blanks: blanks at the ends go, and runs become one. marked: blanks are
        written as MARK."""
        self.map = CharacterMap(compiled) if compiled else None
        self.prefix, self.single_blanks = prefix, single_blanks
        self.blank = np.frombuffer(MARK.encode() if marked else b" ", np.uint8)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> Normalized:
        begin = leads(data)
        pool, start, size, covered = data, begin, np.diff(np.append(begin, len(data))), None
        if self.map is not None:
            own = np.searchsorted(offsets, begin, "right") - 1
            length, value = self.map.longest(data, begin, offsets[own + 1])
            covered = self._covered(begin, size, length)
            pool = np.concatenate([data, self.map.strings])
            hit = length > 0
            start, size = np.where(hit, value + len(data), begin), np.where(hit, self.map.sizes(value), size)
            if covered is not None:
                begin, start, size = begin[~covered], start[~covered], size[~covered]
        pool = np.append(pool, np.uint8(BLANK))
        first = np.searchsorted(begin, offsets)  # each text's first rule, and how many there are
        said, at = np.diff(first) > 0, offsets[:-1].copy()
        if self.single_blanks:
            start, size, said, at = self._single(pool, start, size, begin, first, offsets)
        if self.prefix:  # a rule of its own before each text's first
            where = first[:-1][said]
            begin, start, size = (np.insert(x, where, v) for x, v in ((begin, at[said]), (start, len(pool) - 1), (size, 1)))
            first = first + np.concatenate(([0], np.cumsum(said)))
        raw = pool[np.repeat(start, size) + within(size)]
        wide = np.where(raw == BLANK, len(self.blank), 1)
        total = np.concatenate(([0], np.cumsum(wide)))
        out = np.repeat(raw, wide)
        blanks = total[:-1][raw == BLANK]
        for i, b in enumerate(self.blank):
            out[blanks + i] = b
        source = np.repeat(np.repeat(begin, size), wide)
        rules = np.concatenate(([0], np.cumsum(size)))
        ends, stop = total[rules[first]], offsets[1:].copy()
        if self.single_blanks:
            return self._trimmed(out, ends, source, stop)
        return Normalized(out, ends, source, stop)

    @staticmethod
    def _covered(begin: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray | None:
        """Characters within a rule that began before them; of rules that overlap the first one holds."""
        many = np.flatnonzero(length > size)
        if not len(many):
            return None
        edge, reach = np.zeros(len(begin) + 1, np.int64), -1
        after = np.searchsorted(begin, begin[many] + length[many])
        for a, b in zip(many.tolist(), after.tolist()):
            if a >= reach:
                reach = b
                edge[a + 1] += 1
                edge[b] -= 1
        return np.cumsum(edge[:-1]) > 0

    @staticmethod
    def _single(pool, start, size, begin, first, offsets):
        """Rules without the blanks that follow a blank; which texts say anything but blanks, and the place where they begin."""
        head, some = np.zeros(len(size), np.int64), np.flatnonzero(size > 0)
        while len(some := some[pool[start[some] + head[some]] == BLANK]):
            head[some] += 1
            some = some[head[some] < size[some]]
        filled = size > 0
        ends = np.zeros(len(size), bool)
        ends[filled] = pool[(start + size - 1)[filled]] == BLANK
        last = np.maximum.accumulate(np.where(filled, np.arange(len(size)), -1)) if len(size) else np.zeros(0, np.int64)
        last = np.concatenate(([-1], last[:-1])) if len(last) else last
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        follows = (last < first[own]) | ends[last]
        plain = (size == 1) & (head == 1)
        solid = np.flatnonzero(~plain)
        lead = np.searchsorted(solid, first[:-1])
        said = np.zeros(len(first) - 1, bool)
        inside = lead < len(solid)
        said[inside] = solid[lead[inside]] < first[1:][inside]
        at = offsets[:-1].copy()
        at[said] = begin[solid[lead[said]]]
        cut = np.where(follows, head, 0)
        size = np.where(said[own], size - cut, 0)
        return start + cut, size, said, at

    def _trimmed(self, data, offsets, source, stop) -> Normalized:
        """Without the blanks at each text's end."""
        begin = leads(data)
        mark = int.from_bytes(self.blank.tobytes(), "big")
        code = code_points(data) if len(data) else np.zeros(0, np.uint32)
        solid = begin[code != (ord(MARK) if mark > 255 else BLANK)]
        size = np.diff(np.append(begin, len(data)))[np.searchsorted(begin, solid)]
        last = np.searchsorted(solid, offsets[1:]) - 1
        any_left = (last >= 0) & (solid[last] >= offsets[:-1]) if len(solid) else np.zeros(len(last), bool)
        end = offsets[:-1].copy()
        end[any_left] = (solid + size)[last[any_left]]
        short = end < offsets[1:]
        stop[short] = source[end[short]]
        keep = np.ones(len(data) + 1, np.int64)
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, end, 1)
        np.add.at(edge, offsets[1:], -1)
        keep = np.cumsum(edge)[:-1] == 0
        return Normalized(data[keep], np.concatenate(([0], np.cumsum(end - offsets[:-1]))), source[keep], stop)


class Pieces(Vocabulary):
    """The pieces of a model: merges by score, best first, leftmost of equals, over characters; unknown ones become bytes."""

    def __init__(self, pieces: Sequence[tuple[str, float, int]], normalizer: Normalizer, unknown: str = " ⁇ ", limit: int = 250_000):
        self.normalizer, self.limit = normalizer, limit
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        scores = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        self.rank = np.array([scores[s] if kind == NORMAL else -1 for _, s, kind in pieces], np.int64)
        self.kind = np.array([kind for _, _, kind in pieces])
        self.byte_id = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("models without byte fallback are not supported")
        self.lengths = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in pieces], np.int64)
        surface = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda _: unknown.encode(), CONTROL: lambda _: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.surface = [surface[kind](p) for p, _, kind in pieces]
        self.controls = frozenset(i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL)
        self.marked = [kind == NORMAL and p.startswith(MARK) for p, _, kind in pieces]
        self.decimal = [str(i) for i in range(len(pieces))]
        self._characters()
        self._empty()

    def _characters(self) -> None:
        """A number for each character of any piece: its piece, or one beyond them; which stand side by side; joins."""
        inside = sorted({c for p in self.id_of for c in p})
        beyond = len(self.kind)
        token = {c: self.id_of.get(c, beyond + 1 + i) for i, c in enumerate(inside)}
        self.token_of = np.full(0x110000, beyond, np.int64)  # beyond: in no piece
        self.place_of = np.zeros(0x110000, np.int32)
        for i, c in enumerate(inside):
            self.token_of[ord(c)], self.place_of[ord(c)] = token[c], i + 1
        place = {c: i + 1 for i, c in enumerate(inside)}
        width = (len(inside) + 8) // 8
        self.beside = np.zeros((len(inside) + 1, width), np.uint8)
        joins: dict[int, int] = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = place[p[k - 1]], place[p[k]]
                self.beside[a, b >> 3] |= 1 << (b & 7)
                x = token[p[0]] if k == 1 else self.id_of.get(p[:k])
                y = token[p[k]] if k == len(p) - 1 else self.id_of.get(p[k:])
                if x is not None and y is not None:
                    joins[(x << 32 | y) + 1] = i
        self.pairs = Table(max(4, (2 * len(joins)).bit_length()))
        self.pairs.put(np.array(list(joins), np.uint64), np.array(list(joins.values()), np.int64))

    def slices(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes at which slices begin: where a text does, and between characters that no piece has side by side."""
        begin = leads(data)
        if not len(begin):
            return begin
        place = self.place_of[code_points(data)]
        a, b = place[:-1], place[1:]
        cut = np.ones(len(begin), bool)
        cut[1:] = (self.beside[a, b >> 3] >> (b & 7) & 1) == 0
        cut[np.searchsorted(begin, offsets[:-1][offsets[:-1] < len(data)])] = True
        return begin[cut]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each slice, one after another, and how many each has."""
        size = ends - starts
        raw = data[np.repeat(starts, size) + within(size)]
        begin, code = leads(raw), code_points(raw)
        width = np.diff(np.append(begin, len(raw)))
        owner = np.searchsorted(np.cumsum(size), begin, "right")
        n = np.bincount(owner, minlength=len(starts))
        token, place = self.token_of[code], begin
        long = np.flatnonzero(n > IN_STEP)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(long):
            apart = np.isin(owner, long)
            lo = np.searchsorted(owner, long)
            for i, a in zip(long.tolist(), lo.tolist()):
                t, p = self._merge_long(raw[begin[a] : begin[a] + size[i]].tobytes().decode(), begin[a : a + n[i]])
                done.append((t, np.full(len(t), i), p))
            token, owner, place = token[~apart], owner[~apart], place[~apart]
        done += self._in_step(token, owner, place)
        token, owner, place = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(owner, kind="stable")
        token, owner, place = token[order], owner[order], place[order]
        # what is in no piece, or only within some, becomes its bytes
        odd = token >= len(self.kind)
        count = np.ones(len(token), np.int64)
        count[odd] = width[np.searchsorted(begin, place[odd])]
        ids = np.repeat(token, count)
        fallen = np.repeat(odd, count)
        ids[fallen] = self.byte_id[raw[(np.repeat(place, count) + within(count))[fallen]]]
        return ids.astype(np.uint32), np.bincount(owner, count, len(starts)).astype(np.int64)

    def _in_step(self, token: np.ndarray, owner: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In all slices at once, join the neighbours of the best piece, leftmost first, until none is one."""
        out = []
        joined, rank = self._join(token[:-1], token[1:], owner[:-1] == owner[1:])
        joined, rank = np.append(joined, -1)[: len(token)], np.append(rank, NONE)[: len(token)]
        while len(token):
            begin = np.flatnonzero(first_rows(owner))
            each = np.diff(np.append(begin, len(token)))
            least = np.minimum.reduceat(rank, begin)
            busy = np.repeat(least < NONE, each)
            if not busy.all():
                out.append((token[~busy], owner[~busy], place[~busy]))
                token, owner, place, joined, rank = token[busy], owner[busy], place[busy], joined[busy], rank[busy]
                if not len(token):
                    break
                begin = np.flatnonzero(first_rows(owner))
                each, least = np.diff(np.append(begin, len(token))), least[least < NONE]
            at = np.flatnonzero(rank == np.repeat(least, each))
            at = at[first_rows(owner[at])]
            token[at] = joined[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            token, owner, place, joined, rank = token[keep], owner[keep], place[keep], joined[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                rank[i] = NONE
                i = i[i + 1 < len(token)]
                joined[i], rank[i] = self._join(token[i], token[i + 1], owner[i] == owner[i + 1])
        return out

    def _join(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two neighbours make (-1: none), and its rank."""
        joined = np.full(len(left), -1, np.int64)
        i = np.flatnonzero(together)
        joined[i] = self.pairs.get((left[i].astype(np.uint64) << np.uint64(32) | right[i].astype(np.uint64)) + np.uint64(1))
        return joined, np.where(joined >= 0, self.rank[joined], NONE)

    def _merge_long(self, text: str, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of one slice with a heap and links: tokens, and the byte each begins at."""
        n, id_of, rank = len(text), self.id_of, self.rank
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int, e: int) -> tuple[int, int, int] | None:
            return None if (p := id_of.get(text[i:e])) is None else (int(rank[p]), i, e)

        heap = [x for i in range(n - 1) if (x := pair(i, i + 2)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != e:
                continue
            gone[j], end[i] = 1, e
            if e < n:
                back[e] = i
                if (x := pair(i, end[e])) is not None:
                    heapq.heappush(heap, x)
            if (b := back[i]) >= 0 and (x := pair(b, e)) is not None:
                heapq.heappush(heap, x)
        first = [i for i in range(n) if not gone[i]]
        single = self.token_of
        return np.array([id_of[text[i : end[i]]] if end[i] - i > 1 else single[ord(text[i])] for i in first], np.int64), begin[first]

    def encode(self, chunk: TextChunk) -> tuple[np.ndarray, np.ndarray, Normalized]:
        """All ids of a chunk's texts, len(chunk) + 1 bounds among them, and the normalised texts."""
        text = self.normalizer.run(chunk.data, chunk.offsets)
        starts = self.slices(text.data, text.offsets)
        ids, count = self.encode_slices(text.data, starts, np.append(starts[1:], len(text.data))[: len(starts)])
        return ids, np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, text.offsets)], text

    def spans(self, ids: np.ndarray, bounds: np.ndarray, text: Normalized) -> tuple[np.ndarray, np.ndarray]:
        """The original bytes [begin, end) of each piece. Of a character's bytes the last has its span, the others are empty."""
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        begin = text.source[begins]
        after = np.append(text.source, 0)[ends]
        last = bounds[1:] - 1
        some = bounds[1:] > bounds[:-1]
        after[last[some]] = text.stop[some]
        inner = np.flatnonzero(self.kind[ids] == BYTE)
        more = inner[(np.append(text.data, np.uint8(0))[ends[inner]] & 0xC0) == 0x80]
        after[more] = begin[more]
        return begin, after

    def decode(self, ids: Sequence[int]) -> bytes:
        """The text of any ids: blanks for marks, without the one put before a text; bytes that are no character as U+FFFD."""
        parts = [self.surface[i] for i in ids]
        if self.normalizer.prefix or self.normalizer.single_blanks:
            for n, i in enumerate(ids):
                if self.kind[i] == CONTROL:
                    continue
                if self.marked[i]:
                    parts[n] = parts[n][1:]
                    if not parts[n] and self.normalizer.single_blanks:
                        continue
                break
        out = b"".join(parts)
        try:
            if self.controls.isdisjoint(ids):  # a control piece parts the bytes around it
                out.decode("utf-8")
                return out
        except UnicodeDecodeError:
            pass
        return b"".join(self._repaired(ids, parts))

    def _repaired(self, ids: Sequence[int], parts: list[bytes]) -> Iterator[bytes]:
        run = b""
        for i, part in zip(ids, parts):
            if self.kind[i] == BYTE:
                run += part
                continue
            yield from (*_valid(run), part)
            run = b""
        yield from _valid(run)


def _valid(run: bytes) -> Iterator[bytes]:
    """Characters, and U+FFFD for each byte that begins none."""
    at = 0
    while at < len(run):
        size = next((n for n in (1, 2, 3, 4) if _is_character(run[at : at + n], n)), 0)
        yield run[at : at + size] if size else b"\xef\xbf\xbd"
        at += size or 1


def _is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def from_model(raw: bytes) -> Pieces:
    """The pieces of a serialised model. Only BPE models with byte fallback, without user-defined or unused pieces."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models, without user-defined or unused pieces and with blanks before words, are supported")
    spec = model.normalizer_spec
    normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    return Pieces([(p.piece, p.score, p.type) for p in model.pieces], normalizer, model.trainer_spec.unk_surface)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return from_model(f.read())


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends (binary, little-endian unsigned 32-bit): the pieces of each text and their original bytes.

    Null and empty texts have no pieces; repeated rows give repeated rows; other columns are dropped; an empty table gives
    none. Very long texts are encoded whole, in a step of their own. No row is moved: one pass over the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids, bounds, text = model.encode(chunk)
                begin, end = model.spans(ids, bounds, text)
                base = np.repeat(chunk.offsets[:-1], np.diff(bounds))
                columns = [x.astype("<u4").tobytes() for x in (ids, begin - base, end - base)]
                at = (4 * bounds).tolist()
                cut = [pa.array([x[a:b] for a, b in zip(at, at[1:])], pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), *cut], ["doc_id", "ids", "begins", "ends"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, ids binary, begins binary, ends binary")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with commas between), decoded_sha256: encoding, then decoding.

    Null and empty texts give no tokens and the digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids, bounds, _ = model.encode(chunk)
                ids, at = ids.tolist(), bounds.tolist()
                each = [ids[a:b] for a, b in zip(at, at[1:])]
                digests = ([hashlib.sha256(x).hexdigest() for x in xs] for xs in ([",".join(map(model.decimal.__getitem__, x)).encode() for x in each], [model.decode(x) for x in each]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(np.diff(bounds), pa.int64()), *(pa.array(x, pa.string()) for x in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
