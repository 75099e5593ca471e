"""Fill-in-the-middle transformation: a document is cut into prefix, middle and suffix, which are written in another order.

Cuts are drawn in units (a run of ASCII letters, or any other single code point) and needed as bytes, to slice the text, and as
code points, to report it. Both come from a sparse exception index: only characters of several bytes are recorded, with their
places and the excess bytes up to them. A binary search among them converts a cut, and what lies between them is arithmetic;
a text of ASCII has an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statewalk.llm.common import TextChunk, released, text_chunks, texts_of

PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = (PLAIN, PSM, SPM)


@dataclass(frozen=True)
class Recipe:
    """Markers of prefix, suffix and middle, percents of documents that are cut and of those that put the suffix first, seed."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"
    cut: int = 90
    suffix_first: int = 20
    seed: int = 1


class Exceptions:
    """The characters of several bytes in a run of UTF-8 bytes.

    first: the byte each begins at. excess: the bytes beyond one of the characters before each, and of all at the end.
    """

    __slots__ = ("excess", "first")

    def __init__(self, data: np.ndarray):
        self.first = np.flatnonzero(data >= 0xC0)
        lead = data[self.first]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(more)))

    def characters(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte position, which begins a character or is the end."""
        return at - self.excess[np.searchsorted(self.first, at)] if len(self.first) else at

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """The byte at which each code point, by its number, begins."""
        if not len(self.first):
            return at
        return at + self.excess[np.searchsorted(self.first - self.excess[:-1], at)]


def unit_starts(data: np.ndarray, offsets: np.ndarray, index: Exceptions) -> np.ndarray:
    """The code point numbers at which units begin: runs of ASCII letters within a text, and every other code point."""
    folded = data | 0x20
    letter = (folded >= 97) & (folded <= 122)
    begin = (data & 0xC0) != 0x80
    begin[1:] &= ~(letter[1:] & letter[:-1])
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = True
    return index.characters(np.flatnonzero(begin))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the digest of seed and id; a missing id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def written(pieces: tuple[bytes, bytes, bytes], form: str, how: Recipe) -> bytes:
    """prefix, middle and suffix in the order of a form."""
    prefix, middle, suffix = pieces
    if form == PLAIN:
        return prefix + middle + suffix
    if form == PSM:
        return how.prefix + prefix + how.suffix + suffix + how.middle + middle
    return how.suffix + suffix + how.prefix + prefix + how.middle + middle


def restored(output: bytes, form: str, how: Recipe = Recipe()) -> bytes:
    """The text from its written form. A text that holds a marker is plain, so each marker occurs once."""
    if form == PLAIN:
        return output
    one, two = (how.prefix, how.suffix) if form == PSM else (how.suffix, how.prefix)
    if not output.startswith(one):
        raise ValueError(f"not of the form {form}")
    second = output.index(two, len(one))
    third = output.index(how.middle, second + len(two))
    first, other, middle = output[len(one) : second], output[second + len(two) : third], output[third + len(how.middle) :]
    return first + middle + other if form == PSM else other + middle + first


@dataclass
class Cuts:
    """Of each text of a chunk: units, form (index into FORMS), bytes and code points of both cuts, counted from its start."""

    units: np.ndarray
    form: np.ndarray
    bytes: np.ndarray  # texts, 2
    characters: np.ndarray  # texts, 2


def cuts_of(chunk: TextChunk, ids: list[int | None], how: Recipe) -> Cuts:
    data, offsets, raw = chunk.data, chunk.offsets, chunk.data.tobytes()
    index = Exceptions(data)
    begins = index.characters(offsets)
    starts = unit_starts(data, offsets, index)
    first = np.searchsorted(starts, begins)
    units = np.diff(first)
    h = np.array([draws(x, how.seed) for x in ids], np.int64).reshape(-1, 4)
    both = np.sort(h[:, :2] % (units + 1)[:, None], axis=1)
    # a cut after u units is where unit u begins: unit number n of a text is the next text's first, or the end
    places = np.append(starts, begins[-1])
    chars = np.where(both < units[:, None], places[np.minimum(first[:-1, None] + both, len(starts))], begins[1:, None])
    marked = [any(m in raw[a:b] for m in (how.prefix, how.suffix, how.middle)) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    plain = (units == 0) | (h[:, 2] % 100 >= how.cut) | np.array(marked, bool)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < how.suffix_first, 2, 1))
    return Cuts(units, form, index.bytes(chars) - offsets[:-1, None], chars - begins[:-1, None])


def _outputs(chunk: TextChunk, cuts: Cuts, how: Recipe) -> list[bytes]:
    raw, out = chunk.data.tobytes(), []
    for a, b, form, (x, y) in zip(chunk.offsets.tolist(), chunk.offsets[1:].tolist(), cuts.form.tolist(), cuts.bytes.tolist()):
        out.append(written((raw[a : a + x], raw[a + x : a + y], raw[a + y : b]), FORMS[form], how))
    return out


def _lengths(cuts: Cuts) -> tuple[pa.Array, pa.Array]:
    """Code points of prefix and middle, null for plain texts."""
    plain = cuts.form == 0
    return pa.array(cuts.characters[:, 0], pa.int64(), mask=plain), pa.array(cuts.characters[:, 1] - cuts.characters[:, 0], pa.int64(), mask=plain)


def fill_in_middle(docs: DataFrame, how: Recipe = Recipe()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null for plain texts), output (the written text).

    Null and empty texts are plain and empty, as are texts that hold a marker plain and whole. What is drawn depends on seed
    and doc_id alone, so repeated rows give repeated rows and a missing id draws as an id without digits. Texts of any length
    are cut whole, those over a chunk in a step of their own; an empty table gives none; other columns are dropped. No row is
    moved: one pass over the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.lo, len(chunk))
                cuts = cuts_of(chunk, ids.to_pylist(), how)
                texts = pa.array(_outputs(chunk, cuts, how), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(cuts.units), pa.array([FORMS[x] for x in cuts.form]), *_lengths(cuts), texts], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts_of(docs).mapInArrow(released(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def round_trip(docs: DataFrame, how: Recipe = Recipe()) -> DataFrame:
    """fill_in_middle with digests in place of the text: output_sha256, and restored_sha256 of the text rebuilt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.lo, len(chunk))
                cuts = cuts_of(chunk, ids.to_pylist(), how)
                forms, output = [FORMS[x] for x in cuts.form], _outputs(chunk, cuts, how)
                digests = [hashlib.sha256(x).hexdigest() for x in output], [hashlib.sha256(restored(x, form, how)).hexdigest() for x, form in zip(output, forms)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cuts.units), pa.array(forms, pa.string()), *_lengths(cuts), *(pa.array(x, pa.string()) for x in digests)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
                )

    return texts_of(docs).mapInArrow(released(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def oracle() -> str:
    """The same of table documents in DuckDB SQL, for the default recipe."""
    draw = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS w, {draw} FROM d),
c AS (SELECT doc_id, x, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
 CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, x, n, form, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(pre || mid || suf) AS restored_sha256 FROM p"""
