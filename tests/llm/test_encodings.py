"""SentencePiece, fill-in-the-middle and vector codes against the library, a plain version and enumeration."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statewalk.llm import codes, infilling, pieces
from statewalk.llm.common import text_chunks
from tests.llm.test_operators import SCHEMA, corpus

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
MODEL = "piece_bpe_32k.model"
ODD = ["a", "b", "the", " ", "  ", "▁", "▁▁", "\n", "é", "é", "ﬁ", "Ａ", "日本", "🎉", "​", "　", "\xa0", "①", "㌀", "ｶﾞ", "<s>", "<0x0A>", "\xad", "Ⅷ", "...", "…", "0", "\t", "\0", "�", "ß", "İ", "ﷺ", "한", "aaaa"]


def model_bytes(rule: str = "", prefix: bool = True, single_blanks: bool = False) -> bytes:
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(P.path(MODEL), "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    if rule:
        model.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec.precompiled_charsmap
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = prefix, single_blanks
    return model.SerializeToString()


def odd_texts(n: int) -> list[str]:
    rng = random.Random(7)
    texts = ["".join(rng.choice(ODD) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.choice([1, 2, 3, 8, 30, 200]))) for _ in range(n)]
    return ["", " ", "  ", " a ", "▁", "▁ ", "​", "a​ ", "a" * 3000, " " * 500, "▁" * 300 + "x", "ab " * 2000, "thethe" * 500, *texts]


@pytest.mark.parametrize(("rule", "prefix", "single"), [("", True, False), ("", True, True), ("nmt_nfkc", True, True), ("nmt_nfkc", False, False), ("nfkc_cf", True, False), ("nfkc_cf", False, True)])
def test_op11_as_the_library(rule, prefix, single):
    """Ids, spans and decoding, also through character maps, which the model at hand doesn't have."""
    from sentencepiece import sentencepiece_pb2 as pb

    raw, texts = model_bytes(rule, prefix, single), odd_texts(500)
    library, model = spm.SentencePieceProcessor(model_proto=raw), pieces.from_model(raw)
    for chunk in text_chunks(pa.array(texts), 1 << 14):
        ids, bounds, text = model.encode(chunk)
        begin, end = model.spans(ids, bounds, text)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want = pb.SentencePieceText.FromString(library.encode(texts[chunk.lo + i], out_type="serialized_proto")).pieces
            at = chunk.offsets[i]
            assert list(zip(ids[a:b].tolist(), (begin[a:b] - at).tolist(), (end[a:b] - at).tolist())) == [(p.id, p.begin, p.end) for p in want]
            assert model.decode(ids[a:b].tolist()).decode() == library.decode(ids[a:b].tolist())


def test_op11_decodes_any_ids():
    library, model, rng = spm.SentencePieceProcessor(model_file=P.path(MODEL)), pieces.pieces(P.path(MODEL)), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(131, 259), rng.randrange(259, 275), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert model.decode(ids).decode() == library.decode(ids)


def test_op11(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    library = spm.SentencePieceProcessor(model_file=P.path(MODEL))

    def want(x):
        ids = library.encode(x or "")
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    got = [(r["doc_id"], (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in pieces.round_trip(docs, P.path(MODEL)).collect()]
    assert sorted(got, key=str) == sorted(((r[0], want(r[1])) for r in corpus()), key=str)
    spans = pieces.encode(docs, P.path(MODEL)).where("doc_id = 8").first()
    text = dict((r[0], r[1]) for r in corpus())[8].encode()
    ids, begin, end = (np.frombuffer(spans[c], "<u4") for c in ("ids", "begins", "ends"))
    assert begin[0] == 0 and end[-1] == len(text) and (begin[1:] == end[:-1]).all()
    assert [text[a:b].decode().replace(" ", "▁") for a, b in zip(begin[1:4], end[1:4])] == [library.id_to_piece(int(i)) for i in ids[1:4]]
    assert pieces.round_trip(spark.createDataFrame([], SCHEMA), P.path(MODEL)).count() == 0


def test_op11_refuses_other_models():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(model_bytes())
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="only BPE"):
        pieces.from_model(model.SerializeToString())


def plain_fim(doc_id, text):
    """The contract, read literally."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    return (len(units), form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), out)


FIM = [(i, t) for i, t in enumerate(["", None, "<P>", "a<S>b", "<", "<<P", "é", "日本語 abc 🎉🎉x", "ab" * 4000, "é" * 3000 + "abc", "A1b2", "\0\n a", "<P", "S>x", *odd_texts(150)])] + [(None, "no id at all"), (7, "日本語 abc 🎉🎉x")]


def test_op12(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in FIM], "doc_id long, text string, form string, n long").repartition(3)
    key = lambda r: str(r)
    want = [(i, *plain_fim(i, t)) for i, t in FIM]
    assert sorted(map(tuple, infilling.fill_in_middle(docs).collect()), key=key) == sorted(want, key=key)
    digests = [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, (_, t) in zip(want, FIM)]
    assert sorted(map(tuple, infilling.round_trip(docs).collect()), key=key) == sorted(digests, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infilling.round_trip(docs.limit(0)).count() == 0


def test_op12_index_converts_both_ways():
    raw = "aé日🎉b" * 50 + "ascii only" * 20 + "é"
    data = np.frombuffer(raw.encode(), np.uint8)
    index = infilling.Exceptions(data)
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    assert index.characters(begins).tolist() == list(range(len(raw) + 1))
    assert index.bytes(np.arange(len(raw) + 1)).tolist() == begins.tolist()
    assert len(index.first) == 151  # only the exceptions are recorded
    assert not len(infilling.Exceptions(np.frombuffer(b"ascii", np.uint8)).first)


def test_op12_damaged_output():
    with pytest.raises(ValueError):
        infilling.restored(b"<P>a<S>b", "psm")


def plain_codes(rows):
    """The contract over (vec_id, vector, label), read literally with numbers of any size."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, [floor(4096 * Fraction(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(6):
        new = []
        for p in range(8):
            of = [near(part(v, p), p)[1] for _, v, _ in kept]
            new.append([[sum(c) // len(c) for c in zip(*own)] if (own := [part(v, p) for (_, v, _), e in zip(kept, of) if e == j]) else old for j, old in enumerate(books[p])])
        books = new
    found = [(i, [near(part(v, p), p) for p in range(8)], label) for i, v, label in kept]
    error = [sum(d for d, _ in x) for _, x, _ in found]
    by = {}
    for (_, _, label), e in zip(found, error):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return [(i, "".join(f"{j:02x}" for _, j in x), min(e, most), min(by[label], most), digest) for (i, x, label), e in zip(found, error)]


def vectors(n: int, dims: int = 16, seed: int = 0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(int(i), (centres[i % 6] + rng.normal(size=dims) * 0.2).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]


CODED = {
    "usual": vectors(120),
    "odd": [*vectors(60), (500, None, 1), (501, [1.0] * 15 + [None], 1), (502, [float("nan")] * 16, 2), (503, [float("inf")] * 16, 2), (3, vectors(4)[3][1], 0), (None, vectors(9)[8][1], 2), (None, vectors(5)[4][1], None), (7, [0.5] * 16, 9)],
    "few": vectors(5),
    "none left": [(1, None, 1), (2, [float("nan")], None)],
    "large numbers": [*vectors(30), (600, [3e38, -3e38, *[1e20] * 14], 1), (601, [1e300] * 16, 4), (602, [-1.7e308, 1e-300, *[1e12] * 14], 1)],
    "other lengths": [*vectors(20, 10), (700, [], 1), (701, [1.0], 1), (702, [2.0] * 13, 2)],
    "alike": [(i, [1.0] * 8, 0) for i in range(40)],
}


@pytest.mark.parametrize("name", CODED)
def test_op13(spark, name):
    rows = [(i, v, label, "clash", 5) for i, v, label in CODED[name]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    got = [tuple(r) for r in codes.compressed(table).collect()]
    assert sorted(got, key=str) == sorted(plain_codes(CODED[name]), key=str)


def test_op13_empty(spark):
    assert codes.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize(("module", "table", "run"), [(infilling, "documents", infilling.round_trip), (codes, "embeddings", codes.compressed)])
def test_as_sql(spark, sf_dir, module, table, run):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    got, want = run(spark.read.parquet(f"{sf_dir}/{table}.parquet")).toPandas(), c.sql(module.oracle()).df()
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values([c for c in columns if c.endswith("_id")]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
