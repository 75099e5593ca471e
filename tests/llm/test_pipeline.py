"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from statewalk.llm import simhash
from statewalk.llm.queries import oracle_sql, queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before and len(now) > 0.5 * len(before), name
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == before
    assert all(r["offset"] + r["length"] <= 2048 for r in pieces)


def test_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(oracle_sql()) <= set(names)


def test_license_oracle(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(map(tuple, c.sql(oracle_sql()["op9_license_digest"]).fetchall()), key=str)
    assert sorted(map(tuple, queries()["op9_license_digest"](spark, sf_dir).collect()), key=str) == want


def shingle_set(text: str) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(texts: list[str], similarity: float = 0.8) -> list[int]:
    """The first text of each component of the exact graph of similar pairs."""
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and (sets[i] == sets[j] or both >= similarity * len(sets[i] | sets[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted(set(group))


def kept(spark, texts: list[str]) -> list[int]:
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r["doc_id"] for r in simhash.one_of_each(docs.repartition(3)).collect())


def edited(words: list[str], n: int, tag: str) -> str:
    """words with n of them replaced, far from each other: each costs five shingles."""
    out = list(words)
    for k in range(n):
        out[7 * k + 5] = f"{tag}{k}"
    return " ".join(out)


def test_near_duplicates_close_to_the_threshold(spark):
    """Long texts just below the similarity are decided by their whole shingle sets."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 1000)]
        texts += [" ".join(words), edited(words, 23 + i % 2, f"x{i}_")]
    assert kept(spark, texts) == brute_kept(texts) == list(range(80))


def test_near_duplicates_in_a_family(spark, monkeypatch):
    """Near copies among many texts of one template, most pairs of which are alike but less than the similarity."""
    rng = np.random.default_rng(5)
    template = [f"t{x}" for x in range(400)]
    texts = []
    for i in range(120):
        texts.append(edited(template, 9, f"a{i}_"))
        if i % 3 == 0:
            words = texts[-1].split()
            words[int(rng.integers(350, 390))] = f"b{i}"
            texts.append(" ".join(words))
    want = brute_kept(texts)
    assert len(want) == 120 and kept(spark, texts) == want
    monkeypatch.setattr(simhash, "SET_BLOCK", 32)
    assert kept(spark, texts) == want


def test_near_duplicates_misses_no_pair(spark):
    """All pairs at a similarity of 0.8 and little more are found, a repeated line on one side being of no weight."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(60):
        n = (120, 300, 1000)[i % 3]
        words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        texts += [" ".join(words), edited(words, (2, 6, 22)[i % 3], f"x{i}_")]
        if i % 4 == 0:
            texts[-1] += "\n" + "\n".join(["one line of ten words which is there many times"] * 60)
    want = brute_kept(texts)
    assert len(want) < len(texts) and kept(spark, texts) == want


def test_stages_on_awkward_tables(spark, sf_dir):
    """Each stage on nulls, empty and repeated rows and clashing columns, and on a table without rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (-7, None, None, "s", None), (-7, "a b c d e f", "en", "s", 11), (-7, "a b c d e f", "en", "s", 11), (-8, "x" * 200_000, "en", "s", 200_000)], docs.schema)
    rows = docs.union(odd).withColumn("row_key", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("bucket", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        assert out.count() > 0 and (name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS), name
        assert stage(spark, rows.where("false"), sf_dir).count() == 0, name
    kept = simhash.one_of_each(rows.select(*corpus_pipeline.COLUMNS))
    same = kept.where("doc_id = -7 and text is not null").count()
    assert same == 2  # equal rows are one document: both stay or both go


def test_quality_and_toxicity_stages_keep_what_they_judge_so(spark, sf_dir):
    """A stage's rows are those that its operator's own scores keep."""
    from statewalk.llm import quality, toxicity

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, labels).where("accepted").count()
    assert corpus_pipeline.quality_stage(spark, docs, sf_dir).count() == judged
    model = toxicity.fit(docs, labels, keep=toxicity.training_fold())
    assert corpus_pipeline.toxicity_stage(spark, docs, sf_dir).count() == toxicity.score(docs, model).where("score < 0.5").count()


def test_near_duplicates_on_the_table(spark, sf_dir):
    """The whole table against exact all pairs."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for _, t in rows]
    want = [rows[i][0] for i in brute_kept(low)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs.select(*corpus_pipeline.COLUMNS)).collect()) == want


def test_near_duplicates_of_texts_that_share_by_chance(spark, monkeypatch):
    """Texts that each share passages with a few others, in one long chain, are no candidates; near copies among them are found."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "LAST_SHINGLES", 0)  # as on a large table, of which the sample knows little
    rng = np.random.default_rng(7)
    passages = [" ".join(f"p{i}x{x}" for x in rng.integers(0, 10**9, 64)) for i in range(480)]
    texts = []
    for i in range(150):
        own = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 256))]
        texts.append(" ".join([*own, *[passages[(3 * i + k) % 450] for k in (0, 1, 2)], *[passages[(3 * (i + d) + d - 1) % 450] for d in (1, 2, 3)]]))
    texts += [edited(texts[i].split(), 6, f"x{i}_") for i in range(0, 150, 10)]
    assert kept(spark, texts) == brute_kept(texts) == list(range(150))
    sizes = []
    verified = simhash.verified

    def spied(docs, parts, *how):
        sizes.extend(r["count"] for r in parts.groupBy("component").agg(F.count("*").alias("count")).collect())
        return verified(docs, parts, *how)

    monkeypatch.setattr(simhash, "verified", spied)
    kept(spark, texts)
    assert sizes == [2] * 15


def test_candidates_of_one_shingle():
    """Of the sets that share a shingle, those within the radius are joined, in groups small and large, and no others."""
    from statewalk.llm.blocks import Forest

    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    prints = np.repeat(seeds, 10, axis=0)
    for row in prints:  # some 40 bits of 256 changed: a class is within the radius, mostly
        for bit in rng.choice(256, 40, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    prints[:30] = seeds[0]
    for i in range(30):  # a chain: neighbours differ in 80 bits, others in more
        for bit in range(80 * (i % 3)):
            prints[i][bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = simhash.differing(prints[:, None], prints[None]) <= simhash.SET_RADIUS
    groups = [rng.choice(len(prints), size, replace=False) for size in (120, 70, 33, 32, 20, 2, 5)]
    for some in ([g] for g in groups), [groups[1:]], [groups[3:]]:
        for chosen in some:
            key = np.repeat(np.arange(len(chosen), dtype=np.uint64), [len(g) for g in chosen])
            forest, want = Forest(len(prints)), Forest(len(prints))
            simhash.join_near(forest, key, np.concatenate(chosen), prints)
            for g in chosen:
                a, b = np.nonzero(near[np.ix_(g, g)])
                want.join(g[a], g[b])
            every = np.arange(len(prints))
            assert np.array_equal(forest.roots(every), want.roots(every))
