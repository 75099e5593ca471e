"""Keyed permutations and numbering in ranges: bijections, evenness, plans without a task that holds all rows."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.operators import design, numbering, permutations, sequences, statistics


def plain(place: int, n: int, perm: int, seed: str = "42") -> int:
    """The bijection with numbers of any size."""
    if perm == 0:
        return place
    p = permutations.PRIME

    def mixed(w, c):
        return (w * w % p) * (w + c) % p

    a = 1
    while a * a < n:
        a += 1
    b = -(-n // a)
    keys = [(mixed((perm * x + y) % p, c), c) for x, y, c in permutations.constants(seed)]
    while True:
        left, right = divmod(place, b)
        for h, (k, c) in enumerate(keys):
            if h % 2 == 0:
                left = (left + mixed((right + k) % p, c)) % a
            else:
                right = (right + mixed((left + k) % p, c)) % b
        place = left * b + right
        if place < n:
            return place


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 101, 1000])
def test_dealt_places(spark, n):
    rows = spark.range(n).selectExpr("id as place", f"{n} as n").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(20))))
    got = collections.defaultdict(dict)
    for r in permutations.dealt_places(rows, "place", "n", "perm").collect():
        got[r["perm"]][r["place"]] = r["dealt"]
    assert all(sorted(x.values()) == list(range(n)) for x in got.values())
    assert got == {i: {j: plain(j, n, i) for j in range(n)} for i in range(21)}


def test_numbers_over_the_end_walk_on(spark):
    """Of 2 * 2 numbers the fourth isn't a place of three, and of 11 * 10 nine aren't of 101: they take more than one pass."""
    for n in (3, 101):
        assert any(plain(j, n, i) != plain_once(j, n, i) for i in range(1, 40) for j in range(n))


def plain_once(place, n, perm):
    try:
        return next(x for x in [plain_pass(place, n, perm)] if x < n)
    except StopIteration:
        return -1


def plain_pass(place, n, perm):
    p = permutations.PRIME
    a = next(x for x in range(1, n + 1) if x * x >= n)
    b = -(-n // a)
    left, right = divmod(place, b)
    for h, (x, y, c) in enumerate(permutations.constants("42")):
        v = (perm * x + y) % p
        k = (v * v % p) * (v + c) % p
        w = ((right if h % 2 == 0 else left) + k) % p
        add = (w * w % p) * (w + c) % p
        left, right = ((left + add) % a, right) if h % 2 == 0 else (left, (right + add) % b)
    return left * b + right


def test_permutations_are_even():
    """Each place gets each row about as often, and each of the 24 orders of four comes up."""
    n, times = 12, 6000
    seen = collections.Counter((j, plain(j, n, i)) for i in range(1, times + 1) for j in range(n))
    expected = times / n
    assert sum((seen[j, k] - expected) ** 2 / expected for j in range(n) for k in range(n)) < 200  # 121 degrees of freedom
    orders = collections.Counter(tuple(plain(j, 4, i) for j in range(4)) for i in range(1, 4801))
    assert len(orders) == 24 and max(orders.values()) < 2 * min(orders.values())


def test_labels_are_dealt(spark):
    rows = [(f, i, random.Random(f * 100 + i).choice(["a", "b", None, "c"]), float(i)) for f in (0, 1) for i in range(30 + f)]
    df = spark.createDataFrame(rows, "fam int, sid int, grp string, r double")
    got = statistics.permuted(df, 4, ("fam",)).collect()
    of = collections.defaultdict(dict)
    for r in got:
        of[r["fam"], r["perm"]][r["sid"]] = r["grp"]
    for f in (0, 1):
        own = sorted(((g is not None, g or "", i) for ff, i, g, _ in rows if ff == f))
        place = {i: j for j, (_, _, i) in enumerate(own)}
        label = [g if known else None for known, g, _ in own]
        for perm in range(5):
            assert of[f, perm] == {i: label[plain(place[i], len(own), perm)] for i in place}


def test_many_levels(spark):
    df = spark.createDataFrame([(i, f"level{i % 40:02d}", 1.0) for i in range(200)], "sid int, grp string, r double")
    got = statistics.permuted(df, 2)
    assert {r["n"] for r in got.groupBy("perm", "grp").agg(F.count("*").alias("n")).collect()} == {5}


@pytest.mark.parametrize("by", [[], ["fam"]])
def test_places(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame(rows, "fam string, v int").repartition(7)
    got = numbering.places(df, ["v"], by).collect()
    for fam in {r["fam"] for r in got} if by else [None]:
        mine = sorted((r["place"], r["v"]) for r in got if not by or r["fam"] == fam)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_running_sum_and_empty(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "sid int, n long").repartition(5)
    got = {r["sid"]: r["end"] for r in numbering.running_sum(df, ["sid"], "n", "end").collect()}
    assert got == {i: sum(j % 5 for j in range(i + 1)) for i in range(100)}
    assert numbering.places(df.limit(0), ["sid"]).count() == 0 and sequences.segment_index(df.limit(0)).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_all_rows(spark):
    """Neither a window nor an exchange into one partition stands over subjects."""
    rows = spark.range(200).selectExpr("id as sid", "cast(id as double) as r", "if(id % 2 = 0, 'M', 'F') as grp", "id as pos", "id as row_key")
    plans = [
        plan(permutations.deal(*permutations.labelled_places(rows, [])[:1], 5, 2)),
        plan(design.exchange_blocks(rows)),
        plan(design.columns_of(rows, 3)),
        plan(sequences.numbered(rows.select("pos"), "pos")),
    ]
    assert not any("Window" in p or "SinglePartition" in p for p in plans)
    assert "SinglePartition" not in plan(sequences.segment_index(rows))


def test_dealt_numbers():
    """Of all sizes at once, those of the plain bijection."""
    place, size = (np.array(x) for x in zip(*[(j, n) for n in (1, 2, 3, 5, 101, 1000, 5_000_000) for j in range(0, n, max(1, n // 50))]))
    got = permutations.dealt_numbers(place, size, np.arange(9))
    assert got.tolist() == [[plain(int(j), int(n), i) for i in range(9)] for j, n in zip(place, size)]


@pytest.mark.parametrize("levels", [3, 40])
def test_sums_of_dealt_labels(spark, levels):
    """Without a row for each permutation: the sums of what `deal` deals, of families, further keys and null labels."""
    rows = [(f, i, None if i % 7 == 0 else f"level{random.Random(f"{f}{i}").randrange(levels):02d}", i % 3, float(i * i)) for f in ("x", "y", None) for i in range(60 + len(f or ""))]
    df = spark.createDataFrame(rows, "fam string, sid int, grp string, s int, r double")
    placed = permutations.labelled_places(df, ["fam"])
    want = permutations.deal(placed.rows, 5, placed.levels).groupBy("fam", "s", "perm", "grp").agg(F.count("*").cast("double").alias("n"), F.sum("r").alias("r"))
    found = permutations.dealt_sums(placed, [F.lit(1), F.col("r")], ["fam"], 5, over=("s",))
    assert "Generate" not in plan(found)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["fam"], r["s"], r["perm"], r["grp"], *r["sums"]) for r in found.collect()], key=key) == sorted(map(tuple, want.collect()), key=key)
