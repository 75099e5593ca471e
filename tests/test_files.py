"""The data source of matrix files: shapes, ranges, orientation, pruning, and writes that leave nothing behind."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.sources import matrix_files, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("matrices")
    y = np.random.default_rng(0).normal(size=(500, 3))
    np.save(root / "b_rest.npy", y)
    np.save(root / "c_rest.npy", np.asfortranarray(y.T.astype(np.float32)))
    np.save(root / "d_rest.npy", y.T[:, :10])
    np.save(root / "e_rest.npy", np.zeros((2, 2, 2)))
    np.save(root / "f_rest.npy", np.zeros((9, 4)))
    np.savetxt(root / "a_rest.txt", y[:20].T, delimiter=",")
    np.savetxt(root / "0h_rest.txt", y[20:40])
    (root / "g_rest.txt").write_text("\n \n")
    (root / ".hidden").write_text("x")
    return root, y


def test_series(spark, folder):
    root, y = folder
    rows = matrix_files.source(spark, f"{root}/*", partitionBytes="2000").load()
    assert rows.rdd.getNumPartitions() > 8  # a long array is read in ranges
    got = {sid: np.array([r["y"] for r in sorted(part, key=lambda r: r["t"])]) for sid, part in grouped(rows.collect()).items()}
    assert set(got) == {"0h", "a", "b", "c", "d"}
    for sid, want in (("0h", y[20:40]), ("a", y[:20]), ("b", y), ("c", y), ("d", y[:10])):
        np.testing.assert_allclose(got[sid], want, atol=1e-6)
    assert readers.series(spark, str(root)).columns == ["sid", "t", "y"]
    lying = matrix_files.series(spark, [f"{root}/b_rest.npy", f"{root}/a_rest.txt"], orient=False)
    assert {r["name"]: r["count"] for r in lying.groupBy("name").count().collect()} == {"a_rest.txt": 3}  # 20 features: b has others


def grouped(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r["sid"], []).append(r)
    return out


def test_filters_prune_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}_x.txt").write_text("1 2\n3 4\n5 6\n")
    rows = matrix_files.series(spark, str(tmp_path))
    (tmp_path / "c_x.txt").write_text("no numbers\n")  # a file that isn't asked for isn't opened
    assert rows.where("sid in ('a', 'b')").count() == 6 and rows.where("sid = 'b' and t > 0").count() == 2
    assert rows.where("sid = 'nobody'").count() == 0


def test_shapes_and_preflight(spark, folder):
    root, _ = folder
    found = {r["name"]: r for r in readers.preflight(matrix_files.shapes(spark, str(root))).collect()}
    assert (found["c_rest.npy"]["rows"], found["c_rest.npy"]["p"], found["c_rest.npy"]["turned"]) == (500, 3, True)
    assert {n for n, r in found.items() if r["keep"]} == {"0h_rest.txt", "a_rest.txt", "b_rest.npy", "c_rest.npy", "d_rest.npy"}
    assert found["e_rest.npy"]["n_dim"] == 3 and not found["g_rest.txt"]["keep"]


def test_ragged_text_is_an_error(spark, tmp_path):
    (tmp_path / "a_x.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="different lengths"):
        readers.series(spark, str(tmp_path)).collect()


def test_through_spark_is_the_same(spark, folder):
    root, _ = folder
    paths = [f"{root}/a_rest.txt", f"{root}/0h_rest.txt"]
    one, two = (sorted((r["sid"], r["t"], tuple(r["y"])) for r in f(spark, paths).collect()) for f in (readers.series, readers.series_through_spark))
    assert one == two


def test_write_and_read_back(spark, folder, tmp_path):
    root, y = folder
    rows = matrix_files.series(spark, str(root)).where("sid in ('a', 'b')").select(F.concat("sid", F.lit("_w.txt")).alias("name"), "t", "y")
    (tmp_path / "old_w.txt").write_text("1\n")
    matrix_files.write(rows, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["a_w.txt", "b_w.txt"]
    got = sorted(matrix_files.series(spark, str(tmp_path)).where("sid = 'b'").collect(), key=lambda r: r["t"])
    np.testing.assert_allclose([r["y"] for r in got], y, atol=1e-6)
    matrix_files.write(rows.limit(0), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_failed_write_leaves_nothing(spark, folder, tmp_path):
    root, _ = folder
    (tmp_path / "old_w.txt").write_text("1\n")
    rows = matrix_files.series(spark, str(root)).select(F.concat("sid", F.when(F.col("sid") == "c", "/w.txt").otherwise("_w.txt")).alias("name"), "t", "y")
    with pytest.raises(Exception, match="not a file's name"):
        matrix_files.write(rows, str(tmp_path))
    assert os.listdir(tmp_path) == ["old_w.txt"]
