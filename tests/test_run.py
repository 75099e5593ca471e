"""Files in, a full run out, on small generated sequences; readers; streaming against batch."""

from __future__ import annotations

import numpy as np
import pytest

from statewalk.operators import arhmm
from statewalk.plans.config import from_mapping
from statewalk.plans.run import Run
from statewalk.sources import readers, writers
from statewalk.streaming import filtering


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    rng = np.random.default_rng(0)
    lines = ["Subject_ID\tGender\tAgeGroup\tmeanFD\tsite"]
    for i in range(12):
        state = np.repeat(rng.integers(0, 2, 12), 5)
        x = rng.normal(size=(60, 2)) * 0.4 + np.where(state[:, None] == 0, -1.0, 1.0)
        np.savetxt(root / f"00{i:02d}_rest.txt", x, fmt="%.5f")
        lines.append(f"00{i:02d}\t{'male' if i % 2 else 'F'}\t{'old' if i % 3 else 'young'}\t{'bad' if i == 5 else 0.1 * i}\tX")
    (root / "cov.tsv").write_text("\n".join(lines) + "\n")
    return root


def test_full_run(spark, folder, tmp_path):
    series = readers.series(spark, str(folder / "*_rest.txt"))
    cov = readers.covariates(spark, str(folder / "cov.tsv"))
    got = {r["sid"]: r for r in cov.collect()}
    assert got["0001"]["sex"] == "M" and got["0000"]["sex"] == "F" and got["0005"]["fd"] is None and "site" in cov.columns
    config = from_mapping({"hmm": {"K": 2, "max_iter": 4}, "stats": {"n_perm_rm": 5, "n_perm_between": 5}})
    run = Run(spark, config, str(tmp_path), series, cov)
    page = run.all()
    assert "state effects" in page and run.segments().count() == 12
    assert run.metrics_state().count() == 24 and run.transitions().count() == 48
    assert all(abs(r["n"] - 1) < 1e-9 for r in run.metrics_state().groupBy("sid").agg({"fo": "sum"}).withColumnRenamed("sum(fo)", "n").collect())
    first = run.model().loglik
    assert run.model().loglik == first  # read again, not fitted
    assert {r["factor"] for r in run.effects_between().collect()} == {"Sex", "AgeGroup"}
    assert all(r["q_bh"] is None or r["q_bh"] >= r["p_perm"] - 1e-12 for r in run.effects_state().collect())


def lines_of(spark, path: str) -> list[str]:
    return [r[0] for r in spark.read.text(path).collect()]


def test_design_and_merge(spark, folder, tmp_path):
    series, cov = readers.series(spark, str(folder / "*_rest.txt")), readers.covariates(spark, str(folder / "cov.tsv"))
    settings = {"hmm": {"K": 2, "max_iter": 2}, "stats": {"n_perm_rm": 3, "n_perm_between": 3}, "group_design": {"contrast": "sex", "demean": ["fd"]}, "palm": {"enabled": True, "n_perm": 5, "tfce": True}}
    run = Run(spark, from_mapping(settings), str(tmp_path), series, cov)
    rows, names = run.design()
    assert names == ["intercept", "age[old]", "sex", "fd", "state[2]"] or names == ["intercept", "age[young]", "sex", "fd", "state[2]"]
    assert rows.count() == 24 and abs(sum(r["fd"] for r in rows.collect())) < 1e-9
    root = run.write_design()
    text = lines_of(spark, f"{root}/design.mat")
    assert text[:2] == ["/NumWaves 5", "/NumPoints 24"] and text[2].startswith("/PPHeights") and len(text) == 28
    assert lines_of(spark, f"{root}/eb.txt") == [str(i // 2 + 1) for i in range(24)]
    assert lines_of(spark, f"{root}/mapping.tsv")[:3] == ["row\tsubid\tstate", "1\t0000\t1", "2\t0000\t2"]
    assert lines_of(spark, f"{root}/design.con")[-1] == "0 0 1 0 0" and lines_of(spark, f"{root}/design_subjects.con")[-1] == "0 0 1 0"
    assert len(lines_of(spark, f"{root}/design_subjects.mat")) == 16 and len(lines_of(spark, f"{root}/age_levels.txt")) == 2
    assert run.stacks().count() == 2 * 12 * 2 and run.columns_map().count() == 24
    assert {r["p_fwe"] is not None for r in run.parcel_tests().collect()} == {True} and run.parcel_tests().count() == 4
    terms = {r["term"] for r in run.omnibus().collect()}
    assert terms == {"State", "AgeGroup", "AgeGroup:State", "Sex", "Sex:State"}


def test_ids_of_text(spark, tmp_path):
    """Ids that aren't numbers through maps, group maps, files, stacks and parcel tests."""
    rng = np.random.default_rng(1)
    (tmp_path / "in").mkdir()
    lines = ["subject,sex,age_group,mean_fd"]
    for i in range(6):
        x = rng.normal(size=(30, 2))
        np.savetxt(tmp_path / "in" / f"sub-0{i}_rest.txt", x.T if i == 2 else x, fmt="%.5f")  # one lies on its side
        lines.append(f"sub-0{i},{'MF'[i % 2]},{'young' if i < 3 else 'old'},0.{i}")
    (tmp_path / "cov.csv").write_text("\n".join(lines) + "\n")
    config = from_mapping({"hmm": {"K": 2, "max_iter": 1}, "palm": {"enabled": True, "n_perm": 4, "two_tailed": False}})
    run = Run(spark, config, str(tmp_path / "out"), readers.series(spark, str(tmp_path / "in")), readers.covariates(spark, str(tmp_path / "cov.csv")))
    assert {r["sid"] for r in run.maps().collect()} == {f"sub-0{i}" for i in range(6)}
    folder = run.write_maps()
    beta = {(r["s"], r["p"]): r["beta"] for r in run.maps().where("sid = 'sub-02'").collect()}
    found = np.loadtxt(f"{folder}/subjects/sub-02_beta.txt")
    assert found.shape == (2, 2) and all(abs(found[s, p] - v) < 1e-6 for (s, p), v in beta.items())
    assert np.loadtxt(f"{folder}/stacks/state0_stack.txt").shape == (6, 2) and np.loadtxt(f"{folder}/group/state1_sd.txt").shape == (2,)
    assert run.parcel_stats().count() == 4 and run.parcel_tests().where("t is not null").count() == 4


def test_other_input_is_another_table(spark, folder, tmp_path):
    series, cov = readers.series(spark, str(folder / "*_rest.txt")), readers.covariates(spark, str(folder / "cov.tsv"))
    config = from_mapping({"hmm": {"K": 2, "max_iter": 1}})
    few = series.where("sid < '0004'")
    assert Run(spark, config, str(tmp_path), few, cov).segments().count() == 4
    assert Run(spark, config, str(tmp_path), series, cov).segments().count() == 12
    assert [r["start"] for r in Run(spark, config, str(tmp_path), few, cov).segments().orderBy("sid").collect()] == [0, 60, 120, 180]


def test_thresholds_reach_the_detectors(spark, folder, tmp_path):
    series, cov = readers.series(spark, str(folder / "*_rest.txt")), readers.covariates(spark, str(folder / "cov.tsv"))

    def figures(**limits):
        config = from_mapping({"hmm": {"K": 2, "max_iter": 2}, "evaluation": {"enabled": True, "K_values": [2], "seeds": [1], **limits}})
        return Run(spark, config, str(tmp_path), series, cov).selection().first().asDict()

    plain = figures(reliability={"run_len_tr": 15, "n_runs": 4})
    strict = figures(junk={"fo_median_min": 0.99, "dt_mean_min_tr": 1e6, "presence_min": 2.0}, reliability={"run_len_tr": 1200, "n_runs": 4})
    assert strict["junk__n_junk__mean"] == 2 and plain["junk__n_junk__mean"] < 2
    assert plain["reliability__r_mean__mean"] is not None and strict["reliability__r_mean__mean"] is None  # no sequence has 4800 steps
    assert figures(reliability={"run_len_tr": 15, "n_runs": 4}) == plain  # read again
    tables = [x.name for x in (tmp_path).iterdir()]
    assert "selection_junk_states" in tables and "selection_clone_pairs" in tables


def test_config():
    with pytest.raises(ValueError):
        from_mapping({"hmm": {"states": 3}})
    with pytest.raises(ValueError):
        from_mapping({"other": {}})
    assert from_mapping({"evaluation": True}).evaluation.enabled
    assert from_mapping({"evaluation": {"K_values": 3}}).evaluation.K_values == [3]
    nested = from_mapping({"evaluation": {"clone": {"corr_thr": 0.5}, "out_dir": "x"}, "palm": {"ise": True, "tfce2D": False}, "logging": {"format": "json"}, "group_design": {"demean": "fd"}})
    assert nested.evaluation.clone_corr == 0.5 and nested.palm.one_sample and nested.group_design.demean == ["fd"]
    with pytest.raises(ValueError):
        from_mapping({"evaluation": {"clone": {"corr": 0.5}}})


def test_readers(spark, tmp_path):
    (tmp_path / "seg.csv").write_text("Subject_ID,start,end\n007,0,10\n007,10,25\n8,0,3\n")
    rows = readers.segments(spark, str(tmp_path / "seg.csv")).orderBy("sid", "seg").collect()
    assert [(r["sid"], r["seg"], r["n_tr"]) for r in rows] == [("007", 0, 10), ("007", 1, 15), ("8", 0, 3)]
    (tmp_path / "a_gamma.txt").write_text("2 2\n0 0\n1 3\n")
    got = [r["g"] for r in readers.posteriors(spark, str(tmp_path / "a_gamma.txt"), 2).orderBy("t").collect()]
    assert got == [[0.5, 0.5], [0.0, 0.0], [0.25, 0.75]]
    (tmp_path / "labels.txt").write_text("V1\n1 0 0 0 255\nM1\n3 1 1 1 255\n")
    assert [(r["label"], r["name"]) for r in readers.label_table(spark, str(tmp_path / "labels.txt")).orderBy("label").collect()] == [(1, "V1"), (2, "parcel_2"), (3, "M1")]
    (tmp_path / "map.csv").write_text("merged_file,col_index,sid,state\nf,1,a,state0\nf,x,b,state0\nf,2,,state0\n")
    assert readers.columns_map(spark, str(tmp_path / "map.csv")).count() == 1
    files = spark.createDataFrame([("a", 2, 9, 3), ("b", 2, 8, 4), ("c", 3, 7, 3), ("d", 2, 6, 3)], "name string, n_dim int, rows int, p int")
    assert {r["name"] for r in readers.preflight(files).where("keep").collect()} == {"a", "d"}


def test_more_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("subject_id,age,sex,mean_fd\n01,old,F,0.5\n,old,M,1\n02,young,x,1\n03,young,1,bad\n")
    assert {(r["sid"], r["sex"], r["fd"]) for r in readers.design_covariates(spark, str(tmp_path / "d.csv")).collect()} == {("01", 0.0, 0.5), ("03", 1.0, 0.0)}
    (tmp_path / "ids.txt").write_text("b\n\na\nb\n")
    assert [r["sid"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["b", "a"]
    (tmp_path / "used.tsv").write_text("row\tsid\tsex\n1\ta\tM\n2\ta\tM\n3\tb\t0\n")
    assert [(r["sid"], r["sex"]) for r in readers.used_ids(spark, str(tmp_path / "used.tsv")).orderBy("pos").collect()] == [("a", "M"), ("b", "F")]
    assert readers.used_rows(spark, str(tmp_path / "used.tsv")).count() == 3
    (tmp_path / "plain.txt").write_text("V1\nx\nM1\ny\n")
    assert [(r["label"], r["name"]) for r in readers.label_table(spark, str(tmp_path / "plain.txt")).orderBy("label").collect()] == [(1, "V1"), (2, "M1")]
    (tmp_path / "wide_ts.txt").write_text("1 2 3\n4 5 6\n")
    assert [r["y"] for r in readers.series(spark, str(tmp_path / "wide_ts.txt"), orient=True).orderBy("t").collect()] == [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]]
    (tmp_path / "p1_gamma.txt").write_text("1 1\n1 3\n")
    (tmp_path / "p2_gamma.txt").write_text("1 1 1\n")
    (tmp_path / "p3_gamma.txt").write_text("1 x\n")
    good = readers.posteriors(spark, [str(tmp_path / f"p{i}_gamma.txt") for i in (1, 2, 3)], 2, skip_bad=True)
    assert {r["sid"] for r in good.collect()} == {"p1"}
    (tmp_path / "global.csv").write_text("Subject,x\nb,1\na,2\nb,3\n")
    assert [r["sid"] for r in readers.ordered_subjects(spark, str(tmp_path / "global.csv"), "").orderBy("pos").collect()] == ["b", "a"]
    assert [r["sid"] for r in readers.ordered_subjects(spark, str(tmp_path / "none.csv"), str(tmp_path / "p*_gamma.txt")).orderBy("pos").collect()] == ["p1", "p2", "p3"]
    names = spark.createDataFrame([("a_z.tsv",), ("a_zz.tsv",), ("b_other.tsv",), ("b_zz.tsv",), ("c_q.tsv",), ("c_r.tsv",)], "name string")
    assert {r["sid"]: r["name"] for r in readers.map_files(names, ["_zz.tsv", "_z.tsv"]).collect()} == {"a": "a_zz.tsv", "b": "b_zz.tsv", "c": "c_q.tsv"}
    assert readers.covariates(spark, str(tmp_path / "nowhere.tsv")).count() == 0
    assert readers.optional(spark, str(tmp_path / "nowhere.tsv"), "a string").columns == ["a"]
    (tmp_path / "noid.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.covariates(spark, str(tmp_path / "noid.csv"))
    (tmp_path / "names.csv").write_text("name,x\nV1,1\n\nM1,2\n")
    assert [(r["p"], r["name"]) for r in readers.label_names(spark, str(tmp_path / "names.csv")).orderBy("p").collect()] == [(0, "V1"), (1, "M1")]
    (tmp_path / "means.csv").write_text("state,a,b\n1,0.5,2\n0,1,x\n")
    assert {(r["s"], r["p"], r["mean"]) for r in readers.mean_patterns(spark, str(tmp_path / "means.csv")).collect()} == {(1, 0, 0.5), (1, 1, 2.0), (0, 0, 1.0), (0, 1, None)}
    assert {r["name"]: r["sid"] for r in readers.files(spark, str(tmp_path), "*.csv").collect()}["d.csv"] == "d.csv"


def test_texts():
    assert writers.matrix_text([[1, 0.5]]).splitlines() == ["/NumWaves 2", "/NumPoints 1", "/Matrix", "1.000000 0.500000"]
    assert "/ContrastName1 sex" in writers.contrast_text(["sex"], [[0, 1]])


def test_streaming_filter(spark, tmp_path):
    rng = np.random.default_rng(3)
    p = arhmm.Parameters(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[[0.3], [-1.0]], [[0.3], [1.0]]]), np.ones((2, 1)), np.zeros((2, 1)), 1)
    y = rng.normal(size=(12, 1))
    for part, cut in enumerate((slice(0, 5), slice(5, 12))):
        rows = [(1, t, y[t].tolist()) for t in range(12)[cut]]
        spark.createDataFrame(rows, "sid long, t int, y array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sid long, t int, y array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = filtering.filtered(stream, p).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["t"]: r["g"] for r in spark.table("filtered").collect()}
    log_b = arhmm.emission(y, arhmm.lagged(y, 1), p)
    for t in range(12):  # filtering at t is smoothing of the sequence cut at t
        assert got[t] == pytest.approx(arhmm.forward_backward(log_b[: t + 1], p.start, p.trans)[1][-1])
