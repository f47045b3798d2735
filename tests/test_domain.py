"""Edge rules on small hand-made frames, and published golden values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import standins
from condmon import functions as fn, sources as src
from condmon.constants import CHANNELS, DB4_HIGH
from condmon.evaluate import errors as er, regress as rg
from condmon.evaluate.scaler import Scaler
from condmon.operators import features as ft, sequence as sq, spectrum as sp, wavelet as wv
from condmon.physics import score as sc, wear as we
from condmon.plans import reports as rp, study
from condmon.session import shared_dir
from condmon.sources.cache import cached_features


def one(df):
    (row,) = df.collect()
    return row


def recording(spark, columns, rid=1):
    n = len(columns["acc"])
    pdf = pd.DataFrame({"recording_id": [rid] * n, "pos": np.arange(n)} | {
        c: np.asarray(columns.get(c, np.zeros(n)), dtype=float) for c in CHANNELS})
    return spark.createDataFrame(pdf, f"recording_id int, pos long, {', '.join(f'{c} double' for c in CHANNELS)}")


# ---- cleaning

def test_label_edges(spark, tmp_path):
    text = (
        " Set ,ImageID,SensorID,ImageName,SensorName,ImageFile,SensorFile,ImageDateTime,SensorDateTime, wear , type\n"
        "3,1,1,i1,s1,MATWI/Set3/i1.bmp,Set3\\s1.csv,2023-01-01 10:00:00,junk,120.5, Flank Wear \n"
        "17,2,,i2,,Set17/i2.bmp,,2023-01-01 10:00:00,,999,combination\n"
        "x,,3,,s3,,MATWI\\Set1/s3.csv,,,?,\n"
        "12,4,4,i4,s4,a/b,c/d,,,nan,odd type\n")
    (tmp_path / "labels.csv").write_text(text)
    rows = {r["ImageName"] or "none": r for r in src.read_labels(spark, str(tmp_path / "labels.csv")).collect()}
    a, b, c, d = rows["i1"], rows["i2"], rows["none"], rows["i4"]
    assert (a["ImageFile"], a["SensorFile"]) == ("Set3/Set3/i1.bmp", "Set3/Set3/s1.csv")
    assert (a["type"], a["wear"], a["split"], a["material"], a["both"]) == ("flank_wear", 120.5, "val", "CK45", True)
    assert a["ImageDateTime"] is not None and a["SensorDateTime"] is None
    assert (b["type"], b["has_image"], b["has_sensor"], b["split"], b["material"]) == ("flank_wear+adhesion", True, False, "unseen", "RVS 304")
    assert (c["Set"], c["type"], c["wear"], c["SensorFile"], c["material"]) == (None, "nan", None, "Set1/Set1/s3.csv", None)
    assert (d["type"], d["wear"]) == ("odd_type", None)


@pytest.mark.parametrize("cell, mean, null", [
    ("?", None, None), ("", None, None), (None, None, None), ("185/148", 166.5, None), ("x/10", 10.0, None),
    ("a/b", None, None), (" 2.5 ", 2.5, 2.5), ("abc", None, None)])
def test_parameter_cells(spark, cell, mean, null):
    df = spark.createDataFrame([(cell,)], "c string").select(
        fn.parse_param(F.col("c")).alias("m"), fn.parse_param(F.col("c"), "null").alias("n"))
    assert tuple(one(df)) == (mean, null)


def test_set_params_file(spark, tmp_path):
    (tmp_path / "sets.csv").write_text(",Vc ,fz,Vf,material,z\nSet 1,?,?,?,CK45,4\nSet 6,174,0.05,185/148,ck45,4\nSet 17,120,.05,9, rvs 304 ,2\n")
    rows = {r["Set"]: r for r in src.read_set_params(spark, str(tmp_path / "sets.csv")).collect()}
    assert rows[1]["Vc"] is None and rows[6]["Vf"] == 166.5 and rows[17]["material_RVS"] == 1.0 and rows[6]["material_RVS"] == 0.0


def test_file_order_survives_split_scans(spark, tmp_path):
    for rid, n in (("s1", 3000), ("s2", 10)):
        lines = [f"{i},{i % 7},0,0,1,2023-01-01 00:00:00" for i in range(n)]
        (tmp_path / f"{rid}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = src.read_recordings(spark, str(tmp_path / "*.csv"), id_pattern=src.FILE_STEM).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert df.groupby("recording_id").size().to_dict() == {"s1": 3000, "s2": 10}
    assert (df["pos"] == df["acc"]).all()


def test_equal_file_names_stay_apart_and_broken_files_are_left_out(spark, tmp_path):
    good = "1,2,3,4,5,2023-01-01 00:00:00\n"
    for folder, text in (("Set1", good * 3), ("Set2", good * 2), ("Set 3", good + "stopped\n" + good), ("Set4", good + "1,x,3,4,5,2023-01-01 00:00:00\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "001.csv").write_text(text)
    df = src.read_recordings(spark, str(tmp_path / "*" / "*.csv")).groupBy("recording_id").count()
    assert {r[0]: r[1] for r in df.collect()} == {"Set1/001.csv": 3, "Set2/001.csv": 2}


def test_recordings_are_written_as_a_file_each_in_few_folders(spark, tmp_path):
    rows = [(r, p, f"{p},{r},0,0,1,2023-01-01 00:00:00") for r in range(40) for p in reversed(range(3))]
    rows += [(None, p, f"{p},99,0,0,1,2023-01-01 00:00:00") for p in (1, 0)]
    df = spark.createDataFrame(rows, "rid long, pos int, value string").repartition(5)
    standins.write_files(df, str(tmp_path / "out"), ("pos",))
    files = list((tmp_path / "out").glob("*/rid=*.txt"))
    assert len(files) == 41 and len(list((tmp_path / "out").iterdir())) <= 8 and not list((tmp_path / "out").glob("*/.*"))
    found = src.read_recordings(spark, str(tmp_path / "out" / "*"), id_pattern=r"rid=(\w+)[./]").collect()
    assert sorted((r["recording_id"], r["pos"], r["acc"], r["acoustic"]) for r in found) == sorted(
        ("__HIVE_DEFAULT_PARTITION__" if r is None else str(r), p, float(p), 99.0 if r is None else float(r)) for r, p, _ in rows)
    standins.write_files(df.limit(0), str(tmp_path / "none"))


def test_ranks_of_known_designs(spark):
    rows = [("constant", 120.5, float(i % 50 + 1), float(i % 7 + 1)) for i in range(30_000)]
    rows += [("near", 120.5 * (1 + 1e-9 * (i % 13)), float(i % 50 + 1), float(i % 7 + 1)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "material string, Vc double, fz double, Ap double").repartition(6)
    assert {r["material"]: r["rank"] for r in we.log_design_rank(df).collect()} == {"constant": 3, "near": 4}


def test_empty_config_and_missing_name_of_a_run(spark, tmp_path):
    (tmp_path / "t3_e17_s43").mkdir()
    (tmp_path / "t3_e17_s43" / "results.json").write_text(
        '{"config": {}, "base_config": {"epochs": 17}, "best_epoch": 3, "splits": {"val": {"mae_overall_um": 20.5, "n_total": 4}}}')
    r = one(rp.run_meta(src.read_runs(spark, str(tmp_path))))
    assert (r["experiment"], r["epochs"], r["seed"], r["overall"]) == ("t3_e17_s43", 17, 43, 20.5)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_feature_cache_only_computes_missing(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 4).alias("recording_id"), F.col("id").cast("double").alias("acc"))
    seen = []

    def extract(r):
        seen.append(sorted(x[0] for x in r.select("recording_id").distinct().collect()))
        return r.groupBy("recording_id").agg(F.avg("acc").alias("m"))

    cached_features(rows.filter("recording_id < 2"), str(tmp_path), "v1", extract)
    out = cached_features(rows, str(tmp_path), "v1", extract)
    assert seen == [[0, 1], [2, 3]] and out.count() == 4


# ---- sequences

def test_life_at_threshold_cases(spark):
    data = [("never", 0.0, 10.0), ("never", 1.0, 20.0), ("first", 2.0, 95.0), ("first", 3.0, 99.0),
            ("between", 0.0, 80.0), ("between", 10.0, 100.0), ("between", 20.0, 50.0), ("exact", 1.0, 10.0), ("exact", 5.0, 90.0),
            ("tie", 1.0, 50.0), ("tie", 2.0, 100.0), ("tie", 2.0, 60.0)]
    df = spark.createDataFrame(data, "g string, t double, w double")
    got = {r["g"]: r["life"] for r in sq.life_at_threshold(df, "g", "t", "w", 90.0).collect()}
    assert got == {"never": None, "first": 2.0, "between": 5.0, "exact": 5.0, "tie": 2.0}


def test_delta_of_baseline_rows_averages_zero(spark):
    df = spark.range(40).select((F.col("id") % 4).alias("g"), F.col("id").alias("o"), F.sin("id").alias("x"))
    d = sq.delta_features(df, "g", [F.col("o")], ["x"]).filter("o < 12").groupBy("g").agg(F.avg("x").alias("m"))
    assert all(abs(r["m"]) < 1e-12 for r in d.collect())


def test_best_epoch_first_wins(spark):
    df = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 3.0), ("r", 3, 3.0), ("r", 4, 9.0)], "run string, epoch int, mae double")
    r = one(sq.best_epoch(df, ["run"], "mae"))
    assert (r["best_epoch"], r["best_value"], r["last_value"]) == (2, 3.0, 9.0)


# ---- signals

@pytest.mark.parametrize("n", [1, 3, 5, 9, 10, 19])
def test_short_recordings(spark, n):
    rng = np.random.default_rng(n)
    x = {c: rng.normal(2, 1, n) for c in CHANNELS}
    rec = recording(spark, x)
    v2 = one(ft.features_v2(rec)).asDict()
    v1 = one(ft.features_v1(rec)).asDict()
    assert len(v2) == 86 and len(v1) == 41
    assert all(v is not None and np.isfinite(v) for v in [*v1.values(), *v2.values()])
    if n < 10:
        rms = np.sqrt(np.mean(x["acc"] ** 2))
        assert v2["acc_win_mean_rms"] == pytest.approx(rms) and v2["acc_win_slope_rms"] == 0.0
        assert v2["acc_win_intercept_rms"] == pytest.approx(rms)
    if n < 4:
        assert v2["acc_rel_e_b0"] == 0.0 and v2["acc_spec_entropy"] == 0.0


def test_flat_signal(spark):
    v = one(ft.features_v2(recording(spark, {c: np.full(40, 3.0) for c in CHANNELS}))).asDict()
    assert v["acc_std"] == 0.0 and v["acc_win_slope_rms"] == 0.0 and v["acc_win_intercept_rms"] == pytest.approx(3.0)
    assert v["acc_spec_entropy"] == 0.0 and v["acc_frac3sig"] == 0.0
    v1 = one(ft.features_v1(recording(spark, {c: np.full(40, 3.0) for c in CHANNELS}))).asDict()
    assert v1["acc_kurtosis"] == 0.0 and v1["acc_dom_freq"] == 0.0


def test_ramp_slope_and_trimmed_tail(spark):
    # constant inside each of the ten segments, rows after the last full segment are wild
    x = np.append(np.repeat(np.arange(1.0, 11.0), 4), [1e6] * 3)
    v = one(ft.windowed_rms_trend(recording(spark, {"acc": x}), ["acc"]))
    assert v["acc_win_slope_rms"] == pytest.approx(9.0) and v["acc_win_intercept_rms"] == pytest.approx(1.0)


@pytest.mark.parametrize("hz, part", [(100, "low_energy"), (500, "mid_energy")])
def test_sine_lands_in_its_band(spark, hz, part):
    t = np.arange(2000) * 0.0006
    v = one(ft.features_v1(recording(spark, {c: np.sin(2 * np.pi * hz * t) for c in CHANNELS}))).asDict()
    assert v[f"acc_{part}"] > 0.98 and v["acc_dom_freq"] == pytest.approx(hz, abs=1.0)


def test_energies_sum_to_one_and_ignore_gain(spark):
    x = np.random.default_rng(0).normal(0, 1, 300)
    spec = lambda k: one(sp.spectral_summary(sp.spectrum_wide(recording(spark, {c: k * x for c in CHANNELS}), share=True), CHANNELS)).asDict()
    a, b = spec(1.0), spec(7.5)
    assert sum(a[f"acc_rel_e_b{i}"] for i in range(3)) == pytest.approx(1.0)
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def mirrored_detail(x):
    n = len(x)
    at = lambda i: x[(lambda m: m if m < n else 2 * n - 1 - m)(i % (2 * n))]
    return np.abs([sum(DB4_HIGH[j] * at(2 * k + 1 - j) for j in range(8)) for k in range((n + 7) // 2)])


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 8, 30, 31])
def test_db4_detail_matches_direct_filter(spark, n):
    x = np.random.default_rng(n).normal(0, 1, n)
    got = wv.db4_detail(recording(spark, {"acc": x}), ["acc"]).orderBy("k").toPandas()
    assert np.allclose(got["acc"].to_numpy(), mirrored_detail(x)) and list(got["k"]) == list(range((n + 7) // 2))


def test_detector_finds_burst_and_falls_back(spark):
    rng = np.random.default_rng(2)
    quiet, loud = rng.normal(0, .01, 4000), rng.normal(0, 5, 4000)
    burst = np.concatenate([quiet, loud, rng.normal(0, .01, 2000)])
    r = one(wv.cut_window(recording(spark, {"acc": burst, "acoustic": burst})))
    span = 4000
    assert abs(r["s"] - (4000 - .05 * span)) < 20 and abs(r["e"] - (8000 + .05 * span)) < 20
    r = one(wv.cut_window(recording(spark, {"acc": quiet, "acoustic": quiet})))
    assert (r["s"], r["e"]) == (0, 4000)


def test_tiny_window_keeps_everything(spark):
    rec = recording(spark, {"acc": np.arange(20.0)})
    win = spark.createDataFrame([(1, 20, 5, 8)], "recording_id int, n long, s long, e long")
    assert wv.gate(rec, win).count() == 20
    assert one(wv.keep_fraction(win))["keep_frac"] == 1.0
    win = spark.createDataFrame([(1, 20, 5, 12)], "recording_id int, n long, s long, e long")
    assert sorted(r["pos"] for r in wv.gate(rec, win).collect()) == list(range(7))


# ---- physics golden values (set records as published)

V300 = [(2, "CK45", 120.0, 0.0), (5, "CK45", 174.0, 6.818181818181818), (7, "CK45", 174.0, 0.0),
        (8, "CK45", 174.0, 0.8490566037735849), (10, "CK45", 174.0, 0.5084745762711864), (11, "CK45", 174.0, 0.75),
        (12, "RVS 304", 120.0, 6.0), (13, "RVS 304", 150.0, 1.0714285714285714)]
V90 = [(2, "CK45", 120.0, 0.08, 4.8), (5, "CK45", 174.0, 0.04, 6.0), (7, "CK45", 174.0, 0.045, 48.0),
       (8, "CK45", 174.0, 0.048, 23.0), (10, "CK45", 174.0, 0.05, 25.0), (11, "CK45", 174.0, 0.043, 0.0),
       (12, "RVS 304", 120.0, 0.05, 7.0), (13, "RVS 304", 150.0, 0.05, 8.0)]


def test_published_simple_constants(spark):
    rates = spark.createDataFrame(V300, "Set int, material string, Vc double, slope_um_per_pass double")
    k = {r["material"]: r for r in we.tool_life_constants(rates).collect()}
    a, b = k["CK45"], k["RVS 304"]
    assert (a["n"], a["C"], a["n_sets"], a["n_distinct_vc"], a["source"], a["note"]) == (0.25, 765.8101, 4, 1, "literature_n", None)
    assert (b["n"], b["C"], b["n_sets"], b["source"]) == (0.2, 328.1426, 2, "literature_n")
    assert b["note"] == "regression slope b=7.7204 >= 0 (non-physical)"
    p = {r["Set"]: r for r in we.predict_life(rates, we.tool_life_constants(rates)).collect()}
    assert p[2]["T_taylor"] == pytest.approx(1658.6676523037293) and p[13]["taylor_slope_um_per_pass"] == pytest.approx(5.987761254617725)


def test_published_life_crossing_constants(spark):
    rates = spark.createDataFrame(V90, "Set int, material string, Vc double, fz double, life_at_failure double").withColumn(
        "slope_um_per_pass", F.lit(1.0))
    k = {r["material"]: r for r in we.tool_life_constants(rates, "life_feed", 90.0).collect()}
    assert (k["CK45"]["n"], k["CK45"]["m"], k["CK45"]["C"], k["CK45"]["n_sets"]) == (-0.0466, 0.5158, 30.6723, 5)
    assert (k["RVS 304"]["n"], k["RVS 304"]["m"], k["RVS 304"]["C"]) == (-1.6711, 0.0, 4.6445)
    p = {r["Set"]: r for r in we.predict_life(rates, we.tool_life_constants(rates, "life_feed", 90.0), "life_feed", 90.0).collect()}
    assert p[2]["T_taylor"] == pytest.approx(3.7313063047090074, rel=1e-9)


def test_fallback_without_records(spark):
    rates = spark.createDataFrame([(2, "CK45", 120.0, 0.05, 0.0, None)],
                                  "Set int, material string, Vc double, fz double, slope_um_per_pass double, life_at_failure double")
    a = one(we.tool_life_constants(rates))
    assert (a["n"], a["C"], a["n_sets"]) == (0.25, None, 0)
    b = one(we.tool_life_constants(rates, "life_feed"))
    assert (b["n"], b["m"], b["C"], b["source"]) == (0.25, 0.5, 300.0, "fallback")


def test_wear_rate_record(spark):
    data = [(2, float(t), 10.0 + 2.0 * t) for t in range(0, 101, 10)] + [(5, 1.0, 1.0), (5, 2.0, 2.0), (7, 1.0, 9.0), (7, 2.0, 8.0), (7, 3.0, 7.0), (7, 4.0, 6.0), (1, 1.0, 1.0)]
    df = spark.createDataFrame(data, "Set int, t double, wear double")
    params = spark.createDataFrame([(s, "CK45", 174.0) for s in (1, 2, 5, 7)], "Set int, material string, Vc double")
    r = {x["Set"]: x for x in we.wear_rates(df, params, with_life=True, failure_um=100.0).collect()}
    assert set(r) == {2, 7}
    assert r[2]["slope_um_per_pass"] == pytest.approx(2.0) and r[2]["intercept_um"] == pytest.approx(10.0)
    assert r[2]["n_window"] == 7 and r[2]["life_at_failure"] == pytest.approx(45.0)
    assert r[7]["slope_clamped"] and r[7]["slope_um_per_pass"] == 0.0 and r[7]["slope_raw_um_per_pass"] == -1.0


def test_wear_rates_of_big_sets(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"Set": [2] * 60 + [5] * 12 + [7] * 5, "t": [*range(60), *range(12), *range(5)]}).astype({"t": float})
    pdf["wear"] = np.round(pdf.t * 1.3 + rng.normal(20, 4, len(pdf)), 2)
    df = spark.createDataFrame(pdf)
    params = spark.createDataFrame([(s, "CK45", 174.0) for s in (2, 5, 7)], "Set int, material string, Vc double")
    consts = spark.createDataFrame([("CK45", 0.25, 700.0)], "material string, n double, C double")

    def run(limit):
        r = we.wear_rates(df, params, task_rows=limit)
        return we.predict_life(r, consts, samples=df, task_rows=limit).orderBy("Set").toPandas()

    plain, split = run(1 << 15), run(30)
    assert list(plain.columns) == list(split.columns)
    num = plain.select_dtypes("number").columns
    assert np.allclose(plain[num], split[num], rtol=1e-9)


def test_physics_score_rules(spark):
    sets = spark.createDataFrame([(2, "CK45", 1.0, 0.0, 100.0), (12, "RVS 304", 1.0, 0.0, 100.0), (1, "CK45", 1.0, 0.0, 100.0)],
                                 "Set int, material string, slope_um_per_pass double, intercept_um double, max_image_id double")
    preds = spark.createDataFrame([(0, 2, 50.0, 0.06), (0, 12, 50.0, 0.03), (0, 1, 50.0, 9.0), (0, 2, 99.0, 9.0), (0, 99, 50.0, 9.0), (7, 2, 1.0, 9.0)],
                                  "epoch int, Set int, t double, pred_norm double")
    got = {r["epoch"]: r for r in sc.physics_score(preds, sets, 0.4, warmup=4).collect()}
    assert got[0]["n_rows"] == 2 and got[0]["lam"] == pytest.approx(0.1)
    assert got[0]["physics_loss"] == pytest.approx(0.1 * (0.01 ** 2 + 0.02 ** 2) / 2)
    assert got[7]["physics_loss"] == 0.0
    ceil = {r["epoch"]: r for r in sc.physics_score(preds, sets, 0.4, one_sided=True).collect()}
    assert ceil[0]["physics_loss"] == pytest.approx(0.1 * 0.01 ** 2 / 2)
    rvs = {r["epoch"]: r for r in sc.physics_score(preds, sets, 0.4, apply_to="rvs").collect()}
    assert rvs[0]["n_rows"] == 1
    with pytest.raises(ValueError):
        sc.physics_score(preds, sets, 20.0)


def test_bounded_prediction_stays_in_band(spark):
    rates = spark.createDataFrame([(2, 3.0)], "Set int, k double")
    df = spark.createDataFrame([(2, 50.0, 9.0), (2, 500.0, -9.0), (3, 5.0, 0.2)], "Set int, t double, raw double")
    for r in sc.bounded_prediction(df, rates, 40.0).collect():
        assert abs(r["pred_norm"] * 1000 - r["anchor_um"]) <= 40.0 + 1e-9
        assert r["anchor_um"] == (0.0 if r["Set"] == 3 else min(300.0, 3.0 * r["t"]))


# ---- models

def closed_form(x, y, xe, alpha=1.0):
    m = np.nan_to_num(np.nanmean(x, axis=0))
    x, xe = np.where(np.isnan(x), m, x), np.where(np.isnan(xe), m, xe)
    s = x.std(axis=0)
    s[s == 0] = 1.0
    z, ze = (x - m) / s, (xe - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return np.clip(ze @ w + y.mean(), 0, 450)


@pytest.fixture(scope="module")
def tabular(spark):
    rng = np.random.default_rng(4)
    n = 240
    x = rng.normal(0, 1, (n, 4)) * [1, 5, .1, 1] + [0, 3, 0, 1]
    x[rng.random((n, 4)) < .05] = np.nan
    y = 150 + np.nan_to_num(x) @ [20, -5, 100, 3] + rng.normal(0, 3, n)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["y"], pdf["id"], pdf["g"] = y, np.arange(n), np.arange(n) % 6
    pdf["type"] = np.where(pdf.id % 2 == 0, "adhesion", "flank_wear")
    df = spark.createDataFrame(pdf)
    for c in "abcd":
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df.persist(), pdf


def test_ridge_equals_closed_form(tabular):
    df, pdf = tabular
    got = rg.fit_ridge(df, list("abcd"), "y", F.col("g") < 4).transform(df).orderBy("id").toPandas()["pred"]
    x, y = pdf[list("abcd")].to_numpy(), pdf.y.to_numpy()
    assert np.allclose(got, closed_form(x[pdf.g < 4], y[pdf.g < 4], x), atol=1e-8)


def test_hold_out_ridge_equals_refits(tabular):
    df, pdf = tabular
    preds, folds, pooled = rg.leave_group_out(df, "g", list("abcd"), "y")
    got = preds.orderBy("id").toPandas()
    x, y = pdf[list("abcd")].to_numpy(), pdf.y.to_numpy()
    want = np.empty(len(pdf))
    for g in range(6):
        ho = (pdf.g == g).to_numpy()
        want[ho] = closed_form(x[~ho], y[~ho], x[ho])
    assert np.allclose(got["pred"], want, atol=1e-8)
    assert folds.agg(F.sum("n")).first()[0] == len(pdf) and one(pooled)["n"] == len(pdf)


def test_boosted_trees_beat_the_mean(tabular):
    df, _ = tabular
    methods = [study.Method("mean", "mean"), study.Method("trees", "boosted", list("abcd"))]
    split = df.withColumn("split", F.when(F.col("g") < 4, "train").otherwise("test"))
    res = study.evaluate_methods(split, methods, "y", "id", rounds=60, depth=3, step=0.3)
    test = {r["method"]: r["overall"] for r in res.filter("split = 'test'").collect()}
    assert test["trees"] < 0.7 * test["mean"]
    assert one(er.best_method(res.filter("split = 'test'")))["method"] == "trees"


def test_method_matrix_has_all_methods():
    names = [m.name for m in study.method_matrix(ft.v1_names(), ft.v2_names(), ["Vc"])]
    assert len(names) == len(set(names)) == 20 and "boosted_v2cut_absolute" in names and "ridge_v4_delta" in names


def test_scaler_round_trip(tabular, spark, tmp_path):
    df, pdf = tabular
    sc_ = Scaler.fit(df.withColumn("k", F.lit(2.0)), ["a", "k"])
    sc_.save(str(tmp_path / "s"))
    v = Scaler.load(spark, str(tmp_path / "s")).values()
    assert v["k"] == (2.0, 1.0) and v["a"][1] == pytest.approx(np.nanstd(pdf.a))


def test_errors_of_missing_class(spark):
    df = spark.createDataFrame([(1.0, 3.0, "adhesion"), (2.0, 2.0, "other")], "pred double, target double, type string")
    r = one(er.error_by_class(df))
    assert (r["overall"], r["n"], r["adhesion"], r["flank_wear"], r["n_flank_wear"]) == (1.0, 2, 2.0, None, 0)


# ---- reports

# test MAE of three control and three ceiling runs (seeds 42, 43, 44)
CONFIRM = [("ctrl", 0.0, 42, 21.605284, 26.569221), ("ctrl", 0.0, 43, 19.982986, 27.414701), ("ctrl", 0.0, 44, 23.961855, 25.122553),
           ("taylor_ceil", 0.5, 42, 18.276417, 20.607025), ("taylor_ceil", 0.5, 43, 19.832203, 27.544245), ("taylor_ceil", 0.5, 44, 23.313919, 34.836094)]


def test_published_confirmation_rows(spark, tmp_path):
    import json
    for kind, lam, seed, overall, fa in CONFIRM:
        d = tmp_path / "stage3_fusion" / f"{kind}_e17_s{seed}"
        d.mkdir(parents=True)
        (d / "results.json").write_text(json.dumps({
            "experiment": d.name, "base_config": {"epochs": 17}, "best_epoch": 3, "best_val_mae_um": 1.5,
            "physics": {"lambda_max": lam, "one_sided": lam > 0, "use_taylor_slope": lam > 0},
            "splits": {"test": {"mae_overall_um": overall, "mae_flank_wear+adhesion_um": fa, "mae_adhesion_um": float("nan"), "n_total": 247}}}, indent=1))
    runs = src.read_runs(spark, str(tmp_path), src.FAMILY_TREE)
    rep = {r["variant"]: r for r in rp.confirm_report(runs).collect()}
    a, b = rep["ctrl"], rep["ceil-T"]
    assert (a["family"], a["epochs"], a["seeds"]) == ("stage3_fusion", 17, 3)
    assert (round(a["overall_m"], 2), round(a["overall_s"], 2), round(a["fa_m"], 2), round(a["fa_s"], 2)) == (21.85, 2.00, 26.37, 1.16)
    assert (round(b["overall_m"], 2), round(b["overall_s"], 2), round(b["fa_m"], 2), round(b["fa_s"], 2)) == (20.47, 2.58, 27.66, 7.12)
    assert b["d_overall_m"] == pytest.approx(b["overall_m"] - a["overall_m"]) and a["adh_m"] is None


def test_variant_names(spark):
    df = spark.createDataFrame([(True, 40.0), (True, 12.5), (False, 40.0), (None, None)], "e boolean, c double")
    got = [r[0] for r in df.select(rp.hard_variant(F.col("e"), F.col("c"))).collect()]
    assert got == ["hard_C40", "hard_C12.5", "ctrl", "ctrl"]


def test_constants_round_trip(spark, tmp_path):
    mats = spark.createDataFrame([("CK45", 0.25, 765.8101)], "material string, n double, C double")
    sets = spark.createDataFrame([(2, "CK45", 120.0)], "set int, material string, Vc double")
    src.write_constants(mats, sets, {"failure_um": 300.0, "excluded_sets": [1]}, str(tmp_path / "k"))
    m, s = src.read_constants(spark, str(tmp_path / "k"))
    assert (one(m)["C"], one(m)["failure_um"], one(s)["set"], one(s)["Vc"]) == (765.8101, 300.0, 2, 120.0)
    many = spark.range(50).select(F.col("id").cast("int").alias("set"), F.lit("CK45").alias("material"), F.lit(1.0).alias("Vc"))
    src.write_constants(mats, many, {"failure_um": 300.0}, str(tmp_path / "shards"))
    m, s = src.read_constants(spark, str(tmp_path / "shards"))
    assert m.count() == 1 and sorted(r["set"] for r in s.collect()) == list(range(50))
