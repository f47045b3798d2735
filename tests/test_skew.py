"""Big groups: every result must equal the plain form when a limit forces the split form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from condmon.operators import features as ft, profile as pf, sequence as sq, spectrum as sp
from condmon.operators.samples import weighted_resample
from condmon.operators.skew import exact_percentiles, rank_in_group, running
from condmon.physics import large_lines, lines
from condmon.physics.lines import inversions, theil_sen


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values repeat; a NULL group and NULL values exist."""
    rng = np.random.default_rng(7)
    groups = ["hot"] * 3000 + ["a"] * 40 + ["b"] * 3 + [None] * 900
    pdf = pd.DataFrame({"g": groups, "id": range(len(groups)), "v": np.round(rng.normal(50, 20, len(groups)), 1)})
    pdf["t"] = rng.permutation(len(pdf))
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("v")))
    return df.withColumn("g", F.when(F.isnan("v") | F.col("g").isNull(), F.col("g")).otherwise(F.col("g"))).persist()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rank_is_same_when_split(skewed):
    order = [F.col("t"), F.col("id")]
    plain = rank_in_group(skewed, ["g"], order).select("id", "pos")
    split = rank_in_group(skewed, ["g"], order, limit=100).select("id", "pos")
    assert rows(plain) == rows(split)


def test_rank_without_group(skewed):
    split = rank_in_group(skewed, [], [F.col("t"), F.col("id")], limit=100).select("t", "pos").toPandas()
    assert (split["t"].to_numpy() == split["pos"].to_numpy()).all()


@pytest.mark.parametrize("fn", ["sum", "min", "max"])
def test_running_is_same_when_split(skewed, fn):
    order = [F.col("t"), F.col("id")]
    plain = running(skewed, ["g"], order, "id", fn, "x").select("id", "x")
    split = running(skewed, ["g"], order, "id", fn, "x", limit=100).select("id", "x")
    assert rows(plain) == rows(split)


@pytest.mark.parametrize("by", [["g"], []])
def test_percentiles_are_same_when_split(skewed, by):
    probs = [0.0, .05, .25, .5, .9, 1.0]
    plain = exact_percentiles(skewed, by, ["v", "t"], probs).toPandas()
    split = exact_percentiles(skewed, by, ["v", "t"], probs, limit=50).toPandas()
    if by:
        plain, split = (d.sort_values("g", na_position="first").reset_index(drop=True) for d in (plain, split))
    for c in ("v_q", "t_q"):
        assert np.allclose(np.stack(plain[c]), np.stack(split[c]))


def test_describe_and_boxes_when_split(skewed):
    assert rows(pf.describe(skewed, "v")) == rows(pf.describe(skewed, "v", limit=50))
    assert rows(pf.five_number(skewed, "v", "g")) == rows(pf.five_number(skewed, "v", "g", limit=50))


def test_running_best_when_split(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("run"), F.col("id").alias("epoch"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("mae"))
    assert rows(sq.running_best(df, ["run"], "mae")) == rows(sq.running_best(df, ["run"], "mae", limit=100))


@pytest.mark.parametrize("n", [97, 512, 1000])
def test_long_spectrum_equals_direct(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"recording_id": [1] * n + [2] * 30, "pos": [*range(n), *range(30)],
                        "acc": rng.normal(5, 2, n + 30), "acoustic": rng.normal(0, 1, n + 30)})
    df = spark.createDataFrame(pdf)
    key = ["recording_id", "bin"]
    for share in (False, True):
        plain = sp.spectrum_wide(df, channels=["acc", "acoustic"], share=share).toPandas().sort_values(key).reset_index(drop=True)
        split = sp.spectrum_wide(df, channels=["acc", "acoustic"], share=share, limit=50).toPandas().sort_values(key).reset_index(drop=True)
        assert (plain[key] == split[key]).all().all()
        for c in ("freq", "acc", "acoustic"):
            assert np.allclose(plain[c], split[c], rtol=1e-8, atol=1e-8 * plain[c].abs().max())


def test_features_v2_when_split(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"recording_id": [1] * n + [2] * 60, "pos": [*range(n), *range(60)]})
    for c in ("acc", "acoustic", "Fx", "Fy", "Fz"):
        pdf[c] = rng.normal(3, 2, len(pdf))
    df = spark.createDataFrame(pdf)
    plain = ft.features_v2(df).toPandas().sort_values("recording_id")
    split = ft.features_v2(df, limit=100).toPandas().sort_values("recording_id")
    assert np.allclose(plain.to_numpy(float), split.to_numpy(float), rtol=1e-7, atol=1e-9)


def test_gated_features_when_split(spark):
    rng = np.random.default_rng(9)
    n = 700
    pdf = pd.DataFrame({"recording_id": [1] * n + [2] * 60, "pos": [*range(n), *range(60)]})
    for c in ("acc", "acoustic", "Fx", "Fy", "Fz"):
        pdf[c] = rng.normal(3, 2, len(pdf)) * np.where(pdf.pos.between(200, 500), 20, 1)
    df = spark.createDataFrame(pdf)
    wavelet = {"z": 4.0, "baseline": 50, "min_active": 20}
    plain = ft.features_v3(df, **wavelet).toPandas().sort_values("recording_id")
    split = ft.features_v3(df, limit=100, **wavelet).toPandas().sort_values("recording_id")
    assert plain["keep_frac"].min() < 1
    assert np.allclose(plain.to_numpy(float), split.to_numpy(float), rtol=1e-7, atol=1e-9)


def test_square_mod_is_exact():
    for m in (2, 97, 2_000_000, 6_000_000_002, (1 << 50) + 6):
        j = np.array([0, 1, m // 3, m // 2, m - 1], dtype=np.int64)
        assert sp._square_mod(j, m).tolist() == [int(x) ** 2 % m for x in j]


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 33, 100):
        v = rng.integers(0, 10, n).astype(float)
        assert inversions(v) == sum(v[i] >= v[j] for i in range(n) for j in range(i + 1, n))


def slow_line(x, y):
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    ok = dx != 0
    slope = float(np.median((y[j] - y[i])[ok] / dx[ok])) if ok.any() else 0.0
    return slope, float(np.median(y - slope * x))


def test_slope_search_equals_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(lines, "PAIR_ROWS", 2)
    for n in (5, 40, 41, 90):
        x, y = rng.integers(0, 20, n).astype(float), np.round(rng.normal(0, 5, n), 2)
        assert lines.line_of(x, y) == pytest.approx(slow_line(x, y), rel=1e-9, abs=1e-9)


def test_theil_sen_when_split(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 300
    pdf = pd.DataFrame({"g": [1] * n + [2] * 9 + [3], "x": np.append(rng.integers(0, 60, n + 9), 1).astype(float)})
    pdf["y"] = np.round(pdf["x"] * 0.7 + rng.normal(0, 5, len(pdf)), 3)
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(large_lines, "CANDIDATES", 63)  # fewer passes
    got = {r["g"]: (r["slope"], r["intercept"]) for r in theil_sen(df, ["g"], "x", "y", limit=60).collect()}
    for g in (1, 2):
        part = pdf[pdf.g == g]
        assert got[g] == pytest.approx(slow_line(part.x.to_numpy(), part.y.to_numpy()), rel=1e-9, abs=1e-9)
    assert got[3] == (0.0, pdf[pdf.g == 3].y.iloc[0])


def test_resample_follows_weights(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 300, "a").otherwise("b").alias("c"))
    n = 20000
    out = weighted_resample(df, "c", {"b": 3.0}, n, 1, [F.col("id")], limit=50)
    counts = {r["c"]: r["count"] for r in out.groupBy("c").count().collect()}
    assert sum(counts.values()) == n
    assert counts["b"] / n == pytest.approx(0.5, abs=0.02)
    assert out.select("id").distinct().count() == 400


def test_a_constant_channel_is_flat_on_both_sides_of_the_limit(spark):
    from condmon.operators.spectrum import spectrum_wide
    rows = [("r", i, 98765.4321, float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "recording_id string, pos bigint, a double, b double")
    for limit in (1000, 100):
        r = spectrum_wide(df, 1000.0, ["a", "b"], share=True, limit=limit).selectExpr("sum(a) AS a", "sum(b) AS b").first()
        assert r["a"] == 0 and abs(r["b"] - 1) < 1e-9


def test_weighted_resample_over_very_many_classes(spark):
    many = 100_000
    df = spark.range(3 * many).selectExpr("id", "CASE WHEN id < 2 * 100000 THEN id % 100000 ELSE -1 END AS c")
    out = weighted_resample(df, "c", {-1: 0.0, 5: 1000.0, 6: 1000.0}, 60_000, 3, [F.col("id")])
    counts = {r["c"]: r["n"] for r in out.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(counts.values()) == 60_000 and out.select("draw").distinct().count() == 60_000 and -1 not in counts
    # masses: 2000 each of 203996 for two classes, 2 for each of the others
    assert all(abs(counts[c] - 60_000 * 2000 / 203_996) < 150 for c in (5, 6))
    assert len(counts) > 40_000 and max(n for c, n in counts.items() if c not in (5, 6)) < 12
    halves = sum(n for c, n in counts.items() if c >= many // 2) / 60_000
    assert abs(halves - 100_000 / 203_996) < 0.02
