"""Ridge from triangles: large offsets, outlying groups, merges, NULL groups, subsets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from condmon.evaluate import regress as rg, triangles as tr


def plain(x, y, alpha=1.0):
    """Ridge on imputed, standardised columns, in extended precision up to the solve."""
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    m = np.array([c[~np.isnan(c)].mean() if (~np.isnan(c)).any() else 0 for c in x.T])
    z = np.where(np.isnan(x), 0, x - m)
    s = np.sqrt((z ** 2).mean(0))
    s[s == 0] = 1
    z = (z / s).astype(float)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()).astype(float))
    return lambda q: np.where(np.isnan(q), 0, (q.astype(np.longdouble) - m) / s).astype(float) @ w + float(y.mean())


@pytest.fixture(scope="module")
def offset(spark):
    rng = np.random.default_rng(2)
    n = 180
    x = rng.normal(0, 1, (n, 3)) + [1e8, 0, -5]
    x[rng.random((n, 3)) < .1] = np.nan
    y = 200 + 20 * np.nan_to_num(x[:, 0] - 1e8) - 7 * np.nan_to_num(x[:, 1]) + rng.normal(0, 1, n)
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["y"], pdf["id"], pdf["g"], pdf["type"], pdf["k"] = y, np.arange(n), np.array(["p", "q", None, "r"])[np.arange(n) % 4], "adhesion", 3.0
    df = spark.createDataFrame(pdf)
    for c in "abc":
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df.repartition(4).persist(), pdf


def test_large_offsets_cost_no_digits(offset):
    df, pdf = offset
    train = pdf.id < 120
    x = pdf[list("abc")].to_numpy()
    want = plain(x[train], pdf.y.to_numpy()[train])(x)
    got = rg.fit_ridge(df, list("abc"), "y", F.col("id") < 120, clip=None).transform(df).orderBy("id").toPandas()["pred"]
    assert np.abs(got - want).max() < 1e-5
    folds = rg.fit_ridges(df, [["b"], ["a", "k", "c"], []], "y", F.col("id") < 120, clip=None)
    assert folds[2].ridge.intercept == pytest.approx(pdf.y[train].mean())
    want = plain(x[train][:, [0, 2]], pdf.y.to_numpy()[train])(x[:, [0, 2]])
    assert np.abs(folds[1].transform(df).orderBy("id").toPandas()["pred"] - want).max() < 1e-5 and folds[1].ridge.coef[1] == 0


def test_every_group_left_out_null_included(offset):
    df, pdf = offset
    got = rg.leave_group_out(df, "g", list("abc"), "y", clip=None)[0].orderBy("id").toPandas()
    x, y, g = pdf[list("abc")].to_numpy(), pdf.y.to_numpy(), pdf.g.fillna("none").to_numpy()
    assert len(got) == len(pdf)
    for name in ("p", "q", "none", "r"):
        assert np.abs(got["pred"].to_numpy()[g == name] - plain(x[g != name], y[g != name])(x[g == name])).max() < 1e-5


def test_a_group_far_away_does_not_spoil_the_others(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (90, 2))
    x[:30] += 1e9
    y = x[:, 1] * 3 + rng.normal(0, .1, 90)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "g": np.arange(90) // 30, "type": "adhesion", "id": np.arange(90)}))
    got = rg.leave_group_out(df, "g", ["a", "b"], "y", clip=None)[0].filter("g = 0").orderBy("id").toPandas()["pred"]
    want = plain(x[30:], y[30:])(x[:30])
    assert np.allclose(got, want, rtol=1e-5)


def test_buckets_and_merges_change_nothing(offset, monkeypatch):
    df, _ = offset
    many = df.withColumn("g", F.col("id") % 30)
    once = {r["g"]: r for r in tr.left_out(tr.triangles(many, "g", list("abc"), "y"), 1).collect()}
    monkeypatch.setattr(tr, "FLUSH", 2)
    again = tr.left_out(tr.triangles(many.repartition(7), "g", list("abc"), "y"), 7).collect()
    assert len(again) == 30
    for r in again:
        assert np.allclose(r["coef"], once[r["g"]]["coef"], rtol=1e-6) and np.allclose(r["fill"], once[r["g"]]["fill"])


def test_edges(spark):
    empty = spark.createDataFrame([], "g string, a double, y double")
    assert rg.fold_coefficients(empty, "g", ["a"], "y").count() == 0
    single = spark.createDataFrame([("p", 1.0, 2.0), ("p", None, None)], "g string, a double, y double")
    assert rg.fold_coefficients(single, "g", ["a"], "y").count() == 0  # nobody else to learn from
    with pytest.raises(ValueError, match="no training row"):
        rg.fit_ridge(empty, ["a"], "y", F.lit(True))
