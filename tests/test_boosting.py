"""Histogram boosting: brute force, one block against many, folds against single fits, missing values, edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from condmon.evaluate import boosting as bo, regress as rg
from condmon.plans import study

ALL = {"row_share": 1.0, "feature_share": 1.0}


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    n = 200
    x = np.round(rng.normal(0, 1, (n, 4)), 2)
    x[rng.random((n, 4)) < .1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["y"] = 150 + np.nan_to_num(x) @ [20, -5, 100, 3] + 30 * np.isnan(x[:, 0]) + rng.normal(0, 3, n)
    pdf["id"], pdf["g"], pdf["type"] = np.arange(n), np.array(["x", "y", "z"])[np.arange(n) % 3], "adhesion"
    df = spark.createDataFrame(pdf)
    for c in "abcd":
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df.repartition(3).persist(), pdf


def fit(df, **settings):
    return bo.fit_boosters(df, list("abcd"), "y", "id", [list("abcd")], settings=bo.Settings(**settings))


def plain_trees(x, y, fitting, s, low_high):
    """Rounds of boosting by looking at every cut of every node, row by row; x holds bins."""
    def median(values, low, high):
        place = np.minimum(((values - low) / (high - low) * bo.MEDIAN_BINS).astype(int), bo.MEDIAN_BINS - 1)
        count = np.bincount(place, minlength=bo.MEDIAN_BINS)
        at = int((2 * np.cumsum(count) >= len(values)).argmax())
        inside = (len(values) / 2 - count[:at].sum()) / count[at]
        return low + (at + inside) * (high - low) / bo.MEDIAN_BINS

    margin = np.full(len(y), median(y[fitting], y[fitting].min(), y[fitting].max()))
    for _ in range(s.rounds):
        resid = y - margin
        low, high = resid[fitting].min(), resid[fitting].max()

        def grow(rows, depth):
            inside = rows[fitting[rows]]
            best = (1e-9, None)
            g_all = np.sign(resid[inside]).sum() ** 2 / (len(inside) + s.l2)
            for f in range(x.shape[1]) if depth else ():
                for left in (0, 1):
                    for cut in range(1, x[:, f].max() + 1):
                        goes_left = np.where(x[:, f] == 0, left == 1, x[:, f] <= cut)
                        a, b = inside[goes_left[inside]], inside[~goes_left[inside]]
                        if min(len(a), len(b)) >= s.min_leaf:
                            gain = sum(np.sign(resid[p]).sum() ** 2 / (len(p) + s.l2) for p in (a, b)) - g_all
                            if gain > best[0] + 1e-9:
                                best = (gain, goes_left)
            if best[1] is None:
                margin[rows] += s.step * (median(resid[inside], low, high) if len(inside) else 0.0)
                return
            grow(rows[best[1][rows]], depth - 1)
            grow(rows[~best[1][rows]], depth - 1)
        grow(np.arange(len(y)), s.depth)
    return margin


def test_against_brute_force(noisy):
    df, pdf = noisy
    s = bo.Settings(rounds=3, depth=2, step=0.5, **ALL)
    fitted = fit(df, rounds=3, depth=2, step=0.5, **ALL)
    x = bo.binned(pdf[list("abcd")].to_numpy(), fitted.edges)
    u = np.array([r["u"] for r in df.select("id", F.xxhash64("id").alias("u")).orderBy("id").collect()]).view(np.uint64)
    fitting = bo.share(u, s.seed) >= fitted.models[0].es_share
    assert 0.75 < fitting.mean() < 0.95
    want = plain_trees(x, pdf["y"].to_numpy(), fitting, s, None)
    got = fitted.predict(df, "p", F.lit(0)).orderBy("id").toPandas()["p"]
    assert len(fitted.models[0].trees) == 4 and np.allclose(got, want, atol=1e-9)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(
        (p.feature == q.feature).all() and (p.cut == q.cut).all() and (p.left == q.left).all() and np.allclose(p.value, q.value)
        for p, q in zip(a.trees, b.trees))


def test_many_blocks_and_stored_margins_change_nothing(noisy, monkeypatch):
    df, _ = noisy
    alone = fit(df, rounds=5, depth=3, step=0.3)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 37)
    monkeypatch.setattr(bo, "KEPT", 2)
    monkeypatch.setattr(bo, "TOGETHER", 2)
    together = fit(df, rounds=5, depth=3, step=0.3)
    assert same(alone.models[0], together.models[0]) and alone.models[0].gains == pytest.approx(together.models[0].gains)


def test_folds_equal_single_fits(noisy):
    df, pdf = noisy
    preds, folds, pooled = rg.leave_group_out_boosted(df, "g", list("abcd"), "y", "id", rounds=40, step=0.2)
    assert {r["g"]: r["n"] for r in folds.collect()} == pdf.groupby("g").size().to_dict() and pooled.first()["n"] == len(pdf)
    numbered = df.withColumn("fold", F.when(F.col("g") == "x", 0).when(F.col("g") == "y", 1).otherwise(2))
    joint = bo.fit_boosters(numbered, list("abcd"), "y", "id", [list("abcd")], F.col("fold"), range(3), settings=bo.Settings(rounds=40, step=0.2))
    for number, g in enumerate("xyz"):
        one = bo.Growing(number, [0, 1, 2, 3], number, joint.models[number].es_share, bo.Settings(rounds=40, step=0.2), joint.models[number].bins)
        pdf_block = {"n": len(pdf), "x": bo.binned(pdf[list("abcd")].to_numpy(), joint.edges).tobytes(), "y": pdf["y"].to_numpy().tobytes(), "margin": None,
                     "u": np.array([r["u"] for r in df.select("id", F.xxhash64("id").alias("u")).orderBy("id").collect()]).tobytes(),
                     "fold": (np.arange(len(pdf)) % 3).astype(np.int32).tobytes()}
        # rows of the fold are changed beyond recognition: the model of the fold does not see them
        changed = pdf["y"].to_numpy().copy()
        changed[pdf["g"] == g] = 1e6
        block = bo.Block({**pdf_block, "y": changed.tobytes()}, 3)
        while not one.done:
            bo.step_alone(block, one)
        assert same(one, joint.models[number])
    err = preds.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    assert err < 0.5 * np.abs(pdf["y"] - pdf["y"].mean()).mean()


def test_patience_ends_training_and_keeps_the_best(noisy):
    df, _ = noisy
    model = fit(df, rounds=3000, patience=20, step=0.5).models[0]
    assert len(model.losses) == len(model.trees) + 20 and int(np.argmin(model.losses)) + 1 == len(model.trees)


def test_missing_values_have_their_own_side(spark):
    rows = [(i, None if i % 2 else float(i % 7), 10.0 + 80 * (i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    fitted = bo.fit_boosters(df, ["a"], "y", "id", [["a"]], settings=bo.Settings(rounds=30, step=0.5, **ALL))
    got = fitted.predict(df, "p", F.lit(0)).orderBy("id").toPandas()
    assert np.abs(got["p"] - got["y"]).max() < 1


def test_edges(spark):
    schema = "id string, a double, y double, p int"
    empty = spark.createDataFrame([], schema)
    fitted = bo.fit_boosters(empty, ["a"], "y", "id", [["a"]])
    some = spark.createDataFrame([("1", None, None, 1), (None, 2.0, 7.0, 1)], schema)
    assert [r["q"] for r in fitted.predict(some, "q", F.lit(0)).collect()] == [None, None]
    single = bo.fit_boosters(some, ["a"], "y", "id", [["a"], []], settings=bo.Settings(rounds=3))
    assert [r["q"] for r in single.predict(some, "q", F.lit(1)).collect()] == [7.0, 7.0]
    constant = spark.createDataFrame([(str(i), 1.0, 5.0, 1) for i in range(40)], schema)
    assert {r["q"] for r in bo.fit_boosters(constant, ["a"], "y", "id", [["a"]], settings=bo.Settings(rounds=3)).predict(
        constant, "q", F.lit(0)).collect()} == {5.0}


def test_gain_names_the_columns_that_count(noisy):
    df, _ = noisy
    model = rg.fit_boosted(df, list("abcd"), "y", F.lit(True), "id", rounds=50, step=0.2)
    assert [r["feature"] for r in study.importance_report(model, 2).collect()] == ["c", "a"]


def test_study_in_one_call(noisy):
    df, _ = noisy
    split = df.withColumn("split", F.when(F.col("id") % 4 == 0, "test").when(F.col("id") % 4 == 1, "val").otherwise("train"))
    methods = [study.Method("ridge_all", "ridge", list("abcd")), study.Method("trees_all", "boosted", list("abcd")), study.Method("trees_d", "boosted", ["d"])]
    made = study.run_study(split, methods, "y", "id", "g", rounds=60, step=0.2)
    assert made.splits.count() == 4 * 3 and made.folds.count() == 4 * 3 and made.pooled.count() == 4
    assert made.best in ("ridge_all", "trees_all") and made.importance.first()["feature"] == "c"
    pooled = {r["method"]: r["overall"] for r in made.pooled.collect()}
    assert pooled["trees_all"] < pooled["trees_d"] and pooled["ridge_all"] < pooled["predict_mean_train"]


def test_rows_of_a_few_blocks_take_no_job_per_step(noisy, monkeypatch):
    df, _ = noisy
    want = fit(df, rounds=4, depth=3, step=0.3)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 60)
    monkeypatch.setattr(bo, "grown_together", None)
    assert same(want.models[0], fit(df, rounds=4, depth=3, step=0.3).models[0])


def test_tables_of_a_block_by_counting(noisy):
    """Signs of all three kinds, missing values, a held-out fold: the tables of every level against rows counted one by one."""
    rng = np.random.default_rng(1)
    n, s = 300, bo.Settings(rounds=2, depth=3, min_leaf=2)
    x, y = rng.integers(0, 6, (n, 3)).astype(np.uint8), rng.integers(0, 4, n).astype(float)
    row = {"n": n, "x": x.tobytes(), "y": y.tobytes(), "u": rng.integers(0, 1 << 62, n).astype(np.uint64).tobytes(),
           "fold": (np.arange(n) % 3).astype(np.int32).tobytes(), "margin": None}
    block, model, seen, zeros = bo.Block(row, 1), bo.Growing(0, [0, 1, 2], 1, 0.2, s, 6), 0, 0
    while not model.done:
        tables, resid = dict(block.tables(model)), y - sum((t(x) for t in model.trees), np.zeros(n))
        level = max(model.level, 0)
        rows = np.flatnonzero((np.arange(n) % 3 != 1) & (bo.share(block.u, s.seed) >= 0.2)
                              & (bo.share(block.u, s.seed + 7919 * len(model.trees)) < s.row_share))
        for f in [f for f in tables if f >= 0]:
            want = np.zeros((2, 2 ** level, 6))
            for i, node in zip(rows, (model.tree or bo.Tree.bare(3)).leaf(x[rows], level)):
                want[:, node, x[i, f]] += np.sign(resid[i]), 1
            assert (tables[f] == want).all()
            seen, zeros = seen + 1, zeros + (resid[rows] == 0).sum()
        bo.step_alone(block, model)
        if len(model.trees) == 1:
            model.trees[0].value[:] = 2.0
    assert seen >= 9 and zeros


def test_alone_only_the_smaller_children_are_counted(monkeypatch):
    """Tables of a model in one block equal those counted in full, and below the root no more than half of the rows are counted."""
    rng = np.random.default_rng(2)
    n, s = 400, bo.Settings(rounds=3, depth=4, min_leaf=2)
    x, y = rng.integers(0, 9, (n, 5)).astype(np.uint8), rng.integers(0, 30, n).astype(float)
    row = {"n": n, "x": x.tobytes(), "y": y.tobytes(), "u": rng.integers(0, 1 << 62, n).astype(np.uint64).tobytes(),
           "fold": (np.arange(n) % 4).astype(np.int32).tobytes(), "margin": None}
    block, model, counted, asked, levels = bo.Block(row, 1), bo.Growing(0, [0, 1, 2, 3, 4], 1, 0.2, s, 9), bo.counted, [], 0
    monkeypatch.setattr(bo, "TOGETHER", 2)
    monkeypatch.setattr(bo, "counted", lambda bins, node, *rest: asked.append(len(node)) or counted(bins, node, *rest))
    while not model.done:
        if block.splitting(model):
            want = {f: bo.summed_up(v) for f, v in block.tables(model) if f >= 0}
            drawn = len(block.sample(model, None)[0])
            asked.clear()
            got = {f: v for part, upto in block.summed(model, block.y - block.catch_up(model)) for f, v in zip(part, upto)}
            assert got.keys() == want.keys() and all((got[f] == want[f]).all() for f in want)
            assert all(a <= drawn / (2 if model.level else 1) for a in asked) and asked
            levels += 1
        bo.step_alone(block, model)
    assert levels >= 12


def test_alone_the_root_counts_only_rows_that_are_not_drawn(monkeypatch):
    """The tables of all rows are kept from round to round: counting starts at the rows that were left out, with signs of all three kinds."""
    rng = np.random.default_rng(3)
    n, s = 400, bo.Settings(rounds=6, depth=2, min_leaf=2, step=0.5)
    x, y = rng.integers(0, 7, (n, 4)).astype(np.uint8), rng.integers(0, 5, n).astype(float)
    row = {"n": n, "x": x.tobytes(), "y": y.tobytes(), "u": rng.integers(0, 1 << 62, n).astype(np.uint64).tobytes(),
           "fold": (np.arange(n) % 4).astype(np.int32).tobytes(), "margin": None}
    block, model, counted, asked, roots = bo.Block(row, 1), bo.Growing(0, [3, 0, 2, 1], 1, 0.2, s, 7), bo.counted, [], 0
    monkeypatch.setattr(bo, "counted", lambda bins, node, *rest: asked.append(len(node)) or counted(bins, node, *rest))
    while not model.done:
        if block.splitting(model) and model.level == 0:
            want = {f: bo.summed_up(v) for f, v in block.tables(model) if f >= 0}
            fit, drawn = len(block.halves(model)[0]), len(block.sample(model, None)[0])
            asked.clear()
            got = {f: v for part, upto in block.summed(model, block.y - block.catch_up(model)) for f, v in zip(part, upto)}
            assert all((got[f] == want[f]).all() for f in want) and len(got) == len(want)
            assert asked and max(asked) == fit - drawn < drawn / 2
            roots += 1
        bo.step_alone(block, model)
        if len(model.trees) == 1:
            model.trees[0].value[:] = 2.0   # some residuals are zero
    assert roots >= 3


def test_more_rows_than_a_block_take_no_job_per_step(spark, monkeypatch):
    """300,000 rows, in many blocks: every fold still grows in a task of its own."""
    monkeypatch.setattr(bo, "grown_together", None)
    df = spark.range(300_000, numPartitions=5).select("id", (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                                      (F.col("id") % 2).alias("g"))
    df = df.withColumn("y", 10 * F.col("a") - F.col("b"))
    _, folds, _ = rg.leave_group_out_boosted(df.withColumn("type", F.lit("adhesion")), "g", ["a", "b"], "y", "id", rounds=12, step=0.5)
    assert [(r["g"], r["n"], r["overall"] < 8) for r in folds.orderBy("g").collect()] == [(0, 150_000, True), (1, 150_000, True)]


def test_joined_blocks_hold_the_rows_of_a_fold_once_and_in_one_order():
    rng = np.random.default_rng(6)
    n = 90
    x, y, u = rng.integers(0, 9, (n, 5)).astype(np.uint8), rng.normal(0, 1, n), rng.integers(0, 1 << 62, n).astype(np.uint64)
    fold = (np.arange(n) % 3).astype(np.int32)

    def rows(*cuts):
        for a, b in zip((0, *cuts), (*cuts, n)):
            yield {"n": b - a, "margin": None, "m": 1} | {c: v[a:b].tobytes() for c, v in zip(("x", "y", "u", "fold"), (x, y, u, fold))}

    one, many = bo.Block.joined(list(rows()), 1), bo.Block.joined(list(rows(40, 41, 70))[::-1], 1)
    assert all((getattr(one, c) == getattr(many, c)).all() for c in ("x", "y", "u", "fold"))
    mine = np.flatnonzero(fold != 1)
    assert (one.u == np.sort(u[mine])).all() and (one.x == x[mine][np.argsort(u[mine])]).all() and not (one.fold == 1).any()


def test_blocks_of_rows_are_full_whatever_the_batches(spark):
    """Blocks of at most `most` rows hold every row once, with its own bins; a batch may be longer than a block."""
    df = spark.range(100, numPartitions=2).selectExpr("CAST(id AS DOUBLE) AS _y", "id AS _u", "0 AS _fold", "CAST(id % 5 AS DOUBLE) AS a")
    edges = [np.array([0.0, 1.0, 2.0, 3.0])]
    rows = bo.row_blocks(df, ["a"], edges, 7).collect()
    assert sorted(r["n"] for r in rows) == [1, 1] + [7] * 14
    blocks = [bo.Block(r.asDict(), 1) for r in rows]
    assert sorted(np.concatenate([b.y for b in blocks])) == list(range(100))
    assert all((b.x[:, 0] == b.y % 5 + 1).all() and (b.u == b.y).all() for b in blocks)


def test_pairs_of_features_give_bins_and_nodes_of_the_rows():
    """An odd number of features, in any order; trees walk pairs as they walk rows, in more than one piece."""
    rng = np.random.default_rng(7)
    n = bo.PIECE + 300
    x = rng.integers(0, bo.BINS, (n, 5)).astype(np.uint8)
    block = bo.Block({"n": n, "x": x.tobytes(), "y": np.zeros(n).tobytes(), "u": np.zeros(n, np.uint64).tobytes(),
                      "fold": np.zeros(n, np.int32).tobytes(), "margin": None}, 1)
    tree = bo.Tree(rng.integers(-1, 5, 31), rng.integers(0, 255, 31), rng.integers(0, 2, 31), rng.normal(0, 1, 32))
    plain = tree.leaf(x, 5)
    block.pack()
    rows = np.sort(rng.choice(n, 200, replace=False))
    assert all((b == x[rows, f]).all() for f, b in zip([4, 0, 1, 3], block.bins([4, 0, 1, 3], rows)))
    assert (tree.leaf(np.asfortranarray(x), 5) == plain).all()
    node, packed = np.zeros(n, int), np.zeros(n, int)   # row by row, without tables
    for level in range(5):
        packed = tree.down(block.x, packed, level)
        at = 2 ** level - 1 + node
        b = x[np.arange(n), tree.feature[at]]
        node = 2 * node + ((tree.feature[at] >= 0) & np.where(b == 0, tree.left[at] == 0, b > tree.cut[at]))
    assert (node == plain).all() and (packed == plain).all()


def test_a_few_rows_go_down_many_trees_at_once():
    rng = np.random.default_rng(8)
    trees = [bo.Tree.bare(3)] + [bo.Tree(rng.integers(-1, 4, 7), rng.integers(0, 255, 7), rng.integers(0, 2, 7), rng.normal(0, 1, 8)) for _ in range(40)]
    trees[0].value[:] = 5.0
    for n in (0, 1, bo.PIECE // 15, bo.PIECE + 1):
        x = rng.integers(0, bo.BINS, (n, 4)).astype(np.uint8)
        assert (bo.added_up(bo.stacked(trees), x) == sum(t(x) for t in trees)).all()
    assert (bo.added_up(bo.stacked(trees[:1]), np.zeros((3, 0), np.uint8)) == 5.0).all()
