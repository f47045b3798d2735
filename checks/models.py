"""Checked queries: estimators, physics and reports (survey J and K)."""

from pyspark.sql import functions as F

from checks import standins as s
from checks.profiles import LIFE, MID, THEIL
from checks.registry import query
from condmon.evaluate import errors as er, regress as rg
from condmon.operators.sequence import delta_features
from condmon.physics import score as sc, wear as we
from condmon.plans import eda, reports as rp, study
from condmon.session import stored

SAMP, PARAM, PRED, RUN, LAB = s.SAMP_SQL, s.PARAM_SQL, s.PRED_SQL, s.RUN_SQL, s.LAB_SQL
BY = {"by": "set_id"}

# ---- J10 wear rates

RATES = f"""{SAMP}, {PARAM}, {MID}, {THEIL.format(src='mid')},
rates AS (SELECT set_id, material, Vc, fz, mt AS max_image_id, mw AS max_wear_um, mw / 300.0 AS frac_of_failure,
    slope AS slope_raw_um_per_pass, greatest(slope, 0) AS slope_um_per_pass, slope < 0 AS slope_clamped, intercept AS intercept_um,
    0.15 * mt AS window_lo_id, 0.85 * mt AS window_hi_id, n_window, set_id IN (6, 17) AS caution
    FROM mx JOIN cnt USING (set_id) JOIN lines USING (set_id) JOIN params USING (set_id) WHERE n >= 4 AND set_id <> 1)"""
RATE_COLS = ("set_id, material, max_image_id, max_wear_um, frac_of_failure, slope_raw_um_per_pass, slope_um_per_pass, slope_clamped, "
             "intercept_um, window_lo_id, window_hi_id, n_window, caution")
RATE_DBL = "max_image_id max_wear_um frac_of_failure slope_raw_um_per_pass slope_um_per_pass intercept_um window_lo_id window_hi_id"


def rates(spark, sf, **kw):
    """Records as a stored table: one row per set, used several times by what follows."""
    return stored(fresh_rates(spark, sf, **kw), "rates")


def fresh_rates(spark, sf, **kw):
    return we.wear_rates(s.samples(spark, sf), s.params(spark, sf), **(BY | kw))


@query("J10_wear_rates", f"WITH {RATES} SELECT {RATE_COLS} FROM rates", RATE_DBL)
def j10(spark, sf):
    return fresh_rates(spark, sf).select(*RATE_COLS.split(", "))


LIT = "CASE WHEN material = 'CK45' THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END"
SIMPLE = f"""rec AS (SELECT *, ln(Vc) AS lv, ln(300.0 / slope_um_per_pass) AS lt FROM rates WHERE slope_um_per_pass > 1e-4),
fit AS (SELECT material, count(*) AS n_sets, count(DISTINCT round(Vc, 3)) AS n_distinct_vc, regr_slope(lt, lv) AS b, regr_intercept(lt, lv) AS a,
    regr_r2(lt, lv) AS r, median(Vc) AS mv, median(slope_um_per_pass) AS mk FROM rec GROUP BY material),
consts AS (SELECT material, CASE WHEN n_distinct_vc >= 2 AND b < -1e-9 THEN round(-1.0 / b, 6) ELSE {LIT} END AS n,
    round(CASE WHEN n_distinct_vc >= 2 AND b < -1e-9 THEN exp(a * (-1.0 / b)) ELSE mv * pow(300.0 / mk, {LIT}) END, 4) AS c,
    CASE WHEN n_distinct_vc >= 2 AND b < -1e-9 THEN round(r, 4) END AS r2, n_sets, n_distinct_vc,
    CASE WHEN n_distinct_vc >= 2 AND b < -1e-9 THEN 'fitted' ELSE 'literature_n' END AS source FROM fit)"""


@query("J11_tool_life_constants", f"WITH {RATES}, {SIMPLE} SELECT material, n, c, r2, n_sets, n_distinct_vc, source FROM consts", "n c r2", 3)
def j11(spark, sf):
    k = we.tool_life_constants(rates(spark, sf))
    return k.select("material", "n", F.col("C").alias("c"), "r2", "n_sets", "n_distinct_vc", "source")


def ols2_sql(src: str, source: str = "localized_training_fit_90um") -> str:
    """ln Vc ~ ln life + ln fz from covariances (regular design)."""
    return f"""o AS (SELECT material, count(*) AS n_sets, count(DISTINCT round(Vc, 3)) AS n_distinct_vc, var_pop(lt) AS aa, var_pop(lf) AS bb, covar_pop(lt, lf) AS ab,
    covar_pop(lv, lt) AS ya, covar_pop(lv, lf) AS yb, avg(lv) AS y, avg(lt) AS mlt, avg(lf) AS mlf FROM {src} GROUP BY material),
ext AS (SELECT material, -(bb * ya - ab * yb) / (aa * bb - ab * ab) AS n0, -(aa * yb - ab * ya) / (aa * bb - ab * ab) AS m0, y, mlt, mlf, n_sets, n_distinct_vc FROM o),
consts AS (SELECT material, round(n0, 4) AS n, round(m0, 4) AS m, round(exp(y + n0 * mlt + m0 * mlf), 4) AS c, n_sets, n_distinct_vc, '{source}' AS source FROM ext)"""


@query("J12_extended_constants", f"""WITH {RATES}, src AS (SELECT material, Vc, ln(Vc) AS lv, ln(300.0 / slope_um_per_pass) AS lt, ln(fz) AS lf FROM rates
    WHERE slope_um_per_pass > 0 AND Vc > 0), {ols2_sql('src')} SELECT * FROM consts""", "n m c", 3)
def j12(spark, sf):
    return we.tool_life_constants(rates(spark, sf), "rate_feed").withColumnRenamed("C", "c")


@query("J13_life_crossing_constants", f"""WITH {RATES}, {LIFE.format(thr='90.0')}, src AS (SELECT material, Vc, ln(Vc) AS lv, ln(life) AS lt, ln(fz) AS lf
    FROM rates JOIN life USING (set_id) WHERE life > 0 AND Vc > 0), {ols2_sql('src', 'life_at_90um_crossing')} SELECT * FROM consts""", "n m c", 3)
def j13(spark, sf):
    r = rates(spark, sf, failure_um=90.0, with_life=True)
    return we.tool_life_constants(r, "life_feed", 90.0).withColumnRenamed("C", "c")


PREDICT = f"""{SIMPLE}, tay AS (SELECT rates.*, pow(c / Vc, 1.0 / n) AS T_taylor, 300.0 / pow(c / Vc, 1.0 / n) AS ts FROM rates LEFT JOIN consts USING (material)),
icp AS (SELECT mid.set_id, median(wear - ts * t) AS ti FROM mid JOIN tay USING (set_id) WHERE ts IS NOT NULL GROUP BY mid.set_id),
full_sets AS (SELECT tay.*, ti FROM tay LEFT JOIN icp USING (set_id))"""


@query("J14_predict_life", f"WITH {RATES}, {PREDICT} SELECT set_id, T_taylor AS life, ts AS slope, ti AS intercept FROM full_sets", "life slope intercept", 5)
def j14(spark, sf):
    r = rates(spark, sf)
    p = we.predict_life(r, we.tool_life_constants(r), samples=s.samples(spark, sf), **BY)
    return p.select("set_id", F.col("T_taylor").alias("life"), F.col("taylor_slope_um_per_pass").alias("slope"),
                    F.col("taylor_intercept_um").alias("intercept"))


@query("J14_predict_life_extended", f"""WITH {RATES}, src AS (SELECT material, Vc, ln(Vc) AS lv, ln(300.0 / slope_um_per_pass) AS lt, ln(fz) AS lf FROM rates
    WHERE slope_um_per_pass > 0 AND Vc > 0), {ols2_sql('src')}
    SELECT set_id, (ln(c) - ln(Vc) - m * ln(fz)) / n AS log_life FROM rates LEFT JOIN consts USING (material)""", "log_life", 5)
def j14e(spark, sf):
    r = rates(spark, sf)
    p = we.predict_life(r, we.tool_life_constants(r, "rate_feed"), "rate_feed")
    return p.select("set_id", F.ln("T_taylor").alias("log_life"))


@query("J15_log_design_rank")
def j15(spark, sf):
    return we.log_design_rank(s.params(spark, sf))


@query("J15_rank_of_known_designs", """SELECT * FROM (VALUES ('constant', 3, 4), ('nearly constant', 4, 4), ('proportional', 3, 4), ('full', 4, 4))
    t(material, rank, full_rank) WHERE (SELECT count(*) FROM lineitem) > 100""")
def j15_known(spark, sf):
    """Designs whose rank is known: a constant column, one that varies by a millionth, two proportional ones, and none of these."""
    li = s.table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("p"), F.col("l_quantity").cast("double").alias("q"),
                                               (F.col("l_partkey") % 97 + 1).cast("double").alias("k"))
    kinds = F.array(*[F.struct(F.lit(name).alias("material"), vc.alias("Vc"), fz.alias("fz")) for name, vc, fz in (
        ("constant", F.lit(120.5), F.col("q")), ("nearly constant", 120.5 * (1 + F.col("k") * 1e-6), F.col("q")),
        ("proportional", F.col("q") * 3, F.col("q")), ("full", F.col("k"), F.col("q")))])
    return we.log_design_rank(li.select(F.inline(kinds), F.col("p").alias("Ap")))


@query("J10_J14_fit_tool_life", f"""WITH raw AS (WITH {SAMP} SELECT * FROM samp), samp AS (SELECT set_id, t, least(wear, 450.0) AS wear FROM raw
    WHERE set_id IN (1, 2, 5, 7, 8, 10, 11, 12, 13)), {RATES.replace(SAMP + ', ', '')}, {PREDICT}
    SELECT set_id, T_taylor AS life, ts AS slope, ti AS intercept FROM full_sets""", "life slope intercept", 5)
def j10_fit(spark, sf):
    _, sets, _ = we.fit_tool_life(s.samples(spark, sf), s.params(spark, sf), by="set_id")
    return sets.select("set_id", F.col("T_taylor").alias("life"), F.col("taylor_slope_um_per_pass").alias("slope"),
                       F.col("taylor_intercept_um").alias("intercept"))


def _scored_sets(spark, sf, taylor):
    r = rates(spark, sf)
    return we.predict_life(r, we.tool_life_constants(r), samples=s.samples(spark, sf), **BY) if taylor else r


@query("J16_expected_wear", f"""WITH {RATES}, {PRED} SELECT rowno, epoch, preds.set_id, CASE WHEN intercept_um IS NOT NULL THEN greatest(0, least(300.0, slope_um_per_pass * t + intercept_um)) / 1000 END AS expected_norm
    FROM preds LEFT JOIN rates USING (set_id)""", "expected_norm", 7)
def j16(spark, sf):
    return sc.expected_wear(s.preds(spark, sf), _scored_sets(spark, sf, False), **BY).select("rowno", "epoch", "set_id", "expected_norm")


TAYLOR_LINE = "CASE WHEN ts > 0 AND ti IS NOT NULL THEN ts * t + ti ELSE slope_um_per_pass * t + intercept_um END"


@query("J16_expected_wear_taylor", f"""WITH {RATES}, {PREDICT}, {PRED} SELECT rowno, epoch, preds.set_id, CASE WHEN intercept_um IS NOT NULL THEN greatest(0, least(300.0, {TAYLOR_LINE})) / 1000 END AS expected_norm
    FROM preds LEFT JOIN full_sets USING (set_id)""", "expected_norm", 7)
def j16t(spark, sf):
    return sc.expected_wear(s.preds(spark, sf), _scored_sets(spark, sf, True), True, **BY).select("rowno", "epoch", "set_id", "expected_norm")


def score_sql(line, sets, where="TRUE", one_sided=False):
    gap = f"pred_norm - greatest(0, least(300.0, {line})) / 1000"
    gap = f"greatest(0, {gap})" if one_sided else gap
    return f"""j AS (SELECT epoch, CASE WHEN set_id IN (6, 17) THEN 0.5 ELSE 1.0 END AS w, {gap} AS d, set_id <> 1 AND {where}
        AND t BETWEEN 0.15 * max_image_id AND 0.85 * max_image_id AS ok FROM preds LEFT JOIN {sets} USING (set_id))
    SELECT epoch, count(*) FILTER (ok) AS n_rows, 0.5 * least(1.0, (epoch + 1) / 4.0) AS lam,
        0.5 * least(1.0, (epoch + 1) / 4.0) * coalesce(sum(w * d * d) FILTER (ok) / greatest(sum(w) FILTER (ok), 1e-12), 0) AS physics_loss FROM j GROUP BY epoch"""


@query("J17_physics_score", f"WITH {RATES}, {PRED}, {score_sql('slope_um_per_pass * t + intercept_um', 'rates')}", "lam physics_loss", 9)
def j17(spark, sf):
    return sc.physics_score(s.preds(spark, sf), _scored_sets(spark, sf, False), 0.5, **BY)


@query("J17_physics_score_ceiling", f"""WITH {RATES}, {PREDICT}, {PRED}, {score_sql(TAYLOR_LINE, 'full_sets', "material = 'RVS 304'", True)}""", "lam physics_loss", 8)
def j17c(spark, sf):
    return sc.physics_score(s.preds(spark, sf), _scored_sets(spark, sf, True), 0.5, apply_to="rvs", one_sided=True, use_taylor=True, **BY)


RATE_TABLE = f"""{SIMPLE}, ktab AS (SELECT set_id, params.material, Vc, CASE WHEN Vc > 0 AND c IS NOT NULL THEN 300.0 / pow(c / Vc, 1.0 / n) ELSE 0 END AS k
    FROM params LEFT JOIN consts USING (material))"""


def _ktab(spark, sf):
    return sc.rate_table(s.params(spark, sf), we.tool_life_constants(rates(spark, sf)), **BY)


@query("J18_rate_table", f"WITH {RATES}, {RATE_TABLE} SELECT set_id, material, Vc AS vc, k FROM ktab", "vc k", 5)
def j18(spark, sf):
    return _ktab(spark, sf).withColumnRenamed("Vc", "vc")


BOUNDED = f"""{RATE_TABLE}, {PRED}, bd AS (SELECT rowno, epoch, preds.set_id, greatest(0, least(300.0, coalesce(k, 0) * t)) AS anchor_um, 40.0 * tanh(raw) AS correction_um
    FROM preds LEFT JOIN ktab USING (set_id))"""


@query("J19_J20_bounded_prediction", f"WITH {RATES}, {BOUNDED} SELECT *, (anchor_um + correction_um) / 1000 AS pred_norm FROM bd", "anchor_um correction_um pred_norm", 5)
def j20(spark, sf):
    b = sc.bounded_prediction(s.preds(spark, sf).drop("pred_norm"), _ktab(spark, sf), 40.0, **BY)
    return b.select("rowno", "epoch", "set_id", "anchor_um", "correction_um", "pred_norm")


@query("J21_recommend_band", f"""WITH {RATES}, {RATE_TABLE} SELECT quantile_cont(abs(wear - greatest(0, least(300.0, coalesce(k, 0) * t))), 0.95) AS band_um
    FROM samp LEFT JOIN ktab USING (set_id)""", "band_um", 5)
def j21(spark, sf):
    return sc.recommend_band(s.samples(spark, sf), _ktab(spark, sf), **BY)


@query("J22_band_diagnostics", f"""WITH {PRED} SELECT epoch, avg(abs(40.0 * tanh(raw))) AS corr_abs_um, avg(CASE WHEN abs(40.0 * tanh(raw)) > 0.95 * 40.0 THEN 1.0 ELSE 0.0 END) AS sat_frac,
    count(*) AS n FROM preds GROUP BY epoch""", "corr_abs_um sat_frac")
def j22(spark, sf):
    p = s.preds(spark, sf).withColumn("correction_um", 40.0 * F.tanh("raw"))
    return sc.band_diagnostics(p, 40.0, ["epoch"])


# ---- estimators

NAMES = [f"f{i}" for i in range(64)]


def vectors(spark, sf):
    """Embeddings as feature rows: group = class label, target from three dimensions, split by id."""
    df, _ = rg.array_columns(s.table(spark, sf, "embeddings"), "embedding", 64)
    y = 200 + 300 * F.col("f0") - 200 * F.col("f1") + 150 * F.col("f2") * F.col("f3")
    kind = F.when(F.col("vec_id") % 3 == 0, "flank_wear").when(F.col("vec_id") % 3 == 1, "adhesion").otherwise("flank_wear+adhesion")
    return df.select("vec_id", F.col("label").alias("set_id"), *NAMES, y.alias("wear"), kind.alias("type"),
                     F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "val").otherwise("test").alias("split"))


VEC = """vec AS (SELECT vec_id, label AS set_id, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1,
    200 + 300 * CAST(embedding[1] AS DOUBLE) - 200 * CAST(embedding[2] AS DOUBLE) + 150 * CAST(embedding[3] AS DOUBLE) * CAST(embedding[4] AS DOUBLE) AS wear,
    CASE vec_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM embeddings)"""
# one feature: standardised slope is Sxy / (Sxx + alpha * var) in raw units
RIDGE1 = """{pre}b AS (SELECT {key} avg(f0) AS mx, avg(wear) AS my, count(*) * covar_pop(f0, wear) / (count(*) * var_pop(f0) + var_pop(f0)) AS b FROM {src} {group})"""


@query("J2_ridge_one_feature", f"""WITH {VEC}, tr AS (SELECT * FROM vec WHERE split = 'train'), {RIDGE1.format(pre='', key='', src='tr', group='')}
    SELECT vec_id, greatest(0, least(450.0, my + b * (f0 - mx))) AS pred FROM vec, b""", "pred", 5)
def j2(spark, sf):
    df = vectors(spark, sf)
    return rg.fit_ridge(df, ["f0"], "wear", F.col("split") == "train").transform(df).select("vec_id", "pred")


RIDGE2 = """SELECT avg(f0) AS m0, avg(f1) AS m1, avg(wear) AS my, stddev_pop(f0) AS s0, stddev_pop(f1) AS s1, count(*) + 1.0 AS d,
    regr_count(f1, f0) * covar_pop(f0, f1) / (stddev_pop(f0) * stddev_pop(f1)) AS o,
    count(*) * covar_pop(f0, wear) / stddev_pop(f0) AS y0, count(*) * covar_pop(f1, wear) / stddev_pop(f1) AS y1 FROM {src}"""
LINE2 = "my + (d * y0 - o * y1) / (d * d - o * o) * (f0 - m0) / s0 + (d * y1 - o * y0) / (d * d - o * o) * (f1 - m1) / s1"


@query("J2_ridge_two_features", f"""WITH {VEC}, g AS ({RIDGE2.format(src="vec WHERE split = 'train'")})
    SELECT vec_id, greatest(0, least(450.0, {LINE2})) AS pred FROM vec, g""", "pred", 5)
def j2c(spark, sf):
    df = vectors(spark, sf)
    return rg.fit_ridge(df, ["f0", "f1"], "wear", F.col("split") == "train").transform(df).select("vec_id", "pred")


@query("J2_ridge_all_features")
def j2b(spark, sf):
    df = vectors(spark, sf)
    return rg.fit_ridge(df, NAMES, "wear", F.col("split") == "train").transform(df).select("vec_id", "pred")


@query("J3_boosted_trees")
def j3(spark, sf):
    df = vectors(spark, sf)
    model = rg.fit_boosted(df, NAMES, "wear", F.col("split") == "train", "vec_id", step=0.2, patience=50)
    return er.error_by_class(model.transform(df), "pred", "wear", keys=["split"])


@query("J3_boosted_beats_mean", f"""WITH {VEC} SELECT split, count(*) AS n, avg(abs(wear - (SELECT avg(wear) FROM vec WHERE split = 'train'))) AS mean_error,
    true AS better FROM vec GROUP BY split""", "mean_error")
def j3_better(spark, sf):
    """On every split, unseen ones included, trees of all columns are better than the mean."""
    df, train = vectors(spark, sf), F.col("split") == "train"
    scored = er.mean_baseline(rg.fit_boosted(df, NAMES, "wear", train, "vec_id", step=0.2, patience=50).transform(df), "wear", train, "mean")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("wear") - F.col("mean"))).alias("mean_error"),
                                       (F.avg(F.abs(F.col("wear") - F.col("pred"))) < F.avg(F.abs(F.col("wear") - F.col("mean")))).alias("better"))


@query("J4_mean_baseline", f"""WITH {VEC} SELECT split, avg(abs(wear - (SELECT avg(wear) FROM vec WHERE split = 'train'))) AS overall, count(*) AS n
    FROM vec GROUP BY split""", "overall")
def j4(spark, sf):
    df = er.mean_baseline(vectors(spark, sf), "wear", F.col("split") == "train")
    return er.error_by_class(df, "pred", "wear", keys=["split"]).select("split", "overall", "n")


# Blocks of two dimensions each, the same minus the mean of a set's first rows, and one parameter that some sets lack.
STUDY_BLOCKS = {"v1": (0, 1), "v2": (2, 3), "v3": (4, 5), "v4": (6, 7)}
STUDY_METHODS = study.method_matrix(["a", "b"], ["a", "b"], ["cut"])


def study_rows(spark, sf):
    """vectors() with the columns of a study: v1_a, v1_b .. v4_b, their deltas d_*, and one parameter `cut` that sets 0 to 2 lack."""
    df = vectors(spark, sf)
    plain = {f"{v}_{n}": F.col(f"f{i}") for v, pair in STUDY_BLOCKS.items() for n, i in zip("ab", pair)}
    df = df.select("vec_id", "set_id", "wear", "type", "split", *[c.alias(n) for n, c in plain.items()],
                   F.when(F.col("set_id") > 2, F.col("f8")).alias("cut"))
    deltas = [f"d_{n}" for n in plain]
    return delta_features(df.select("*", *[F.col(n).alias(f"d_{n}") for n in plain]), "set_id", [F.col("vec_id")], deltas, 5)


def study_sql():
    cells = [f"CAST(embedding[{i + 1}] AS DOUBLE) AS {v}_{n}" for v, pair in STUDY_BLOCKS.items() for n, i in zip("ab", pair)]
    names = [f"{v}_{n}" for v in STUDY_BLOCKS for n in "ab"]
    base = ", ".join(f"avg({n}) FILTER (place <= 5) OVER (PARTITION BY set_id) AS base_{n}" for n in names)
    delta = ", ".join(f"{n} - base_{n} AS d_{n}" for n in names)
    parts = [f"""WITH {VEC}, plain AS (SELECT vec.*, row_number() OVER (PARTITION BY vec.set_id ORDER BY vec.vec_id) AS place, {", ".join(cells)}
        FROM vec JOIN embeddings USING (vec_id)), based AS (SELECT *, {base} FROM plain), study AS (SELECT *, {delta} FROM based)"""]
    rows = ["SELECT 'predict_mean_train' AS method, 0 AS position, split, avg(abs(wear - (SELECT avg(wear) FROM vec WHERE split = 'train'))) AS overall, count(*) AS n FROM vec GROUP BY split"]
    for i, m in enumerate(STUDY_METHODS, 1):
        if m.kind == "ridge":
            x = "SELECT vec_id, set_id, split, wear, {} AS f0, {} AS f1 FROM study".format(*m.cols)
            fit = RIDGE2.format(src=f"({x}) WHERE split = 'train'")
            rows.append(f"SELECT '{m.name}', {i}, split, avg(abs(wear - greatest(0, least(450.0, {LINE2})))), count(*) FROM ({x}), ({fit}) GROUP BY split")
        else:
            rows.append(f"SELECT '{m.name}', {i}, split, NULL, count(*) FROM vec GROUP BY split")
    return f"{parts[0]} {' UNION ALL '.join(rows)}"


def _study(spark, sf):
    return stored(study_rows(spark, sf), "study")


@query("J5_method_matrix", study_sql(), "overall", 5)
def j5(spark, sf):
    """All twenty methods and the mean; errors of trees have no SQL."""
    methods = [study.Method("predict_mean_train", "mean"), *STUDY_METHODS]
    res = study.evaluate_methods(_study(spark, sf), methods, "wear", "vec_id", step=0.2, patience=50)
    return res.select("method", "position", "split", F.when(~F.col("method").startswith("boosted"), F.col("overall")).alias("overall"), "n")


@query("J5_J7_study", f"""WITH {VEC} SELECT count(*) FILTER (split = 'train') AS n_train, count(DISTINCT set_id) FILTER (split = 'train') AS n_sets,
    21 AS n_methods, true AS covered, true AS ranked FROM vec""")
def j57(spark, sf):
    """The study in one call: every method on every split, every held-out set and pooled, and the ranked features of the best method."""
    made = study.run_study(_study(spark, sf), STUDY_METHODS, "wear", "vec_id", "set_id", step=0.2, patience=50)
    per_method = made.folds.groupBy("method").agg(F.sum("n").alias("n"), F.countDistinct("set_id").alias("sets"))
    checked = per_method.join(made.pooled.select("method", F.col("n").alias("pooled")), "method")
    one = checked.agg(F.max("n").alias("n_train"), F.max("sets").cast("long").alias("n_sets"), F.count(F.lit(1)).cast("int").alias("n_methods"),
                      ((F.min("n") == F.max("n")) & (F.min("pooled") == F.max("n")) & (F.min("sets") == F.max("sets"))).alias("covered"))
    ranked = made.importance.agg(((F.count(F.lit(1)) > 0) & (F.max("rank") == F.count(F.lit(1)))).alias("ranked"))
    return one.withColumn("ranked", ranked.scalar())


FOLD = f"""WITH {VEC}, fold AS (SELECT v.set_id, count(*) AS n, avg(r.wear) AS my, avg(r.f0) AS mx,
        count(*) * covar_pop(r.f0, r.wear) / (count(*) * var_pop(r.f0) + var_pop(r.f0)) AS b
    FROM (SELECT DISTINCT set_id FROM vec) v JOIN vec r ON r.set_id <> v.set_id GROUP BY v.set_id)"""


@query("J6_leave_one_out_mean", f"{FOLD} SELECT vec.set_id, avg(abs(wear - my)) AS overall, count(*) AS n FROM vec JOIN fold USING (set_id) GROUP BY vec.set_id", "overall")
def j6m(spark, sf):
    return rg.leave_group_out(vectors(spark, sf), "set_id", [], "wear", method="mean")[1].select("set_id", "overall", "n")


@query("J6_leave_one_out_ridge_1", f"""{FOLD} SELECT vec.set_id, avg(abs(wear - greatest(0, least(450.0, my + b * (f0 - mx))))) AS overall, count(*) AS n
    FROM vec JOIN fold USING (set_id) GROUP BY vec.set_id""", "overall")
def j6r(spark, sf):
    return rg.leave_group_out(vectors(spark, sf), "set_id", ["f0"], "wear")[1].select("set_id", "overall", "n")


@query("J6_leave_one_out_ridge_2", f"""WITH {VEC}, g AS (SELECT v.set_id, k.* FROM (SELECT DISTINCT set_id FROM vec) v,
        LATERAL ({RIDGE2.format(src='vec r WHERE r.set_id <> v.set_id')}) k)
    SELECT vec.set_id, avg(abs(wear - greatest(0, least(450.0, {LINE2})))) AS overall, count(*) AS n FROM vec JOIN g USING (set_id) GROUP BY vec.set_id""", "overall")
def j6r2(spark, sf):
    return rg.leave_group_out(vectors(spark, sf), "set_id", ["f0", "f1"], "wear")[1].select("set_id", "overall", "n")


@query("J6_D25_pooled_ridge_1", f"""{FOLD} SELECT avg(abs(wear - greatest(0, least(450.0, my + b * (f0 - mx))))) AS overall, count(*) AS n
    FROM vec JOIN fold USING (set_id)""", "overall")
def j6p(spark, sf):
    return rg.leave_group_out(vectors(spark, sf), "set_id", ["f0"], "wear")[2].select("overall", "n")


@query("J6_leave_one_out_ridge_all")
def j6a(spark, sf):
    return rg.leave_group_out(vectors(spark, sf), "set_id", NAMES, "wear")[1]


@query("J7_gain_importance", "SELECT 2 AS n_strong, true AS signal_first")
def j7g(spark, sf):
    """Gain names the dimensions that the target is made of: the two strongest of 64."""
    df = vectors(spark, sf)
    model = rg.fit_boosted(df, NAMES, "wear", F.lit(True), "vec_id", step=0.2, patience=50)
    top = study.importance_report(model, 2)
    return top.agg(F.count(F.lit(1)).cast("int").alias("n_strong"), F.bool_and(F.col("feature").isin("f0", "f1")).alias("signal_first"))


@query("J6_leave_one_out_trees", f"""WITH {VEC}, folds AS (SELECT set_id, count(*) AS n, sum(wear) AS s FROM vec GROUP BY set_id),
    whole AS (SELECT count(*) AS n, sum(wear) AS s FROM vec)
    SELECT vec.set_id, count(*) AS n, avg(abs(wear - (whole.s - folds.s) / (whole.n - folds.n))) AS mean_error, true AS better
    FROM vec JOIN folds USING (set_id), whole GROUP BY vec.set_id""", "mean_error")
def j6t(spark, sf):
    """Every set predicted by trees of all the others: better than the mean of the others."""
    df = vectors(spark, sf)
    trees = rg.leave_group_out_boosted(df, "set_id", NAMES, "wear", "vec_id", step=0.2, patience=50)[1]
    mean = rg.leave_group_out(df, "set_id", [], "wear", method="mean")[1].select("set_id", F.col("overall").alias("mean_error"))
    return trees.join(mean, "set_id").select("set_id", "n", "mean_error", (F.col("overall") < F.col("mean_error")).alias("better"))


@query("J7_importance")
def j7(spark, sf):
    model = rg.fit_ridge(vectors(spark, sf), NAMES, "wear", F.col("split") == "train")
    return study.importance_report(model)


# ---- K: reports

@query("K1_vision_report", f"""WITH {RUN} SELECT experiment, CASE WHEN seed % 2 = 0 THEN 'b0' END AS backbone, split, overall, flank, adh, fa, n_total FROM runs
    UNION ALL SELECT 'paper_baseline', 'resnet50', 'test', 30.0, 14.0, 39.0, 91.0, NULL""", "overall flank adh fa")
def k1(spark, sf):
    return rp.vision_report(s.runs(spark, sf)).select("experiment", "backbone", "split", "overall", "flank", "adh", "fa", "n_total")


MODE = "CASE WHEN seed % 2 = 0 THEN CASE flag WHEN 'N' THEN 'none' WHEN 'A' THEN 'early' ELSE 'late' END END"
FSET = "CASE WHEN seed % 2 = 0 THEN CASE WHEN seed % 4 = 0 THEN 'top25' ELSE 'raw25' END END"


@query("K2_fusion_report", f"""WITH {RUN} SELECT experiment, {MODE} AS fusion_mode, {FSET} AS feature_set, split, overall, fa, n_total FROM runs
    UNION ALL SELECT 'vision_only_664 (reference)', 'none', 'none', 'test', 19.0, 23.2, 254
    UNION ALL SELECT 'paper_baseline', 'none', 'none', 'test', 30.0, 91.0, 254""", "overall fa")
def k2(spark, sf):
    return rp.fusion_report(s.runs(spark, sf)).select("experiment", "fusion_mode", "feature_set", "split", "overall", "fa", "n_total")


@query("K2_fusion_analysis", f"""WITH {RUN}, t AS (SELECT experiment, {MODE} AS mode, {FSET} AS fs, seed % 2 = 0 AND flag <> 'N' AS sens, overall, fa FROM runs WHERE split = 'test'),
    sc AS (SELECT 'overall' AS scope, 'all' AS name, * FROM t UNION ALL SELECT 'fusion_mode', mode, * FROM t WHERE mode IN ('early', 'intermediate', 'late')
        UNION ALL SELECT 'feature_set', fs, * FROM t WHERE fs IS NOT NULL UNION ALL SELECT 'sensors', 'all', * FROM t WHERE sens)
    SELECT scope, name, arg_min(experiment, overall) AS experiment, min(overall) AS overall, arg_min(fa, overall) AS fa,
        min(overall) - (SELECT arg_min(overall, experiment) FROM t WHERE mode = 'none') AS delta_to_control FROM sc GROUP BY scope, name""", "overall fa delta_to_control")
def k2b(spark, sf):
    return rp.fusion_analysis(s.runs(spark, sf)).select("scope", "name", "experiment", "overall", "fa", "delta_to_control")


@query("K3_stage_report", f"""WITH {RUN}, c AS (SELECT family, split, arg_min(overall, experiment) AS o0, arg_min(adh, experiment) AS a0, arg_min(fa, experiment) AS f0
        FROM runs WHERE experiment LIKE '%ctrl%' GROUP BY family, split)
    SELECT family, experiment, split, lam AS lambda_max, flag = 'A' AS one_sided, CAST(best_epoch AS INTEGER) AS best_epoch, overall, overall - o0 AS d_overall,
        adh - a0 AS d_adh, fa - f0 AS d_fa FROM runs LEFT JOIN c USING (family, split)""", "lambda_max overall d_overall d_adh d_fa")
def k3(spark, sf):
    return rp.stage_report(s.runs(spark, sf)).select("family", "experiment", "split", "lambda_max", "one_sided", "best_epoch", "overall",
                                                     "d_overall", "d_adh", "d_fa")


AGG = ", ".join(f"avg({m}) AS {m}_m, stddev_samp({m}) AS {m}_s" for m in ("overall", "flank", "adh", "fa"))
AGG_DBL = " ".join(f"{m}_{x}" for m in ("overall", "flank", "adh", "fa") for x in "ms")
D_COLS = ", ".join(f"g.{m}_m - c.{m}_m AS d_{m}_m" for m in ("overall", "flank", "adh", "fa"))
D_DBL = " ".join(f"d_{m}_m" for m in ("overall", "flank", "adh", "fa"))


@query("K4_confirm_report", f"""WITH {RUN}, g AS (SELECT family, split, epochs, CASE flag WHEN 'N' THEN 'ctrl' WHEN 'A' THEN 'ceil' ELSE 'sym-T' END AS variant, lam,
        count(DISTINCT seed) AS seeds, {AGG} FROM runs GROUP BY ALL)
    SELECT g.*, {D_COLS} FROM g LEFT JOIN g c ON c.family = g.family AND c.split = g.split AND c.epochs = g.epochs AND c.variant = 'ctrl'""", f"lam {AGG_DBL} {D_DBL}")
def k4(spark, sf):
    return rp.confirm_report(s.runs(spark, sf))


@query("K5_hard_report", f"""WITH {RUN}, g AS (SELECT family, split, CASE flag WHEN 'N' THEN 'ctrl' WHEN 'A' THEN 'hard_C40' ELSE 'hard_C12.5' END AS variant,
        CASE flag WHEN 'N' THEN 0.0 WHEN 'A' THEN 40.0 ELSE 12.5 END AS c_um, count(DISTINCT seed) AS seeds, {AGG} FROM runs GROUP BY ALL)
    SELECT g.*, {D_COLS} FROM g LEFT JOIN g c ON c.family = g.family AND c.split = g.split AND c.variant = 'ctrl'""", f"c_um {AGG_DBL} {D_DBL}")
def k5(spark, sf):
    return rp.hard_report(s.runs(spark, sf)).withColumnRenamed("C", "c_um")


@query("K6_baseline_report", f"WITH {RUN} SELECT family AS run_group, flag || epochs AS config_name, split, count(DISTINCT seed) AS seeds, {AGG} FROM runs GROUP BY ALL", AGG_DBL)
def k6(spark, sf):
    meta = rp.run_meta(s.runs(spark, sf))
    flag = F.when(F.col("variant") == "ctrl", "N").when(F.col("variant") == "ceil", "A").otherwise("R")
    named = meta.withColumns({"run_group": F.col("family"), "config_name": F.concat(flag, "epochs")})
    return rp.baseline_report(named)


PIVOT = ", ".join(f"min(overall) FILTER (seed = {x}) AS s{x}" for x in range(41, 48))
SEED_ROWS = " UNION ALL ".join(
    f"SELECT NULL, '{name}', 'test', NULL, " + ", ".join(f"{v}, NULL" for v in values) + ", NULL" * 7
    for name, *values in (("paper_resnet50", 30.0, 14.0, 39.0, 91.0), ("vision_664_1seed (s42)", 19.0, 16.6, 37.2, 23.2),
                          ("vision_647_1seed (s42)", 22.4, 20.3, 35.1, 27.1), ("t3_gated_md30_1seed(s42)", 21.44, 18.94, 40.13, 25.77)))


@query("K6_three_seed_report", f"""WITH {RUN} SELECT family AS run_group, flag || epochs AS config_name, split, count(DISTINCT seed) AS seeds, {AGG}, {PIVOT}
    FROM runs GROUP BY ALL UNION ALL {SEED_ROWS}""", f"{AGG_DBL} {' '.join(f's{x}' for x in range(41, 48))}")
def k6s(spark, sf):
    meta = rp.run_meta(s.runs(spark, sf))
    flag = F.when(F.col("variant") == "ctrl", "N").when(F.col("variant") == "ceil", "A").otherwise("R")
    named = meta.withColumns({"run_group": F.col("family"), "config_name": F.concat(flag, "epochs")})
    return rp.three_seed_report(named, range(41, 48))


@query("K7_comparison", f"""WITH {RUN} SELECT experiment, split, CAST(best_epoch AS INTEGER) AS best_epoch, overall, flank, adh, fa, n_total FROM runs
    UNION ALL SELECT 'paper_baseline', 'test', NULL, 30.0, 14.0, 39.0, 91.0, NULL""", "overall flank adh fa")
def k7(spark, sf):
    return rp.comparison(s.runs(spark, sf))


@query("K9_eda_bundle_counts", f"""WITH {LAB} SELECT 'splits' AS tab, split AS item, count(*) AS n FROM lab WHERE wear IS NOT NULL GROUP BY split
    UNION ALL SELECT 'type_counts', type, count(*) FROM lab GROUP BY type
    UNION ALL SELECT 'sync_errors', CAST(sid AS VARCHAR), count(*) - count(*) FILTER (both_ok) FROM lab GROUP BY sid
    UNION ALL SELECT 'wear_bins', CASE WHEN wear < 0 THEN NULL WHEN wear < 50 THEN '0–50' WHEN wear < 100 THEN '50–100' WHEN wear < 150 THEN '100–150'
        WHEN wear < 200 THEN '150–200' WHEN wear < 300 THEN '200–300' WHEN wear < 450 THEN '300–450' WHEN wear < 1000 THEN '>450' END, count(*)
        FROM lab WHERE wear IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'stages', stage, count(*) FROM (SELECT unnest([CASE WHEN wear < 80 THEN 'low' END, CASE WHEN wear >= 80 AND wear < 200 THEN 'mid' END,
        CASE WHEN wear >= 200 THEN 'high' END, CASE WHEN type IN ('adhesion', 'flank_wear+adhesion') THEN 'adhesion' END]) AS stage
        FROM lab WHERE wear IS NOT NULL) WHERE stage IS NOT NULL GROUP BY stage
    UNION ALL SELECT 'recordings_per_set', CAST(sid AS VARCHAR), count(*) FROM lab WHERE has_sensor GROUP BY sid
    UNION ALL SELECT 'trajectories', CAST(sid AS VARCHAR), count(wear) FROM lab WHERE wear IS NOT NULL GROUP BY sid
    UNION ALL SELECT 'set_params', CAST(sid AS VARCHAR), count(wear) FROM lab WHERE wear IS NOT NULL GROUP BY sid
    UNION ALL SELECT 'life', CAST(sid AS VARCHAR), count(*) FROM lab WHERE wear IS NOT NULL GROUP BY sid
    UNION ALL SELECT 'wear_histogram', 'all', count(*) FROM lab WHERE wear IS NOT NULL
    UNION ALL SELECT 'wear_histogram_by_type', type, count(*) FROM lab WHERE wear IS NOT NULL GROUP BY type
    UNION ALL SELECT 'wear_histogram_by_split', split, count(*) FROM lab WHERE wear IS NOT NULL GROUP BY split
    UNION ALL SELECT 'integrity', 'total', count(*) FROM lab
    UNION ALL SELECT 'wear_describe', 'count', count(wear) FROM lab""")
def k9(spark, sf):
    b = eda.eda_bundle(stored(s.labels(spark, sf), "labels"), s.params(spark, sf).withColumnRenamed("set_id", "Set"))
    def rows(tab, item, n):
        return b[tab].select(F.lit(tab).alias("tab"), F.col(item).cast("string").alias("item"), F.col(n).alias("n"))

    def summed(tab, item, n):
        return b[tab].groupBy(item.alias("item")).agg(F.sum(n).cast("long").alias("n")).select(F.lit(tab).alias("tab"), "item", "n")

    parts = [rows("splits", "split", "n_samples"), rows("type_counts", "type", "n"), rows("sync_errors", "Set", "sync_errors"),
             rows("wear_bins", "wear_bin", "n"), rows("stages", "stage", "n"), rows("recordings_per_set", "Set", "n_recordings"),
             rows("trajectories", "Set", "n"), rows("set_params", "Set", "n"),
             summed("life", F.col("Set").cast("string"), F.lit(1)),
             summed("wear_histogram", F.lit("all"), F.col("n")), summed("wear_histogram_by_type", F.col("type"), F.col("n")),
             summed("wear_histogram_by_split", F.col("split"), F.col("n")),
             b["integrity"].select(F.lit("integrity").alias("tab"), F.lit("total").alias("item"), F.col("total").alias("n")),
             b["wear_describe"].select(F.lit("wear_describe").alias("tab"), F.lit("count").alias("item"), F.col("count").alias("n"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cells(tab, src, item, metrics):
    return [f"SELECT '{tab}' AS tab, {item} AS item, '{name}' AS metric, CAST({sql} AS DOUBLE) AS value FROM {src}" for name, sql in metrics.items()]


SID, LISTED = "CAST(sid AS VARCHAR)", "octet_length(encode({c})) % 2 = 0"
BUNDLE_CELLS = [
    *_cells("integrity", "lab", "'all'", {
        "both": "count(*) FILTER (both_ok)", "only_image": "count(*) FILTER (has_image AND NOT has_sensor)",
        "only_sensor": "count(*) FILTER (has_sensor AND NOT has_image)", "neither": "count(*) FILTER (NOT has_sensor AND NOT has_image)",
        "missing_label": "count(*) FILTER (wear IS NULL)", "label_min": "min(wear)", "label_max": "max(wear)"}),
    *_cells("wear_describe", "lab", "'all'", {
        "mean": "avg(wear)", "std": "stddev_samp(wear)", "min": "min(wear)", "max": "max(wear)",
        **{f"p{q}": f"quantile_cont(wear, 0.{q})" for q in (10, 25, 50, 75, 90)}}),
    *[f"{c} WHERE wear IS NOT NULL GROUP BY type" for c in _cells("wear_boxes", "lab", "type", {
        "q1": "quantile_cont(wear, 0.25)", "median": "quantile_cont(wear, 0.5)", "q3": "quantile_cont(wear, 0.75)"})],
    *[f"{c} WHERE wear IS NOT NULL GROUP BY sid" for c in _cells("set_params", "lab", SID, {"max": "max(wear)", "mean": "avg(wear)"})],
    *[f"{c} WHERE wear IS NOT NULL GROUP BY split" for c in _cells("splits", "lab", "split", {
        "n_sets": "count(DISTINCT sid)", "wear_mean": "avg(wear)", "wear_std": "stddev_samp(wear)",
        "adhesion_frac": "avg(CASE WHEN type IN ('adhesion', 'flank_wear+adhesion') THEN 1.0 ELSE 0.0 END)"})],
    *_cells("sensor_files", "lab", "'all'", {
        "referenced": "count(sensor_file)", "found": f"count(*) FILTER ({LISTED.format(c='sensor_file')})",
        "missing": f"count(sensor_file) - count(*) FILTER ({LISTED.format(c='sensor_file')})"}),
    *_cells("image_files", "lab", "'all'", {"referenced": "count(image_file)", "found": f"count(*) FILTER ({LISTED.format(c='image_file')})"}),
    *_cells("unknown_params", "params", "'all'", {"n": "count(*) FILTER (Vc IS NULL)"}),
    *_cells("metadata", "(SELECT DISTINCT material, split FROM lab)", "'all'", {"n_distinct": "count(*)"}),
    f"SELECT 'first_mid_last', {SID}, role, sensor_id FROM placed WHERE role IS NOT NULL",
]
PLACED = """ranked AS (SELECT sid, sensor_id, row_number() OVER (PARTITION BY sid ORDER BY sensor_id) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n
    FROM lab WHERE has_sensor), placed AS (SELECT *, CASE WHEN pos = 0 THEN 'first' WHEN pos = n - 1 THEN 'last' WHEN pos = n // 2 THEN 'middle' END AS role
    FROM ranked)"""


@query("K9_eda_bundle_values", f"WITH {LAB}, {PARAM}, {PLACED} {' UNION ALL '.join(BUNDLE_CELLS)}", "value")
def k9v(spark, sf):
    """Tables of the bundle by value, the file checks, unknown parameters, metadata and first, middle and last recordings among them."""
    labels = stored(s.labels(spark, sf), "labels")  # cleaned once, for some twenty tables
    paths = labels.select(F.explode(F.array("ImageFile", "SensorFile")).alias("path")).filter(F.octet_length("path") % 2 == 0)
    b = eda.eda_bundle(labels, s.params(spark, sf).withColumnRenamed("set_id", "Set"), files=paths,
                       metadata=labels.select("material", "split"), sample=None)

    def cells(tab, item, names):
        pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
        return b[tab].select(F.lit(tab).alias("tab"), item.cast("string").alias("item"), pairs)

    one = F.lit("all")
    parts = [
        cells("integrity", one, ["both", "only_image", "only_sensor", "neither", "missing_label", "label_min", "label_max"]),
        cells("wear_describe", one, ["mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90"]),
        cells("wear_boxes", F.col("type"), ["q1", "median", "q3"]), cells("set_params", F.col("Set"), ["max", "mean"]),
        cells("splits", F.col("split"), ["n_sets", "wear_mean", "wear_std", "adhesion_frac"]),
        cells("sensor_files", one, ["referenced", "found", "missing"]), cells("image_files", one, ["referenced", "found"]),
        b["unknown_params"].agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("unknown_params").alias("tab"), one.alias("item"), F.lit("n").alias("metric"), "value"),
        b["metadata"].agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("metadata").alias("tab"), one.alias("item"), F.lit("n_distinct").alias("metric"), "value"),
        b["first_mid_last"].select(F.lit("first_mid_last").alias("tab"), F.col("Set").cast("string").alias("item"), F.col("role").alias("metric"),
                                   F.col("SensorID").cast("double").alias("value"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
