"""Checked queries: joins, aggregations, windows, sort, set operations (survey C to G)."""

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import query
from condmon.constants import CHANNELS, CK45, RVS, WEAR_TYPES
from condmon.evaluate import errors as er
from condmon.evaluate.scaler import Scaler
from condmon.operators import lookup as lk, profile as pf, sequence as sq
from condmon.physics.lines import theil_sen
from condmon.physics.score import recommend_band
from condmon.plans import reports as rp
from condmon.plans.study import channel_importance
from condmon.sources import union_runs

LAB, SAMP, PARAM, PRED, RUN, REC, LONG = (
    s.LAB_SQL, s.SAMP_SQL, s.PARAM_SQL, s.PRED_SQL, s.RUN_SQL, s.REC_SQL, s.LONG_SQL)


# ---- C: joins

@query("C1_set_summary_params", f"""WITH {SAMP}, {PARAM} SELECT set_id, mx, mean, n, material, Vc AS vc FROM
    (SELECT set_id, max(wear) AS mx, avg(wear) AS mean, count(wear) AS n FROM samp GROUP BY set_id) g
    LEFT JOIN params USING (set_id)""", "mx mean vc")
def c1(spark, sf):
    g = pf.group_extremes(s.samples(spark, sf), "set_id", "wear")
    return lk.attach_params(g, s.params(spark, sf), "set_id").select(
        "set_id", F.col("max").alias("mx"), "mean", "n", "material", F.col("Vc").alias("vc"))


@query("C2_attach_params", f"""WITH {PRED}, {PARAM} SELECT rowno, epoch, preds.set_id, material, Vc AS vc, fz
    FROM preds LEFT JOIN params USING (set_id)""", "vc fz")
def c2(spark, sf):
    return lk.attach_params(s.preds(spark, sf), s.params(spark, sf), "set_id").select(
        "rowno", "epoch", "set_id", "material", F.col("Vc").alias("vc"), "fz")


DELTA_SQL = f"""WITH {SAMP}, base AS (SELECT set_id, avg(wear) AS b FROM samp WHERE t <= 3 GROUP BY set_id)
    SELECT rowno, set_id, wear - b AS wear FROM samp JOIN base USING (set_id)"""


@query("C3_J8_delta_features", DELTA_SQL, "wear")
def c3(spark, sf):
    d = sq.delta_features(s.samples(spark, sf), "set_id", [F.col("t"), F.col("rowno")], ["wear"])
    return d.select("rowno", "set_id", "wear")


@query("E1_set_baseline", f"WITH {SAMP} SELECT set_id, avg(wear) AS base_wear FROM samp WHERE t <= 3 GROUP BY set_id", "base_wear")
def e1(spark, sf):
    return sq.set_baseline(s.samples(spark, sf), "set_id", [F.col("t"), F.col("rowno")], ["wear"])


THEIL = """slopes AS (SELECT a.set_id, median((b.wear - a.wear) / (b.t - a.t)) AS slope
    FROM {src} a JOIN {src} b ON a.set_id = b.set_id AND a.t < b.t GROUP BY a.set_id),
lines AS (SELECT r.set_id, coalesce(any_value(slope), 0) AS slope,
    CASE WHEN any_value(slope) IS NULL THEN median(r.wear) ELSE median(r.wear - slope * r.t) END AS intercept
    FROM {src} r LEFT JOIN slopes USING (set_id) GROUP BY r.set_id)"""


@query("C4_J9_theil_sen", f"WITH {SAMP}, {THEIL.format(src='samp')} SELECT set_id, slope, intercept FROM lines", "slope intercept")
def c4(spark, sf):
    return theil_sen(s.samples(spark, sf), ["set_id"], "t", "wear")


MID = """mx AS (SELECT set_id, max(t) AS mt, max(wear) AS mw, count(*) AS n FROM samp GROUP BY set_id),
inw AS (SELECT samp.*, t BETWEEN 0.15 * mt AND 0.85 * mt AS inside FROM samp JOIN mx USING (set_id)),
cnt AS (SELECT set_id, count(*) FILTER (inside) AS n_window FROM inw GROUP BY set_id),
mid AS (SELECT inw.*, n_window FROM inw JOIN cnt USING (set_id) WHERE inside OR n_window < 3)"""


@query("C5_mid_life_rows", f"WITH {SAMP}, {MID} SELECT rowno, set_id, t, wear, n_window FROM mid", "t wear")
def c5(spark, sf):
    return sq.mid_life(s.samples(spark, sf), "set_id", "t").select("rowno", "set_id", "t", "wear", "n_window")


@query("C7_delta_vs_control", f"""WITH {RUN}, g AS (SELECT family, split, epochs, flag, avg(overall) AS overall, avg(fa) AS fa
        FROM runs GROUP BY ALL), c AS (SELECT family, split, epochs, overall AS o0, fa AS f0 FROM g WHERE flag = 'N')
    SELECT family, split, epochs, flag, overall, fa, overall - o0 AS d_overall, fa - f0 AS d_fa
    FROM g LEFT JOIN c USING (family, split, epochs)""", "overall fa d_overall d_fa")
def c7(spark, sf):
    meta = rp.run_meta(s.runs(spark, sf))
    flag = F.when(F.col("variant") == "ctrl", "N").when(F.col("variant") == "ceil", "A").otherwise("R")
    g = meta.groupBy("family", "split", "epochs", flag.alias("flag")).agg(F.avg("overall").alias("overall"), F.avg("fa").alias("fa"))
    return lk.delta_vs_control(g, ["family", "split", "epochs"], ["overall", "fa"], F.col("flag") == "N")


@query("C8_attach_rates", f"""WITH {PRED}, {PARAM} SELECT rowno, epoch, preds.set_id, coalesce(Vc, 0) AS k
    FROM preds LEFT JOIN params USING (set_id)""", "k")
def c8(spark, sf):
    rates = s.params(spark, sf).withColumnRenamed("Vc", "k")
    return lk.attach_rates(s.preds(spark, sf), rates, "set_id").select("rowno", "epoch", "set_id", "k")


@query("C9_twin_comparison", """SELECT s_suppkey AS id, a <> b AND abs(a - b) > 1e-6 + 1e-4 * abs(b) AS changed FROM
    (SELECT s_suppkey, s_acctbal AS a, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 1.00005 WHEN s_suppkey % 3 = 1 THEN s_acctbal * 1.01
        ELSE s_acctbal END AS b FROM supplier)""")
def c9(spark, sf):
    a = s.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") % 3 == 0, F.col("v") * 1.00005).when(F.col("id") % 3 == 1, F.col("v") * 1.01).otherwise(F.col("v")))
    return lk.any_changed(a, b, "id", ["v"])


@query("C10_attach_constants", f"""WITH {PARAM}, k AS (SELECT material, avg(Vc) AS c FROM params GROUP BY material)
    SELECT set_id, material, c FROM params LEFT JOIN k USING (material)""", "c")
def c10(spark, sf):
    p = s.params(spark, sf)
    k = p.groupBy("material").agg(F.avg("Vc").alias("c"))
    return lk.attach_constants(p, k).select("set_id", "material", "c")


# ---- D: aggregations

@query("D1_integrity", f"""WITH {LAB} SELECT count(*) AS total, count(*) FILTER (both_ok) AS both_n,
    count(*) FILTER (has_image AND NOT has_sensor) AS only_image, count(*) FILTER (has_sensor AND NOT has_image) AS only_sensor,
    count(*) FILTER (NOT has_image AND NOT has_sensor) AS neither, count(*) - count(wear) AS missing_label,
    min(wear) AS label_min, max(wear) AS label_max FROM lab""", "label_min label_max")
def d1(spark, sf):
    return pf.integrity(s.labels(spark, sf)).withColumnRenamed("both", "both_n")


@query("D2_sync_errors", f"""WITH {LAB} SELECT sid, count(*) AS total, count(*) FILTER (both_ok) AS both_n,
    count(*) - count(*) FILTER (both_ok) AS sync_errors FROM lab GROUP BY sid""")
def d2(spark, sf):
    return pf.sync_errors(s.labels(spark, sf)).withColumnsRenamed({"Set": "sid", "both": "both_n"})


PCTS = ", ".join(f"quantile_cont(wear, {p}) AS p{round(p * 100):02d}" for p in (.1, .25, .5, .75, .9))


@query("D3_describe", f"""WITH {LAB} SELECT count(wear) AS count, avg(wear) AS mean, stddev_samp(wear) AS std, min(wear) AS min,
    max(wear) AS max, {PCTS} FROM lab""", "mean std min max p10 p25 p50 p75 p90")
def d3(spark, sf):
    return pf.describe(s.labels(spark, sf), "wear")


@query("D3_describe_by_type", f"""WITH {LAB} SELECT type, count(wear) AS count, avg(wear) AS mean, stddev_samp(wear) AS std,
    min(wear) AS min, max(wear) AS max, {PCTS} FROM lab GROUP BY type""", "mean std min max p10 p25 p50 p75 p90")
def d3b(spark, sf):
    return pf.describe(s.labels(spark, sf), "wear", by=["type"])


@query("D4_value_counts", f"WITH {LAB} SELECT type, count(*) AS n FROM lab GROUP BY type")
def d4(spark, sf):
    return pf.value_counts(s.labels(spark, sf), "type")


@query("D5_crosstab", f"""WITH {LAB} SELECT type, count(*) FILTER (material = 'CK45') AS ck45, count(*) FILTER (material = 'RVS 304') AS rvs
    FROM lab GROUP BY type""")
def d5(spark, sf):
    return pf.crosstab(s.labels(spark, sf), "type", "material", [CK45, RVS]).toDF("type", "ck45", "rvs")


@query("D5_quality_toxic", "SELECT quality, count(*) FILTER (toxic = 0) AS t0, count(*) FILTER (toxic = 1) AS t1 FROM labels GROUP BY quality")
def d5b(spark, sf):
    return pf.crosstab(s.table(spark, sf, "labels"), "quality", "toxic", [0, 1]).toDF("quality", "t0", "t1")


@query("D6_pivot_set_type", f"""WITH {LAB} SELECT sid, count(*) FILTER (type = 'flank_wear') AS flank, count(*) FILTER (type = 'adhesion') AS adh,
    count(*) FILTER (type = 'flank_wear+adhesion') AS fa FROM lab GROUP BY sid""")
def d6(spark, sf):
    return pf.pivot_counts(s.labels(spark, sf), "Set", "type", WEAR_TYPES).toDF("sid", "flank", "adh", "fa")


@query("D7_trajectory_stats", f"""WITH {LAB} SELECT sid, material, split, count(wear) AS n, round(min(wear), 1) AS min, round(max(wear), 1) AS max,
    round(avg(wear), 1) AS mean, round(stddev_samp(wear), 1) AS std FROM lab WHERE wear IS NOT NULL GROUP BY sid, material, split""", "min max mean std")
def d7(spark, sf):
    return pf.trajectory_stats(s.labels(spark, sf)).withColumnRenamed("Set", "sid")


@query("D8_group_extremes", f"WITH {SAMP} SELECT set_id, max(wear) AS max, avg(wear) AS mean, count(wear) AS n FROM samp GROUP BY set_id", "max mean")
def d8(spark, sf):
    return pf.group_extremes(s.samples(spark, sf), "set_id", "wear")


@query("D9_split_stats", f"""WITH {LAB} SELECT split, count(*) AS n_samples, count(DISTINCT sid) AS n_sets, avg(wear) AS wear_mean,
    stddev_samp(wear) AS wear_std, avg((type IN ('adhesion', 'flank_wear+adhesion'))::INT) AS adhesion_frac
    FROM lab WHERE wear IS NOT NULL GROUP BY split""", "wear_mean wear_std adhesion_frac")
def d9(spark, sf):
    return pf.split_stats(s.labels(spark, sf))


HISTO = """b AS (SELECT min(wear) AS lo, max(wear) AS hi FROM lab),
h AS (SELECT {by} CAST(least({n}, 1 + floor((wear - lo) / ((hi - lo) / {n}))) AS INTEGER) AS bin, lo, hi FROM lab, b WHERE wear IS NOT NULL)
SELECT {by} bin, count(*) AS n, min(lo + (bin - 1) * ((hi - lo) / {n})) AS left_edge FROM h GROUP BY {by} bin"""


@query("D10_histogram", f"WITH {LAB}, {HISTO.format(by='', n=40)}", "left_edge")
def d10(spark, sf):
    return pf.histogram(s.labels(spark, sf), "wear", 40)


@query("D10_histogram_by_type", f"WITH {LAB}, {HISTO.format(by='type,', n=30)}", "left_edge")
def d10b(spark, sf):
    return pf.histogram(s.labels(spark, sf), "wear", 30, ["type"])


@query("D11_box_plot", f"""WITH {LAB}, q AS (SELECT type, quantile_cont(wear, 0.25) AS q1, quantile_cont(wear, 0.5) AS median,
        quantile_cont(wear, 0.75) AS q3 FROM lab GROUP BY type)
    SELECT type, min(wear) FILTER (wear >= q1 - 1.5 * (q3 - q1)) AS whisker_low, any_value(q1) AS q1, any_value(median) AS median,
        any_value(q3) AS q3, max(wear) FILTER (wear <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (wear < q1 - 1.5 * (q3 - q1) OR wear > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM lab JOIN q USING (type) GROUP BY type""", "whisker_low q1 median q3 whisker_high")
def d11(spark, sf):
    return pf.five_number(s.labels(spark, sf), "wear", "type")


@query("D12_recordings_per_set", f"WITH {LAB} SELECT sid, count(*) AS n_recordings FROM lab WHERE has_sensor GROUP BY sid")
def d12(spark, sf):
    return pf.recordings_per_set(s.labels(spark, sf)).withColumnRenamed("Set", "sid")


@query("D13_channel_stats", f"""WITH {LONG} SELECT recording_id, channel, count(*) AS n, sqrt(avg(v * v)) AS rms, avg(v) AS mean,
    stddev_pop(v) AS std FROM long GROUP BY recording_id, channel""", "rms mean std")
def d13(spark, sf):
    return pf.channel_stats(s.signal_rows(spark, sf), "recording_id", CHANNELS)


@query("D14_near_zero", f"""WITH {LONG}, m AS (SELECT recording_id, avg(v) AS mean FROM long WHERE channel = 'Fx' GROUP BY recording_id)
    SELECT avg(mean) AS mean_of_means, stddev_pop(mean) AS std_of_means, abs(avg(mean)) < 1 AS near_zero FROM m""", "mean_of_means std_of_means")
def d14(spark, sf):
    stats = pf.channel_stats(s.signal_rows(spark, sf), "recording_id", CHANNELS)
    return pf.near_zero(stats.filter(F.col("channel") == "Fx"), "mean")


ERR = """avg(abs(target - pred)) AS overall, count(*) AS n,
    avg(abs(target - pred)) FILTER (type = 'flank_wear') AS flank, count(*) FILTER (type = 'flank_wear') AS n_flank,
    avg(abs(target - pred)) FILTER (type = 'adhesion') AS adh, count(*) FILTER (type = 'adhesion') AS n_adh,
    avg(abs(target - pred)) FILTER (type = 'flank_wear+adhesion') AS fa, count(*) FILTER (type = 'flank_wear+adhesion') AS n_fa"""
ERR_COLS = ["overall", "n", "flank", "n_flank", "adh", "n_adh", "fa", "n_fa"]


@query("D15_error_by_class", f"WITH {PRED} SELECT epoch, {ERR} FROM preds GROUP BY epoch", "overall flank adh fa")
def d15(spark, sf):
    return er.error_by_class(s.preds(spark, sf), keys=["epoch"]).toDF("epoch", *ERR_COLS)


@query("D25_pooled_errors", f"WITH {PRED} SELECT {ERR} FROM preds", "overall flank adh fa")
def d25(spark, sf):
    return er.error_by_class(s.preds(spark, sf)).toDF(*ERR_COLS)


SEEDS = "count(DISTINCT seed) AS seeds, " + ", ".join(f"avg({m}) AS {m}_m, stddev_samp({m}) AS {m}_s" for m in ("overall", "flank", "adh", "fa"))
SEED_DBL = " ".join(f"{m}_{x}" for m in ("overall", "flank", "adh", "fa") for x in "ms")


@query("D16_seed_summary", f"WITH {RUN} SELECT family, split, epochs, {SEEDS} FROM runs GROUP BY family, split, epochs", SEED_DBL)
def d16(spark, sf):
    return rp.seed_summary(rp.run_meta(s.runs(spark, sf)), ["family", "split", "epochs"])


@query("D17_seed_pivot", f"""WITH {RUN} SELECT family, split, {', '.join(f"min(overall) FILTER (seed = {x} AND flag = 'N' AND epochs = 17) AS s{x}" for x in range(41, 48))}
    FROM runs GROUP BY family, split""", " ".join(f"s{x}" for x in range(41, 48)))
def d17(spark, sf):
    meta = rp.run_meta(s.runs(spark, sf)).filter((F.col("variant") == "ctrl") & (F.col("epochs") == 17))
    return rp.seed_pivot(meta, ["family", "split"], range(41, 48))


@query("D18_profile_fraction", """SELECT avg(l_discount) AS mean, quantile_cont(l_discount, 0.1) AS p10, quantile_cont(l_discount, 0.5) AS p50,
    quantile_cont(l_discount, 0.9) AS p90 FROM lineitem""", "mean p10 p50 p90")
def d18(spark, sf):
    return pf.profile_fraction(s.table(spark, sf, "lineitem"), "l_discount")


@query("D18_D28_fraction_by_set", "SELECT l_suppkey AS set_id, avg(l_discount) AS mean, min(l_discount) AS min, max(l_discount) AS max FROM lineitem GROUP BY l_suppkey", "mean min max")
def d18b(spark, sf):
    li = s.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "set_id")
    return pf.profile_fraction(li, "l_discount", "set_id")


@query("D28_segment_counts", f"WITH {REC} SELECT avg(n)::DOUBLE AS mean, min(n) AS min, max(n) AS max FROM (SELECT recording_id, count(*) AS n FROM recs GROUP BY recording_id)", "mean")
def d28(spark, sf):
    n = s.signal_rows(spark, sf).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    return pf.profile_fraction(n.withColumn("all", F.lit("all")), "n", "all").drop("all")


@query("D19_label_stats", f"""WITH {LAB} SELECT count(wear) AS n, avg(wear) AS mean, stddev_samp(wear) AS std, min(wear) AS min, max(wear) AS max,
    median(wear) AS median FROM lab""", "mean std min max median")
def d19(spark, sf):
    return pf.label_stats(s.labels(spark, sf))


IMP = "SELECT split_part(p_name, ' ', 1) || '_' || p_type AS feature, sum(p_retailprice * p_size) AS importance FROM part GROUP BY 1"


def _imp(spark, sf):
    p = s.table(spark, sf, "part")
    return p.groupBy(F.concat_ws("_", F.substring_index("p_name", " ", 1), "p_type").alias("feature")).agg(
        F.sum(F.col("p_retailprice") * F.col("p_size")).alias("importance"))


@query("D20_channel_importance", f"SELECT split_part(feature, '_', 1) AS channel, sum(abs(importance)) AS importance FROM ({IMP}) GROUP BY 1", "importance", 2)
def d20(spark, sf):
    return channel_importance(_imp(spark, sf))


@query("D21_J21_band_percentile", f"""WITH {SAMP}, {PARAM} SELECT quantile_cont(abs(wear - greatest(0, least(300.0, coalesce(Vc, 0) * t))), 0.95) AS band_um
    FROM samp LEFT JOIN params USING (set_id)""", "band_um")
def d21(spark, sf):
    rates = s.params(spark, sf).withColumnRenamed("Vc", "k")
    return recommend_band(s.samples(spark, sf), rates, by="set_id")


@query("D22_column_means", f"WITH {LAB} SELECT coalesce(avg(wear), 0) AS wear, coalesce(avg(image_id), 0) AS image_id, 0.0::DOUBLE AS nothing FROM lab", "wear image_id nothing", 5)
def d22(spark, sf):
    df = s.labels(spark, sf).select("wear", F.col("ImageID").alias("image_id"), F.lit(None).cast("double").alias("nothing"))
    return pf.column_means(df, ["wear", "image_id", "nothing"])


@query("D23_vector_stats", """SELECT dim, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS dim,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY dim""", "mean std")
def d23(spark, sf):
    return pf.vector_stats(s.table(spark, sf, "embeddings"), "embedding")


@query("D24_weighted_mean", "SELECT l_linenumber AS epoch, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean, sum(l_quantity) AS n FROM lineitem GROUP BY l_linenumber", "mean n", 4)
def d24(spark, sf):
    li = s.table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "epoch")
    return pf.weighted_mean(li, ["epoch"], "l_extendedprice", "l_quantity")


@query("D26_J15_identifiability", f"""WITH {PARAM}, u AS (SELECT material, 'Vc' AS param, Vc AS v FROM params UNION ALL SELECT material, 'fz', fz FROM params
        UNION ALL SELECT material, 'Ap', Ap FROM params)
    SELECT material, param, count(DISTINCT v) AS n_distinct, min(v) AS lo, max(v) AS hi, count(DISTINCT v) < 2 AS is_constant
    FROM u GROUP BY material, param""", "lo hi")
def d26(spark, sf):
    return pf.identifiability(s.params(spark, sf), ["material"], ["Vc", "fz", "Ap"])


@query("D26_distinct_params", f"""WITH {PARAM} SELECT DISTINCT material, 'Vc' AS param, Vc AS value FROM params WHERE Vc IS NOT NULL
    UNION SELECT DISTINCT material, 'fz', fz FROM params""", "value")
def d26b(spark, sf):
    return pf.distinct_params(s.params(spark, sf), ["material"], ["Vc", "fz"])


@query("D27_improvement", f"""WITH {PRED}, e AS (SELECT epoch, avg(abs(target - pred)) / 3 AS mae, avg(abs(target - 200)) AS base FROM preds GROUP BY epoch)
    SELECT epoch, (1 - mae / base) * 100 AS improvement_pct, CASE WHEN mae < 50 THEN 'strong' WHEN mae < 80 THEN 'moderate' ELSE 'weak' END AS verdict FROM e""", "improvement_pct")
def d27(spark, sf):
    p = s.preds(spark, sf)
    e = p.groupBy("epoch").agg((F.avg(F.abs(F.col("target") - F.col("pred"))) / 3).alias("mae"),
                               F.avg(F.abs(F.col("target") - 200)).alias("base"))
    return er.improvement(e, "base", "mae").select("epoch", "improvement_pct", "verdict")


# ---- E: order inside groups

@query("E2_life_fraction", f"""WITH {SAMP}, b AS (SELECT set_id, min(t) AS lo, max(t) AS hi FROM samp GROUP BY set_id)
    SELECT rowno, (t - lo) / greatest(hi - lo, 1) AS life FROM samp JOIN b USING (set_id)""", "life")
def e2(spark, sf):
    return sq.life_fraction(s.samples(spark, sf), "set_id", "t").select("rowno", "life")


LIFE = """ord AS (SELECT *, lag(t) OVER w AS t0, lag(wear) OVER w AS w0, row_number() OVER w AS rn FROM samp
    WINDOW w AS (PARTITION BY set_id ORDER BY t, wear)),
f AS (SELECT set_id, min(rn) AS rn FROM ord WHERE wear >= {thr} GROUP BY set_id),
life AS (SELECT s.set_id, CASE WHEN ord.t0 IS NULL OR ord.w0 = ord.wear THEN ord.t ELSE ord.t0 + ({thr} - ord.w0) / (ord.wear - ord.w0) * (ord.t - ord.t0) END AS life
    FROM (SELECT DISTINCT set_id FROM samp) s LEFT JOIN f USING (set_id) LEFT JOIN ord ON ord.set_id = f.set_id AND ord.rn = f.rn)"""


@query("E3_life_at_threshold", f"WITH {SAMP}, {LIFE.format(thr='400.0')} SELECT set_id, life FROM life", "life")
def e3(spark, sf):
    return sq.life_at_threshold(s.samples(spark, sf), "set_id", "t", "wear", 400.0)


@query("E3_life_with_ties", f"""WITH raw AS (WITH {SAMP} SELECT * FROM samp), samp AS (SELECT set_id, floor(t / 4) AS t, wear FROM raw),
    {LIFE.format(thr='400.0')} SELECT set_id, life FROM life""", "life")
def e3_ties(spark, sf):
    coarse = s.samples(spark, sf).withColumn("t", F.floor(F.col("t") / 4))
    return sq.life_at_threshold(coarse, "set_id", "t", "wear", 400.0)


SEG = """sz AS (SELECT recording_id, count(*) AS n FROM recs GROUP BY recording_id),
sg AS (SELECT recs.*, n, CAST(pos // (n // 10) AS INTEGER) AS seg FROM recs JOIN sz USING (recording_id) WHERE pos < n - n % 10)"""


@query("E4_segments", f"WITH {REC}, {SEG} SELECT recording_id, seg, count(*) AS n, min(pos) AS first_pos, avg(acc) AS mean FROM sg GROUP BY recording_id, seg", "mean")
def e4(spark, sf):
    seg = sq.segment(s.recordings(spark, sf), "recording_id")
    return seg.groupBy("recording_id", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.avg("acc").alias("mean"))


@query("E5_F2_top_features", f"SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance FROM ({IMP}) QUALIFY rank <= 15", "importance", 2)
def e5(spark, sf):
    return sq.top_k(_imp(spark, sf), "importance", 15, "feature")


@query("F2_bottom_features", f"SELECT CAST(row_number() OVER (ORDER BY importance, feature) AS INTEGER) AS rank, feature, importance FROM ({IMP}) QUALIFY rank <= 5", "importance", 2)
def f2(spark, sf):
    return sq.top_k(_imp(spark, sf), "importance", 5, "feature", asc=True)


HIST = "hist AS (SELECT l_suppkey AS run, l_linenumber AS epoch, avg(l_extendedprice) AS mae FROM lineitem GROUP BY l_suppkey, l_linenumber)"


def _history(spark, sf):
    return s.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(
        F.avg("l_extendedprice").alias("mae"))


@query("E6_running_best", f"WITH {HIST} SELECT run, epoch, mae, min(mae) OVER (PARTITION BY run ORDER BY epoch) AS best_so_far FROM hist", "mae best_so_far")
def e6(spark, sf):
    return sq.running_best(_history(spark, sf), ["run"], "mae")


@query("E6_K8_best_epoch", f"""WITH {HIST} SELECT run, min(mae) AS best_value, arg_min(epoch, mae) AS best_epoch, max(epoch) AS last_epoch,
    arg_max(mae, epoch) AS last_value FROM hist GROUP BY run""", "best_value last_value")
def e6b(spark, sf):
    return rp.history_report(_history(spark, sf), ["run"], "mae")


@query("E7_first_mid_last", f"""WITH {SAMP}, r AS (SELECT *, CAST(t AS BIGINT) - 1 AS p, count(*) OVER (PARTITION BY set_id) AS n FROM samp)
    SELECT set_id, rowno, CASE WHEN p = 0 THEN 'first' WHEN p = n - 1 THEN 'last' ELSE 'middle' END AS role FROM r WHERE p IN (0, n // 2, n - 1)""")
def e7(spark, sf):
    return sq_first(s.samples(spark, sf)).select("set_id", "rowno", "role")


def sq_first(df):
    return pf.first_mid_last(df, "set_id", [F.col("t"), F.col("rowno")])


@query("E8_sample_per_group")
def e8(spark, sf):
    return pf.sample_per_group(s.samples(spark, sf), "set_id", 4, 42, "rowno").select("set_id", "rowno")


@query("E8_sample_counts", f"WITH {SAMP} SELECT set_id, least(count(*), 4) AS n FROM samp GROUP BY set_id")
def e8b(spark, sf):
    picked = pf.sample_per_group(s.samples(spark, sf), "set_id", 4, 42, "rowno").distinct()
    return picked.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


@query("E9_baseline_z", f"""WITH {REC}, b AS (SELECT recording_id, avg(acc) AS mu, stddev_pop(acc) AS sd FROM recs WHERE pos < 10 GROUP BY recording_id)
    SELECT recording_id, pos, (acc - mu) / (sd + 1e-9) AS z FROM recs JOIN b USING (recording_id)""", "z")
def e9(spark, sf):
    z = sq.baseline_z(s.recordings(spark, sf), ["recording_id"], "pos", "acc", 10)
    return z.select("recording_id", "pos", "z")


@query("E11_delta_to_best", f"WITH {RUN} SELECT experiment, split, overall - min(overall) OVER (PARTITION BY family, split) AS delta FROM runs", "delta")
def e11(spark, sf):
    return sq.delta_to_best(s.runs(spark, sf), ["family", "split"], "overall").select("experiment", "split", "delta")


# ---- F: sort and top-k

@query("F1_rank_report", f"WITH {RUN} SELECT family, split, experiment, overall FROM runs ORDER BY family, split, overall", "overall")
def f1(spark, sf):
    return sq.rank_report(s.runs(spark, sf), "overall", ["family", "split"]).select("family", "split", "experiment", "overall")


@query("F3_best_per_group", f"""WITH {RUN} SELECT family, split, arg_min(experiment, overall) AS experiment, min(overall) AS overall FROM runs
    GROUP BY family, split""", "overall")
def f3(spark, sf):
    best = sq.best_per_group(s.runs(spark, sf), ["family", "split"], "overall", ["experiment"])
    return best.select("family", "split", "experiment", "overall")


@query("F4_best_method", f"""WITH {PRED}, m AS (SELECT epoch AS position, 'm' || epoch AS method, avg(abs(target - pred)) AS overall FROM preds GROUP BY epoch)
    SELECT position, method, overall FROM m ORDER BY overall, position LIMIT 1""", "overall")
def f4(spark, sf):
    m = er.error_by_class(s.preds(spark, sf), keys=["epoch"]).select(
        F.col("epoch").alias("position"), F.concat(F.lit("m"), "epoch").alias("method"), "overall")
    return er.best_method(m)


@query("F5_ordered_series", f"WITH {SAMP} SELECT set_id, t, wear, type FROM samp ORDER BY set_id, t", "t wear")
def f5(spark, sf):
    return sq.ordered_series(s.samples(spark, sf).select("set_id", "t", "wear", "type"), "set_id", "t")


# ---- G: set operations

@query("G1_reference_rows", f"""WITH {RUN} SELECT experiment, split, overall, fa, n_total FROM runs
    UNION ALL SELECT 'paper_baseline', 'test', 30.0, 91.0, NULL""", "overall fa")
def g1(spark, sf):
    rows = s.runs(spark, sf).select("experiment", "split", "overall", "fa", "n_total")
    return rp.with_reference_rows(rows, [rp.PAPER])


@query("G3_union_runs", f"""WITH {RUN} SELECT experiment, split, overall, NULL::DOUBLE AS fa FROM runs WHERE family = 'F'
    UNION ALL SELECT experiment, split, NULL, fa FROM runs WHERE family = 'O'""", "overall fa")
def g3(spark, sf):
    r = s.runs(spark, sf)
    return union_runs([r.filter("family = 'F'").select("experiment", "split", "overall"),
                       r.filter("family = 'O'").select("experiment", "split", "fa")])


@query("G4_flatten_results", f"""WITH {RUN}, g AS (SELECT family AS method, split, avg(overall) AS overall, sum(n_total)::BIGINT AS n FROM runs GROUP BY family, split)
    SELECT method, split, overall, n FROM g""", "overall")
def g4(spark, sf):
    r = s.runs(spark, sf)
    def cell(name):
        hit = F.col("split") == name
        return F.struct(F.avg(F.when(hit, F.col("overall"))).alias("overall"), F.sum(F.when(hit, F.col("n_total"))).alias("n")).alias(name)
    wide = r.groupBy(F.col("family").alias("method")).agg(cell("val"), cell("test"))
    return er.flatten_results(wide, ["val", "test"])


@query("J1_scaler_transform", """SELECT l_orderkey AS id, l_linenumber AS line, (l_quantity - m) / s AS qty FROM lineitem,
    (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'N')""", "qty")
def j1(spark, sf):
    df = s.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                                               F.col("l_quantity").alias("qty"), "l_returnflag")
    return Scaler.fit(df.filter("l_returnflag = 'N'"), ["qty"]).transform(df).drop("l_returnflag")
