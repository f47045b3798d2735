"""Checked queries: sources and cleaning (survey A and B)."""

from pyspark.sql import Window, functions as F

from checks import standins as s
from checks.registry import query
from condmon.constants import WEAR_EDGES, WEAR_LABELS
from condmon.evaluate.scaler import Scaler
from condmon import functions as fn
from condmon.operators import features as ft, lookup as lk, profile as pf, samples as sm
from condmon.plans import reports as rp
from condmon.session import scratch_path
from condmon import sources as src
from condmon.sources.cache import cached_features
from condmon.sources.runs import SEED_TREE, with_tree_seed

CLEAN = "rowno, sid, image_id, sensor_id, image_file, sensor_file, image_time, wear, type, has_image, has_sensor, both_ok, material, split"


def _plain(df):
    return df.select(
        F.col("rowno").cast("long").alias("rowno"), F.col("Set").alias("sid"), F.col("ImageID").alias("image_id"),
        F.col("SensorID").alias("sensor_id"), F.col("ImageFile").alias("image_file"),
        F.col("SensorFile").alias("sensor_file"), F.col("ImageDateTime").alias("image_time"), "wear", "type",
        "has_image", "has_sensor", F.col("both").alias("both_ok"), "material", "split")


@query("A1_read_labels", f"WITH {s.LAB_SQL} SELECT {CLEAN} FROM lab", "image_id sensor_id wear")
def a1(spark, sf):
    path = scratch_path(spark, "labels")
    raw = s.raw_labels(spark, sf)
    raw.toDF(*[f" {c} " for c in raw.columns]).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    return _plain(src.read_labels(spark, path))


@query("B1_B7_clean_labels", f"WITH {s.LAB_SQL} SELECT {CLEAN} FROM lab", "image_id sensor_id wear")
def b1_7(spark, sf):
    return _plain(s.labels(spark, sf))


SETS_RAW = (
    "'Set ' || s_suppkey AS label",
    "CASE WHEN s_suppkey % 9 = 1 THEN '?' WHEN s_suppkey % 9 = 6 THEN s_suppkey || '/' || (s_suppkey + 37) "
    "WHEN s_suppkey % 9 = 7 THEN 'x/' || s_suppkey WHEN s_suppkey % 9 = 8 THEN ' ' ELSE s_acctbal || '' END AS Vc",
    "CASE WHEN s_suppkey % 2 = 0 THEN '0.05' ELSE '0.125' END AS fz",
    "CASE WHEN s_suppkey <= 11 THEN 'CK45' WHEN s_suppkey % 3 = 0 THEN NULL ELSE ' rvs 304' END AS material",
)
PARSED = """CASE WHEN Vc LIKE '%/%' THEN (coalesce(TRY_CAST(split_part(Vc, '/', 1) AS DOUBLE), 0) + coalesce(TRY_CAST(split_part(Vc, '/', 2) AS DOUBLE), 0))
    / nullif((TRY_CAST(split_part(Vc, '/', 1) AS DOUBLE) IS NOT NULL)::INT + (TRY_CAST(split_part(Vc, '/', 2) AS DOUBLE) IS NOT NULL)::INT, 0)
    ELSE TRY_CAST(Vc AS DOUBLE) END"""
SETS_SQL = f"""WITH rawsets AS (SELECT {', '.join(SETS_RAW)} FROM supplier)
SELECT CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) AS set_id, {{vc}} AS vc, TRY_CAST(fz AS DOUBLE) AS fz,
    CASE WHEN upper(trim(coalesce(material, ''))) LIKE '%RVS%' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_rvs FROM rawsets"""


def _sets(spark, sf, mode):
    raw = s.table(spark, sf, "supplier").selectExpr(*SETS_RAW)
    p = src.clean_set_params(raw, mode)
    return p.select(F.col("Set").alias("set_id"), F.col("Vc").alias("vc"), "fz", F.col("material_RVS").alias("is_rvs"))


@query("A2_read_set_params", SETS_SQL.format(vc=PARSED), "vc fz is_rvs")
def a2(spark, sf):
    path = scratch_path(spark, "sets")
    raw = s.table(spark, sf, "supplier").selectExpr(*SETS_RAW)
    raw.toDF("", " Vc ", "fz ", "material").write.option("header", True).csv(path)
    p = src.read_set_params(spark, path)
    return p.select(F.col("Set").alias("set_id"), F.col("Vc").alias("vc"), "fz", F.col("material_RVS").alias("is_rvs"))


@query("B13_B15_parse_params_mean", SETS_SQL.format(vc=PARSED), "vc fz is_rvs")
def b13(spark, sf):
    return _sets(spark, sf, "mean")


@query("B13_parse_params_null", SETS_SQL.format(vc="TRY_CAST(Vc AS DOUBLE)"), "vc fz is_rvs")
def b13n(spark, sf):
    return _sets(spark, sf, "null")


@query("B20_unknown_params", f"""SELECT set_id, fz FROM ({SETS_SQL.format(vc=PARSED)}) WHERE vc IS NULL""", "fz")
def b20(spark, sf):
    p = _sets(spark, sf, "mean")
    return sm.unknown_params(p, "vc").select("set_id", "fz")


PASS_ROWS = 10000


def _write_recordings(spark, sf):
    """Events as headerless CSV, one file per pass of at most PASS_ROWS rows, rows in time order."""
    path = scratch_path(spark, "recordings")
    rows = s.recordings(spark, sf).withColumn(
        "rid", F.concat_ws("_", "recording_id", F.floor(F.col("pos") / PASS_ROWS)))
    cells = [*(F.col(c).cast("string") for c in ("acc", "acoustic", "Fx", "Fy", "Fz")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")]
    s.write_files(rows.select("rid", "pos", F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value")), path, ("pos",))
    return path


@query("A3_read_recordings", f"""WITH {s.REC_SQL}
    SELECT recording_id || '_' || (pos // {PASS_ROWS}) AS recording_id, pos % {PASS_ROWS} AS pos, CAST(CAST(acc AS FLOAT) AS DOUBLE) AS acc,
        CAST(CAST(Fz AS FLOAT) AS DOUBLE) AS fz FROM recs""", "acc fz", 4)
def a3(spark, sf):
    rows = src.read_recordings(spark, _write_recordings(spark, sf) + "/*", id_pattern=r"rid=(\w+)[./]")
    return rows.select("recording_id", "pos", "acc", F.col("Fz").alias("fz"))


@query("A4_zero_fill", f"""WITH {s.REC_SQL}, f AS (SELECT recording_id, avg(CAST(CAST(acc AS FLOAT) AS DOUBLE)) AS acc_mean,
            stddev_pop(CAST(CAST(acc AS FLOAT) AS DOUBLE)) AS acc_std FROM recs WHERE recording_id % 3 <> 0 GROUP BY recording_id)
    SELECT e.recording_id, coalesce(acc_mean, 0) AS acc_mean, coalesce(acc_std, 0) AS acc_std,
        f.recording_id IS NULL AS is_missing
    FROM (SELECT DISTINCT user_id AS recording_id FROM events) e LEFT JOIN f USING (recording_id)""", "acc_mean acc_std", 4)
def a4(spark, sf):
    """Every third recording has a line of text in its file, so the file cannot be used."""
    path = scratch_path(spark, "broken")
    rows = s.recordings(spark, sf)
    cells = [F.col(c).cast("string") for c in ("acc", "acoustic", "Fx", "Fy", "Fz")]
    lines = rows.select(F.col("recording_id").alias("rid"), F.concat_ws(
        ",", *cells, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("value"))
    broken = rows.filter("recording_id % 3 = 0").select(F.col("recording_id").alias("rid"), F.lit("sensor stopped,").alias("value")).distinct()
    s.write_files(lines.unionByName(broken), path)
    found = src.read_recordings(spark, path + "/*", id_pattern=r"rid=(\w+)[./]")
    readable = ft.time_features(found.withColumn("recording_id", F.col("recording_id").cast("long")), ["acc"])
    wanted = s.table(spark, sf, "events").select(F.col("user_id").alias("recording_id")).distinct()
    return lk.zero_fill_features(wanted, readable, ["acc_mean", "acc_std"])


@query("A5_C6_check_files", """SELECT count(*) AS referenced, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def a5(spark, sf):
    refs = s.table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path_ref"))
    listed = s.table(spark, sf, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), F.lit(1).alias("length"))
    return src.check_files(refs, listed, "path_ref")


@query("C6_missing_files", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def c6(spark, sf):
    listed = s.table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return src.existing_refs(s.table(spark, sf, "documents").select("doc_id"), listed, "doc_id", missing=True)


@query("C6_existing_files", """SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def c6b(spark, sf):
    listed = s.table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return src.existing_refs(s.table(spark, sf, "documents").select("doc_id"), listed, "doc_id")


@query("A5_file_listing", """SELECT count(*) AS referenced, count(*) FILTER (l_partkey % 40 IN (SELECT l_suppkey % 25 FROM lineitem)) AS found,
    count(*) FILTER (l_partkey % 40 NOT IN (SELECT l_suppkey % 25 FROM lineitem)) AS missing FROM lineitem""")
def a5b(spark, sf):
    """A real listing: up to 25 files, referenced by every line item through 40 names."""
    path = scratch_path(spark, "files")
    li = s.table(spark, sf, "lineitem")
    li.select((F.col("l_suppkey") % 25).alias("f"), F.lit("x").alias("v")).distinct().repartition("f").write.partitionBy("f").text(path)
    listing = src.file_listing(spark, path, path).withColumn("path", F.element_at(F.split("path", "/"), -2)).filter(
        F.col("path").startswith("f="))
    refs = li.select(F.concat(F.lit("f="), F.col("l_partkey") % 40).alias("p"))
    return src.check_files(refs, listing, "p")


@query("A6_distinct_metadata", """SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source""")
def a6(spark, sf):
    docs = s.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return pf.distinct_on_sample(docs, ["lang", "source"], None)


RUN_COLS = "experiment, family, split, epochs_cfg, lam, best_epoch, overall, flank, adh, fa, n_total"
RUN_ROWS_SQL = f"""WITH {s.RUN_SQL} SELECT experiment, family, split, CASE WHEN seed % 2 = 0 THEN epochs END AS epochs_cfg,
    lam, CAST(best_epoch AS INTEGER) AS best_epoch, overall, flank, adh, fa, n_total FROM runs"""


def _run_rows(df):
    return df.select("experiment", "family", "split", F.col("cfg.epochs").alias("epochs_cfg"),
                     F.col("physics.lambda_max").alias("lam"), "best_epoch", "overall", "flank", "adh", "fa", "n_total")


def _write_runs(spark, sf):
    path = scratch_path(spark, "runs")
    nested = s.nested_runs(spark, sf)
    body = F.to_json(F.struct(*[c for c in nested.columns if c != "family"]))
    nested.select("family", F.concat(F.lit("s"), F.regexp_extract("experiment", r"_s(\d+)", 1)).alias("seed"),
                  "experiment", body.alias("value")).repartition(4, "experiment").write.partitionBy(
        "family", "seed", "experiment").text(path)
    return path


@query("A7_read_runs", RUN_ROWS_SQL, "lam overall flank adh fa")
def a7(spark, sf):
    tree = {"family": r"family=([^/]+)/"}
    return _run_rows(src.read_runs(spark, _write_runs(spark, sf), tree, pattern="*.txt"))


@query("A7_flatten_runs", RUN_ROWS_SQL, "lam overall flank adh fa")
def a7b(spark, sf):
    return _run_rows(s.runs(spark, sf))


@query("A8_path_columns", f"""WITH {s.RUN_SQL} SELECT 'family=' || family AS run_group, 'experiment=' || experiment AS config_name,
    seed, split, overall FROM runs""", "overall")
def a8(spark, sf):
    df = with_tree_seed(src.read_runs(spark, _write_runs(spark, sf), SEED_TREE, pattern="*.txt"))
    return df.select("run_group", "config_name", F.col("seed").alias("seed"), "split", "overall")


@query("A9_A12_constants_payload", """SELECT c_custkey AS set_id, c_acctbal AS slope, c_custkey % 2 = 0 AS caution,
    CASE WHEN c_custkey % 2 = 0 THEN 'CK45' ELSE 'RVS 304' END AS material FROM customer""", "slope")
def a9(spark, sf):
    c = s.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("set"), F.when(F.col("c_custkey") % 2 == 0, "CK45").otherwise("RVS 304").alias("material"),
        F.col("c_acctbal").alias("slope_um_per_pass"), (F.col("c_custkey") % 2 == 0).alias("caution"))
    materials = c.groupBy("material").agg(F.avg("slope_um_per_pass").alias("C"), F.lit(0.25).alias("n"))
    path = scratch_path(spark, "constants")
    src.write_constants(materials, c, {"failure_um": 300.0, "train_sets": [1, 2]}, path)
    _, sets = src.read_constants(spark, path)
    return sets.select(F.col("set").cast("long").alias("set_id"), F.col("slope_um_per_pass").alias("slope"), "caution", "material")


@query("A9_constants_materials", """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'CK45' ELSE 'RVS 304' END AS material,
    avg(c_acctbal) AS c, 300.0::DOUBLE AS failure_um FROM customer GROUP BY 1""", "c failure_um")
def a9b(spark, sf):
    c = s.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("set"), F.when(F.col("c_custkey") % 2 == 0, "CK45").otherwise("RVS 304").alias("material"),
        F.col("c_acctbal").alias("slope_um_per_pass"))
    materials = c.groupBy("material").agg(F.avg("slope_um_per_pass").alias("C"), F.lit(0.25).alias("n"))
    path = scratch_path(spark, "constants")
    src.write_constants(materials, c, {"failure_um": 300.0}, path)
    m, _ = src.read_constants(spark, path)
    return m.select("material", F.col("C").alias("c"), "failure_um")


HIST_SQL = """SELECT l_suppkey % 5 AS run, l_linenumber AS epoch, avg(l_extendedprice) AS train_loss,
        CASE WHEN l_suppkey % 5 < 2 THEN avg(l_discount) END AS train_gate_mean,
        CASE WHEN l_suppkey % 5 >= 2 THEN avg(l_tax) END AS lr, avg(l_quantity) AS val_mae_overall_um
    FROM lineitem GROUP BY l_suppkey % 5, l_linenumber"""


@query("A10_read_history", HIST_SQL, "train_loss train_gate_mean lr val_mae_overall_um")
def a10(spark, sf):
    li = s.table(spark, sf, "lineitem").withColumn("run", F.col("l_suppkey") % 5)
    hist = li.groupBy("run", F.col("l_linenumber").alias("epoch")).agg(
        F.avg("l_extendedprice").alias("train_loss"), F.avg("l_discount").alias("train_gate_mean"),
        F.avg("l_tax").alias("lr"), F.avg("l_quantity").alias("val_mae_overall_um"))
    a, b = scratch_path(spark, "history"), scratch_path(spark, "history")
    hist.filter("run < 2").drop("lr").repartition("run").write.partitionBy("run").option("header", True).csv(a)
    hist.filter("run >= 2").drop("train_gate_mean").repartition("run").write.partitionBy("run").option("header", True).csv(b)
    h = src.read_history(spark, [a, b])
    return h.select(F.regexp_extract("file", r"run=(\d+)/", 1).cast("long").alias("run"), "epoch", "train_loss",
                    "train_gate_mean", "lr", "val_mae_overall_um")


@query("A11_csv_sink", """SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag""", "qty")
def a11(spark, sf):
    path = scratch_path(spark, "report")
    df = s.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    src.write_report(df, path)
    return spark.read.option("header", True).schema("flag string, n bigint, qty double").csv(path)


@query("A12_results_json", RUN_ROWS_SQL, "lam overall flank adh fa")
def a12(spark, sf):
    nested = s.nested_runs(spark, sf)
    path = scratch_path(spark, "results")
    src.results_json(nested).write.text(path)
    back = spark.read.schema("family string, " + src.RUN_SCHEMA).json(path)
    return _run_rows(src.flatten_runs(back))


@query("A13_feature_cache", f"""WITH {s.REC_SQL} SELECT recording_id, avg(acc) AS acc_mean, stddev_pop(acc) AS acc_std,
    sqrt(avg(acc * acc)) AS acc_rms, max(acc) - min(acc) AS acc_p2p, coalesce(kurtosis_pop(acc), 0) AS acc_kurtosis,
    count(*) AS n FROM recs GROUP BY recording_id""", "acc_mean acc_std acc_rms acc_p2p acc_kurtosis")
def a13(spark, sf):
    rows, path = s.signal_rows(spark, sf), scratch_path(spark, "cache")
    extract = lambda r: ft.time_features(r, ["acc"])
    cached_features(rows.filter("recording_id % 2 = 0"), path, "v1", extract)
    return cached_features(rows, path, "v1", extract)


@query("A14_scaler_save_load", """SELECT 'qty' AS feature, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem
    UNION ALL SELECT 'price', avg(l_extendedprice), stddev_pop(l_extendedprice) FROM lineitem""", "mean std", 4)
def a14(spark, sf):
    df = s.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    path = scratch_path(spark, "scaler")
    Scaler.fit(df, ["qty", "price"]).save(path)
    return Scaler.load(spark, path).stats


def _sel(split, rng, require, missing):
    def run(spark, sf):
        rows = sm.select_samples(s.labels(spark, sf), split, rng, require, missing)
        return rows.select(F.col("rowno").cast("long").alias("rowno"), F.col("Set").alias("sid"), "wear", "wear_norm")
    return run


def _sel_sql(sets, require, zero):
    need = {"both": "both_ok", "image": "has_image", "sensor": "has_sensor"}[require]
    label = "coalesce(wear, 0)" if zero else "wear"
    return f"""WITH {s.LAB_SQL} SELECT rowno, sid, least({label}, 450.0) AS wear, least({label}, 450.0) / 1000 AS wear_norm
        FROM lab WHERE sid IN ({sets}) AND {need} {'' if zero else 'AND wear IS NOT NULL'}"""


for _name, _args, _sql in (
    ("B8_B12_select_train", ("train", "1-13", "both", "drop"), _sel_sql("1,2,5,7,8,10,11", "both", False)),
    ("B12_select_train_wide", ("train", "1-17", "sensor", "drop"), _sel_sql("1,2,5,7,8,10,11,14,15,16,17", "sensor", False)),
    ("B9_select_impute_zero", ("val", "1-13", "image", "zero"), _sel_sql("3,6,12", "image", True)),
    ("B12_G2_select_all", ("all", "1-17", "both", "drop"), _sel_sql(",".join(map(str, range(1, 18))), "both", False)),
):
    query(_name, _sql, "wear wear_norm")(_sel(*_args))


@query("B10_cap_label", "SELECT o_orderkey AS rowno, least(o_totalprice / 1000, 450.0) AS wear FROM orders", "wear")
def b10(spark, sf):
    o = s.table(spark, sf, "orders").select(F.col("o_orderkey").alias("rowno"), (F.col("o_totalprice") / 1000).alias("wear"))
    return sm.cap_label(o)


@query("B11_decode_predictions", f"WITH {s.PRED_SQL} SELECT rowno, epoch, greatest(0.0, least(450.0, raw * 1000)) AS um FROM preds", "um")
def b11(spark, sf):
    return s.preds(spark, sf).select("rowno", "epoch", fn.to_um(F.col("raw")).alias("um"))


@query("B16_wear_bins", """SELECT CASE WHEN w < 0 THEN NULL WHEN w < 50 THEN '0–50' WHEN w < 100 THEN '50–100' WHEN w < 150 THEN '100–150'
    WHEN w < 200 THEN '150–200' WHEN w < 300 THEN '200–300' WHEN w < 450 THEN '300–450' WHEN w < 1000 THEN '>450' END AS wear_bin,
    count(*) AS n FROM (SELECT o_totalprice / 1000 AS w FROM orders) GROUP BY 1""")
def b16(spark, sf):
    w = s.table(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("w"))
    return w.groupBy(fn.bin_right_open(F.col("w"), WEAR_EDGES, WEAR_LABELS).alias("wear_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("B17_stage_membership", f"""WITH {s.LAB_SQL}, st AS (SELECT 'low' AS stage, wear < 80 AS ok FROM lab
    UNION ALL SELECT 'mid', wear >= 80 AND wear < 200 FROM lab UNION ALL SELECT 'high', wear >= 200 FROM lab
    UNION ALL SELECT 'adhesion', type IN ('adhesion', 'flank_wear+adhesion') FROM lab)
    SELECT stage, count(*) AS n FROM st WHERE ok GROUP BY stage""")
def b17(spark, sf):
    return sm.stage_membership(s.labels(spark, sf)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("B18_feature_subset", f"""WITH {s.LONG_SQL} SELECT recording_id,
    {', '.join(f"avg(v) FILTER (channel = '{c}') AS {c}_mean" for c in ('acc', 'acoustic', 'Fx', 'Fy', 'Fz'))}
    FROM long GROUP BY recording_id""", "acc_mean acoustic_mean Fx_mean Fy_mean Fz_mean")
def b18(spark, sf):
    names = [n for n in ft.subset_names("raw25") if n.endswith("_mean")]
    return ft.time_features(s.signal_rows(spark, sf)).select("recording_id", *names)


@query("B19_concat_blocks", f"""WITH {s.REC_SQL} SELECT recording_id, avg(acc) AS v1_acc_mean, stddev_pop(acc) AS v1_acc_std,
    avg(acoustic) AS v2_acoustic_mean, sqrt(avg(acoustic * acoustic)) AS v2_acoustic_rms FROM recs GROUP BY recording_id""",
       "v1_acc_mean v1_acc_std v2_acoustic_mean v2_acoustic_rms")
def b19(spark, sf):
    rows = s.signal_rows(spark, sf)
    a = ft.time_features(rows, ["acc"]).select("recording_id", "acc_mean", "acc_std")
    b = ft.time_features(rows, ["acoustic"]).select("recording_id", "acoustic_mean", "acoustic_rms")
    return sm.concat_features([a, b], "recording_id", ["v1_", "v2_"])


@query("B21_sample_time", f"WITH {s.REC_SQL} SELECT recording_id, pos, pos * 0.0006 AS t FROM recs", "t")
def b21(spark, sf):
    return s.recordings(spark, sf).select("recording_id", "pos", fn.sample_time(F.col("pos")).alias("t"))


@query("B22_weighted_resample")
def b22(spark, sf):
    o = s.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("type"), "o_orderkey")
    n = o.count()
    drawn = sm.weighted_resample(o, "type", {"O": 3.0}, n, 42, [F.col("o_orderkey")])
    return drawn.groupBy("type").agg(F.count(F.lit(1)).alias("n_draws"), F.countDistinct("o_orderkey").alias("n_rows"))


@query("B22_resample_total", "SELECT count(*) AS n_draws FROM orders")
def b22n(spark, sf):
    o = s.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("type"), "o_orderkey")
    drawn = sm.weighted_resample(o, "type", {"O": 3.0}, o.count(), 7, [F.col("o_orderkey")])
    return drawn.agg(F.count(F.lit(1)).alias("n_draws"))


@query("B22_class_shares", """WITH c AS (SELECT o_orderpriority || '/' || o_orderstatus AS type, count(*) * CASE WHEN o_orderstatus = 'P' THEN 3.0 ELSE 1.0 END AS mass
    FROM orders GROUP BY 1, o_orderstatus) SELECT type, mass / sum(mass) OVER () AS share, true AS near FROM c""", "share")
def b22s(spark, sf):
    """The share of each class among the draws lies within five deviations of its share of the weight."""
    o = s.table(spark, sf, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("type"), "o_orderkey")
    n, weights = 4 * o.count(), {f"{p}/P": 3.0 for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    drawn = sm.weighted_resample(o, "type", weights, n, 5, [F.col("o_orderkey")])
    mass = F.when(F.col("type").endswith("/P"), 3.0).otherwise(1.0) * F.count(F.lit(1))
    share = o.groupBy("type").agg(mass.alias("mass")).withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy()))
    found = share.join(drawn.groupBy("type").agg(F.count(F.lit(1)).alias("k")), "type", "left")
    off = F.abs(F.coalesce("k", F.lit(0)) / F.lit(float(n)) - F.col("share"))
    return found.select("type", "share", (off < 5 * F.sqrt(F.col("share") * (1 - F.col("share")) / n) + 1e-9).alias("near"))


META_SQL = f"""WITH {s.RUN_SQL} SELECT experiment, split, seed, epochs,
    CASE flag WHEN 'N' THEN 'ctrl' WHEN 'A' THEN 'ceil' ELSE 'sym-T' END AS variant,
    CASE flag WHEN 'N' THEN 'ctrl' WHEN 'A' THEN 'hard_C40' ELSE 'hard_C12.5' END AS hard_variant, lam FROM runs"""


@query("B23_B24_run_meta", META_SQL, "lam")
def b23(spark, sf):
    return rp.run_meta(s.runs(spark, sf)).select("experiment", "split", "seed", "epochs", "variant", "hard_variant", "lam")


@query("B25_name_filter", f"WITH {s.RUN_SQL} SELECT experiment, split FROM runs WHERE experiment LIKE '%ctrl%'")
def b25(spark, sf):
    df = s.runs(spark, sf)
    return df.filter(fn.name_matches(F.col("experiment"), "ctrl")).select("experiment", "split")
