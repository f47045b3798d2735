"""The domain tables, derived from the driver's tables: in Spark and as SQL text.

recordings: events of a user in time order; channels from value and the props field.
raw labels: orders as label rows with missing, bad and variously spelled cells.
samples:    orders of a customer as the measurements of one set.
params:     one row per customer with speed, feed and material.
preds:      line items as predictions per epoch, set and time.
runs:       line items aggregated to experiment results per (family, variant, seed, epochs).
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from condmon.operators.skew import rank_in_group
from condmon.session import stored
from condmon.sources import clean_labels, flatten_runs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- recordings
CHANNEL_EXPRS = ("acc - acoustic / 10 AS Fx", "acoustic - acc AS Fy", "acc * acoustic / 100 AS Fz")
REC_SQL = f"""rec0 AS (
    SELECT user_id AS recording_id, value AS acc, ts, event_id,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS acoustic,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
    FROM events),
recs AS (SELECT recording_id, pos, acc, acoustic, {", ".join(CHANNEL_EXPRS)} FROM rec0)"""


def signal_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings without positions: enough for everything that ignores order."""
    acoustic = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), "ts", "event_id", F.col("value").alias("acc"),
        acoustic.alias("acoustic"))
    return rows.selectExpr("*", *CHANNEL_EXPRS)


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return rank_in_group(signal_rows(spark, sf), ["recording_id"], [F.col("ts"), F.col("event_id")], "pos")


def stored_recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings written once, for work that reads them several times."""
    return stored(recordings(spark, sf), "recordings")


def write_files(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """(rid, value): the values of a rid as the lines of a text file of its own, sorted by `order`.

    In a folder of the local file system, tasks stream the files path/<task>/rid=<rid>.txt. Spark's writer takes a folder, several
    renames and a change of rights for each, many milliseconds a file; it serves all other stores, as path/rid=<rid>/part-*.txt.
    """
    spark = rows.sparkSession
    dealt = rows.repartition("rid")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        dealt.sortWithinPartitions("rid", *order).select("rid", "value").write.partitionBy("rid").text(path)
        return
    local = urlparse(folder.toUri().toString()).path

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        into = os.path.join(local, f"{task.partitionId():05d}")
        os.makedirs(into, exist_ok=True)
        # Hidden until complete, and one per attempt, so that a repeated task leaves no half of a file.
        draft = os.path.join(into, f".{task.taskAttemptId()}")
        name, out, n = None, None, 0
        for batch in batches:
            for rid, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or rid != name:
                    if out is not None:
                        out.close()
                        os.replace(draft, os.path.join(into, f"rid={name}.txt"))
                    name, out, n = rid, open(draft, "w", encoding="utf-8", newline=""), n + 1
                out.write(value + "\n")
        if out is not None:
            out.close()
            os.replace(draft, os.path.join(into, f"rid={name}.txt"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    text = F.coalesce(F.col("rid").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))  # as Spark's writer names it
    dealt.sortWithinPartitions("rid", *order).select(text.alias("rid"), "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()


LONG_SQL = REC_SQL + """,
long AS (SELECT recording_id, pos, 'acc' AS channel, acc AS v FROM recs
    UNION ALL SELECT recording_id, pos, 'acoustic', acoustic FROM recs
    UNION ALL SELECT recording_id, pos, 'Fx', Fx FROM recs
    UNION ALL SELECT recording_id, pos, 'Fy', Fy FROM recs
    UNION ALL SELECT recording_id, pos, 'Fz', Fz FROM recs)"""

# ---- raw labels
NO = "(o_custkey % 18 + 1)"
RAW_EXPRS = (
    "o_orderkey AS rowno",
    f"CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE {NO} || '' END AS Set",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey || '' END AS ImageID",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey + 1) || '' END AS SensorID",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'img_' || o_orderkey END AS ImageName",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'rec_' || o_orderkey END AS SensorName",
    f"CASE WHEN o_orderkey % 2 = 0 THEN 'MATWI/Set' || {NO} || '/img_' || o_orderkey "
    f"ELSE 'Set' || {NO} || chr(92) || 'img_' || o_orderkey END AS ImageFile",
    f"CASE WHEN o_orderkey % 3 = 0 THEN 'MATWI' || chr(92) || 'Set' || {NO} || '/rec_' || o_orderkey "
    f"ELSE 'other/rec_' || o_orderkey END AS SensorFile",
    "CASE WHEN o_orderkey % 19 = 0 THEN 'bad' ELSE CAST(o_orderdate AS DATE) || ' 10:00:00' END AS ImageDateTime",
    "CASE WHEN o_orderkey % 17 = 0 THEN '?' ELSE (o_totalprice / 1000) || '' END AS wear",
    "CASE o_orderpriority WHEN '1-URGENT' THEN ' Flank wear ' WHEN '2-HIGH' THEN 'Adhesive' "
    "WHEN '3-MEDIUM' THEN 'combination' WHEN '4-NOT SPECIFIED' THEN 'flank wear & adhesion' "
    "ELSE NULL END AS type",
)


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*RAW_EXPRS)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return clean_labels(raw_labels(spark, sf))


RAW_SQL = f"raw AS (SELECT {', '.join(RAW_EXPRS)} FROM orders)"
PATH_SQL = (r"regexp_replace(regexp_replace({c}, '^MATWI[\\/]', ''), '^(Set\d+)[\\/]', '\1/\1/')")
LAB_SQL = RAW_SQL + f""",
lab0 AS (SELECT rowno, TRY_CAST(TRY_CAST(Set AS DOUBLE) AS INTEGER) AS sid,
    TRY_CAST(ImageID AS DOUBLE) AS image_id, TRY_CAST(SensorID AS DOUBLE) AS sensor_id,
    ImageName AS image_name, SensorName AS sensor_name,
    {PATH_SQL.format(c='ImageFile')} AS image_file, {PATH_SQL.format(c='SensorFile')} AS sensor_file,
    TRY_CAST(ImageDateTime AS TIMESTAMP) AS image_time, TRY_CAST(wear AS DOUBLE) AS wear,
    replace(lower(trim(coalesce(type, 'nan'))), ' ', '_') AS t0 FROM raw),
lab AS (SELECT rowno, sid, image_id, sensor_id, image_file, sensor_file, image_time, wear,
    CASE t0 WHEN 'adhesive' THEN 'adhesion' WHEN 'combination' THEN 'flank_wear+adhesion'
        WHEN 'flank_wear_&_adhesion' THEN 'flank_wear+adhesion' ELSE t0 END AS type,
    image_name IS NOT NULL AND image_id IS NOT NULL AS has_image,
    sensor_name IS NOT NULL AND sensor_id IS NOT NULL AS has_sensor,
    image_name IS NOT NULL AND image_id IS NOT NULL AND sensor_name IS NOT NULL AND sensor_id IS NOT NULL AS both_ok,
    CASE WHEN sid <= 11 THEN 'CK45' WHEN sid IS NOT NULL THEN 'RVS 304' END AS material,
    CASE WHEN sid IN (1,2,5,7,8,10,11) THEN 'train' WHEN sid IN (3,6,12) THEN 'val'
        WHEN sid IN (4,9,13) THEN 'test' ELSE 'unseen' END AS split
    FROM lab0)"""

# ---- samples and parameters per set
SAMP_SQL = """samp AS (SELECT o_custkey AS set_id, o_orderkey AS rowno, o_orderstatus AS type,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS t,
    least(o_totalprice / 1000, 450.0) AS wear FROM orders)"""
PARAM_EXPRS = (
    "c_custkey AS set_id",
    "CASE WHEN c_custkey % 2 = 0 THEN 'CK45' ELSE 'RVS 304' END AS material",
    "CASE WHEN c_custkey % 29 = 3 THEN NULL ELSE 80 + (c_custkey % 7) * 12.5E0 END AS Vc",
    "0.05E0 + 0.01E0 * (c_custkey % 3) AS fz",
    "1.0E0 + (c_custkey % 2) AS Ap",
)
PARAM_SQL = f"params AS (SELECT {', '.join(PARAM_EXPRS)} FROM customer)"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("rowno"), F.col("o_orderstatus").alias("type"),
        F.least(F.col("o_totalprice") / 1000, F.lit(450.0)).alias("wear"), "o_orderdate")
    ranked = rank_in_group(o, ["set_id"], [F.col("o_orderdate"), F.col("rowno")], "_p")
    return ranked.select("set_id", "rowno", "type", (F.col("_p") + 1).cast("double").alias("t"), "wear")


def params(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*PARAM_EXPRS)


# ---- predictions
PRED_EXPRS = (
    "l_linenumber AS epoch", "l_partkey AS set_id", "l_orderkey AS rowno", "l_quantity / 5 AS t",
    "l_extendedprice / 250000 AS pred_norm", "l_discount * 40 - 2 AS raw",
    "l_extendedprice / 250 AS target", "l_quantity * 8 AS pred",
    "CASE WHEN l_returnflag = 'A' THEN 'flank_wear' WHEN l_returnflag = 'N' THEN 'adhesion' "
    "WHEN l_linestatus = 'F' THEN 'flank_wear+adhesion' ELSE 'other' END AS type",
)
PRED_SQL = f"preds AS (SELECT {', '.join(PRED_EXPRS)} FROM lineitem)"


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*PRED_EXPRS)


# ---- experiment runs
RUN_EXPRS = (
    "l_linestatus AS family", "l_returnflag AS flag", "l_linenumber + 40 AS seed",
    "CASE WHEN l_suppkey % 2 = 0 THEN 17 ELSE 34 END AS epochs",
    "CASE WHEN l_partkey % 2 = 0 THEN 'test' ELSE 'val' END AS split",
    "abs(l_extendedprice / 250 - l_quantity * 8) AS err", "l_tax AS tax",
)
RUN_METRICS = (
    "avg(err) AS overall", "avg(CASE WHEN tax < 0.03 THEN err END) AS flank",
    "avg(CASE WHEN tax >= 0.03 AND tax < 0.06 THEN err END) AS adh", "avg(CASE WHEN tax >= 0.06 THEN err END) AS fa",
    "count(*) AS n_total",
)
VARIANT = ("CASE flag WHEN 'N' THEN 'ctrl' WHEN 'A' THEN 'ceil' ELSE 'symt' END")
LAMBDA = "CASE flag WHEN 'N' THEN 0.0E0 WHEN 'A' THEN 0.5E0 ELSE 1.5E0 END"
NAME = f"family || '_' || {VARIANT} || '_e' || epochs || '_s' || seed"
RUN_SQL = f"""cells AS (SELECT {', '.join(RUN_EXPRS)} FROM lineitem),
runs0 AS (SELECT family, flag, seed, epochs, split, {', '.join(RUN_METRICS)} FROM cells
    GROUP BY family, flag, seed, epochs, split),
runs AS (SELECT *, {NAME} AS experiment, {LAMBDA} AS lam, seed % 17 AS best_epoch FROM runs0)"""


def nested_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run in the layout of a results file (plus its family)."""
    keys = ["family", "flag", "seed", "epochs"]
    cells = table(spark, sf, "lineitem").selectExpr(*RUN_EXPRS)
    flat = cells.groupBy(*keys, "split").agg(*[F.expr(m) for m in RUN_METRICS])
    metrics = F.struct(
        F.col("overall").alias("mae_overall_um"), F.col("flank").alias("mae_flank_wear_um"),
        F.col("adh").alias("mae_adhesion_um"), F.col("fa").alias("mae_flank_wear+adhesion_um"), "n_total")
    runs = flat.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("split", metrics))).alias("splits"))
    none_if_named = F.when(F.col("seed") % 2 == 0, F.struct(
        "epochs", F.when(F.col("flag") == "N", "none").when(F.col("flag") == "A", "early").otherwise("late").alias("fusion_mode"),
        F.when(F.col("seed") % 4 == 0, "top25").otherwise("raw25").alias("feature_set"),
        (F.col("flag") != "N").alias("use_sensors"), F.lit("b0").alias("backbone")))
    lam = F.expr(LAMBDA)
    return runs.select(
        "family", F.expr(NAME).alias("experiment"), none_if_named.alias("config"), F.lit(None).cast("struct<epochs:int>").alias("base_config"),
        F.struct(lam.alias("lambda_max"), F.lit("all").alias("apply_to"), (F.col("flag") == "A").alias("one_sided"),
                 (F.col("flag") == "R").alias("use_taylor_slope")).alias("physics"),
        F.struct((F.col("flag") != "N").alias("enabled"), F.when(F.col("flag") != "N", F.when(F.col("flag") == "A", 40.0).otherwise(12.5)).alias("C_um")).alias("hard"),
        (F.col("seed") % 17).alias("best_epoch"), F.lit(None).cast("double").alias("best_val_mae_um"), "splits")


def as_run_schema(df: DataFrame) -> DataFrame:
    """Through JSON text and back with the file schema, as a reader would see it."""
    from condmon.sources import RUN_SCHEMA
    text = df.select(*[c for c in ("family",) if c in df.columns],
                     F.to_json(F.struct(*[c for c in df.columns if c != "family"])).alias("j"))
    keep = ["family"] if "family" in df.columns else []
    return text.select(*keep, F.from_json("j", RUN_SCHEMA).alias("r")).select(*keep, "r.*")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_runs(as_run_schema(nested_runs(spark, sf)))
