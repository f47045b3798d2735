"""Experiment result trees: results JSON, epoch histories, tool-life constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS_STRUCT = (
    "struct<mae_overall_um double, mae_flank_wear_um double, mae_adhesion_um double, "
    "`mae_flank_wear+adhesion_um` double, n_total bigint, n_flank_wear bigint, n_adhesion bigint, "
    "`n_flank_wear+adhesion` bigint, loss double>"
)
CONFIG_STRUCT = (
    "struct<epochs int, seed int, fusion_mode string, feature_set string, use_sensors boolean, "
    "modality_dropout_p double, backbone string, head_type string, normalisation string, "
    "loss string, use_scheduler boolean>"
)
RUN_SCHEMA = (
    f"experiment string, config {CONFIG_STRUCT}, base_config {CONFIG_STRUCT}, "
    "physics struct<lambda_max double, warmup int, apply_to string, one_sided boolean, "
    "use_taylor_slope boolean>, hard struct<enabled boolean, C_um double, anchor string>, "
    f"best_epoch int, best_val_mae_um double, splits map<string, {METRICS_STRUCT}>"
)
# fixed values: metric fields of a result file and their short report names
METRICS = {
    "mae_overall_um": "overall",
    "mae_flank_wear_um": "flank",
    "mae_adhesion_um": "adh",
    "mae_flank_wear+adhesion_um": "fa",
}
SHORT = tuple(METRICS.values())

RECORD_STRUCT = (
    "struct<`set` int, material string, Vc double, fz double, max_image_id double, "
    "max_wear_um double, frac_of_failure double, slope_um_per_pass double, "
    "slope_raw_um_per_pass double, slope_clamped boolean, intercept_um double, "
    "life_at_failure double, window_lo_id double, window_hi_id double, n_window bigint, "
    "caution boolean, T_taylor double, taylor_slope_um_per_pass double, taylor_intercept_um double>"
)
CONSTANTS_SCHEMA = (
    "meta struct<form string, failure_um double, wear_cap_um double, `window` array<double>, "
    "train_sets array<int>, excluded_sets array<int>, caution_sets array<int>>, "
    "constants map<string, struct<n double, m double, C double, r2 double, n_sets bigint, "
    "n_distinct_vc bigint, `source` string, note string>>, "
    f"sets map<string, {RECORD_STRUCT}>"
)


def no_nan(col):
    return F.when(~F.isnan(col), col)


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One row per (run, split) with short metric names; NaN metrics become NULL."""
    # A config without any entry counts as none; a run without a name has that of its folder.
    empty = F.col("config").isNull() | (F.to_json("config") == "{}")
    cfg = F.when(empty, F.coalesce("base_config", "config")).otherwise(F.col("config"))
    name = F.col("experiment")
    if "file" in runs.columns:
        name = F.coalesce(name, F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    keep = [c for c in ("file", "family", "config_name", "seed_dir", "run_group") if c in runs.columns]
    cells = runs.select(
        *keep, name.alias("experiment"), cfg.alias("cfg"), "physics", "hard", "best_epoch",
        no_nan(F.col("best_val_mae_um")).alias("best_val_mae_um"), F.explode("splits").alias("split", "m"))
    return cells.select(
        *keep, "experiment", "split", "cfg", "physics", "hard", "best_epoch", "best_val_mae_um",
        *[no_nan(F.col("m").getField(k)).alias(v) for k, v in METRICS.items()],
        F.col("m.n_total").alias("n_total"))


def read_runs(spark: SparkSession, roots: str | Sequence[str], path_regex: dict[str, str] | None = None,
              pattern: str = "results.json") -> DataFrame:
    """Every result file below the roots, flattened to (run, split) rows.

    `path_regex` maps an extra column (family, config_name, seed_dir, run_group) to a pattern
    whose first group is taken from the file path.
    """
    runs = (
        spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).json(roots)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    for name, regex in (path_regex or {}).items():
        runs = runs.withColumn(name, F.regexp_extract("file", regex, 1))
    return flatten_runs(runs)


# Path layout <group>/s<seed>/<config>/results.json
SEED_TREE = {
    "run_group": r"([^/]+)/[^/]+/[^/]+/[^/]+$",
    "seed_dir": r"([^/]+)/[^/]+/[^/]+$",
    "config_name": r"([^/]+)/[^/]+$",
}
FAMILY_TREE = {"family": r"([^/]+)/[^/]+/[^/]+$"}


def with_tree_seed(runs: DataFrame) -> DataFrame:
    """Seed from a folder such as 's42'; -1 if there is none."""
    digits = F.regexp_extract("seed_dir", r"s(\d+)", 1).try_cast("int")
    return runs.withColumn("seed", F.coalesce(digits, F.lit(-1)))


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames that share some columns; the others are NULL where absent."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_history(spark: SparkSession, globs: str | Sequence[str]) -> DataFrame:
    """Epoch histories of several header layouts, one path or glob per layout."""
    frames = []
    for glob in [globs] if isinstance(globs, str) else globs:
        raw = spark.read.option("header", True).csv(glob)
        cols = [F.col(f"`{c}`").try_cast("int" if c == "epoch" else "double").alias(c) for c in raw.columns]
        frames.append(raw.select(*cols, F.col("_metadata.file_path").alias("file")))
    return union_runs(frames)


def read_constants(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(materials, sets) rows of a constants payload: the written layout, or documents that hold the sets themselves."""
    payload = (spark.read.schema(CONSTANTS_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json")
               .option("recursiveFileLookup", True).json(path))
    materials = payload.select("meta", F.explode("constants").alias("material", "c")).select(
        "material", "c.*", "meta.failure_um").distinct()
    held = payload.select("meta", F.explode("sets").alias("set_key", "r")).select("set_key", "r.*", "meta.failure_um")
    line = f"struct<set_key string, failure_um double, record {RECORD_STRUCT}>"
    listed = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path)
              .select(F.from_json("value", line).alias("s")).select("s.set_key", "s.record.*", "s.failure_um"))
    return materials, held.unionByName(listed)
