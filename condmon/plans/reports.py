"""Experiment reports over (run, split) rows as `read_runs` gives them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.functions import name_matches
from condmon.operators.lookup import delta_vs_control
from condmon.operators.sequence import best_epoch, best_per_group
from condmon.sources.runs import SHORT

# fixed values: published rows that reports append for context
PAPER = {"experiment": "paper_baseline", "split": "test", "overall": 30.0, "flank": 14.0, "adh": 39.0, "fa": 91.0}
VISION_REFERENCES = [PAPER | {"backbone": "resnet50", "head_type": "simple", "scheduler": False}]
FUSION_REFERENCES = [
    {"experiment": "vision_only_664 (reference)", "fusion_mode": "none", "feature_set": "none",
     "use_sensors": False, "split": "test", "best_epoch": 14, "overall": 19.0, "flank": 16.6, "adh": 37.2,
     "fa": 23.2, "n_total": 254},
    PAPER | {"fusion_mode": "none", "feature_set": "none", "use_sensors": False, "n_total": 254},
]
SEED_REFERENCES = [
    {"config_name": "paper_resnet50", "split": "test", "overall": 30.0, "flank": 14.0, "adh": 39.0, "fa": 91.0},
    {"config_name": "vision_664_1seed (s42)", "split": "test", "overall": 19.0, "flank": 16.6, "adh": 37.2, "fa": 23.2},
    {"config_name": "vision_647_1seed (s42)", "split": "test", "overall": 22.4, "flank": 20.3, "adh": 35.1, "fa": 27.1},
    {"config_name": "t3_gated_md30_1seed(s42)", "split": "test", "overall": 21.44, "flank": 18.94, "adh": 40.13, "fa": 25.77},
]


def with_reference_rows(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Append fixed rows; cells they do not name are NULL."""
    cells = [F.struct(*[F.lit(r.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields]) for r in rows]
    fixed = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
    return df.unionByName(fixed)


def variant(lam: Column, one_sided: Column, taylor: Column) -> Column:
    """'ctrl' without physics, else 'ceil' or 'sym', with '-T' for the tool-life slope."""
    kind = F.when(F.coalesce(one_sided, F.lit(False)), "ceil").otherwise("sym")
    tail = F.when(F.coalesce(taylor, F.lit(False)), "-T").otherwise("")
    return F.when(F.coalesce(lam, F.lit(0.0)) == 0.0, "ctrl").otherwise(F.concat(kind, tail))


def short_number(x: Column) -> Column:
    """Number without trailing zeros (40.0 -> 40, 12.5 -> 12.5), six significant digits."""
    text = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return text


def hard_variant(enabled: Column, width: Column) -> Column:
    on = F.coalesce(enabled, F.lit(False)) & width.isNotNull()
    return F.when(on, F.concat(F.lit("hard_C"), short_number(width))).otherwise("ctrl")


def _number_after(name: Column, tag: str) -> Column:
    return F.regexp_extract(name, rf"_{tag}(\d+)", 1).try_cast("int")


def run_meta(runs: DataFrame) -> DataFrame:
    """Variant, weight, epochs and seed of every run; the name decides where the config is silent."""
    name = F.col("experiment")
    lam = F.coalesce("physics.lambda_max", F.lit(0.0))
    return runs.withColumns({
        "variant": variant(lam, F.col("physics.one_sided"), F.col("physics.use_taylor_slope")),
        "lam": lam,
        "epochs": F.coalesce("cfg.epochs", _number_after(name, "e"), F.lit(-1)),
        "seed": F.coalesce(_number_after(name, "s"), F.lit(-1)),
        "hard_variant": hard_variant(F.col("hard.enabled"), F.col("hard.C_um")),
        "C": F.coalesce("hard.C_um", F.lit(0.0)),
    })


def seed_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = SHORT, seed: str = "seed") -> DataFrame:
    """Mean and sample std per metric and the number of distinct seeds; std of one seed is NULL."""
    aggs = [F.countDistinct(seed).alias("seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_m"), F.stddev_samp(m).alias(f"{m}_s")]
    return df.groupBy(*keys).agg(*aggs)


def seed_pivot(df: DataFrame, keys: Sequence[str], seeds: Sequence[int], metric: str = "overall",
               seed: str = "seed") -> DataFrame:
    """One column per seed with the first value of the metric."""
    return df.groupBy(*keys).agg(*[
        F.min_by(F.when(F.col(seed) == s, F.col(metric)), F.when(F.col(seed) == s, F.struct(*_tiebreak(df, metric)))
                 ).alias(f"s{s}") for s in seeds])


def _tiebreak(df: DataFrame, metric: str) -> list[str]:
    return [c for c in ("experiment", "file") if c in df.columns] + [metric]


def vision_report(runs: DataFrame) -> DataFrame:
    rows = runs.select(
        "experiment", F.col("cfg.backbone").alias("backbone"), F.col("cfg.head_type").alias("head_type"),
        F.col("cfg.normalisation").alias("normalisation"), F.col("cfg.loss").alias("loss"),
        F.col("cfg.use_scheduler").alias("scheduler"), "split", "best_epoch", "best_val_mae_um", *SHORT, "n_total")
    return with_reference_rows(rows, VISION_REFERENCES).orderBy("split", F.asc_nulls_last("overall"))


def fusion_rows(runs: DataFrame) -> DataFrame:
    return runs.select(
        "experiment", F.col("cfg.fusion_mode").alias("fusion_mode"), F.col("cfg.feature_set").alias("feature_set"),
        F.col("cfg.use_sensors").alias("use_sensors"), "split", "best_epoch", "best_val_mae_um", *SHORT, "n_total")


def fusion_report(runs: DataFrame) -> DataFrame:
    return with_reference_rows(fusion_rows(runs), FUSION_REFERENCES).orderBy("split", F.asc_nulls_last("overall"))


def fusion_analysis(runs: DataFrame) -> DataFrame:
    """Best test run overall, per fusion mode, per feature set and among sensor runs, with the distance
    to the first control run (no fusion)."""
    test = fusion_rows(runs).filter((F.col("split") == "test") & ~name_matches(F.col("experiment"), "reference|paper"))
    picks = F.array_compact(F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("name")),
        F.when(F.col("fusion_mode").isin("early", "intermediate", "late"),
               F.struct(F.lit("fusion_mode").alias("scope"), F.col("fusion_mode").alias("name"))),
        F.when(F.col("feature_set").isin("raw25", "top25", "all40"),
               F.struct(F.lit("feature_set").alias("scope"), F.col("feature_set").alias("name"))),
        F.when(F.col("use_sensors"), F.struct(F.lit("sensors").alias("scope"), F.lit("all").alias("name")))))
    scoped = test.select("experiment", "overall", "fa", F.inline(picks))
    best = best_per_group(scoped, ["scope", "name"], "overall", ["experiment"])
    control = test.filter(F.col("fusion_mode") == "none").agg(F.min_by("overall", "experiment").alias("c"))
    return best.withColumn("delta_to_control", F.col("overall") - control.scalar())


def stage_report(runs: DataFrame) -> DataFrame:
    """Single runs of a family and split with the distance to its first control run."""
    rows = runs.select(
        "family", "experiment", "split", F.coalesce("physics.lambda_max", F.lit(0.0)).alias("lambda_max"),
        F.coalesce("physics.one_sided", F.lit(False)).alias("one_sided"),
        F.coalesce("physics.apply_to", F.lit("-")).alias("apply_to"), "best_epoch", *SHORT, "n_total")
    out = delta_vs_control(rows, ["family", "split"], ["overall", "adh", "fa"],
                           name_matches(F.col("experiment"), "ctrl"), [F.col("experiment")])
    return out.orderBy("family", "split", F.asc_nulls_last("overall"))


def confirm_report(runs: DataFrame) -> DataFrame:
    """Mean and std over seeds per family, split, epochs and variant, with the distance to the
    control of the same epochs."""
    keys = ["family", "split", "epochs"]
    table = seed_summary(run_meta(runs), [*keys, "variant", "lam"])
    means = [f"{m}_m" for m in SHORT]
    out = delta_vs_control(table, keys, means, F.col("variant") == "ctrl", [F.col("lam")])
    return out.orderBy(*keys, F.asc_nulls_last("overall_m"))


def hard_report(runs: DataFrame) -> DataFrame:
    keys = ["family", "split"]
    meta = run_meta(runs).withColumn("variant", F.col("hard_variant"))
    table = seed_summary(meta, [*keys, "variant", "C"])
    means = [f"{m}_m" for m in SHORT]
    out = delta_vs_control(table, keys, means, F.col("variant") == "ctrl", [F.col("C")])
    return out.orderBy(*keys, F.asc_nulls_last("overall_m"))


def baseline_report(runs: DataFrame, group: str = "run_group", config: str = "config_name") -> DataFrame:
    """Three-seed table per group and configuration."""
    return seed_summary(runs, [group, config, "split"]).orderBy(group, "split", F.asc_nulls_last("overall_m"))


def three_seed_report(runs: DataFrame, seeds: Sequence[int], group: str = "run_group", config: str = "config_name",
                      reference: Sequence[dict] = SEED_REFERENCES) -> DataFrame:
    """baseline_report() with the overall error of every seed, and the fixed reference rows, which have no group, seeds or spread."""
    keys = [group, config, "split"]
    table = seed_summary(runs, keys).join(seed_pivot(runs, keys, seeds), keys)
    fixed = [{config: r["config_name"], "split": r["split"], **{f"{m}_m": r[m] for m in SHORT}} for r in reference]
    return with_reference_rows(table, fixed).orderBy(F.asc_nulls_last(group), "split", F.asc_nulls_last("overall_m"))


def comparison(runs: DataFrame, reference: Sequence[dict] = (PAPER,)) -> DataFrame:
    """Results of this run next to fixed reference rows, best first."""
    rows = runs.select("experiment", "split", "best_epoch", *SHORT, "n_total")
    return with_reference_rows(rows, list(reference)).orderBy("split", F.asc_nulls_last("overall"))


def history_report(history: DataFrame, by: Sequence[str] = ("file",), metric: str = "val_mae_overall_um") -> DataFrame:
    return best_epoch(history, by, metric)
