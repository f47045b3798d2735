"""The exploratory bundle: every table behind the label, trajectory, sensor and split figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from condmon.constants import CHANNELS, CK45, RVS, WEAR_EDGES, WEAR_LABELS, WEAR_TYPES
from condmon.functions import bin_right_open
from condmon.operators import profile as pf
from condmon.operators.lookup import attach_params
from condmon.operators.samples import stage_membership, unknown_params
from condmon.operators.sequence import life_fraction, ordered_series
from condmon.sources.recordings import check_files


def wear_bins(df: DataFrame, label: str = "wear") -> DataFrame:
    binned = df.filter(F.col(label).isNotNull()).withColumn("wear_bin", bin_right_open(F.col(label), WEAR_EDGES, WEAR_LABELS))
    return binned.groupBy("wear_bin").agg(F.count(F.lit(1)).alias("n"))


def eda_bundle(labels: DataFrame, params: DataFrame, recordings: DataFrame | None = None, files: DataFrame | None = None,
               metadata: DataFrame | None = None, sample: int | None = 20) -> dict[str, DataFrame]:
    """All tables, lazily; persist `labels` first when several of them are used.

    `files` is a listing of paths to hold the references against, `metadata` has the descriptive columns of each recording,
    of which `sample` rows are looked at (None: all).
    """
    measured = labels.filter(F.col("wear").isNotNull())
    out = {
        "integrity": pf.integrity(labels),
        "sync_errors": pf.sync_errors(labels),
        "wear_describe": pf.describe(measured, "wear"),
        "type_counts": pf.value_counts(labels, "type"),
        "type_by_material": pf.crosstab(labels, "type", "material", [CK45, RVS]),
        "set_by_type": pf.pivot_counts(labels, "Set", "type", WEAR_TYPES),
        "wear_histogram": pf.histogram(measured, "wear", 40),
        "wear_histogram_by_type": pf.histogram(measured, "wear", 30, ["type"]),
        "wear_histogram_by_split": pf.histogram(measured, "wear", 25, ["split"]),
        "wear_boxes": pf.five_number(measured, "wear", "type"),
        "trajectories": pf.trajectory_stats(labels),
        "series": ordered_series(measured.select("Set", "ImageID", "wear", "type"), "Set", "ImageID"),
        "life": life_fraction(measured, "Set", "ImageID"),
        "set_params": attach_params(pf.group_extremes(measured, "Set", "wear"), params),
        "stages": stage_membership(measured).groupBy("stage").agg(F.count(F.lit(1)).alias("n")),
        "splits": pf.split_stats(labels),
        "wear_bins": wear_bins(labels),
        "recordings_per_set": pf.recordings_per_set(labels),
        "unknown_params": unknown_params(params),
        "first_mid_last": pf.first_mid_last(labels.filter("has_sensor"), "Set", [F.col("SensorID")]),
    }
    if files is not None:
        out["image_files"] = check_files(labels, files, "ImageFile")
        out["sensor_files"] = check_files(labels, files, "SensorFile")
    if metadata is not None:
        out["metadata"] = pf.distinct_on_sample(metadata, metadata.columns, sample)
    if recordings is not None:
        stats = pf.channel_stats(recordings, "recording_id", CHANNELS)
        out["channel_stats"] = stats
        out["near_zero"] = pf.near_zero(stats.filter(F.col("channel") == "acoustic"), "mean")
    return out
