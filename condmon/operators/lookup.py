"""Joins: per-set parameters, control deltas, rates, twins.

No side is hinted as broadcast. Spark broadcasts a side only when its measured size is
below the threshold, and splits hot keys of the large side otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.operators.skew import join_null_safe


def attach_params(df: DataFrame, params: DataFrame, on: str = "Set") -> DataFrame:
    """Left lookup of one parameter row per key; unknown keys get NULLs."""
    return df.join(params, on, "left")


def attach_constants(df: DataFrame, constants: DataFrame, on: str = "material") -> DataFrame:
    return df.join(constants, on, "left")


def attach_rates(df: DataFrame, rates: DataFrame, on: str = "Set", rate: str = "k") -> DataFrame:
    """Rate per key, 0 where the key is unknown."""
    joined = df.join(rates.select(on, rate), on, "left")
    return joined.withColumn(rate, F.coalesce(rate, F.lit(0.0)))


def delta_vs_control(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], control: Column,
                     first_by: Sequence[Column] | None = None) -> DataFrame:
    """Add d_<metric> = metric minus the control row's metric in the same keys; NULL without control.

    If several rows match `control`, the first under `first_by` counts.
    """
    order = F.struct(*(first_by or [F.col(m) for m in metrics]))
    base = df.filter(control).groupBy(*keys).agg(
        *[F.min_by(F.col(f"`{m}`"), order).alias(f"_c_{m}") for m in metrics])
    joined = join_null_safe(df, base, keys, "left")
    return joined.withColumns(
        {f"d_{m}": F.col(f"`{m}`") - F.col(f"`_c_{m}`") for m in metrics}).drop(*[f"_c_{m}" for m in metrics])


def any_changed(left: DataFrame, right: DataFrame, on: str, cols: Sequence[str],
                rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """Per key: does any column of `left` differ from `right` by more than atol + rtol*|right|?"""
    pairs = left.select(on, F.struct(*cols).alias("_a")).join(right.select(on, F.struct(*cols).alias("_b")), on)
    moved = F.lit(False)
    for c in cols:
        a, b = F.col("_a").getField(c), F.col("_b").getField(c)
        moved = moved | (F.abs(a - b) > atol + rtol * F.abs(b))
    return pairs.select(on, moved.alias("changed"))


def zero_fill_features(labels: DataFrame, feats: DataFrame, names: Sequence[str],
                       on: str = "recording_id") -> DataFrame:
    """Every label keeps a feature row; recordings that could not be read are all zeros and flagged."""
    joined = labels.join(feats.select(on, *names).withColumn("_seen", F.lit(True)), on, "left")
    filled = {n: F.coalesce(n, F.lit(0.0)) for n in names}
    return joined.withColumns(filled | {"is_missing": F.col("_seen").isNull()}).drop("_seen")
