"""Choosing samples: modality, split, active range, stages, weighted resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import ADHESION_TYPES, SPLITS, WEAR_CAP_UM
from condmon.functions import normalise_wear
from condmon.operators.skew import SORT_ROWS, join_null_safe, rank_in_group, running
from condmon.session import stored

MODALITY = {"both": "both", "image": "has_image", "sensor": "has_sensor", "any": None}


def modality_filter(df: DataFrame, require: str = "both", require_sensors: bool = False) -> DataFrame:
    flag = MODALITY[require]
    if flag is not None:
        df = df.filter(flag)
    return df.filter("has_sensor") if require_sensors else df


def missing_label(df: DataFrame, policy: str = "drop", label: str = "wear") -> DataFrame:
    if policy == "drop":
        return df.filter(F.col(label).isNotNull())
    if policy == "zero":
        return df.withColumn(label, F.coalesce(label, F.lit(0.0)))
    raise ValueError("policy must be 'drop' or 'zero'")


def cap_label(df: DataFrame, cap: float | None = WEAR_CAP_UM, label: str = "wear") -> DataFrame:
    """Upper limit on the label; a missing label stays missing."""
    if cap is None:
        return df
    return df.withColumn(label, F.when(F.col(label).isNotNull(), F.least(F.col(label), F.lit(cap))))


def split_members(split: str, set_range: str = "1-13", splits: dict = SPLITS) -> list[int]:
    """Sets of a split. A named split ignores the range, except that 1-17 trains on unseen too."""
    if set_range not in ("1-13", "1-17"):
        raise ValueError("set_range must be '1-13' or '1-17'")
    if split == "all":
        return list(range(1, int(set_range.split("-")[1]) + 1))
    members = list(splits[split])
    if split == "train" and set_range == "1-17":
        members += list(splits["unseen"])
    return members


def select_samples(df: DataFrame, split: str = "train", set_range: str = "1-13", require: str = "both",
                   missing: str = "drop", cap: float | None = WEAR_CAP_UM,
                   require_sensors: bool = False) -> DataFrame:
    """Rows one training or evaluation split uses, with capped and normalised labels."""
    rows = df.filter(F.col("Set").isin(*split_members(split, set_range)))
    rows = cap_label(missing_label(modality_filter(rows, require, require_sensors), missing), cap)
    return rows.withColumn("wear_norm", normalise_wear(F.col("wear")))


def stage_rules(label: str = "wear", low: float = 80.0, high: float = 200.0) -> dict[str, Column]:
    w = F.col(label)
    return {"low": w < low, "mid": (w >= low) & (w < high), "high": w >= high,
            "adhesion": F.col("type").isin(*ADHESION_TYPES)}


def stage_membership(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """One row per (sample, stage) it belongs to; stages may overlap."""
    names = F.array(*[F.when(cond, F.lit(n)) for n, cond in (rules or stage_rules()).items()])
    return df.withColumn("stage", F.explode(F.array_compact(names)))


def unknown_params(df: DataFrame, c: str = "Vc") -> DataFrame:
    return df.filter(F.col(c).isNull())


def feature_block(df: DataFrame, key: str, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.select(key, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in cols])


def concat_features(frames: Sequence[DataFrame], on: str, prefixes: Sequence[str]) -> DataFrame:
    """Feature blocks side by side, matched by sample key."""
    out = None
    for df, prefix in zip(frames, prefixes, strict=True):
        block = feature_block(df, on, [c for c in df.columns if c != on], prefix)
        out = block if out is None else out.join(block, on)
    return out


def weighted_resample(df: DataFrame, cls: str, weights: dict[str, float], n: int, seed: int,
                      order: Sequence[Column], default: float = 1.0, limit: int = SORT_ROWS) -> DataFrame:
    """n draws with replacement, row weight given by class.

    Drawing a class by its total weight and then a row of that class evenly is the same
    distribution as drawing a row by its weight. Each draw is then one equi-join on
    (class, row number), so nothing is compared with everything. The classes lie side by side on a line of their masses, which is
    cut into as many equal parts as there are classes; a draw meets only the classes of its part. Draws come from hashes of
    the draw number and stay the same when a task is run again. NULL is a class.
    """
    ranked = rank_in_group(df, [cls], order, "_idx", limit)
    weight = F.lit(default)
    for name, value in weights.items():
        weight = F.when(F.col(cls) == name, float(value)).otherwise(weight)
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_mass": F.col("_n") * weight, "_all": F.lit(0)})
    line = stored(running(sizes.filter("_mass > 0"), ["_all"], [F.col(cls)], "_mass", "sum", "_hi", limit), "masses")
    whole = line.agg(F.max("_hi").alias("total"), F.count(F.lit(1)).alias("k")).first()
    total, parts = whole["total"] or 0.0, max(1, whole["k"])

    def uniform(salt: int) -> Column:
        return F.pmod(F.xxhash64("draw", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)

    def part(c: str) -> Column:
        return F.least(F.floor(F.col(c) / max(total, 1e-300) * parts), F.lit(parts - 1)).cast("long")

    spans = line.withColumn("_lo", F.col("_hi") - F.col("_mass"))
    # Neighbours meet at the same number, and nothing lies behind the last class.
    spans = spans.withColumns({"_lo": F.greatest("_lo", F.lit(0.0)), "_hi": F.when(F.col("_hi") < total, F.col("_hi")).otherwise(float("inf"))})
    index = spans.withColumn("_part", F.explode(F.sequence(part("_lo"), F.when(F.col("_hi") < total, part("_hi")).otherwise(parts - 1))))
    drawn = df.sparkSession.range(n if whole["k"] else 0).withColumnRenamed("id", "draw").withColumn("_u", uniform(1) * total)
    met = drawn.withColumn("_part", part("_u")).join(index.select(F.col(cls), "_n", "_lo", "_hi", "_part"), "_part")
    first = F.max_by(F.struct(F.col(cls).alias("c"), F.col("_n").alias("n")), "_lo")  # of two that rounding lets overlap
    picked = met.filter((F.col("_lo") <= F.col("_u")) & (F.col("_u") < F.col("_hi"))).groupBy("draw").agg(first.alias("_pick"))
    draws = picked.select("draw", F.col("_pick.c").alias(cls),
                          F.least(F.floor(uniform(2) * F.col("_pick.n")).cast("long"), F.col("_pick.n") - 1).alias("_idx"))
    return join_null_safe(draws, ranked, [cls, "_idx"], "inner").drop("_idx")
