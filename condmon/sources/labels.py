"""Label and process-parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from condmon.constants import CUTTING, TYPE_MAP
from condmon.functions import (
    canonical_type, is_rvs, material, normalise_path, parse_param, set_number, split_label,
    to_number, to_ts,
)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every cell as text and blanks trimmed from the header names."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def with_modality(df: DataFrame) -> DataFrame:
    image = F.col("ImageName").isNotNull() & F.col("ImageID").isNotNull()
    sensor = F.col("SensorName").isNotNull() & F.col("SensorID").isNotNull()
    return df.withColumns({"has_image": image, "has_sensor": sensor, "both": image & sensor})


def clean_labels(raw: DataFrame, type_map: dict[str, str] = TYPE_MAP) -> DataFrame:
    """Typed, canonical labels with modality flags, material and split."""
    have = set(raw.columns)
    cleaned = {c: normalise_path(F.col(c)) for c in ("ImageFile", "SensorFile") if c in have}
    cleaned["type"] = canonical_type(F.col("type"), type_map)
    cleaned["Set"] = to_number(F.col("Set")).cast("int")
    cleaned |= {c: to_number(F.col(c)) for c in ("wear", "ImageID", "SensorID") if c in have}
    cleaned |= {c: to_ts(F.col(c)) for c in ("ImageDateTime", "SensorDateTime") if c in have}
    flagged = with_modality(raw.withColumns(cleaned))
    return flagged.withColumns({"material": material(F.col("Set")), "split": split_label(F.col("Set"))})


def read_labels(spark: SparkSession, path: str, type_map: dict[str, str] = TYPE_MAP) -> DataFrame:
    return clean_labels(read_raw_csv(spark, path), type_map)


def clean_set_params(raw: DataFrame, mode: str = "mean") -> DataFrame:
    """Per-set parameters; the first column holds 'Set N' whatever its name is."""
    named = raw.withColumnRenamed(raw.columns[0], "set_label")
    have = set(named.columns)
    out = {"Set": set_number(F.col("set_label"))}
    out |= {c: parse_param(F.col(c), mode) for c in CUTTING if c in have}
    if "material" in have:
        out["material_RVS"] = is_rvs(F.col("material"))
    return named.withColumns(out)


def read_set_params(spark: SparkSession, path: str, mode: str = "mean") -> DataFrame:
    return clean_set_params(read_raw_csv(spark, path), mode)
