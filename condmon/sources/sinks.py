"""Report, constants and feature-table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def constants_document(materials: DataFrame, meta: dict) -> DataFrame:
    """(value): one JSON document with meta and the constants of all materials, of which there is a handful."""
    cells = {
        "form": F.lit(meta.get("form", "simple")),
        "failure_um": F.lit(float(meta["failure_um"])),
        "wear_cap_um": F.lit(float(meta.get("wear_cap_um", 450.0))),
        "window": F.array(*[F.lit(float(x)) for x in meta.get("window", (0.15, 0.85))]),
    }
    cells |= {k: F.array(*[F.lit(int(x)) for x in meta.get(k, ())]).cast("array<int>")
              for k in ("train_sets", "excluded_sets", "caution_sets")}
    entry = F.struct(F.col("material").cast("string"), F.struct(*materials.columns))
    return materials.agg(F.map_from_entries(F.collect_list(entry)).alias("constants")).select(
        F.struct(*[v.alias(k) for k, v in cells.items()]).alias("meta"), "constants")


def set_lines(sets: DataFrame, meta: dict) -> DataFrame:
    """(value): one JSON line per set."""
    return sets.select(F.to_json(F.struct(
        F.col("set").cast("string").alias("set_key"), F.lit(float(meta["failure_um"])).alias("failure_um"),
        F.struct(*sets.columns).alias("record"))).alias("value"))


def write_constants(materials: DataFrame, sets: DataFrame, meta: dict, path: str) -> None:
    """path/document holds meta and constants, path/sets one JSON line per set, whatever their number."""
    constants_document(materials, meta).coalesce(1).write.mode("overwrite").json(f"{path}/document")
    set_lines(sets, meta).write.mode("overwrite").text(f"{path}/sets")


def results_json(runs: DataFrame) -> DataFrame:
    """One JSON text per run (the results file layout)."""
    return runs.select(F.to_json(F.struct(*runs.columns)).alias("value"))
