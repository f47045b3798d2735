"""Standardisation with population std, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Scaler:
    """(feature, mean, std) rows. One row per feature, so its size does not grow with the data."""

    stats: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], tiny: float = 1e-8, imputed: bool = False) -> Scaler:
        """With `imputed`, the std is that of the column after its gaps take the mean."""
        def cell(c):
            v = f"CASE WHEN NOT isnan(`{c}`) THEN `{c}` END"
            scale = f" * sqrt(count({v}) / count(1))" if imputed else ""
            return (f"named_struct('feature', '{c}', 'mean', coalesce(avg({v}), 0D), "
                    f"'std', coalesce(stddev_pop({v}), 0D){scale})")

        # SQL text: one call per column, which matters for hundreds of them
        wide = df.agg(*[F.expr(cell(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
        rows = wide.select(F.inline(F.array(*[f"_s{i}" for i in range(len(cols))])))
        return cls(rows.withColumn("std", F.when(F.col("std") < tiny, 1.0).otherwise(F.col("std"))))

    def values(self) -> dict[str, tuple[float, float]]:
        return {r["feature"]: (r["mean"], r["std"]) for r in self.stats.collect()}

    def transform(self, df: DataFrame, impute: bool = False) -> DataFrame:
        """Standardised columns; with `impute`, missing values take the training mean (0 after scaling)."""
        out = {}
        for c, (mean, std) in self.values().items():
            z = f"(CASE WHEN NOT isnan(`{c}`) THEN `{c}` END - {mean!r}D) / {std!r}D"
            out[c] = F.expr(f"coalesce({z}, 0D)" if impute else z)
        return df.withColumns(out)

    def save(self, path: str) -> None:
        self.stats.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        return cls(spark.read.parquet(path))
