"""Error metrics by class, baselines, improvement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from condmon.constants import WEAR_TYPES


def error_by_class(df: DataFrame, pred: str = "pred", target: str = "target", cls: str = "type",
                   keys: Sequence[str] = (), classes: Sequence[str] = WEAR_TYPES) -> DataFrame:
    """Overall MAE and n, and per class <class> and n_<class>; NULL and 0 for an empty class.

    Rows of other classes count in the overall figures only.
    """
    err = F.abs(F.col(target) - F.col(pred))
    aggs = [F.avg(err).alias("overall"), F.count(F.lit(1)).alias("n")]
    for name in classes:
        hit = F.col(cls) == name
        aggs += [F.avg(F.when(hit, err)).alias(name), F.count_if(hit).alias(f"n_{name}")]
    return df.groupBy(*keys).agg(*aggs)


def mean_baseline(df: DataFrame, label: str, train, name: str = "pred") -> DataFrame:
    """Predict the training mean everywhere; `train` is a condition on the rows."""
    mean = df.filter(train).agg(F.avg(label).alias("m"))
    return df.withColumn(name, mean.scalar())


def improvement(df: DataFrame, base: str, metric: str, strong: float = 50.0, moderate: float = 80.0) -> DataFrame:
    """Percent better than the baseline, and a verdict on the metric itself."""
    verdict = F.when(F.col(metric) < strong, "strong").when(F.col(metric) < moderate, "moderate").otherwise("weak")
    return df.withColumns({"improvement_pct": (1 - F.col(metric) / F.col(base)) * 100, "verdict": verdict})


def best_method(results: DataFrame, metric: str = "overall", order: str = "position") -> DataFrame:
    """Lowest test error; the earlier method wins a tie."""
    best = F.min_by(F.struct(*results.columns), F.struct(F.col(metric), F.col(order)))
    return results.filter(F.col(metric).isNotNull()).agg(best.alias("_b")).select("_b.*")


def flatten_results(results: DataFrame, splits: Sequence[str]) -> DataFrame:
    """method + one struct column per split -> one row per (method, split)."""
    cells = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("m")) for s in splits])
    return results.select("method", F.inline(cells)).select("method", "split", "m.*")
