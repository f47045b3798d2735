"""Regressors and group-wise hold-out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from condmon.constants import WEAR_CAP_UM
from condmon.evaluate.boosting import Boosted, Settings, fit_boosters
from condmon.evaluate.errors import error_by_class
from condmon.evaluate.triangles import Ridge, left_out, solved, triangles
from condmon.operators.skew import join_null_safe
from condmon.session import stored

CLIP = (0.0, WEAR_CAP_UM)


def clipped(c: str | Column, clip: tuple[float, float] | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if clip is None else F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), c))


@dataclass
class FittedModel:
    """A ridge model; `transform` adds a clipped prediction column, `importance` lists absolute coefficients per standard deviation."""

    cols: list[str]
    ridge: Ridge
    clip: tuple[float, float] | None = CLIP

    def transform(self, df: DataFrame, name: str = "pred") -> DataFrame:
        terms = [repr(self.ridge.intercept) + "D", *[
            f"{float(b)!r}D * coalesce(CASE WHEN NOT isnan(`{c}`) THEN CAST(`{c}` AS DOUBLE) END, {float(m)!r}D)"
            for c, b, m in zip(self.cols, self.ridge.coef, self.ridge.fill)]]
        return df.withColumn(name, clipped(F.expr(" + ".join(terms)), self.clip))

    def importance(self) -> DataFrame:
        rows = [(c, float(abs(v))) for c, v in zip(self.cols, self.ridge.strength)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def fit_ridges(df: DataFrame, subsets: Sequence[Sequence[str]], label: str, train: Column, alpha: float = 1.0,
               clip: tuple[float, float] | None = CLIP) -> list[FittedModel]:
    """A model for every subset of the columns from one pass: impute with the training mean, standardise, ridge with a free intercept."""
    cols = list(dict.fromkeys(c for cs in subsets for c in cs))
    found = triangles(df.filter(train).withColumn("_one", F.lit(1)), "_one", cols, label)
    row = found.table.first()
    if row is None:
        raise ValueError("no training row has a label")
    r, at = np.frombuffer(row["r"]).reshape(-1, found.width), {c: i for i, c in enumerate(cols)}
    return [FittedModel(list(cs), solved(r, found.shift, alpha, [at[c] for c in cs]), clip) for cs in subsets]


def fit_ridge(df: DataFrame, cols: Sequence[str], label: str, train: Column, alpha: float = 1.0,
              clip: tuple[float, float] | None = CLIP) -> FittedModel:
    return fit_ridges(df, [cols], label, train, alpha, clip)[0]


@dataclass
class BoostedModel:
    """One model of a joint fit, with the interface of FittedModel."""

    fitted: Boosted
    number: int = 0

    def transform(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return self.fitted.predict(df, name, F.lit(self.number))

    def importance(self) -> DataFrame:
        """(feature, importance): total gain, one row per feature."""
        rows = list(self.fitted.importance(self.number).items())
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def fit_boosted(df: DataFrame, cols: Sequence[str], label: str, train: Column, key: str,
                clip: tuple[float, float] | None = CLIP, **settings) -> BoostedModel:
    """Boosted trees on absolute loss; missing values have a side of their own in every split.

    Training ends when a slice of the training rows has seen no better round for `patience` rounds, or at `rounds`.
    """
    return BoostedModel(fit_boosters(df.filter(train), cols, label, key, [cols], clip=clip, settings=Settings(**settings)))


def fold_coefficients(df: DataFrame, group: str, cols: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """(group, icpt, coef, fill) of the model trained on all other groups."""
    own = triangles(df, group, cols, label)
    own = replace(own, table=stored(own.table, "triangles"))
    return left_out(own, max(1, math.isqrt(own.table.count())), alpha)


def leave_group_out(df: DataFrame, group: str, cols: Sequence[str], label: str, cls: str = "type",
                    method: str = "ridge", alpha: float = 1.0, clip: tuple[float, float] | None = CLIP,
                    classes: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, per-fold errors, pooled errors), each group predicted from all the others.

    'mean' and 'ridge' need one pass: a fold is the total minus the group's own sums.
    """
    rows = df.filter(F.col(label).isNotNull())
    if method == "mean":
        own = rows.groupBy(group).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
        total = own.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n"))
        folds = own.select(group, ((total.select("s").scalar() - F.col("_s"))
                                   / F.nullif(total.select("n").scalar() - F.col("_n"), F.lit(0))).alias("_p"))
        scored = join_null_safe(rows, folds, [group], "inner")
    elif method == "ridge":
        folds = fold_coefficients(rows, group, cols, label, alpha)
        terms = [f"coef[{i}] * coalesce(CASE WHEN NOT isnan(`{c}`) THEN CAST(`{c}` AS DOUBLE) END, fill[{i}])"
                 for i, c in enumerate(cols)]
        scored = join_null_safe(rows, folds, [group], "inner").withColumn("_p", F.expr(" + ".join(["icpt", *terms]))).drop("icpt", "coef", "fill")
    else:
        raise ValueError(f"unknown method {method!r}")
    preds = scored.withColumn("pred", clipped("_p", clip)).drop("_p").filter(F.col("pred").isNotNull())
    extra = {} if classes is None else {"classes": classes}
    return (preds, error_by_class(preds, "pred", label, cls, [group], **extra),
            error_by_class(preds, "pred", label, cls, **extra))


def numbered_groups(rows: DataFrame, group: str, number: str) -> DataFrame:
    """rows with the number of their group, from 0 in the order of the groups."""
    groups = rows.select(group).distinct().withColumn(number, F.row_number().over(Window.orderBy(group)) - 1)
    return join_null_safe(rows, stored(groups, "groups"), [group], "inner")


def leave_group_out_boosted(df: DataFrame, group: str, cols: Sequence[str], label: str, key: str, cls: str = "type",
                            clip: tuple[float, float] | None = CLIP, classes: Sequence[str] | None = None,
                            **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, per-fold errors, pooled errors), each group predicted by trees of all the others.

    All folds grow together in the same passes. Groups may be of any type that can be ordered; NULL is a group.
    """
    rows = numbered_groups(df.filter(F.col(label).isNotNull()), group, "_fold_number")
    folds = rows.agg(F.max("_fold_number")).first()[0]
    fold = F.col("_fold_number")
    fitted = fit_boosters(rows, cols, label, key, [cols], fold, range((-1 if folds is None else folds) + 1), clip, Settings(**settings))
    preds = fitted.predict(rows, "pred", fold).drop("_fold_number").filter(F.col("pred").isNotNull())
    extra = {} if classes is None else {"classes": classes}
    return (preds, error_by_class(preds, "pred", label, cls, [group], **extra), error_by_class(preds, "pred", label, cls, **extra))


def array_columns(df: DataFrame, vec: str, size: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """Array column to named double columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.selectExpr("*", *[f"CAST(`{vec}`[{i}] AS DOUBLE) AS `{n}`" for i, n in enumerate(names)]), names
