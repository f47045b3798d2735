"""Sensor-only study: method matrix on the official split, hold-out by set, importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from condmon.evaluate.boosting import Settings, fit_boosters
from condmon.evaluate.errors import best_method, error_by_class, mean_baseline
from condmon.evaluate.regress import CLIP, BoostedModel, FittedModel, fit_ridges, leave_group_out, numbered_groups
from condmon.operators.sequence import top_k
from condmon.session import stored


@dataclass(frozen=True)
class Method:
    """One entry of the matrix: a model kind and the columns it sees."""

    name: str
    kind: str              # mean, ridge or boosted
    cols: Sequence[str] = ()


def method_matrix(v1: Sequence[str], v2: Sequence[str], cutting: Sequence[str]) -> list[Method]:
    """Eight ridge, six tree and six combined methods. Column prefixes name the block; a 'd_' prefix is the
    block minus the set's own baseline."""
    def block(tag: str, names: Sequence[str]) -> list[str]:
        return [f"{tag}_{n}" for n in names]

    names = {"v1": v1, "v2": v2, "v3": v2, "v4": v2}
    out = []
    for kind, tags in (("ridge", ("v1", "v2", "v3", "v4")), ("boosted", ("v2", "v3", "v4"))):
        for tag in tags:
            out += [Method(f"{kind}_{tag}_absolute", kind, block(tag, names[tag])),
                    Method(f"{kind}_{tag}_delta", kind, block(f"d_{tag}", names[tag]))]
    cut = list(cutting)
    combined = {
        "v2cut": block("v2", v2) + cut, "v1v2": block("v1", v1) + block("v2", v2),
        "v1v2cut": block("v1", v1) + block("v2", v2) + cut, "v4cut": block("v4", v2) + cut,
        "v3cut": block("v3", v2) + cut, "v2v3": block("v2", v2) + block("v3", v2),
    }
    return out + [Method(f"boosted_{n}_absolute", "boosted", cols) for n, cols in combined.items()]


def fit_methods(df: DataFrame, methods: Sequence[Method], label: str, train: Column, key: str, alpha: float = 1.0,
                **trees) -> dict[str, FittedModel | BoostedModel]:
    """Models by method name. All tree methods grow in the same passes, each on its own columns; all ridge methods take
    their columns from one triangle."""
    unknown = {m.kind for m in methods} - {"mean", "ridge", "boosted"}
    if unknown:
        raise ValueError(f"unknown method kinds {sorted(unknown)}")
    boosted = [m for m in methods if m.kind == "boosted"]
    models: dict[str, FittedModel | BoostedModel] = {}
    if boosted:
        cols = list(dict.fromkeys(c for m in boosted for c in m.cols))
        joint = fit_boosters(df.filter(train), cols, label, key, [m.cols for m in boosted], clip=CLIP, settings=Settings(**trees))
        models |= {m.name: BoostedModel(joint, i) for i, m in enumerate(boosted)}
    ridges = [m for m in methods if m.kind == "ridge"]
    if ridges:
        models |= zip([m.name for m in ridges], fit_ridges(df, [m.cols for m in ridges], label, train, alpha))
    return models


def evaluate_methods(df: DataFrame, methods: Sequence[Method], label: str, key: str, split: str = "split",
                     cls: str = "type", classes: Sequence[str] | None = None, models: dict | None = None, **trees) -> DataFrame:
    """(method, position, split, errors..): each method is fitted on 'train' and scored on every split."""
    train = F.col(split) == "train"
    models = fit_methods(df, methods, label, train, key, **trees) if models is None else models
    extra = {} if classes is None else {"classes": classes}
    parts = []
    for i, method in enumerate(methods):
        scored = mean_baseline(df, label, train) if method.kind == "mean" else models[method.name].transform(df)
        parts.append(error_by_class(scored, "pred", label, cls, [split], **extra).select(
            F.lit(method.name).alias("method"), F.lit(i).alias("position"), "*"))
    return reduce(DataFrame.unionByName, parts)


def hold_out_methods(df: DataFrame, methods: Sequence[Method], group: str, label: str, key: str, cls: str = "type",
                     classes: Sequence[str] | None = None, **trees) -> tuple[DataFrame, DataFrame]:
    """((method, position, group, errors..), (method, position, pooled errors..)): every method on every group, trained on all other groups.

    The trees of all methods and folds grow in the same passes; a ridge or mean fold is the total without its group.
    """
    rows = numbered_groups(df.filter(F.col(label).isNotNull()), group, "_fold_number")
    last = rows.agg(F.max("_fold_number")).first()[0]
    folds = 0 if last is None else last + 1
    boosted = [m for m in methods if m.kind == "boosted"]
    if boosted:
        cols = list(dict.fromkeys(c for m in boosted for c in m.cols))
        joint = fit_boosters(rows, cols, label, key, [m.cols for m in boosted], F.col("_fold_number"), range(folds), CLIP, Settings(**trees))
    extra = {} if classes is None else {"classes": classes}
    per_fold, pooled = [], []
    for i, method in enumerate(methods):
        tag = (F.lit(method.name).alias("method"), F.lit(i).alias("position"), "*")
        if method.kind == "boosted":
            preds = joint.predict(rows, "pred", F.col("_fold_number") + boosted.index(method) * folds)
            own, whole = (error_by_class(preds.filter(F.col("pred").isNotNull()), "pred", label, cls, keys, **extra) for keys in ([group], []))
        else:
            _, own, whole = leave_group_out(df, group, method.cols, label, cls, method.kind, classes=classes)
        per_fold.append(own.select(*tag))
        pooled.append(whole.select(*tag))
    return reduce(DataFrame.unionByName, per_fold), reduce(DataFrame.unionByName, pooled)


@dataclass(frozen=True)
class Study:
    """Tables of a study: errors by (method, split), by (method, held-out group), pooled, and the strongest features of the best method."""

    splits: DataFrame
    folds: DataFrame
    pooled: DataFrame
    best: str
    importance: DataFrame


def run_study(df: DataFrame, methods: Sequence[Method], label: str, key: str, group: str, split: str = "split", cls: str = "type",
              classes: Sequence[str] | None = None, k: int = 20, **trees) -> Study:
    """The whole study in one call: official split, hold-out on the training groups, and the importance of the method with the least test error."""
    train = F.col(split) == "train"
    methods = [Method("predict_mean_train", "mean"), *methods]
    models = fit_methods(df, methods, label, train, key, **trees)
    splits = stored(evaluate_methods(df, methods, label, key, split, cls, classes, models), "study")
    folds, pooled = hold_out_methods(df.filter(train), methods, group, label, key, cls, classes, **trees)
    ranked = best_method(splits.filter((F.col(split) == "test") & (F.col("position") > 0))).first()
    best = ranked["method"] if ranked is not None else None
    return Study(splits, folds, pooled, best, importance_report(models[best], k) if best else None)


def importance_report(model: FittedModel | BoostedModel, k: int = 20) -> DataFrame:
    """Rank, feature, importance of the k strongest features."""
    return top_k(model.importance(), "importance", k, "feature")


def channel_importance(importance: DataFrame) -> DataFrame:
    """Importance summed over the features of each channel (text before the first underscore)."""
    return importance.groupBy(F.substring_index("feature", "_", 1).alias("channel")).agg(
        F.sum(F.abs("importance")).alias("importance"))
