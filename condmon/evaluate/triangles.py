"""Ridge from triangular factors: one pass over the rows for any number of models and held-out groups.

Every task reduces its rows of a group to the triangle of a QR decomposition; triangles of the same columns merge by another QR. Unlike
sums of products they do not square the condition of the data, and leaving a group out merges the others instead of subtracting.
Columns of a triangle: ones, one flag per feature (value present), the features (0 where missing), the label. Features and
label are first shifted by their mean over all rows, so that large offsets cost no digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from condmon.session import stored

SALTS = 32     # triangles of one group merge in so many parts first
FLUSH = 256    # groups a task holds at a time


def merged(*triangles: np.ndarray | None) -> np.ndarray | None:
    known = [t for t in triangles if t is not None]
    return known[0] if len(known) == 1 else np.linalg.qr(np.vstack(known), mode="r") if known else None


def _load(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell).reshape(-1, width)


@dataclass(frozen=True)
class Triangles:
    """`table` has (group, r): the triangle of every group, as bytes."""

    table: DataFrame
    group: str
    cols: list[str]
    shift: np.ndarray  # of the features and the label

    @property
    def width(self) -> int:
        return 2 * len(self.cols) + 2


def triangles(df: DataFrame, group: str, cols: Sequence[str], label: str) -> Triangles:
    """Triangles per group (NULL is a group) of the rows that have a label."""
    cols = list(cols)
    p = len(cols)
    width = 2 * p + 2
    cell = lambda c: F.expr(f"CASE WHEN NOT isnan(`{c}`) THEN CAST(`{c}` AS DOUBLE) END")
    rows = df.filter(cell(label).isNotNull()).select(
        F.col(group).alias("g"), F.array(*[F.coalesce(cell(c), F.lit(float("nan"))) for c in cols]).alias("x") if cols else F.array().cast("array<double>").alias("x"),
        cell(label).alias("y"))
    means = rows.agg(F.avg("y"), *[F.avg(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])) for i in range(p)]).first()
    shift = np.array([means[i] or 0.0 for i in (*range(1, p + 1), 0)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).reshape(len(pdf), p) - shift[:p]
            seen = ~np.isnan(x)
            z = np.column_stack([np.ones(len(pdf)), seen, np.where(seen, x, 0.0), pdf["y"].to_numpy() - shift[p]])
            for code, index in pd.Series(range(len(pdf))).groupby(pd.factorize(pdf["g"], use_na_sentinel=False)[0]):
                g = pdf["g"].iloc[index.iloc[0]]
                g = None if pd.isna(g) else g
                held[g] = merged(held.get(g), np.linalg.qr(z[index.to_numpy()], mode="r"))
            if len(held) > FLUSH:
                yield pd.DataFrame({"g": list(held), "r": [r.tobytes() for r in held.values()]})
                held = {}
        if held:
            yield pd.DataFrame({"g": list(held), "r": [r.tobytes() for r in held.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"].iloc[:1].to_list(), "r": [merged(*[_load(r, width) for r in pdf["r"]]).tobytes()]})

    schema = f"g {df.schema[group].dataType.simpleString()}, r binary"
    parts = rows.mapInPandas(partial, schema).withColumn("s", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(SALTS)))
    parts = parts.groupBy("g", "s").applyInPandas(merge, schema).groupBy("g").applyInPandas(merge, schema)
    return Triangles(parts.withColumnRenamed("g", group), group, cols, shift)


@dataclass(frozen=True)
class Ridge:
    """Intercept, coefficients on the raw scale, what replaces missing values, and coefficients per standard deviation."""

    intercept: float
    coef: np.ndarray
    fill: np.ndarray
    strength: np.ndarray


def solved(r: np.ndarray, shift: np.ndarray, alpha: float, pick: Sequence[int] | None = None) -> Ridge | None:
    """Ridge with a free intercept on columns imputed by their mean and standardised; `pick` are the features of a model."""
    p = (r.shape[1] - 2) // 2
    at = np.arange(p) if pick is None else np.asarray(pick, dtype=int)
    n = r[0, 0] ** 2
    if n < 0.5:
        return None
    flags, values, y = r[:, 1 + at], r[:, 1 + p + at], r[:, -1]
    present = r[0, 0] * flags[0]
    mean = np.where(present > 0.5, r[0, 0] * values[0] / np.where(present > 0.5, present, 1.0), 0.0)
    centred = values - mean * flags
    y_mean = y[0] / r[0, 0]
    std = np.sqrt((centred ** 2).sum(0) / n)
    # A constant column has only what rounding left of it.
    std = np.where(std <= 10 * np.finfo(float).eps * math.sqrt(n) * (np.abs(mean) + np.abs(shift[at])), 0.0, std)
    scale = np.where(std > 0, std, 1.0)
    design = np.vstack([np.where(std > 0, centred / scale, 0.0), math.sqrt(alpha) * np.eye(len(at))])
    target = np.concatenate([y - y_mean * r[:, 0], np.zeros(len(at))])
    strength = np.linalg.lstsq(design, target, rcond=None)[0] if len(at) else np.zeros(0)
    coef, fill = strength / scale, mean + shift[at]
    return Ridge(float(y_mean + shift[p] - coef @ fill), coef, fill, strength)


def left_out(own: Triangles, buckets: int, alpha: float = 1.0) -> DataFrame:
    """(group, icpt, coef, fill) of the model of all other groups; a group without others gives no row.

    Groups lie in buckets. All others of a group are the other buckets, by prefix and suffix products over the buckets, and the others
    of its bucket, by prefix and suffix products inside it.
    """
    group, width, shift = own.group, own.width, own.shift
    kind = own.table.schema[group].dataType.simpleString()
    placed = own.table.select(F.col(group).alias("g"), "r", F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int").alias("b"))

    def others(parts: list[np.ndarray]) -> list[np.ndarray | None]:
        before: list = [None]
        for r in parts[:-1]:
            before.append(merged(before[-1], r))
        after, out = None, []
        for r, b in zip(parts[::-1], before[::-1]):
            out.append(merged(b, after))
            after = merged(r, after)
        return out[::-1]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf["b"].iloc[:1].to_list(), "r": [merged(*[_load(r, width) for r in pdf["r"]]).tobytes()]})

    def outside(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = others([_load(r, width) for r in pdf["r"]])
        return pd.DataFrame({"c": pdf["b"], "r": [None if r is None else r.tobytes() for r in rest]})

    def fold(pdf: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        far = [_load(r, width) for r in around["r"] if r is not None]
        out = []
        for g, r in zip(pdf["g"], others([_load(r, width) for r in pdf["r"]])):
            rest = merged(r, *far)
            model = None if rest is None else solved(rest, shift, alpha)
            if model is not None:
                out.append((None if pd.isna(g) else g, model.intercept, model.coef, model.fill))
        return pd.DataFrame(out, columns=["g", "icpt", "coef", "fill"])

    # One row per bucket meets in a task.
    totals = placed.groupBy("b").applyInPandas(total, "b int, r binary").withColumn("one", F.lit(1))
    around = stored(totals.groupBy("one").applyInPandas(outside, "c int, r binary"), "buckets")
    folds = placed.groupBy("b").cogroup(around.groupBy("c")).applyInPandas(fold, f"g {kind}, icpt double, coef array<double>, fill array<double>")
    return folds.withColumnRenamed("g", group)
