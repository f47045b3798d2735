"""Robust line per group: median pairwise slope, median residual intercept."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from condmon.operators.sequence import mid_life
from condmon.operators.skew import FIND, exact_percentiles, join_null_safe, oversized_groups

PAIR_ROWS = 256      # up to here the slopes of one group are formed directly
TASK_ROWS = 1 << 15  # up to here one task searches the median slope of a group


def inversions(values: np.ndarray) -> int:
    """Number of places i < j with values[i] >= values[j] (distinct or not), by halving blocks."""
    n = len(values)
    if n < 2:
        return 0
    place = np.unique(values, return_inverse=True)[1].astype(np.int64)
    span = np.int64(n + 1)
    index = np.arange(n, dtype=np.int64)
    total, width = 0, 1
    while width < n:
        block = index // (2 * width)
        right = (index // width) % 2 == 1
        left = np.sort(block[~right] * span + place[~right])
        ends = np.searchsorted(left, (block[right] + 1) * span, "left")
        total += int((ends - np.searchsorted(left, block[right] * span + place[right], "left")).sum())
        width *= 2
    return total


def _float_key(x: float) -> int:
    """Order-preserving integer of a double, so that bisection ends on an exact double."""
    bits = int(np.float64(x).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _float_of(key: int) -> float:
    bits = key if key >= 0 else (-key) | (1 << 63)
    return float(np.uint64(bits).view(np.float64))


def _median_slope_by_search(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median slope over all pairs without forming them: bisection on the slope, where the number
    of pairs not steeper than b is an inversion count of y - b*x in x order."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    same = np.unique(x, return_counts=True)[1].astype(np.int64)
    n = len(x)
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if pairs == 0:
        return None

    def not_steeper(b: float) -> int:
        # rows of one x are in rising order; the pairs of equal residual among them do not count
        r = y - b * x
        starts = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (r[1:] != r[:-1]))))
        runs = np.diff(np.append(starts, n))
        return inversions(r) - int((runs * (runs - 1) // 2).sum())

    reach = float(y.max() - y.min()) / float(np.diff(np.unique(x)).min())

    def kth(k: int) -> float:
        low, high = _float_key(-reach) - 1, _float_key(reach)
        while high - low > 1:
            mid = (low + high) // 2
            if not_steeper(_float_of(mid)) >= k:
                high = mid
            else:
                low = mid
        return _float_of(high)

    first = kth((pairs + 1) // 2)
    return first if pairs % 2 else (first + kth(pairs // 2 + 1)) / 2


def line_of(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    n = len(x)
    if n == 0:
        return 0.0, 0.0
    if n == 1:
        return 0.0, float(y[0])
    if n <= PAIR_ROWS:
        i, j = np.triu_indices(n, 1)
        dx = x[j] - x[i]
        ok = dx != 0
        slope = float(np.median((y[j] - y[i])[ok] / dx[ok])) if ok.any() else None
    else:
        slope = _median_slope_by_search(x, y)
    if slope is None:
        return 0.0, float(np.median(y))
    return slope, float(np.median(y - slope * x))


def theil_sen(df: DataFrame, by: Sequence[str], x: str, y: str, limit: int = TASK_ROWS,
              hot: DataFrame | None = FIND) -> DataFrame:
    """(by, slope, intercept) per group.

    Groups up to `limit` rows travel as two arrays to one vectorised function. Larger ones are solved by
    `theil_sen_large`, which never brings a group together.
    """
    by = list(by)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    hot = oversized_groups(rows, by, limit) if hot is FIND else hot
    if hot is None:
        return _theil_sen_small(rows, by)
    from condmon.physics.large_lines import theil_sen_large
    flagged = join_null_safe(rows, hot, by, "left")
    small = _theil_sen_small(flagged.filter(F.col("_n").isNull()).drop("_n"), by)
    return small.unionByName(theil_sen_large(flagged.filter(F.col("_n").isNotNull()).drop("_n"), by, limit))


def _theil_sen_small(rows: DataFrame, by: list[str]) -> DataFrame:
    @F.pandas_udf("slope double, intercept double")
    def fit(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        lines = [line_of(np.asarray(a, dtype=float), np.asarray(b, dtype=float)) for a, b in zip(xs, ys)]
        return pd.DataFrame(lines, columns=["slope", "intercept"])

    lists = rows.groupBy(*by).agg(F.collect_list("_x").alias("_xs"), F.collect_list("_y").alias("_ys"))
    return lists.withColumn("_line", fit("_xs", "_ys")).select(*by, "_line.*")


def inside_window(t: np.ndarray, lo: float, hi: float, min_rows: int) -> tuple[np.ndarray, int]:
    """Mask of the mid-life rows and their number; all rows if there are fewer than min_rows."""
    mask = (t >= lo * t.max()) & (t <= hi * t.max())
    n = int(mask.sum())
    return (mask if n >= min_rows else np.ones(len(t), dtype=bool)), n


def _lists(rows: DataFrame, by: Sequence[str], t: str, w: str, *more) -> DataFrame:
    """Both columns of each (bounded) group as aligned arrays; rows must be complete."""
    return rows.groupBy(*by).agg(
        F.collect_list(F.col(t).cast("double")).alias("_ts"), F.collect_list(F.col(w).cast("double")).alias("_ws"), *more)


def mid_life_lines(rows: DataFrame, by: str, t: str, w: str, window: tuple[float, float], min_rows: int,
                   hot: DataFrame | None) -> DataFrame:
    """(by, _n, max_image_id, max_wear_um, n_window, slope, intercept) of the mid-life rows of each set.

    Sets that fit a task need one shuffle of the rows: statistics, window and line come from the
    same group. The sets in `hot` go the long way round.
    """
    lo, hi = window

    @F.pandas_udf("n_window bigint, slope double, intercept double")
    def fit(ts: pd.Series, ws: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(ts, ws):
            a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
            mask, n = inside_window(a, lo, hi, min_rows)
            out.append((n, *line_of(a[mask], b[mask])))
        return pd.DataFrame(out, columns=["n_window", "slope", "intercept"])

    stats = [F.count(F.lit(1)).alias("_n"), F.max(F.col(t).cast("double")).alias("max_image_id"),
             F.max(w).alias("max_wear_um")]
    names = [by, "_n", "max_image_id", "max_wear_um"]
    small = rows if hot is None else rows.join(hot.select(by), by, "left_anti")
    out = _lists(small, [by], t, w, *stats).withColumn("_line", fit("_ts", "_ws")).select(*names, "_line.*")
    if hot is None:
        return out
    big = rows.join(hot.select(by), by, "left_semi")
    mid = mid_life(big, by, t, lo, hi, min_rows)
    sizes = mid.groupBy(by).agg(F.first("n_window").alias("n_window"))
    long = big.groupBy(by).agg(*stats).join(sizes, by).join(theil_sen(mid, [by], t, w, hot=hot), by)
    return out.unionByName(long.select(*out.columns))


def anchored_intercept(rows: DataFrame, by: str, t: str, w: str, slopes: DataFrame, slope: str,
                       window: tuple[float, float], min_rows: int, name: str, hot: DataFrame | None) -> DataFrame:
    """Median mid-life residual per set with the slope given per set."""
    lo, hi = window

    @F.pandas_udf("double")
    def median(ts: pd.Series, ws: pd.Series, slope: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(ts, ws, slope):
            a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
            mask, _ = inside_window(a, lo, hi, min_rows)
            out.append(float(np.median(b[mask] - k * a[mask])))
        return pd.Series(out, dtype=float)

    given = slopes.select(by, F.col(slope).alias("_slope")).filter(F.col("_slope").isNotNull())
    complete = rows.filter(F.col(t).isNotNull() & F.col(w).isNotNull())
    small = complete if hot is None else complete.join(hot.select(by), by, "left_anti")
    out = _lists(small, [by], t, w).join(given, by).select(by, median("_ts", "_ws", "_slope").alias(name))
    if hot is None:
        return out
    mid = mid_life(complete.join(hot.select(by), by, "left_semi"), by, t, lo, hi, min_rows)
    resid = mid.join(given, by).select(by, (F.col(w) - F.col("_slope") * F.col(t)).alias("_r"))
    q = exact_percentiles(resid, [by], ["_r"], [.5], hot=hot)
    return out.unionByName(q.select(by, F.col("_r_q")[0].alias(name)))
