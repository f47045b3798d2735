"""Order-dependent operators inside a set or recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import BASELINE_K, N_SEGMENTS, WINDOW
from condmon.operators.skew import SORT_ROWS, first_k, join_null_safe, rank_in_group, running


def set_baseline(df: DataFrame, by: str, order: Sequence[Column], cols: Sequence[str],
                 k: int = BASELINE_K) -> DataFrame:
    """Mean of the first k rows per group, as base_<col>."""
    return first_k(df, [by], order, k).groupBy(by).agg(*[F.avg(c).alias(f"base_{c}") for c in cols])


def subtract_baseline(df: DataFrame, baseline: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Rows whose group has no baseline keep their values."""
    joined = join_null_safe(df, baseline, [by], "left")
    return joined.withColumns({c: F.col(c) - F.coalesce(f"base_{c}", F.lit(0.0)) for c in cols}).drop(
        *[f"base_{c}" for c in cols])


def delta_features(df: DataFrame, by: str, order: Sequence[Column], cols: Sequence[str],
                   k: int = BASELINE_K) -> DataFrame:
    """Features minus the group's own fresh state."""
    return subtract_baseline(df, set_baseline(df, by, order, cols, k), by, cols)


def life_fraction(df: DataFrame, by: str, t: str, name: str = "life") -> DataFrame:
    """(t - min) / max(max - min, 1) inside the group."""
    span = df.groupBy(by).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    joined = join_null_safe(df, span, [by], "inner")
    return joined.withColumn(
        name, (F.col(t) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0))).drop("_lo", "_hi")


def life_at_threshold(df: DataFrame, by: str, t: str, w: str, threshold: float) -> DataFrame:
    """Where w first reaches the threshold, interpolated; NULL for a group that never does.

    Rows are ordered by t, then w. The first row at or above the level and the last row before it are two aggregates, so
    no group has to be sorted.
    """
    rows = df.filter(F.col(t).isNotNull() & F.col(w).isNotNull()).select(
        by, F.col(t).cast("double").alias("_t"), F.col(w).cast("double").alias("_w"))
    cross = rows.groupBy(by).agg(
        F.min(F.when(F.col("_w") >= threshold, F.struct("_t", "_w"))).alias("_hit"))
    before = (
        join_null_safe(rows, cross.filter(F.col("_hit").isNotNull()), [by], "inner")
        .filter(F.struct("_t", "_w") < F.col("_hit"))
        .groupBy(by).agg(F.max(F.struct("_t", "_w")).alias("_prev")))
    t1, w1, t0, w0 = (F.col(c) for c in ("_hit._t", "_hit._w", "_prev._t", "_prev._w"))
    life = (F.when(F.col("_prev").isNull(), t1).when(w1 == w0, t1)
            .otherwise(t0 + (F.lit(float(threshold)) - w0) / (w1 - w0) * (t1 - t0)))
    return join_null_safe(cross, before, [by], "left").select(by, life.alias("life"))


def mid_life(df: DataFrame, by: str, t: str, lo: float = WINDOW[0], hi: float = WINDOW[1],
             min_rows: int = 3) -> DataFrame:
    """Rows with t in [lo*max, hi*max] of their group; all rows if fewer than min_rows are inside."""
    if not 0.0 <= lo < hi <= 1.0:
        raise ValueError("window must satisfy 0 <= lo < hi <= 1")
    top = df.groupBy(by).agg(F.max(t).alias("_max"))
    inside = F.col(t).between(lo * F.col("_max"), hi * F.col("_max"))
    flagged = join_null_safe(df, top, [by], "inner").withColumn("_in", inside)
    sizes = flagged.groupBy(by).agg(F.count_if("_in").alias("n_window"))
    joined = join_null_safe(flagged, sizes, [by], "inner")
    return joined.filter(F.col("_in") | (F.col("n_window") < min_rows)).drop("_in", "_max")


def segment(df: DataFrame, by: str, pos: str = "pos", k: int = N_SEGMENTS, keep_tail: bool = False) -> DataFrame:
    """k equal contiguous segments; the n mod k rows at the end are dropped (or kept with NULL)."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = join_null_safe(df, sizes, [by], "inner")
    width = F.floor(F.col("n_rows") / k)
    seg = F.when(F.col(pos) < width * k, F.floor(F.col(pos) / width).cast("int"))
    out = joined.withColumn("seg", seg)
    return out if keep_tail else out.filter(F.col("seg").isNotNull())


def best_epoch(history: DataFrame, by: Sequence[str], metric: str = "val_mae_overall_um",
               epoch: str = "epoch") -> DataFrame:
    """Lowest metric per run; the earliest epoch wins a tie."""
    value = F.col(f"`{metric}`")
    return history.filter(value.isNotNull()).groupBy(*by).agg(
        F.min(value).alias("best_value"), F.min_by(epoch, F.struct(value, F.col(epoch))).alias("best_epoch"),
        F.max(epoch).alias("last_epoch"), F.max_by(value, F.col(epoch)).alias("last_value"))


def running_best(history: DataFrame, by: Sequence[str], metric: str, epoch: str = "epoch",
                 limit: int = SORT_ROWS) -> DataFrame:
    """Best value so far after every epoch."""
    return running(history, by, [F.col(epoch)], metric, "min", "best_so_far", limit)


def baseline_z(df: DataFrame, by: Sequence[str], k: str, c: str, n: int, eps: float = 1e-9) -> DataFrame:
    """z-score of c against the mean and population std of the rows with k < n."""
    base = df.filter(F.col(k) < n).groupBy(*by).agg(F.avg(c).alias("_mu"), F.stddev_pop(c).alias("_sd"))
    return join_null_safe(df, base, by, "inner").withColumn(
        "z", (F.col(c) - F.col("_mu")) / (F.col("_sd") + eps)).drop("_mu", "_sd")


def best_per_group(df: DataFrame, by: Sequence[str], metric: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The row with the lowest metric in each group; `tiebreak` columns decide equal values."""
    value = F.col(f"`{metric}`")
    order = F.struct(value, *tiebreak)
    rest = [c for c in df.columns if c not in by]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_best")
    return df.filter(value.isNotNull()).groupBy(*by).agg(row).select(*by, "_best.*")


def delta_to_best(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Distance of each row to the best of its group."""
    best = df.groupBy(*by).agg(F.min(metric).alias("_best"))
    return join_null_safe(df, best, by, "left").withColumn("delta", F.col(metric) - F.col("_best")).drop("_best")


def rank_report(df: DataFrame, metric: str, within: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*within, F.asc_nulls_last(metric))


def top_k(df: DataFrame, c: str, k: int, tiebreak: str, asc: bool = False) -> DataFrame:
    """k extreme rows with their rank, without sorting the rest."""
    key = F.asc(c) if asc else F.desc(c)
    picked = df.orderBy(key, tiebreak).limit(k)
    rows = picked.select(F.struct(F.col(c), F.col(tiebreak), F.struct(*df.columns).alias("row")).alias("r"))
    listed = rows.agg(F.sort_array(F.collect_list("r")).alias("a")) if asc else rows.agg(
        F.array_sort(F.collect_list("r"), _descending(c, tiebreak)).alias("a"))
    return listed.select(F.posexplode("a").alias("_i", "r")).select((F.col("_i") + 1).alias("rank"), "r.row.*")


def _descending(c: str, tiebreak: str):
    def compare(a: Column, b: Column) -> Column:
        return (F.when(a[c] > b[c], -1).when(a[c] < b[c], 1)
                .when(a[tiebreak] < b[tiebreak], -1).when(a[tiebreak] > b[tiebreak], 1).otherwise(0))
    return compare


def ordered_series(df: DataFrame, by: str, t: str) -> DataFrame:
    """Trajectories in plotting order: a range sort, so a hot set spreads over partitions."""
    return df.orderBy(by, t)


def set_positions(df: DataFrame, by: str, order: Sequence[Column], name: str = "t",
                  limit: int = SORT_ROWS) -> DataFrame:
    """1-based measurement number of each row in its set."""
    return rank_in_group(df, [by], order, "_p", limit).withColumn(name, F.col("_p") + 1).drop("_p")
