"""Ordered work inside groups of any size.

A plain window or exact percentile puts a whole group into one task. The functions here
first ask (with one map-side-combined count) whether any group is too big for that. If none is,
they use the plain form. If some are, the rows of those groups are cut into buckets along the
order, every bucket is handled on its own, and small per-bucket totals are carried over. Results are
the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from condmon.session import stored

SORT_ROWS = 1 << 22   # rows of one group a task may sort (spills to disk)
HEAP_ROWS = 1 << 18   # rows of one group a task may hold in memory
FIND = ...            # "look for big groups yourself"; callers that know them pass them on
MAX_BUCKETS = 16384   # tasks the rows of all big groups are cut into at most


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys meet; key columns are kept once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{key}" for key in keys])


def oversized_groups(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame | None:
    """Groups with more than `limit` rows as (by, _n); None if there are none.

    The result has at most (all rows / limit) rows.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > limit)
    if hot.isEmpty():
        return None
    return stored(hot, "hot-groups")


def split_by_order(df: DataFrame, by: Sequence[str], order: Sequence[Column], hot: DataFrame, limit: int,
                   most: int = MAX_BUCKETS) -> DataFrame:
    """Add `_bucket`: rows of hot groups are cut along the order, all other rows are in bucket 0.

    Hot rows are range-partitioned by (group, order) and stored, so that a row keeps its bucket
    on every later read. Bucket numbers rise with the order inside a group. `order` must be a full tiebreak.
    """
    rows = int(hot.agg(F.sum("_n").alias("n")).first()["n"] or 0)
    parts = max(2, min(most, -(-rows // limit)))
    if by:
        keys = hot.select(*by).withColumn("_hot", F.lit(True))
        flagged = join_null_safe(df, keys, by, "left")
        big = flagged.filter(F.col("_hot")).drop("_hot")
    else:
        big = df
    ranged = big.repartitionByRange(parts, *by, *order).withColumn("_bucket", F.spark_partition_id())
    ranged = stored(ranged, "buckets")
    if not by:
        return ranged
    rest = flagged.filter(F.col("_hot").isNull()).drop("_hot")
    return rest.withColumn("_bucket", F.lit(0)).unionByName(ranged)


def _carry(bucketed: DataFrame, by: Sequence[str], totals: dict[str, Column],
           carry: dict[str, str]) -> DataFrame:
    """Per (by, bucket): what all earlier buckets of the group add up to."""
    per_bucket = bucketed.groupBy(*by, "_bucket").agg(*[c.alias(n) for n, c in totals.items()])
    before = (Window.partitionBy(*by).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    return per_bucket.select(
        *by, "_bucket",
        *[getattr(F, fn)(n).over(before).alias(n) for n, fn in carry.items()],
    ).filter(F.col("_bucket") > 0)


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "pos",
                  limit: int = SORT_ROWS) -> DataFrame:
    """0-based position of each row in its group under `order` (a full tiebreak)."""
    hot = oversized_groups(df, by, limit)
    if hot is None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
        return df.withColumn(name, place.cast("long"))
    bucketed = split_by_order(df, by, order, hot, limit)
    offsets = _carry(bucketed, by, {"_before": F.count(F.lit(1))}, {"_before": "sum"})
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    placed = join_null_safe(bucketed.withColumn("_local", local), offsets, [*by, "_bucket"], "left")
    place = F.col("_local") + F.coalesce("_before", F.lit(0))
    return placed.withColumn(name, place.cast("long")).drop("_local", "_before", "_bucket")


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, fn: str,
            name: str, limit: int = SORT_ROWS) -> DataFrame:
    """Running 'sum', 'min' or 'max' of `value` from the start of the group to the row."""
    merge = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[fn]
    agg = getattr(F, fn)
    hot = oversized_groups(df, by, limit)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if hot is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)
        return df.withColumn(name, agg(value).over(w))
    bucketed = split_by_order(df, by, order, hot, limit)
    before = _carry(bucketed, by, {"_before": agg(value)}, {"_before": fn})
    w = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(*upto)
    local = bucketed.withColumn("_local", agg(value).over(w))
    joined = join_null_safe(local, before, [*by, "_bucket"], "left")
    return joined.withColumn(name, merge(F.col("_local"), F.col("_before"))).drop(
        "_local", "_before", "_bucket")


def exact_percentiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float],
                      limit: int = HEAP_ROWS, hot: DataFrame | None = FIND) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group; `<col>_q` holds an array.

    NULL values are skipped; a group whose values are all NULL has a NULL array. `hot` may name
    the big groups of a frame this one was cut from, which saves counting here.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    small = df.select(*by, *cols)
    hot = oversized_groups(small, by, limit) if hot is FIND else hot
    wanted = F.array(*[F.lit(p) for p in probs])

    def builtin(frame: DataFrame) -> DataFrame:
        return frame.groupBy(*by).agg(*[F.percentile(c, wanted).alias(f"{c}_q") for c in cols])

    if hot is None:
        return builtin(small)
    if by:
        keys = hot.select(*by).withColumn("_hot", F.lit(True))
        flagged = join_null_safe(small, keys, by, "left")
        rest = builtin(flagged.filter(F.col("_hot").isNull()).drop("_hot"))
        big = flagged.filter(F.col("_hot")).drop("_hot")
    else:
        big = small
    ranked = _percentiles_by_rank(big, by, cols, probs, limit)
    if not by:
        return ranked
    out = join_null_safe(hot.select(*by), ranked, by, "left")
    return rest.unionByName(out)


def _percentiles_by_rank(df: DataFrame, by: list[str], cols: list[str], probs: list[float],
                         limit: int) -> DataFrame:
    """Order statistics of big groups: combine equal values, cut the value axis, rank only the
    buckets that hold a wanted rank. All columns go through one pass, keyed by their name."""
    group_by, by = by, [*by, "_c"]
    tall = df.select(*group_by, F.inline(F.array(
        *[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])))
    counts = stored(tall.filter(F.col("_v").isNotNull()).groupBy(*by, "_v")
                    .agg(F.count(F.lit(1)).alias("_w")), "value-counts")
    distinct = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    bucketed = split_by_order(counts, by, [F.col("_v")], distinct, limit)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        bucketed.groupBy(*by, "_bucket").agg(F.sum("_w").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(group))
    )
    place = [F.lit(p) * (F.col("_total") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(
        *[F.array(F.floor(h).cast("long"), F.ceil(h).cast("long")) for h in place])))
    wanted = (
        buckets.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before"))
                                              & (r < F.col("_before") + F.col("_rows"))))
        .filter(F.size("_ranks") > 0).drop("_rows")
    )
    inside = join_null_safe(bucketed, wanted, [*by, "_bucket"], "inner")
    upto = (Window.partitionBy(*by, "_bucket").orderBy("_v")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = inside.withColumn("_end", F.col("_before") + F.sum("_w").over(upto))
    hits = ended.select(
        *by, "_v", "_total",
        F.explode(F.filter("_ranks", lambda r: (r < F.col("_end"))
                           & (r >= F.col("_end") - F.col("_w")))).alias("_rank"))
    values = hits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
                                   F.max("_total").alias("_total"))

    def interpolated(p: float) -> Column:
        h = F.lit(p) * (F.col("_total") - 1)
        low = F.col("_at")[F.floor(h).cast("long")]
        high = F.col("_at")[F.ceil(h).cast("long")]
        return low + (high - low) * (h - F.floor(h))

    arrays = values.select(*by, F.array(*[interpolated(p) for p in probs]).alias("_q"))
    return arrays.groupBy(*group_by).agg(*[
        F.first(F.when(F.col("_c") == c, F.col("_q")), ignorenulls=True).alias(f"{c}_q") for c in cols])


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rn") -> DataFrame:
    """First k rows per group. Spark limits each group to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
