"""Integrity, distribution and trajectory reports over cleaned labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import ADHESION_TYPES
from condmon.operators.skew import HEAP_ROWS, exact_percentiles, first_k, join_null_safe, rank_in_group


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def integrity(df: DataFrame, label: str = "wear") -> DataFrame:
    image, sensor = F.col("has_image"), F.col("has_sensor")
    return df.agg(
        count_rows("total"),
        F.count_if("both").alias("both"),
        F.count_if(image & ~sensor).alias("only_image"),
        F.count_if(sensor & ~image).alias("only_sensor"),
        F.count_if(~image & ~sensor).alias("neither"),
        F.count_if(F.col(label).isNull()).alias("missing_label"),
        F.min(label).alias("label_min"),
        F.max(label).alias("label_max"),
    )


def sync_errors(df: DataFrame, by: Sequence[str] = ("Set",)) -> DataFrame:
    return df.groupBy(*by).agg(
        count_rows("total"), F.count_if("both").alias("both"),
        (F.count(F.lit(1)) - F.count_if("both")).alias("sync_errors"))


def describe(df: DataFrame, c: str, probs: Sequence[float] = (.1, .25, .5, .75, .9),
             by: Sequence[str] = (), limit: int = HEAP_ROWS) -> DataFrame:
    """Count, mean, sample std, min, max and exact percentiles p10, p25, .."""
    base = df.groupBy(*by).agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_percentiles(df, by, [c], probs, limit)
    named = q.select(*by, *[F.col(f"{c}_q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)])
    if by:
        return join_null_safe(base, named, by, "left")
    return base.select("*", *[named.select(n).scalar().alias(n) for n in named.columns])


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(count_rows("n")).orderBy(F.desc("n"), F.asc(c))


def pivot_counts(df: DataFrame, by: str, c: str, order: Sequence[str]) -> DataFrame:
    """Counts of `c` per `by`, one column per listed value, zero-filled."""
    wide = df.groupBy(by).agg(*[F.count_if(F.col(c) == v).alias(str(v)) for v in order])
    return wide.orderBy(by)


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence[str]) -> DataFrame:
    return pivot_counts(df, a, b, b_values)


def group_extremes(df: DataFrame, by: str, c: str) -> DataFrame:
    return df.groupBy(by).agg(F.max(c).alias("max"), F.avg(c).alias("mean"), F.count(c).alias("n"))


def trajectory_stats(df: DataFrame, by: str = "Set", label: str = "wear") -> DataFrame:
    """Label statistics per set, rounded to one decimal, with its material and split."""
    return (
        df.filter(F.col(label).isNotNull()).groupBy(by, "material", "split")
        .agg(F.count(label).alias("n"), F.round(F.min(label), 1).alias("min"),
             F.round(F.max(label), 1).alias("max"), F.round(F.avg(label), 1).alias("mean"),
             F.round(F.stddev_samp(label), 1).alias("std"))
        .orderBy(by)
    )


def split_stats(df: DataFrame, by: str = "split", label: str = "wear") -> DataFrame:
    """Per split: rows, distinct sets, label mean and std, share of adhesion types."""
    rows = df.filter(F.col(label).isNotNull())
    adhesion = F.col("type").isin(*ADHESION_TYPES).cast("double")
    return rows.groupBy(by).agg(
        count_rows("n_samples"), F.countDistinct("Set").alias("n_sets"),
        F.avg(label).alias("wear_mean"), F.stddev_samp(label).alias("wear_std"),
        F.avg(adhesion).alias("adhesion_frac"))


def label_stats(df: DataFrame, label: str = "wear", limit: int = HEAP_ROWS) -> DataFrame:
    d = describe(df, label, probs=(.5,), limit=limit)
    return d.select(F.col("count").alias("n"), "mean", "std", "min", "max", F.col("p50").alias("median"))


def histogram(df: DataFrame, c: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the overall minimum and maximum; the last bin is closed."""
    values = df.filter(F.col(c).isNotNull())
    span = values.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    ranged = values.select(*by, F.col(c).alias("_v"), lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.lit(bins), F.width_bucket("_v", F.col("_lo"), F.col("_hi"), F.lit(bins)))
    # one value only: the whole range is a single point
    slot = F.when(F.col("_lo") == F.col("_hi"), F.lit(bins // 2 + 1)).otherwise(slot)
    return (
        ranged.withColumns({"bin": slot.cast("int"), "_w": width})
        .groupBy(*by, "bin").agg(count_rows("n"), F.min(F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("left_edge"))
    )


def five_number(df: DataFrame, c: str, by: str, limit: int = HEAP_ROWS) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per category."""
    q = exact_percentiles(df, [by], [c], (.25, .5, .75), limit).select(
        by, *[F.col(f"{c}_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = join_null_safe(df.select(by, c), q, [by], "inner")
    return fenced.groupBy(by).agg(
        F.min(F.when(F.col(c) >= F.col("q1") - reach, F.col(c))).alias("whisker_low"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.max(F.when(F.col(c) <= F.col("q3") + reach, F.col(c))).alias("whisker_high"),
        F.count_if((F.col(c) < F.col("q1") - reach) | (F.col(c) > F.col("q3") + reach)).alias("n_outliers"))


def recordings_per_set(df: DataFrame, by: str = "Set") -> DataFrame:
    return df.filter("has_sensor").groupBy(by).agg(count_rows("n_recordings")).orderBy(by)


def channel_stats(df: DataFrame, by: str, channels: Sequence[str]) -> DataFrame:
    """n, rms, mean and population std of every channel, one row per (group, channel)."""
    wide = df.groupBy(by).agg(
        count_rows("n"),
        *[F.struct(F.lit(c).alias("channel"), F.sqrt(F.avg(F.col(c) * F.col(c))).alias("rms"),
                   F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(f"_{c}") for c in channels])
    return wide.select(by, "n", F.inline(F.array(*[f"_{c}" for c in channels])))


def near_zero(df: DataFrame, c: str, tol: float = 1.0) -> DataFrame:
    """Mean and population std of per-recording means; flags |mean| below the tolerance."""
    return df.agg(F.avg(c).alias("mean_of_means"), F.stddev_pop(c).alias("std_of_means"),
                  (F.abs(F.avg(c)) < tol).alias("near_zero"))


def profile_fraction(df: DataFrame, c: str, by: str | None = None, limit: int = HEAP_ROWS) -> DataFrame:
    """Overall: mean, p10, p50, p90. Per group: mean, min, max."""
    if by is not None:
        return df.groupBy(by).agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))
    return describe(df, c, (.1, .5, .9), limit=limit).select("mean", "p10", "p50", "p90")


def vector_stats(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population std per dimension of an array column."""
    return df.select(F.posexplode(vec).alias("dim", "_v")).groupBy("dim").agg(
        F.avg(F.col("_v").cast("double")).alias("mean"), F.stddev_pop(F.col("_v").cast("double")).alias("std"))


def weighted_mean(df: DataFrame, by: Sequence[str], x: str, n: str) -> DataFrame:
    """Batch-size weighted mean."""
    return df.groupBy(*by).agg((F.sum(F.col(x) * F.col(n)) / F.sum(n)).alias("mean"), F.sum(n).alias("n"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL-skipping means; 0 where every value is missing."""
    return df.agg(*[F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)).alias(c) for c in cols])


def distinct_params(params: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, param, value) for every value a parameter takes in a group."""
    pairs = params.select(*by, F.inline(F.array(
        *[F.struct(F.lit(c).alias("param"), F.col(c).cast("double").alias("value")) for c in cols])))
    return pairs.filter(F.col("value").isNotNull()).distinct()


def identifiability(params: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Number and range of distinct values per parameter and group, with a flag for constant ones.

    `distinct_params` lists the values themselves, one per row.
    """
    return distinct_params(params, by, cols).groupBy(*by, "param").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        (F.count(F.lit(1)) < 2).alias("is_constant"))


def distinct_on_sample(df: DataFrame, cols: Sequence[str], n: int | None = 20, seed: int = 0) -> DataFrame:
    """Distinct metadata tuples among n rows drawn by hash order (all rows when n is None)."""
    rows = df
    if n is not None:
        rows = df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *cols).limit(n)
    return rows.groupBy(*cols).agg(count_rows("n"))


def first_mid_last(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """Rows at positions 0, n div 2 and n-1 of each group."""
    ranked = rank_in_group(df, [by], order, "_pos")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_null_safe(ranked, sizes, [by], "inner")
    role = (F.when(F.col("_pos") == 0, "first").when(F.col("_pos") == F.col("_n") - 1, "last")
            .when(F.col("_pos") == F.floor(F.col("_n") / 2), "middle"))
    return joined.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_pos", "_n")


def sample_per_group(df: DataFrame, by: str, k: int, seed: int, key: str) -> DataFrame:
    """Up to k rows per group in hash order of a key column: repeatable on every run."""
    return first_k(df, [by], [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], k, "_rn").drop("_rn")
