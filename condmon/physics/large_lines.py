"""Median pairwise slope of groups too large for one task.

The slopes are never formed. The number of pairs not steeper than b is the number of inversions of
y - b*x in x order. That count is split in two directions: blocks along x and buckets along the
residual. Pairs inside a block and pairs inside a bucket are counted by bounded tasks, all
other pairs from a table of row counts per (bucket, block). A search over b that halves the
possible doubles several times per pass ends on the exact median.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from condmon.operators.skew import exact_percentiles, join_null_safe, rank_in_group, split_by_order
from condmon.physics.lines import _float_key, _float_of, inversions
from condmon.session import stored

CANDIDATES = 7
MOST = 4096  # blocks along x, and buckets along the residual
STEEPEST = 1e100
BIG = "decimal(38,0)"


def _pairs(c):
    return (c.cast(BIG) * (c - 1).cast(BIG) / 2).cast(BIG)


def not_steeper(rows: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """(by, _b, cnt) for rows (by, _b, _n, _pos, _x, _y): pairs with x_i < x_j and slope <= b."""
    keys = [*by, "_b"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    width = F.greatest(F.lit(limit), F.ceil(F.col("_n") / MOST))
    resid = rows.select(*keys, "_n", "_pos", "_x", (F.col("_y") - F.col("_b") * F.col("_x")).alias("_r"),
                        F.floor(F.col("_pos") / width).cast("long").alias("_block"))

    def head(pdf: pd.DataFrame, value: int) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        out["v"] = value
        return out

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return head(pdf, inversions(pdf.sort_values("_pos")["_r"].to_numpy()))

    def in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows of one block are put in rising order, so only its equal residuals are counted
        pdf = pdf.sort_values(["_block", "_r"])
        same = pdf.groupby(["_block", "_r"]).size().to_numpy()
        return head(pdf, inversions(pdf["_r"].to_numpy()) - int((same * (same - 1) // 2).sum()))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        # at most MOST buckets and MOST + 1 blocks
        bucket = (pdf["_bucket"] - pdf["_bucket"].min()).to_numpy()
        grid = np.zeros((int(bucket.max()) + 1, int(pdf["_block"].max()) + 1), dtype=np.int64)
        grid[bucket, pdf["_block"].to_numpy()] = pdf["c"].to_numpy()
        above = np.cumsum(grid[::-1], axis=0)[::-1]           # this bucket and higher ones
        above = np.vstack([above[1:], np.zeros((1, grid.shape[1]), dtype=np.int64)])
        before = np.hstack([np.zeros((len(grid), 1), dtype=np.int64), np.cumsum(above, axis=1)[:, :-1]])
        return head(pdf, sum(int(a) for a in (grid * before).sum(axis=1)))

    schema = f"{kinds}, v bigint"
    sizes = resid.groupBy(*keys).agg(F.first("_n").alias("_n"))
    # equal residuals: the later row first, so that a pair split over buckets still counts
    cut = split_by_order(resid.drop("_n"), keys, [F.col("_r"), -F.col("_pos")], sizes, limit, MOST)
    parts = resid.groupBy(*keys, "_block").applyInPandas(in_block, schema)
    parts = parts.unionByName(cut.groupBy(*keys, "_bucket").applyInPandas(in_bucket, schema))
    cells = cut.groupBy(*keys, "_bucket", "_block").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.unionByName(cells.groupBy(*keys).applyInPandas(across, schema))
    counted = parts.groupBy(*keys).agg(F.sum(F.col("v").cast(BIG)).alias("_all"))
    # rows of one x are in rising order; the pairs of equal residual among them do not count
    flat = resid.groupBy(*keys, "_x", "_r").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum(_pairs(F.col("_c"))).alias("_flat"))
    return join_null_safe(counted, flat, keys, "inner").select(
        *keys, (F.col("_all") - F.col("_flat")).cast(BIG).alias("cnt"))


def _spread_candidates(by: Sequence[str], n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                low, high = int(row["lo"]), int(row["hi"])
                cuts = {low + (high - low) * i // (n + 1) for i in range(1, n + 1)} - {low, high}
                out += [(*[row[c] for c in by], _float_of(key)) for key in sorted(cuts)]
            yield pd.DataFrame(out, columns=[*by, "_b"])
    return run


def _narrow(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in states:
        lows, highs = [], []
        for _, row in pdf.iterrows():
            low, high = int(row["lo"]), int(row["hi"])
            for b, cnt in zip(row["_bs"], row["_cs"]):
                key = _float_key(b)
                if int(cnt) >= int(row["k"]):
                    high = min(high, key)
                else:
                    low = max(low, key)
            lows.append(low)
            highs.append(high)
        pdf = pdf.drop(columns=["_bs", "_cs"])
        pdf["lo"], pdf["hi"] = lows, highs
        pdf["open"] = [high - low > 1 for low, high in zip(lows, highs)]
        yield pdf


def theil_sen_large(rows: DataFrame, by: Sequence[str], limit: int, candidates: int | None = None) -> DataFrame:
    """(by, slope, intercept) for groups of any size; rows are (by, _x, _y)."""
    by, candidates = list(by), candidates or CANDIDATES
    ranked = stored(rank_in_group(rows, by, [F.col("_x"), F.col("_y")], "_pos", limit), "ranked")
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ties = ranked.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")).groupBy(*by).agg(
        F.sum(_pairs(F.col("_c"))).alias("_tied"))
    pairs = stored(join_null_safe(sizes, ties, by, "inner").withColumn(
        "_p", (_pairs(F.col("_n")) - F.col("_tied")).cast(BIG)), "pair-counts")
    sized = join_null_safe(ranked, pairs.select(*by, "_n"), by, "inner")

    # the two middle slopes (one and the same for an odd number of pairs)
    half = F.floor((F.col("_p") + 1) / 2)
    ks = F.array_distinct(F.array(half.cast(BIG), F.floor(F.col("_p") / 2 + 1).cast(BIG)))
    states = pairs.filter(F.col("_p") > 0).select(
        *by, F.explode(ks).alias("k"), F.lit(_float_key(-STEEPEST)).alias("lo"),
        F.lit(_float_key(STEEPEST)).alias("hi"), F.lit(True).alias("open"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*by).schema.fields)
    states = stored(states, "search")
    while not states.filter("open").isEmpty():
        tried = states.filter("open").select(*by, "lo", "hi").mapInPandas(
            _spread_candidates(by, candidates), f"{kinds}, _b double").distinct()
        counts = not_steeper(join_null_safe(sized, stored(tried, "candidates"), by, "inner"), by, limit)
        tested = counts.groupBy(*by).agg(F.collect_list("_b").alias("_bs"),
                                         F.collect_list(F.col("cnt").cast("string")).alias("_cs"))
        joined = join_null_safe(states, tested, by, "left").select(
            *by, F.col("k").cast("string").alias("k"), "lo", "hi", "open",
            F.coalesce("_bs", F.array().cast("array<double>")).alias("_bs"),
            F.coalesce("_cs", F.array().cast("array<string>")).alias("_cs"))
        states = stored(joined.mapInPandas(_narrow, f"{kinds}, k string, lo bigint, hi bigint, open boolean"), "search")

    @F.pandas_udf("double")
    def as_double(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: _float_of(int(k)))

    slopes = states.select(*by, as_double("hi").alias("_s")).groupBy(*by).agg(F.avg("_s").alias("slope"))
    lines = join_null_safe(pairs.select(*by), slopes, by, "left").withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    lines = stored(lines, "slopes")
    resid = join_null_safe(ranked, lines, by, "inner").select(*by, (F.col("_y") - F.col("slope") * F.col("_x")).alias("_r"))
    mids = exact_percentiles(resid, by, ["_r"], [.5], limit)
    return join_null_safe(lines, mids, by, "inner").select(*by, "slope", F.col("_r_q")[0].alias("intercept"))
