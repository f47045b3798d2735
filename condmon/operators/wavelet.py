"""Cutting-window detector: level-1 db4 detail, baseline z-score, two-channel intersection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import DB4_HIGH, WAVELET

REC = "recording_id"


def recording_sizes(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy(REC).agg(F.count(F.lit(1)).alias("n"))


def _extended_places(pos: Column, n: Column) -> Column:
    """Where a sample appears once the signal is mirrored at both ends (7 samples suffice)."""
    mirrored = F.array_compact(F.array(
        pos, F.when(pos < 7, -1 - pos), F.when(pos >= n - 7, 2 * n - 1 - pos)))
    # shorter than the filter: the mirror image repeats with period 2n
    shifts = F.sequence(F.lit(-4), F.lit(4))
    repeated = F.filter(
        F.flatten(F.transform(shifts, lambda s: F.array(pos + s * 2 * n, -1 - pos + s * 2 * n))),
        lambda e: (e >= -7) & (e <= n + 6))
    return F.when(n >= 7, mirrored).otherwise(repeated)


def db4_detail(recordings: DataFrame, channels: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """(recording_id, k, n, one |detail| per channel).

    Each sample adds to four coefficients; the sums are grouped by (recording, k), so even one
    huge recording spreads over all tasks, and partial sums are combined before the shuffle.
    """
    sizes = recording_sizes(recordings) if sizes is None else sizes
    taps = F.array(*[F.lit(h) for h in DB4_HIGH])
    placed = recordings.select(REC, "pos", *channels).join(sizes, REC).select(
        REC, "n", *channels, F.explode(_extended_places(F.col("pos"), F.col("n"))).alias("_e"))
    odd = F.pmod(F.col("_e") + 1, F.lit(2))
    spread = placed.select(REC, "n", *channels, F.col("_e"), odd.alias("_odd"),
                           F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("_i"))
    k = ((F.col("_e") - 1 + F.col("_odd")) / 2).cast("long") + F.col("_i")
    h = F.get(taps, (F.col("_odd") + 2 * F.col("_i")).cast("int"))
    weighted = spread.select(REC, "n", *channels, k.alias("k"), h.alias("_h"))
    inside = weighted.filter((F.col("k") >= 0) & (F.col("k") < F.floor((F.col("n") + 7) / 2)))
    return inside.groupBy(REC, "k").agg(
        F.first("n").alias("n"), *[F.abs(F.sum(F.col(c) * F.col("_h"))).alias(c) for c in channels])


def _edges(c: str, trim: float, min_active: int) -> tuple[Column, Column]:
    n, count = F.col("n"), F.coalesce(F.col(f"_n_{c}"), F.lit(0))
    first, last = F.col(f"_a_{c}"), F.col(f"_b_{c}")
    reach = (last - first) * F.lit(float(trim))

    def inside(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), x))).cast("long")

    full = (count < min_active) | (n < 2) | first.isNull()
    return (F.when(full, F.lit(0).cast("long")).otherwise(inside(first + reach)),
            F.when(full, n).otherwise(inside(last - reach)))


def active_windows(recordings: DataFrame, channels: Sequence[str], z: float = WAVELET["z"],
                   baseline: int = WAVELET["baseline"], min_active: int = WAVELET["min_active"],
                   trim: float = WAVELET["trim"]) -> DataFrame:
    """(recording_id, n, s_<channel>, e_<channel>): the active slice [s, e) per channel."""
    sizes = recording_sizes(recordings)
    detail = db4_detail(recordings, channels, sizes)
    # the first `baseline` coefficients only need the first samples
    head = db4_detail(recordings.filter(F.col("pos") <= 2 * baseline + 8), channels, sizes)
    base = head.filter(F.col("k") < baseline).groupBy(REC).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in channels], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in channels])
    n = F.col("n")
    # from 6 samples on each coefficient covers two samples, before that one
    low = F.when(n >= 6, 2 * F.col("k")).otherwise(F.col("k"))
    high = F.least(F.when(n >= 6, 2 * F.col("k") + 1).otherwise(F.col("k")), n - 1)
    scored = detail.join(base, REC).withColumns({"_low": low, "_high": high}).filter(F.col("_low") < n)
    aggs = []
    for c in channels:
        hot = (F.col(c) - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + 1e-9) > z
        aggs += [F.sum(F.when(hot, F.col("_high") - F.col("_low") + 1)).alias(f"_n_{c}"),
                 F.min(F.when(hot, F.col("_low"))).alias(f"_a_{c}"),
                 F.max(F.when(hot, F.col("_high"))).alias(f"_b_{c}")]
    spans = sizes.join(scored.groupBy(REC).agg(*aggs), REC, "left")
    out = [REC, n]
    for c in channels:
        s, e = _edges(c, trim, min_active)
        out += [s.alias(f"s_{c}"), e.alias(f"e_{c}")]
    return spans.select(*out)


def active_window(recordings: DataFrame, channel: str, **wavelet) -> DataFrame:
    return active_windows(recordings, [channel], **wavelet).select(
        REC, "n", F.col(f"s_{channel}").alias("s"), F.col(f"e_{channel}").alias("e"))


def cut_window(recordings: DataFrame, channels: Sequence[str] = ("acc", "acoustic"), **wavelet) -> DataFrame:
    """(recording_id, n, s, e): latest start and earliest end of the channels; all rows if they are disjoint."""
    spans = active_windows(recordings, channels, **wavelet)
    s = F.greatest(*[f"s_{c}" for c in channels])
    e = F.least(*[f"e_{c}" for c in channels])
    none = e <= s
    return spans.select(REC, "n", F.when(none, F.lit(0).cast("long")).otherwise(s).alias("s"),
                        F.when(none, F.col("n")).otherwise(e).alias("e"))


def cut_segments(windows: DataFrame) -> DataFrame:
    """The window as a one-element list of segments."""
    return windows.select(REC, F.array(F.struct("s", "e")).alias("segments"), F.lit(1).alias("n_segments"))


def gate(recordings: DataFrame, windows: DataFrame, min_rows: int = 4) -> DataFrame:
    """Rows inside the window, renumbered; a window below min_rows keeps the whole recording."""
    short = F.col("e") - F.col("s") < min_rows
    w = windows.select(
        REC, F.when(short, F.lit(0).cast("long")).otherwise(F.col("s")).alias("_s"),
        F.when(short, F.col("n")).otherwise(F.col("e")).alias("_e"))
    kept = recordings.join(w, REC).filter((F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e")))
    return kept.withColumn("pos", F.col("pos") - F.col("_s")).drop("_s", "_e")


def keep_fraction(windows: DataFrame, min_rows: int = 4) -> DataFrame:
    size = F.col("e") - F.col("s")
    kept = F.when(size < min_rows, F.col("n")).otherwise(size)
    return windows.select(REC, F.when(F.col("n") > 0, kept / F.col("n")).otherwise(0.0).alias("keep_frac"))
