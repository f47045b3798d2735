"""Feature tables of recordings: v1 (40 columns), v2 (85), v3 = v2 on the cutting window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import CHANNELS, FS, N_SEGMENTS
from condmon.operators import wavelet as wv
from condmon.operators.lookup import any_changed
from condmon.operators.skew import FIND, HEAP_ROWS, oversized_groups
from condmon.operators.spectrum import (
    long_percentiles, long_recordings, recording_percentiles, spectral_summary, spectrum_wide,
)
from condmon.session import stored

REC = "recording_id"
FORCES = ("Fx", "Fy", "Fz")
# fixed values: names of the features
V1_PARTS = ("mean", "std", "rms", "p2p", "kurtosis", "dom_freq", "low_energy", "mid_energy")
V1_TIME = V1_PARTS[:5]
V2_PARTS = (
    "mean", "std", "rms", "iqr", "p95mp05", "frac3sig", "win_mean_rms", "win_std_rms",
    "win_slope_rms", "win_intercept_rms", "rel_e_b0", "rel_e_b1", "rel_e_b2", "spec_entropy",
    "spec_centroid_hz",
)
TREND = ("win_mean_rms", "win_std_rms", "win_slope_rms", "win_intercept_rms")

# fixed values: the named v1 subsets
TOP25_PARTS = {
    "acc": ("std", "rms", "p2p", "mid_energy"),
    "acoustic": ("std", "rms", "p2p", "low_energy", "mid_energy"),
    "Fx": ("mean", "std", "rms", "p2p", "low_energy", "mid_energy"),
    "Fy": ("mean", "std", "rms", "p2p", "low_energy", "mid_energy"),
    "Fz": ("std", "rms", "low_energy", "mid_energy"),
}


def v1_names(channels: Sequence[str] = CHANNELS) -> list[str]:
    return [f"{c}_{p}" for c in channels for p in V1_PARTS]


def v2_names(channels: Sequence[str] = CHANNELS) -> list[str]:
    names = [f"{c}_{p}" for c in channels for p in V2_PARTS]
    names += [f"Fres_{p}" for p in ("mean", "std", *TREND)]
    return [*names, "FxFy_ratio_mean", *[f"{c}_cv" for c in FORCES]]


def subset_names(subset: str) -> list[str]:
    if subset == "all40":
        return v1_names()
    if subset == "raw25":
        return [f"{c}_{p}" for c in CHANNELS for p in V1_TIME]
    if subset == "top25":
        return [f"{c}_{p}" for c, parts in TOP25_PARTS.items() for p in parts]
    raise ValueError(f"unknown feature subset {subset!r}")


def select_features(df: DataFrame, subset: str, keep: Sequence[str] = (REC,)) -> DataFrame:
    return df.select(*keep, *subset_names(subset))


def _rms(c: str) -> Column:
    return F.sqrt(F.avg(F.col(c) * F.col(c)))


def time_features(recordings: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """mean, std, rms, p2p, kurtosis per channel: one aggregation with map-side combine."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in channels:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), _rms(c).alias(f"{c}_rms"),
            (F.max(c) - F.min(c)).alias(f"{c}_p2p"),
            F.coalesce(F.nanvl(F.kurtosis(c), F.lit(0.0)), F.lit(0.0)).alias(f"{c}_kurtosis"),
        ]
    return recordings.groupBy(REC).agg(*aggs)


def find_windows(recordings: DataFrame, **wavelet) -> DataFrame:
    """Cutting windows as a stored table: one short row per recording that several blocks join."""
    return stored(wv.cut_window(recordings, **wavelet), "windows")


def features_v1(recordings: DataFrame, gate: bool = False, fs: float = FS, limit: int = HEAP_ROWS,
                windows: DataFrame | None = None, hot: DataFrame | None = FIND, **wavelet) -> DataFrame:
    rows = recordings
    hot = oversized_groups(recordings, [REC], limit) if hot is FIND else hot
    if gate:
        rows = wv.gate(recordings, find_windows(recordings, **wavelet) if windows is None else windows)
    long = long_recordings(rows, limit, hot)
    spec = spectral_summary(spectrum_wide(rows, fs, share=True, limit=limit, long=long), CHANNELS, fs)
    return time_features(rows).join(spec, REC).select(REC, *v1_names())


def with_resultant(recordings: DataFrame) -> DataFrame:
    total = F.sqrt(sum((F.col(c) * F.col(c) for c in FORCES[1:]), F.col("Fx") * F.col("Fx")))
    return recordings.withColumn("Fres", total)


def segment_trend(rows: DataFrame, stats: DataFrame, channels: Sequence[str], k: int = N_SEGMENTS,
                  beyond: Sequence[str] = ()) -> DataFrame:
    """Windowed rms trend per channel, and for `beyond` channels the share of rows outside 3 sigma.

    `stats` holds n and <c>_mean, <c>_std, <c>_rms. The trimmed rows at the end form one more
    segment, which counts for the share only, so a single pass serves both.
    """
    need = ["n", *[f"{c}_{p}" for c in beyond for p in ("mean", "std")]]
    joined = rows.select(REC, "pos", *channels).join(stats.select(REC, *need), REC)
    width = F.floor(F.col("n") / k)
    seg = F.when(F.col("pos") < width * k, F.floor(F.col("pos") / width)).otherwise(k).cast("int")
    parts = [F.avg(F.col(c) * F.col(c)).alias(f"_q_{c}") for c in channels]
    parts += [F.count_if(F.abs(F.col(c) - F.col(f"{c}_mean")) > 3.0 * (F.col(f"{c}_std") + 1e-12)).alias(f"_o_{c}")
              for c in beyond]
    segs = joined.withColumn("_seg", seg).groupBy(REC, "_seg").agg(F.first("n").alias("n"), *parts)
    inside = F.col("_seg") < k
    x = F.when(inside, F.col("_seg") / F.lit(float(k - 1)))
    aggs = []
    for c in channels:
        r = F.when(inside, F.sqrt(f"_q_{c}"))
        flat = F.stddev_pop(r) < 1e-12
        aggs += [
            F.avg(r).alias(f"{c}_win_mean_rms"), F.stddev_pop(r).alias(f"{c}_win_std_rms"),
            F.when(flat, 0.0).otherwise(F.regr_slope(r, x)).alias(f"{c}_win_slope_rms"),
            F.when(flat, F.avg(r)).otherwise(F.regr_intercept(r, x)).alias(f"{c}_win_intercept_rms"),
        ]
    aggs += [(F.sum(f"_o_{c}") / F.max("n")).alias(f"{c}_frac3sig") for c in beyond]
    trend = segs.groupBy(REC).agg(*aggs)
    whole = trend.join(stats.select(REC, "n", *[f"{c}_rms" for c in channels]), REC)
    short = F.col("n") < k
    fixed = {}
    for c in channels:
        fixed[f"{c}_win_mean_rms"] = F.when(short, F.col(f"{c}_rms")).otherwise(F.col(f"{c}_win_mean_rms"))
        fixed[f"{c}_win_std_rms"] = F.when(short, 0.0).otherwise(F.col(f"{c}_win_std_rms"))
        fixed[f"{c}_win_slope_rms"] = F.when(short, 0.0).otherwise(F.col(f"{c}_win_slope_rms"))
        fixed[f"{c}_win_intercept_rms"] = F.when(short, F.col(f"{c}_rms")).otherwise(F.col(f"{c}_win_intercept_rms"))
    return whole.withColumns(fixed).drop("n", *[f"{c}_rms" for c in channels])


def _basic(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), _rms(c).alias(f"{c}_rms")]
    ratio = F.avg(F.abs("Fx") / (F.abs("Fy") + 1e-6)).alias("FxFy_ratio_mean")
    extra = [ratio] if {"Fx", "Fy"} <= set(channels) else []
    return rows.groupBy(REC).agg(*aggs, *extra)


def windowed_rms_trend(recordings: DataFrame, channels: Sequence[str], k: int = N_SEGMENTS) -> DataFrame:
    return segment_trend(recordings, _basic(recordings, channels), channels, k)


def channel_shape(recordings: DataFrame, channels: Sequence[str], limit: int = HEAP_ROWS) -> DataFrame:
    """Inter-quartile range, p95-p05 and share beyond 3 sigma."""
    stats = _basic(recordings, channels)
    beyond = recordings.select(REC, *channels).join(stats, REC).groupBy(REC).agg(*[
        F.avg((F.abs(F.col(c) - F.col(f"{c}_mean")) > 3.0 * (F.col(f"{c}_std") + 1e-12)).cast("double")
              ).alias(f"{c}_frac3sig") for c in channels])
    q = recording_percentiles(recordings, channels, SPREAD_PROBS, limit)
    return q.select(REC, *[v.alias(n) for n, v in _spread(channels).items()]).join(beyond, REC)


SPREAD_PROBS = (.05, .25, .75, .95)


def _spread(channels: Sequence[str]) -> dict[str, Column]:
    """Spread columns from the percentile array `_q`."""
    out = {}
    for i, c in enumerate(channels):
        p05, p25, p75, p95 = (F.col("_q")[4 * i + j] for j in range(4))
        out |= {f"{c}_iqr": p75 - p25, f"{c}_p95mp05": p95 - p05}
    return out


def force_features(recordings: DataFrame, k: int = N_SEGMENTS) -> DataFrame:
    """Resultant statistics, mean |Fx|/|Fy| and coefficients of variation."""
    rows = with_resultant(recordings)
    stats = _basic(rows, [*FORCES, "Fres"])
    trend = segment_trend(rows, stats, ["Fres"], k)
    cv = [(F.col(f"{c}_std") / (F.abs(f"{c}_mean") + 1e-6)).alias(f"{c}_cv") for c in FORCES]
    return stats.join(trend, REC).select(
        REC, "Fres_mean", "Fres_std", *[f"Fres_{p}" for p in TREND], "FxFy_ratio_mean", *cv)


def features_v2(recordings: DataFrame, fs: float = FS, k: int = N_SEGMENTS, limit: int = HEAP_ROWS,
                hot: DataFrame | None = FIND) -> DataFrame:
    hot = oversized_groups(recordings, [REC], limit) if hot is FIND else hot
    rows = with_resultant(recordings)
    every = [*CHANNELS, "Fres"]
    stats = _basic(rows, every)
    trend = segment_trend(rows, stats, every, k, beyond=CHANNELS)
    long = long_recordings(rows, limit, hot)
    shares = spectrum_wide(rows, fs, share=True, limit=limit, long=long, probs=SPREAD_PROBS)
    spec = spectral_summary(shares, CHANNELS, fs, extra=[F.first("_q", ignorenulls=True).alias("_q")])
    if long is not None:
        ranked = long_percentiles(rows, CHANNELS, SPREAD_PROBS, long, limit).withColumnRenamed("_q", "_ranked")
        spec = spec.join(ranked, REC, "left").withColumn("_q", F.coalesce("_q", "_ranked"))
    cv = {f"{c}_cv": F.col(f"{c}_std") / (F.abs(f"{c}_mean") + 1e-6) for c in FORCES}
    joined = stats.join(trend, REC).join(spec, REC)
    return joined.withColumns(cv | _spread(CHANNELS)).select(REC, *v2_names())


def features_v3(recordings: DataFrame, fs: float = FS, k: int = N_SEGMENTS, limit: int = HEAP_ROWS,
                windows: DataFrame | None = None, **wavelet) -> DataFrame:
    """v2 on the cutting window, plus the kept fraction."""
    windows = find_windows(recordings, **wavelet) if windows is None else windows
    gated = wv.gate(recordings, windows)
    hot = oversized_groups(recordings, [REC], limit)
    return features_v2(gated, fs, k, limit, hot).join(wv.keep_fraction(windows), REC)


def features_v4(recordings: DataFrame, **kwargs) -> DataFrame:
    """Same as v3 under the single-window detector, with the number of segments."""
    return features_v3(recordings, **kwargs).drop("keep_frac").withColumn("n_segments", F.lit(1))


def gating_report(recordings: DataFrame, limit: int = HEAP_ROWS, rtol: float = 1e-4, atol: float = 1e-6,
                  **wavelet) -> tuple[DataFrame, DataFrame]:
    """Per recording: window, kept share, fallback flag, whether v1 features move; and a summary."""
    windows = find_windows(recordings, **wavelet)
    hot = oversized_groups(recordings, [REC], limit)
    changed = any_changed(features_v1(recordings, limit=limit, hot=hot),
                          features_v1(recordings, gate=True, limit=limit, windows=windows, hot=hot),
                          REC, v1_names(), rtol, atol)
    kept = F.col("e") - F.col("s")
    rows = windows.join(changed, REC).select(
        REC, "n", "s", "e", kept.alias("kept"), (kept / F.col("n")).alias("kept_frac"),
        (1 - kept / F.col("n")).alias("aircut_frac"),
        ((F.col("s") == 0) & (F.col("e") == F.col("n"))).alias("is_full"), "changed")
    return rows, gating_summary(rows)


def gating_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("files"), F.avg("kept_frac").alias("mean_kept"),
        F.avg("aircut_frac").alias("mean_aircut"), F.min("kept_frac").alias("min_kept"),
        F.max("kept_frac").alias("max_kept"), F.count_if("is_full").alias("fallbacks"))
