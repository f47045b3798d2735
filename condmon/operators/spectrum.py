"""Power spectra of recordings and their descriptors.

A Fourier transform is not a Spark expression, so it runs in grouped numpy functions. A recording
that fits one task is transformed there. A longer one is never gathered: its transform is split
into many short ones (chirp-z form of the exact n-point transform, arranged as a matrix of
short transforms), each of about sqrt(n) values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import CHANNELS, FS
from condmon.operators.skew import FIND, HEAP_ROWS, exact_percentiles, oversized_groups
from condmon.session import stored

REC = "recording_id"
FLAT = 1e-12


def _bin_width(n, fs: float):
    return 1.0 / (n * (1.0 / fs))


def _id_type(recordings: DataFrame) -> str:
    return recordings.schema[REC].dataType.simpleString()


def long_recordings(recordings: DataFrame, limit: int = HEAP_ROWS, hot: DataFrame | None = FIND) -> DataFrame | None:
    """(recording_id, _n) of recordings too long for one task, or None.

    `hot` may name the long recordings of a frame this one was cut from, which saves a scan
    in the usual case that there are none.
    """
    if hot is FIND:
        return oversized_groups(recordings, [REC], max(limit, 4))
    if hot is None:
        return None
    sizes = recordings.join(hot.select(REC), REC, "left_semi").groupBy(REC).agg(F.count(F.lit(1)).alias("_n"))
    return stored(sizes.filter(F.col("_n") > max(limit, 4)), "long-recordings")


def spectrum_wide(recordings: DataFrame, fs: float = FS, channels: Sequence[str] = CHANNELS,
                  share: bool = False, limit: int = HEAP_ROWS, long: DataFrame | None = FIND,
                  probs: Sequence[float] = ()) -> DataFrame:
    """(recording_id, n, bin, freq, one column per channel) for bins 0..n div 2.

    Columns hold one-sided, undoubled power of the mean-removed signal; with `share`, power over
    its total (0 for a flat channel). With `probs`, bin 0 also carries the exact percentiles of
    all channels in `_q`, since the pass has the rows at hand anyway (NULL for long recordings).
    """
    channels = list(channels)
    rows = recordings.select(REC, F.col("pos").cast("long").alias("pos"), *channels)
    long = long_recordings(rows, limit) if long is FIND else long
    if long is None:
        return _small_spectra(rows, fs, channels, share, probs)
    small = _small_spectra(rows.join(long, REC, "left_anti"), fs, channels, share, probs)
    return small.unionByName(_long_spectra(rows.join(long, REC), fs, channels, share), allowMissingColumns=True)


def _whole_recordings(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Regroup sorted batches so that no recording is cut: (rows, bounds of its recordings)."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if held and len(pdf) and pdf[REC].iloc[0] == pdf[REC].iloc[-1] == held[-1][REC].iloc[-1]:
            held.append(pdf)
            continue
        pdf = pd.concat([*held, pdf], ignore_index=True)
        ids = pdf[REC].to_numpy()
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        done = int(cuts[-1]) if len(cuts) else 0
        if done:
            yield pdf.iloc[:done], np.concatenate(([0], cuts))
        held = [pdf.iloc[done:]]
    rest = pd.concat(held, ignore_index=True) if held else None
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _small_spectra(rows: DataFrame, fs: float, channels: list[str], share: bool,
                   probs: Sequence[float] = ()) -> DataFrame:
    """Recordings that fit a task, many per batch."""
    ranks = [100.0 * p for p in probs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _whole_recordings(batches):
            signal = pdf[channels].to_numpy(dtype=float)
            parts, marks = [], []
            for a, b in zip(bounds, bounds[1:]):
                x = signal[a:b]
                power = np.abs(np.fft.rfft(x - x.mean(axis=0), axis=0)) ** 2
                if share:
                    total = power.sum(axis=0)
                    # Flat is decided on the values, as for long recordings; rounding may leave a constant some power.
                    total = np.where(x.min(axis=0) == x.max(axis=0), 0.0, total)
                    power = np.where(total > FLAT, power / np.where(total > FLAT, total, 1.0), 0.0)
                parts.append(power)
                if ranks:
                    marks += [np.percentile(x, ranks, axis=0).T.ravel()] + [None] * (len(power) - 1)
            sizes = np.diff(bounds)
            lengths = sizes // 2 + 1
            n = np.repeat(sizes, lengths)
            bins = np.concatenate([np.arange(k) for k in lengths])
            out = pd.DataFrame(np.concatenate(parts), columns=channels)
            out.insert(0, "freq", bins * _bin_width(n, fs))
            out.insert(0, "bin", bins)
            out.insert(0, "n", n)
            out.insert(0, REC, np.repeat(pdf[REC].to_numpy()[bounds[:-1]], lengths))
            if ranks:
                out["_q"] = marks
            yield out

    cells = ", ".join(f"`{c}` double" for c in channels) + (", _q array<double>" if ranks else "")
    schema = f"{REC} {_id_type(rows)}, n bigint, bin bigint, freq double, {cells}"
    return rows.repartition(REC).sortWithinPartitions(REC, "pos").mapInPandas(run, schema)


def recording_percentiles(recordings: DataFrame, channels: Sequence[str], probs: Sequence[float],
                          limit: int = HEAP_ROWS, long: DataFrame | None = FIND) -> DataFrame:
    """(recording_id, _q): exact percentiles of all channels in one array, channel by channel."""
    channels, ranks = list(channels), [100.0 * p for p in probs]
    rows = recordings.select(REC, *channels)
    long = long_recordings(rows, limit) if long is FIND else long

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _whole_recordings(batches):
            x = pdf[channels].to_numpy(dtype=float)
            yield pd.DataFrame({
                REC: pdf[REC].to_numpy()[bounds[:-1]],
                "_q": [np.percentile(x[a:b], ranks, axis=0).T.ravel() for a, b in zip(bounds, bounds[1:])]})

    small = rows if long is None else rows.join(long, REC, "left_anti")
    out = small.repartition(REC).sortWithinPartitions(REC).mapInPandas(run, f"{REC} {_id_type(rows)}, _q array<double>")
    return out if long is None else out.unionByName(long_percentiles(rows, channels, probs, long, limit))


def long_percentiles(rows: DataFrame, channels: Sequence[str], probs: Sequence[float], long: DataFrame,
                     limit: int = HEAP_ROWS) -> DataFrame:
    """The same for long recordings, by rank."""
    q = exact_percentiles(rows.join(long, REC, "left_semi"), [REC], channels, probs, limit, hot=long)
    return q.select(REC, F.flatten(F.array(*[f"{c}_q" for c in channels])).alias("_q"))


def _square_mod(j: np.ndarray, m: int) -> np.ndarray:
    """j^2 mod m without overflow for 0 <= j < m < 2^51: the number is squared in two halves."""
    high, low = j >> 20, j & ((1 << 20) - 1)

    def shifted(x: np.ndarray, tens: int) -> np.ndarray:
        for _ in range(tens):
            x = (x << 10) % m
        return x

    return (shifted(high * high % m, 4) + shifted(2 * high * low % m, 2) + low * low) % m


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(i*pi*j^2/n); the square is reduced before the angle is formed to keep precision."""
    return np.exp(1j * np.pi * _square_mod(np.abs(j.astype(np.int64)) % (2 * n), 2 * n) / n)


def _grid(n: int) -> tuple[int, int, int]:
    """Padded length and its two factors (powers of two)."""
    bits = int(2 * n - 1).bit_length()
    low = 1 << (bits // 2)
    return 1 << bits, low, (1 << bits) // low


def _long_spectra(rows: DataFrame, fs: float, channels: list[str], share: bool) -> DataFrame:
    """Spectra of recordings beyond one task; `rows` carries the recording length in `_n`.

    With M = L1*L2 >= 2n, index m = m1*L2 + m2 and frequency k = k1 + L1*k2:
    1. columns m2: chirp, L1-point transforms, twiddle;  2. rows k1: L2-point transforms, times
    the chirp's own transform, back over k2, twiddle;  3. columns m2: back over k1, chirp.
    """
    width = len(channels)
    parts = [f"{p}{i}" for i in range(width + 1) for p in ("re", "im")]
    cells = ", ".join(f"{p} double" for p in parts)
    rid = _id_type(rows)

    def pack(head: dict, values: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(head)
        for i in range(width + 1):
            out[f"re{i}"], out[f"im{i}"] = values[:, i].real, values[:, i].imag
        return out

    def unpack(pdf: pd.DataFrame, size: int, at: str) -> np.ndarray:
        full = np.zeros((size, width + 1), dtype=complex)
        data = pdf[parts].to_numpy()
        full[pdf[at].to_numpy()] = data[:, 0::2] + 1j * data[:, 1::2]
        return full

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m2 = int(pdf["_n"].iloc[0]), int(pdf["_m2"].iloc[0])
        size, l1, l2 = _grid(n)
        pos = pdf["pos"].to_numpy()
        grid = np.zeros((l1, width + 1), dtype=complex)
        grid[pos // l2, :width] = pdf[channels].to_numpy(dtype=float) * _chirp(pos, n).conj()[:, None]
        m = np.arange(l1) * l2 + m2
        lag = np.where(m < n, m, size - m)
        grid[:, width] = np.where(lag < n, _chirp(lag, n), 0.0)
        k1 = np.arange(l1)
        turned = np.fft.fft(grid, axis=0) * np.exp(-2j * np.pi * ((k1 * m2) % size) / size)[:, None]
        return pack({REC: pdf[REC].iloc[0], "_n": n, "_k1": k1, "_m2": m2}, turned)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k1 = int(pdf["_n"].iloc[0]), int(pdf["_k1"].iloc[0])
        size, l1, l2 = _grid(n)
        values = np.fft.fft(unpack(pdf, l2, "_m2"), axis=0)
        values[:, :width] *= values[:, width:]
        m2 = np.arange(l2)
        back = np.fft.ifft(values, axis=0) * np.exp(2j * np.pi * ((k1 * m2) % size) / size)[:, None]
        return pack({REC: pdf[REC].iloc[0], "_n": n, "_k1": k1, "_m2": m2}, back)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m2 = int(pdf["_n"].iloc[0]), int(pdf["_m2"].iloc[0])
        _, l1, l2 = _grid(n)
        values = np.fft.ifft(unpack(pdf, l1, "_k1"), axis=0)[:, :width]
        k = np.arange(l1) * l2 + m2
        keep = k <= n // 2
        power = np.abs(values[keep]) ** 2
        out = pd.DataFrame(power, columns=channels)
        out.insert(0, "freq", k[keep] * _bin_width(n, fs))
        out.insert(0, "bin", k[keep])
        out.insert(0, "n", n)
        out.insert(0, REC, pdf[REC].iloc[0])
        return out

    means = rows.groupBy(REC).agg(*[F.avg(c).alias(f"_mean_{c}") for c in channels])
    flat = rows.groupBy(REC).agg(*[(F.min(c) == F.max(c)).alias(f"_flat_{c}") for c in channels])
    centred = rows.join(means, REC).select(
        REC, "_n", "pos", *[(F.col(c) - F.col(f"_mean_{c}")).alias(c) for c in channels])
    # L2 as in _grid; bin() gives the binary digits of 2n-1
    l2 = F.expr("shiftleft(1L, cast(length(bin(2 * _n - 1)) - length(bin(2 * _n - 1)) div 2 as int))")
    steps = f"{REC} {rid}, _n bigint, _k1 bigint, _m2 bigint, {cells}"
    first = centred.withColumn("_m2", F.pmod("pos", l2)).groupBy(REC, "_m2").applyInPandas(columns, steps)
    second = first.groupBy(REC, "_k1").applyInPandas(across, steps)
    powers = ", ".join(f"`{c}` double" for c in channels)
    spec = second.groupBy(REC, "_m2").applyInPandas(
        finish, f"{REC} {rid}, n bigint, bin bigint, freq double, {powers}")
    if not share:
        return spec
    totals = spec.groupBy(REC).agg(*[F.sum(c).alias(f"_t_{c}") for c in channels])
    return spec.join(totals, REC).join(flat, REC).select(
        REC, "n", "bin", "freq",
        *[F.when(~F.col(f"_flat_{c}") & (F.col(f"_t_{c}") > FLAT), F.col(c) / F.col(f"_t_{c}")).otherwise(0.0).alias(c) for c in channels])


def spectrum(recordings: DataFrame, fs: float = FS, channels: Sequence[str] = CHANNELS,
             limit: int = HEAP_ROWS) -> DataFrame:
    """Long form: (recording_id, channel, bin, freq, power)."""
    wide = spectrum_wide(recordings, fs, channels, limit=limit)
    return wide.unpivot([REC, "bin", "freq"], list(channels), "channel", "power")


def spectral_summary(shares: DataFrame, channels: Sequence[str], fs: float = FS, low: float = 200.0,
                     mid: float = 800.0, min_rows: int = 4, extra: Sequence[Column] = ()) -> DataFrame:
    """Descriptors per recording from a spectrum of shares. All are partial aggregates over bins.

    Dominant frequency and the two absolute bands hold for any length; Nyquist thirds, entropy
    and centroid are 0 below `min_rows` samples.
    """
    f = F.col("freq")
    nyquist = fs / 2.0
    b1, b2 = nyquist / 3.0, 2.0 * nyquist / 3.0
    thirds = (f <= b1, (f > b1) & (f <= b2), f > b2)
    long_enough = F.col("n") >= min_rows
    aggs = []
    for c in channels:
        p = F.col(c)
        q = F.when(long_enough, p).otherwise(0.0)
        peak = F.max(F.when((F.col("bin") > 0) & (p > 0), F.struct(p, -F.col("bin"), f.alias("f"))))
        aggs += [
            F.coalesce(peak.getField("f"), F.lit(0.0)).alias(f"{c}_dom_freq"),
            F.sum(F.when(f <= low, p).otherwise(0.0)).alias(f"{c}_low_energy"),
            F.sum(F.when((f > low) & (f <= mid), p).otherwise(0.0)).alias(f"{c}_mid_energy"),
            *[F.sum(F.when(cond, q).otherwise(0.0)).alias(f"{c}_rel_e_b{i}") for i, cond in enumerate(thirds)],
            F.sum(F.when(q > FLAT, -q * F.ln(q)).otherwise(0.0)).alias(f"{c}_spec_entropy"),
            F.sum(f * q).alias(f"{c}_spec_centroid_hz"),
        ]
    return shares.groupBy(REC).agg(*aggs, *extra)
