"""Checked queries: signal operators (survey I)."""

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import query
from condmon.constants import CHANNELS, DB4_HIGH
from condmon.operators import features as ft, spectrum as sp, wavelet as wv
from condmon.operators.skew import exact_percentiles

REC, LONG = s.REC_SQL, s.LONG_SQL
WAVELET = {"z": 1.0, "baseline": 10, "min_active": 5}
STEP = "(1.0::DOUBLE / (1000.0::DOUBLE / 0.6::DOUBLE))"
NYQUIST = "((1000.0::DOUBLE / 0.6::DOUBLE) / 2.0::DOUBLE)"


def spectrum_sql(src: str, out: str = "") -> str:
    """Naive transform over a long table (recording_id, pos, channel, v); CTEs m, spec and shares."""
    return f"""{out}m AS (SELECT recording_id, channel, count(*) AS n, avg(v) AS mu FROM {src} GROUP BY recording_id, channel),
{out}spec AS (SELECT l.recording_id, l.channel, b.bin, any_value(m.n) AS n, b.bin * (1.0::DOUBLE / (any_value(m.n) * {STEP})) AS freq,
    pow(sum((v - mu) * cos(2 * pi() * ((b.bin * pos) % m.n) / m.n)), 2) + pow(sum((v - mu) * sin(2 * pi() * ((b.bin * pos) % m.n) / m.n)), 2) AS power
    FROM {src} l JOIN {out}m m USING (recording_id, channel) JOIN (SELECT unnest(range(0, 100000)) AS bin) b ON b.bin <= m.n // 2
    GROUP BY l.recording_id, l.channel, b.bin),
{out}tot AS (SELECT recording_id, channel, sum(power) AS total FROM {out}spec GROUP BY recording_id, channel),
{out}sh AS (SELECT s.*, CASE WHEN total > 1e-12 THEN power / total ELSE 0 END AS p FROM {out}spec s JOIN {out}tot USING (recording_id, channel))"""


def summary_sql(pre: str = "") -> str:
    b1, b2 = f"({NYQUIST} / 3.0)", f"(2.0 * {NYQUIST} / 3.0)"
    return f"""SELECT recording_id, channel, coalesce(arg_max(freq, p) FILTER (bin > 0 AND p > 0), 0) AS dom_freq,
    sum(CASE WHEN freq <= 200 THEN p ELSE 0 END) AS low_energy, sum(CASE WHEN freq > 200 AND freq <= 800 THEN p ELSE 0 END) AS mid_energy,
    sum(CASE WHEN freq <= {b1} THEN p ELSE 0 END) AS rel_e_b0, sum(CASE WHEN freq > {b1} AND freq <= {b2} THEN p ELSE 0 END) AS rel_e_b1,
    sum(CASE WHEN freq > {b2} THEN p ELSE 0 END) AS rel_e_b2, sum(CASE WHEN p > 1e-12 THEN -p * ln(p) ELSE 0 END) AS spec_entropy,
    sum(freq * p) AS spec_centroid_hz FROM {pre}sh GROUP BY recording_id, channel"""


def pivot_sql(rows: str, parts: list[str], channels=CHANNELS) -> str:
    """Long (recording_id, channel, part..) to one wide row per recording."""
    cells = ", ".join(f"any_value({p}) FILTER (channel = '{c}') AS {c}_{p}" for c in channels for p in parts)
    return f"SELECT recording_id, {cells} FROM ({rows}) GROUP BY recording_id"


TIME = """SELECT recording_id, channel, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS p2p,
    coalesce(kurtosis_pop(v), 0) AS kurtosis, count(*) AS n FROM {src} GROUP BY recording_id, channel"""
TIME_PARTS = ["mean", "std", "rms", "p2p", "kurtosis"]
SPEC_PARTS = ["dom_freq", "low_energy", "mid_energy", "rel_e_b0", "rel_e_b1", "rel_e_b2", "spec_entropy", "spec_centroid_hz"]


def names(parts, channels=CHANNELS):
    return " ".join(f"{c}_{p}" for c in channels for p in parts)


@query("I1_time_features", f"WITH {LONG} {pivot_sql(TIME.format(src='long'), TIME_PARTS)}", names(TIME_PARTS))
def i1t(spark, sf):
    return ft.time_features(s.signal_rows(spark, sf)).drop("n")


V1 = f"""SELECT t.recording_id, t.channel, mean, std, rms, p2p, kurtosis, dom_freq, low_energy, mid_energy
    FROM ({TIME.format(src='{src}')}) t JOIN ({summary_sql('{pre}')}) f USING (recording_id, channel)"""


@query("I1_features_v1", f"WITH {LONG}, {spectrum_sql('long')} {pivot_sql(V1.format(src='long', pre=''), list(ft.V1_PARTS))}", names(ft.V1_PARTS))
def i1(spark, sf):
    return ft.features_v1(s.recordings(spark, sf))


def _subset_check(subset: str) -> None:
    cols = ft.subset_names(subset)
    wide = pivot_sql(V1.format(src="long", pre=""), list(ft.V1_PARTS))

    @query(f"B18_subset_{subset}", f"WITH {LONG}, {spectrum_sql('long')} SELECT recording_id, {', '.join(cols)} FROM ({wide})", " ".join(cols))
    def run(spark, sf):
        return ft.select_features(ft.features_v1(s.recordings(spark, sf)), subset)


for _subset in ("raw25", "top25", "all40"):
    _subset_check(_subset)


@query("I3_spectrum", f"WITH {LONG}, {spectrum_sql('long')} SELECT recording_id, channel, bin, freq, power FROM spec WHERE bin > 0", "freq power", 4)
def i3(spark, sf):
    return sp.spectrum(s.recordings(spark, sf)).filter("bin > 0")


@query("I4_I8_spectral_summary", f"WITH {LONG}, {spectrum_sql('long')} {pivot_sql(summary_sql(), SPEC_PARTS)}", names(SPEC_PARTS))
def i4(spark, sf):
    shares = sp.spectrum_wide(s.recordings(spark, sf), share=True)
    return sp.spectral_summary(shares, CHANNELS)


TREND = """z AS (SELECT recording_id, channel, count(*) AS n, sqrt(avg(v * v)) AS rms FROM {src} GROUP BY recording_id, channel),
sr AS (SELECT l.recording_id, l.channel, pos // (n // 10) AS seg, sqrt(avg(v * v)) AS r FROM {src} l JOIN z USING (recording_id, channel)
    WHERE n >= 10 AND pos < n - n % 10 GROUP BY l.recording_id, l.channel, pos // (n // 10)),
tr AS (SELECT recording_id, channel, avg(r) AS a, stddev_pop(r) AS sd, CASE WHEN stddev_pop(r) < 1e-12 THEN 0 ELSE regr_slope(r, seg / 9.0) END AS sl,
    CASE WHEN stddev_pop(r) < 1e-12 THEN avg(r) ELSE regr_intercept(r, seg / 9.0) END AS ic FROM sr GROUP BY recording_id, channel),
trend AS (SELECT z.recording_id, z.channel, coalesce(a, rms) AS win_mean_rms, coalesce(sd, 0) AS win_std_rms,
    coalesce(sl, 0) AS win_slope_rms, coalesce(ic, rms) AS win_intercept_rms FROM z LEFT JOIN tr USING (recording_id, channel))"""


@query("E4_I9_windowed_rms_trend", f"WITH {LONG}, {TREND.format(src='long')} {pivot_sql('SELECT * FROM trend', list(ft.TREND))}", names(ft.TREND))
def i9(spark, sf):
    return ft.windowed_rms_trend(s.recordings(spark, sf), CHANNELS)


SHAPE = """sh0 AS (SELECT recording_id, channel, avg(v) AS mu, stddev_pop(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr,
    quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS p95mp05 FROM {src} GROUP BY recording_id, channel),
shape AS (SELECT l.recording_id, l.channel, any_value(iqr) AS iqr, any_value(p95mp05) AS p95mp05,
    avg(CASE WHEN abs(v - mu) > 3.0 * (sd + 1e-12) THEN 1.0 ELSE 0.0 END) AS frac3sig FROM {src} l JOIN sh0 USING (recording_id, channel)
    GROUP BY l.recording_id, l.channel)"""
SHAPE_PARTS = ["iqr", "p95mp05", "frac3sig"]


@query("I10_I11_channel_shape", f"WITH {LONG}, {SHAPE.format(src='long')} {pivot_sql('SELECT * FROM shape', SHAPE_PARTS)}", names(SHAPE_PARTS))
def i10(spark, sf):
    return ft.channel_shape(s.signal_rows(spark, sf), CHANNELS)


def force_sql(recs: str, pre: str = "") -> str:
    """CTEs over the resultant; <pre>force holds the ten force columns."""
    return f"""{pre}fl AS (SELECT recording_id, pos, 'Fres' AS channel, sqrt(Fx * Fx + Fy * Fy + Fz * Fz) AS v FROM {recs}),
{pre}fz AS (SELECT recording_id, channel, count(*) AS n, sqrt(avg(v * v)) AS rms FROM {pre}fl GROUP BY recording_id, channel),
{pre}fsr AS (SELECT l.recording_id, l.channel, pos // (n // 10) AS seg, sqrt(avg(v * v)) AS r FROM {pre}fl l JOIN {pre}fz USING (recording_id, channel)
    WHERE n >= 10 AND pos < n - n % 10 GROUP BY l.recording_id, l.channel, pos // (n // 10)),
{pre}ftr AS (SELECT recording_id, avg(r) AS a, stddev_pop(r) AS sd, regr_slope(r, seg / 9.0) AS sl, regr_intercept(r, seg / 9.0) AS ic FROM {pre}fsr GROUP BY recording_id),
{pre}fst AS (SELECT recording_id, avg(v) AS mu, stddev_pop(v) AS sd0 FROM {pre}fl GROUP BY recording_id),
{pre}fx AS (SELECT recording_id, avg(abs(Fx) / (abs(Fy) + 1e-6)) AS ratio, stddev_pop(Fx) / (abs(avg(Fx)) + 1e-6) AS cx,
    stddev_pop(Fy) / (abs(avg(Fy)) + 1e-6) AS cy, stddev_pop(Fz) / (abs(avg(Fz)) + 1e-6) AS cz FROM {recs} GROUP BY recording_id),
{pre}force AS (SELECT x.recording_id, mu AS Fres_mean, sd0 AS Fres_std, coalesce(a, rms) AS Fres_win_mean_rms, coalesce(sd, 0) AS Fres_win_std_rms,
    coalesce(sl, 0) AS Fres_win_slope_rms, coalesce(ic, rms) AS Fres_win_intercept_rms, ratio AS FxFy_ratio_mean, cx AS Fx_cv, cy AS Fy_cv, cz AS Fz_cv
    FROM {pre}fx x JOIN {pre}fst USING (recording_id) JOIN {pre}fz USING (recording_id) LEFT JOIN {pre}ftr USING (recording_id))"""


FORCE_COLS = "Fres_mean Fres_std Fres_win_mean_rms Fres_win_std_rms Fres_win_slope_rms Fres_win_intercept_rms FxFy_ratio_mean Fx_cv Fy_cv Fz_cv"


@query("I12_I14_force_features", f"WITH {REC}, {force_sql('recs')} SELECT * FROM force", FORCE_COLS)
def i12(spark, sf):
    return ft.force_features(s.recordings(spark, sf))


def v2_sql(long: str, recs: str) -> str:
    per = f"""SELECT t.recording_id, t.channel, mean, std, rms, iqr, p95mp05, frac3sig, win_mean_rms, win_std_rms, win_slope_rms, win_intercept_rms,
        rel_e_b0, rel_e_b1, rel_e_b2, spec_entropy, spec_centroid_hz FROM ({TIME.format(src=long)}) t JOIN shape USING (recording_id, channel)
        JOIN trend USING (recording_id, channel) JOIN ({summary_sql()}) f USING (recording_id, channel)"""
    return f"""{SHAPE.format(src=long)}, {TREND.format(src=long)}, {spectrum_sql(long)}, {force_sql(recs)},
wide AS ({pivot_sql(per, list(ft.V2_PARTS))})"""


V2_COLS = names(ft.V2_PARTS) + " " + FORCE_COLS


@query("I2_features_v2", f"WITH {LONG}, {v2_sql('long', 'recs')} SELECT wide.*, {', '.join(FORCE_COLS.split())} FROM wide JOIN force USING (recording_id)", V2_COLS)
def i2(spark, sf):
    return ft.features_v2(s.recordings(spark, sf))


# ---- wavelet detector

TAPS = ", ".join(f"({j}, {h!r}::DOUBLE)" for j, h in enumerate(DB4_HIGH))


def detail_sql(long: str = "long") -> str:
    """Level-1 detail of the mirrored signal; every recording has at least 7 rows here."""
    return f"""taps(j, h) AS (VALUES {TAPS}),
dn AS (SELECT recording_id, channel, count(*) AS n FROM {long} GROUP BY recording_id, channel),
ext AS (SELECT l.recording_id, l.channel, n, unnest([pos, -1 - pos, 2 * n - 1 - pos]) AS e, v FROM {long} l JOIN dn USING (recording_id, channel)),
det AS (SELECT recording_id, channel, (e + j - 1) // 2 AS k, any_value(n) AS n, abs(sum(v * h)) AS d FROM ext, taps
    WHERE e >= -7 AND e <= n + 6 AND (e + j - 1) % 2 = 0 AND e + j - 1 >= 0 AND (e + j - 1) // 2 < (n + 7) // 2
    GROUP BY recording_id, channel, (e + j - 1) // 2)"""


EDGES = f"""bl AS (SELECT recording_id, channel, avg(d) AS mu, stddev_pop(d) AS sd FROM det WHERE k < {WAVELET['baseline']} GROUP BY recording_id, channel),
zr AS (SELECT l.recording_id, l.channel, l.pos, dn.n, (d - mu) / (sd + 1e-9) AS z FROM long l JOIN dn USING (recording_id, channel)
    JOIN det ON det.recording_id = l.recording_id AND det.channel = l.channel AND det.k = l.pos // 2
    JOIN bl ON bl.recording_id = l.recording_id AND bl.channel = l.channel),
ac AS (SELECT recording_id, channel, any_value(n) AS n, count(*) FILTER (z > {WAVELET['z']}) AS c, min(pos) FILTER (z > {WAVELET['z']}) AS a,
    max(pos) FILTER (z > {WAVELET['z']}) AS b FROM zr GROUP BY recording_id, channel),
edges AS (SELECT recording_id, channel, n, CASE WHEN c < {WAVELET['min_active']} THEN 0 ELSE CAST(floor(greatest(0, least(n - 1, a - 0.05::DOUBLE * (b - a)))) AS BIGINT) END AS s,
    CASE WHEN c < {WAVELET['min_active']} THEN n ELSE CAST(floor(greatest(0, least(n - 1, b + 0.05::DOUBLE * (b - a)))) AS BIGINT) END AS e FROM ac)"""
WINDOW = """win0 AS (SELECT recording_id, any_value(n) AS n, max(s) AS s, min(e) AS e FROM edges WHERE channel IN ('acc', 'acoustic') GROUP BY recording_id),
win AS (SELECT recording_id, n, CASE WHEN e <= s THEN 0 ELSE s END AS s, CASE WHEN e <= s THEN n ELSE e END AS e FROM win0)"""
DETECT = f"{LONG}, {detail_sql()}, {EDGES}, {WINDOW}"


@query("E10_db4_detail", f"WITH {LONG}, {detail_sql()} SELECT recording_id, k, n, any_value(d) FILTER (channel = 'acc') AS acc, any_value(d) FILTER (channel = 'acoustic') AS acoustic FROM det GROUP BY recording_id, k, n", "acc acoustic")
def e10(spark, sf):
    return wv.db4_detail(s.recordings(spark, sf), ["acc", "acoustic"])


@query("I15_active_window", f"WITH {LONG}, {detail_sql()}, {EDGES} SELECT recording_id, n, s, e FROM edges WHERE channel = 'acc'")
def i15(spark, sf):
    return wv.active_window(s.recordings(spark, sf), "acc", **WAVELET)


@query("I16_cut_window", f"WITH {DETECT} SELECT recording_id, n, s, e FROM win")
def i16(spark, sf):
    return wv.cut_window(s.recordings(spark, sf), **WAVELET)


@query("I18_cut_segments", f"WITH {DETECT} SELECT recording_id, s AS seg_start, e AS seg_end, 1 AS n_segments FROM win")
def i18(spark, sf):
    segs = wv.cut_segments(wv.cut_window(s.recordings(spark, sf), **WAVELET))
    return segs.select("recording_id", F.inline("segments"), "n_segments").toDF("recording_id", "seg_start", "seg_end", "n_segments")


GATED = """gr AS (SELECT r.recording_id, r.pos - (CASE WHEN e - s < 4 THEN 0 ELSE s END) AS pos, acc, acoustic, Fx, Fy, Fz FROM recs r JOIN win USING (recording_id)
    WHERE e - s < 4 OR (pos >= s AND pos < e)),
gl AS (SELECT recording_id, pos, 'acc' AS channel, acc AS v FROM gr UNION ALL SELECT recording_id, pos, 'acoustic', acoustic FROM gr
    UNION ALL SELECT recording_id, pos, 'Fx', Fx FROM gr UNION ALL SELECT recording_id, pos, 'Fy', Fy FROM gr UNION ALL SELECT recording_id, pos, 'Fz', Fz FROM gr)"""
KEEP = "CASE WHEN e - s < 4 THEN 1.0::DOUBLE ELSE (e - s)::DOUBLE / n END"


@query("I17_features_v1_gated", f"WITH {DETECT}, {GATED}, {spectrum_sql('gl', 'g_')} {pivot_sql(V1.format(src='gl', pre='g_'), list(ft.V1_PARTS))}", names(ft.V1_PARTS), 8)
def i17a(spark, sf):
    return ft.features_v1(s.stored_recordings(spark, sf), gate=True, **WAVELET)


V3_SQL = f"""WITH {DETECT}, {GATED}, {v2_sql('gl', 'gr')} SELECT wide.*, {', '.join(FORCE_COLS.split())}, {{extra}}
    FROM wide JOIN force USING (recording_id) JOIN win USING (recording_id)"""


@query("I17_features_v3", V3_SQL.format(extra=f"{KEEP} AS keep_frac"), V2_COLS + " keep_frac", 8)
def i17(spark, sf):
    return ft.features_v3(s.stored_recordings(spark, sf), **WAVELET)


@query("I18_features_v4", V3_SQL.format(extra="1 AS n_segments"), V2_COLS, 8)
def i18b(spark, sf):
    return ft.features_v4(s.stored_recordings(spark, sf), **WAVELET)


@query("I17_keep_fraction", f"WITH {DETECT} SELECT recording_id, {KEEP} AS keep_frac FROM win", "keep_frac")
def i17k(spark, sf):
    return wv.keep_fraction(wv.cut_window(s.recordings(spark, sf), **WAVELET))


MOVED = " OR ".join(f"abs(a.{c}_{p} - b.{c}_{p}) > 1e-6 + 1e-4 * abs(b.{c}_{p})" for c in CHANNELS for p in ft.V1_PARTS)
QA = f"""WITH {DETECT}, {GATED}, {spectrum_sql('long')}, {spectrum_sql('gl', 'g_')},
a AS ({pivot_sql(V1.format(src='long', pre=''), list(ft.V1_PARTS))}), b AS ({pivot_sql(V1.format(src='gl', pre='g_'), list(ft.V1_PARTS))}),
qa AS (SELECT win.recording_id, n, s, e, e - s AS kept, (e - s)::DOUBLE / n AS kept_frac, 1 - (e - s)::DOUBLE / n AS aircut_frac,
    s = 0 AND e = n AS is_full, {MOVED} AS changed FROM win JOIN a USING (recording_id) JOIN b USING (recording_id))"""


@query("I19_C9_gating_report", f"{QA} SELECT * FROM qa", "kept_frac aircut_frac")
def i19(spark, sf):
    return ft.gating_report(s.stored_recordings(spark, sf), **WAVELET)[0]


@query("I19_gating_summary", f"""{QA} SELECT count(*) AS files, avg(kept_frac) AS mean_kept, avg(aircut_frac) AS mean_aircut, min(kept_frac) AS min_kept,
    max(kept_frac) AS max_kept, count(*) FILTER (is_full) AS fallbacks FROM qa""", "mean_kept mean_aircut min_kept max_kept")
def i19b(spark, sf):
    return ft.gating_report(s.stored_recordings(spark, sf), **WAVELET)[1]


@query("I10_percentiles", f"""WITH {REC} SELECT recording_id, quantile_cont(acc, 0.05) AS p05, quantile_cont(acc, 0.5) AS p50, quantile_cont(acc, 0.95) AS p95
    FROM recs GROUP BY recording_id""", "p05 p50 p95")
def i10b(spark, sf):
    q = exact_percentiles(s.signal_rows(spark, sf), ["recording_id"], ["acc"], (.05, .5, .95))
    return q.select("recording_id", *[F.col("acc_q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])
