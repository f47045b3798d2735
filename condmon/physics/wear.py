"""Wear rates and tool-life constants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import (
    CAUTION_SETS, CK45, EXCLUDED_SETS, FAILURE_UM, FIT_SETS, LIFE_FAILURE_UM, LITERATURE_N, RVS, WEAR_CAP_UM, WINDOW,
)
from condmon.operators.sequence import life_at_threshold
from condmon.operators.skew import exact_percentiles, oversized_groups
from condmon.session import stored
from condmon.physics.lines import TASK_ROWS, anchored_intercept, mid_life_lines

MIN_WINDOW = 3  # below this many mid-life rows the whole trajectory is fitted


def prepare(df: DataFrame, train_sets: Sequence[int] | None = None,
            excluded: Sequence[int] = EXCLUDED_SETS, by: str = "Set", t: str = "t", w: str = "wear") -> DataFrame:
    """Complete rows of the fitted sets."""
    rows = df.filter(F.col(by).isNotNull() & F.col(t).isNotNull() & F.col(w).isNotNull())
    if train_sets is not None:
        rows = rows.filter(F.col(by).isin(*train_sets))
    return rows.filter(~F.col(by).isin(*excluded)) if excluded else rows


def wear_rates(df: DataFrame, params: DataFrame, train_sets: Sequence[int] | None = None,
               failure_um: float = FAILURE_UM, by: str = "Set", t: str = "t", w: str = "wear",
               window: tuple[float, float] = WINDOW, min_rows: int = 4,
               excluded: Sequence[int] = EXCLUDED_SETS, caution: Sequence[int] = CAUTION_SETS,
               with_life: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """One record per set: robust mid-life rate, window, share of the failure level, caution flag.

    `params` holds one row per set (material, Vc, fz, ..); sets without one are left out.
    """
    rows = prepare(df, train_sets, excluded, by, t, w).join(params.select(by), by, "left_semi")
    lo, hi = window
    # big sets are found in the raw input, where only one column is read
    hot = oversized_groups(df.select(by), [by], task_rows)
    lines = mid_life_lines(rows, by, t, w, window, MIN_WINDOW, hot).filter(F.col("_n") >= min_rows)
    out = (
        lines.join(params, by)
        .withColumns({
            "frac_of_failure": F.col("max_wear_um") / failure_um,
            "slope_raw_um_per_pass": F.col("slope"),
            "slope_um_per_pass": F.greatest("slope", F.lit(0.0)),
            "slope_clamped": F.col("slope") < 0,
            "intercept_um": F.col("intercept"),
            "window_lo_id": lo * F.col("max_image_id"),
            "window_hi_id": hi * F.col("max_image_id"),
            "caution": F.col(by).isin(*caution) if caution else F.lit(False),
        }).drop("slope", "intercept", "_n")
    )
    if with_life:
        life = life_at_threshold(rows, by, t, w, failure_um).withColumnRenamed("life", "life_at_failure")
        out = out.join(life, by, "left")
    return out


def _literature(mat: Column) -> Column:
    return F.when(mat == CK45, LITERATURE_N[CK45]).otherwise(LITERATURE_N[RVS])


def _ols2(y: Column, a: Column, b: Column) -> list[Column]:
    """Aggregates for y ~ a + b."""
    return [F.covar_pop(a, a).alias("_aa"), F.covar_pop(b, b).alias("_bb"), F.covar_pop(a, b).alias("_ab"),
            F.covar_pop(y, a).alias("_ya"), F.covar_pop(y, b).alias("_yb"),
            F.avg(y).alias("_y"), F.avg(a).alias("_a"), F.avg(b).alias("_b")]


def _solve2() -> tuple[Column, Column]:
    """Coefficients from the aggregates; the minimum-norm solution when the design is singular."""
    aa, bb, ab, ya, yb = (F.col(c) for c in ("_aa", "_bb", "_ab", "_ya", "_yb"))
    det, trace = aa * bb - ab * ab, aa + bb
    regular = det > 1e-12 * trace * trace
    thin = trace > 1e-24
    first = F.when(regular, (bb * ya - ab * yb) / det).when(thin, (aa * ya + ab * yb) / (trace * trace)).otherwise(0.0)
    second = F.when(regular, (aa * yb - ab * ya) / det).when(thin, (ab * ya + bb * yb) / (trace * trace)).otherwise(0.0)
    return first, second


def tool_life_constants(rates: DataFrame, form: str = "simple", failure_um: float = FAILURE_UM,
                        min_rate: float = 1e-4, by: str = "material") -> DataFrame:
    """Constants of V*T^n = C (simple) or ln V = ln C - n ln T - m ln fz per material.

    `form` says what T is: 'simple' and 'rate_feed' take failure level over rate, 'life_feed' the
    observed life. Materials without enough records fall back to published values.
    """
    if form == "simple":
        return _simple_constants(rates, failure_um, min_rate, by)
    if form not in ("rate_feed", "life_feed"):
        raise ValueError(f"unknown form {form!r}")
    life = (F.when(F.col("slope_um_per_pass") > 0, failure_um / F.col("slope_um_per_pass"))
            if form == "rate_feed" else F.col("life_at_failure"))
    y, ln_t, ln_f = F.ln("Vc"), F.ln("_life"), F.ln("fz")
    usable = (F.col("_life") > 0) & (F.col("Vc") > 0) & (F.col("fz") > 0)
    recs = rates.withColumn("_life", life).filter(usable)
    fits = recs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_sets"), F.countDistinct(F.round("Vc", 3)).alias("n_distinct_vc"),
        *_ols2(y, ln_t, ln_f))
    coef_t, coef_f = _solve2()
    enough = F.coalesce(F.col("n_sets"), F.lit(0)) >= 2
    icpt = F.exp(F.col("_y") - coef_t * F.col("_a") - coef_f * F.col("_b"))
    return rates.select(by).distinct().join(fits, by, "left").select(
        by,
        F.when(enough, F.round(-coef_t, 4)).otherwise(0.25).alias("n"),
        F.when(enough, F.round(-coef_f, 4)).otherwise(0.50).alias("m"),
        F.when(enough, F.round(icpt, 4)).otherwise(300.0).alias("C"),
        F.coalesce("n_sets", F.lit(0)).alias("n_sets"),
        F.coalesce("n_distinct_vc", F.lit(0)).alias("n_distinct_vc"),
        F.when(enough, "localized_training_fit_90um" if form == "rate_feed" else f"life_at_{round(failure_um)}um_crossing")
        .otherwise("fallback").alias("source"))


def _simple_constants(rates: DataFrame, failure_um: float, min_rate: float, by: str) -> DataFrame:
    recs = rates.filter(F.col("slope_um_per_pass") > min_rate)
    ln_v, ln_t = F.ln("Vc"), F.ln(failure_um / F.col("slope_um_per_pass"))
    fits = recs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_sets"), F.countDistinct(F.round("Vc", 3)).alias("n_distinct_vc"),
        F.regr_slope(ln_t, ln_v).alias("_b"), F.regr_intercept(ln_t, ln_v).alias("_a"),
        F.regr_r2(ln_t, ln_v).alias("_r2"), F.regr_syy(ln_t, ln_v).alias("_syy"))
    mids = exact_percentiles(recs, [by], ["slope_um_per_pass", "Vc"], [.5]).select(
        by, F.col("slope_um_per_pass_q")[0].alias("_k"), F.col("Vc_q")[0].alias("_v"))
    n_sets, distinct = F.coalesce("n_sets", F.lit(0)), F.coalesce("n_distinct_vc", F.lit(0))
    designed = (n_sets >= 2) & (distinct >= 2)
    fitted = designed & (F.col("_b") < -1e-9)
    n_fit, n_lit = -1.0 / F.col("_b"), _literature(F.col(by))
    c_lit = F.col("_v") * F.pow(failure_um / F.col("_k"), n_lit)
    return rates.select(by).distinct().join(fits, by, "left").join(mids, by, "left").select(
        by,
        F.when(fitted, F.round(n_fit, 6)).otherwise(n_lit).alias("n"),
        F.round(F.when(fitted, F.exp(F.col("_a") * n_fit)).otherwise(c_lit), 4).alias("C"),
        F.when(fitted & (F.col("_syy") > 1e-12), F.round("_r2", 4)).alias("r2"),
        n_sets.alias("n_sets"), distinct.alias("n_distinct_vc"),
        F.when(fitted, "fitted").otherwise("literature_n").alias("source"),
        F.when(designed & ~fitted, F.format_string("regression slope b=%.4f >= 0 (non-physical)", "_b")).alias("note"))


def predict_life(rates: DataFrame, constants: DataFrame, form: str = "simple", failure_um: float = FAILURE_UM,
                 samples: DataFrame | None = None, by: str = "Set", t: str = "t", w: str = "wear",
                 window: tuple[float, float] = WINDOW, task_rows: int = TASK_ROWS) -> DataFrame:
    """Predicted life and rate per set; with samples, the intercept that fits this rate best."""
    cols = ["material", "n", "C"] + (["m"] if form != "simple" else [])
    joined = rates.join(constants.select(*cols), "material", "left")
    c, n, v = F.col("C"), F.col("n"), F.col("Vc")
    if form == "simple":
        life = F.when((c > 0) & (v > 0) & (n != 0), F.pow(c / v, 1.0 / n))
    else:
        log_t = (F.ln(c) - F.ln(v) - F.coalesce("m", F.lit(0.0)) * F.ln("fz")) / n
        life = F.when((c > 0) & (F.abs(n) > 1e-6), F.exp(log_t))
    sound = (life > 0) & (life < float("inf"))
    out = joined.withColumn("T_taylor", F.when(sound, life)).withColumn(
        "taylor_slope_um_per_pass", failure_um / F.col("T_taylor")).drop("n", "C", "m")
    if samples is None:
        return out
    hot = oversized_groups(samples.select(by), [by], task_rows)
    icpt = anchored_intercept(samples, by, t, w, out, "taylor_slope_um_per_pass", window, MIN_WINDOW,
                              "taylor_intercept_um", hot)
    return out.join(icpt, by, "left")


def log_design_rank(params: DataFrame, cols: Sequence[str] = ("Vc", "fz", "Ap"), by: str = "material") -> DataFrame:
    """Rank of the design [1, ln c1, ln c2, ..] per group, as its singular values tell it.

    Every task reduces its rows of a group to a small triangular factor; factors of all tasks are stacked and reduced
    again. That keeps the singular values, which sums of products would square.
    """
    size = len(cols) + 1
    logs = params.select(F.col(by).cast("string").alias("g"), *[F.ln(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])

    def factors(frames):
        held: dict = {}
        for frame in frames:
            for key, rows in frame.dropna(subset=list(frame.columns[1:])).groupby("g", dropna=False):
                design = np.column_stack([np.ones(len(rows)), rows.iloc[:, 1:].to_numpy(float)])
                n, r = held.get(key, (0, np.zeros((0, size))))
                held[key] = n + len(rows), np.linalg.qr(np.vstack([r, design]), mode="r")
        for key, (n, r) in held.items():
            yield pd.DataFrame({"g": [None if pd.isna(key) else key], "n": [n], "r": [r.ravel().tolist()]})

    @F.pandas_udf("int")
    def rank(r: pd.Series, n: pd.Series) -> pd.Series:
        def one(stacked, rows):
            s = np.linalg.svd(np.concatenate([np.asarray(x, float) for x in stacked]).reshape(-1, size), compute_uv=False)
            return int((s > s.max() * max(rows, size) * np.finfo(float).eps).sum())

        return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="int32")

    small = logs.mapInPandas(factors, "g string, n long, r array<double>")
    stacked = small.groupBy("g").agg(F.collect_list("r").alias("r"), F.sum("n").alias("n"))
    return stacked.select(F.col("g").alias(by), rank("r", "n").alias("rank"), F.lit(size).alias("full_rank"))


def fit_tool_life(labels: DataFrame, params: DataFrame, form: str = "simple", failure_um: float | None = None,
                  train_sets: Sequence[int] | None = FIT_SETS, cap_um: float = WEAR_CAP_UM, by: str = "Set", t: str = "t",
                  w: str = "wear") -> tuple[DataFrame, DataFrame, dict]:
    """Labels to constants in one call: (constants, sets with their predicted life, meta).

    Wear above `cap_um` counts as `cap_um`, and the sets of the published fit are used unless told otherwise. The results go to
    `write_constants` as they are.
    """
    level = failure_um if failure_um is not None else LIFE_FAILURE_UM if form == "life_feed" else FAILURE_UM
    capped = labels.withColumn(w, F.least(w, F.lit(float(cap_um))))
    rates = stored(wear_rates(capped, params, train_sets, level, by, t, w, with_life=form == "life_feed"), "rates")
    constants = stored(tool_life_constants(rates, form, level), "constants")
    sets = predict_life(rates, constants, form, level, prepare(capped, train_sets, by=by, t=t, w=w), by, t, w)
    meta = {"form": form, "failure_um": level, "wear_cap_um": cap_um, "window": WINDOW, "train_sets": train_sets or (),
            "excluded_sets": EXCLUDED_SETS, "caution_sets": CAUTION_SETS}
    return constants, sets, meta
