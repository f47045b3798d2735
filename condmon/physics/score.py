"""Predictions against the expected wear line, and the bounded correction around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from condmon.constants import (
    CAUTION_SETS, CAUTION_WEIGHT, CK45, EXCLUDED_SETS, FAILURE_UM, RVS, WEAR_DIVISOR, WINDOW,
)
from condmon.operators.lookup import attach_rates
from condmon.operators.skew import exact_percentiles


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def set_lines(sets: DataFrame, use_taylor: bool = False, constants: DataFrame | None = None,
              failure_um: float = FAILURE_UM, default_n: float = 0.25, default_c: float = 300.0) -> DataFrame:
    """Slope and intercept in use per set.

    Observed pair, or the tool-life pair where it is complete. With `constants` (extended form), the
    slope is the stored tool-life slope or is computed from the constants, and the
    intercept stays the observed one.
    """
    slope, icpt = F.col("slope_um_per_pass"), F.col("intercept_um")
    if use_taylor and constants is None:
        ready = (F.col("taylor_slope_um_per_pass") > 0) & F.col("taylor_intercept_um").isNotNull()
        slope = F.when(ready, F.col("taylor_slope_um_per_pass")).otherwise(slope)
        icpt = F.when(ready, F.col("taylor_intercept_um")).otherwise(icpt)
    elif use_taylor:
        sets = sets.join(constants.select("material", *[F.col(c).alias(f"_{c}") for c in ("n", "m", "C")]),
                         "material", "left")
        n, m = F.coalesce("_n", F.lit(default_n)), F.coalesce("_m", F.lit(0.0))
        log_t = (F.ln(F.coalesce("_C", F.lit(default_c))) - F.ln(F.coalesce("Vc", F.lit(174.0)))
                 - m * F.ln(F.coalesce("fz", F.lit(0.05)))) / n
        stored = F.col("taylor_slope_um_per_pass")
        slope = F.when(stored.isNotNull() & (stored != 0), stored).otherwise(failure_um / F.exp(log_t))
    return sets.withColumns({"line_slope": slope, "line_intercept": icpt}).drop("_n", "_m", "_C")


def expected_wear(df: DataFrame, sets: DataFrame, use_taylor: bool = False, failure_um: float = FAILURE_UM,
                  by: str = "Set", t: str = "t", constants: DataFrame | None = None) -> DataFrame:
    """Add expected_norm = clip(slope*t + intercept, 0, failure) / divisor; NULL for unknown sets."""
    lines = set_lines(sets, use_taylor, constants, failure_um).select(by, "line_slope", "line_intercept")
    um = clip(F.col("line_slope") * F.col(t) + F.col("line_intercept"), 0.0, failure_um)
    return df.join(lines, by, "left").withColumn("expected_norm", um / WEAR_DIVISOR).drop(
        "line_slope", "line_intercept")


def warmup_lambda(epoch: Column, lambda_max: float, warmup: int) -> Column:
    return F.lit(float(lambda_max)) * F.least(F.lit(1.0), (epoch + 1) / F.lit(float(max(1, warmup))))


def physics_score(preds: DataFrame, sets: DataFrame, lambda_max: float = 0.05, warmup: int = 4,
                  apply_to: str = "all", one_sided: bool = False, use_taylor: bool = False,
                  window: tuple[float, float] = WINDOW, failure_um: float = FAILURE_UM,
                  excluded: Sequence[int] = EXCLUDED_SETS, caution: Sequence[int] = CAUTION_SETS,
                  caution_weight: float = CAUTION_WEIGHT, keys: Sequence[str] = ("epoch",),
                  by: str = "Set", t: str = "t", pred: str = "pred_norm",
                  constants: DataFrame | None = None) -> DataFrame:
    """Weighted squared distance of predictions to the expected line, per key (epoch).

    Only rows of valid sets, of the chosen material, inside the mid-life window count; a key without such
    rows scores 0.
    """
    if apply_to not in ("all", "rvs", "ck45"):
        raise ValueError("apply_to must be 'all', 'rvs' or 'ck45'")
    if not 0.0 <= lambda_max <= 10.0:
        raise ValueError("lambda_max must be in [0, 10]")
    lo, hi = window
    if not 0.0 <= lo < hi <= 1.0:
        raise ValueError("window must satisfy 0 <= lo < hi <= 1")
    usable = sets if not excluded else sets.filter(~F.col(by).isin(*excluded))
    if apply_to != "all":
        usable = usable.filter(F.col("material") == (RVS if apply_to == "rvs" else CK45))
    lines = set_lines(usable, use_taylor, constants, failure_um).select(
        by, "line_slope", "line_intercept", "max_image_id")
    joined = preds.join(lines, by, "left")
    inside = F.coalesce(F.col(t).between(lo * F.col("max_image_id"), hi * F.col("max_image_id")), F.lit(False))
    expected = clip(F.col("line_slope") * F.col(t) + F.col("line_intercept"), 0.0, failure_um) / WEAR_DIVISOR
    gap = F.col(pred) - expected
    if one_sided:
        gap = F.greatest(gap, F.lit(0.0))
    weight = F.when(F.col(by).isin(*caution), caution_weight).otherwise(1.0) if caution else F.lit(1.0)
    scored = joined.groupBy(*keys).agg(
        F.sum(F.when(inside, weight * gap * gap)).alias("_num"), F.sum(F.when(inside, weight)).alias("_den"),
        F.count_if(inside).alias("n_rows"))
    epoch = F.col("epoch") if "epoch" in keys else F.lit(warmup)
    lam = warmup_lambda(epoch, lambda_max, warmup)
    loss = lam * F.coalesce(F.col("_num") / F.greatest("_den", F.lit(1e-12)), F.lit(0.0))
    return scored.select(*keys, "n_rows", lam.alias("lam"), loss.alias("physics_loss"))


def rate_table(params: DataFrame, constants: DataFrame, failure_um: float = FAILURE_UM, by: str = "Set") -> DataFrame:
    """Rate from speed alone: k = failure / (C/V)^(1/n); 0 where speed or constant is unusable."""
    joined = params.join(constants.select("material", "n", "C"), "material", "left")
    v, n, c = F.col("Vc"), F.col("n"), F.col("C")
    usable = (v > 0) & ~F.isnan(v) & c.isNotNull() & (n != 0)
    life = F.pow(c / v, 1.0 / n)
    return joined.select(by, "material", "Vc", F.when(usable & (life > 0), failure_um / life).otherwise(0.0).alias("k"))


def anchor_um(df: DataFrame, rates: DataFrame, failure_um: float = FAILURE_UM, by: str = "Set", t: str = "t") -> DataFrame:
    return attach_rates(df, rates, by).withColumn("anchor_um", clip(F.col("k") * F.col(t), 0.0, failure_um))


def bounded_prediction(df: DataFrame, rates: DataFrame, C_um: float, raw: str = "raw", failure_um: float = FAILURE_UM,
                       by: str = "Set", t: str = "t") -> DataFrame:
    """Anchor plus a correction that tanh keeps inside +-C_um."""
    anchored = anchor_um(df, rates, failure_um, by, t)
    corr = F.lit(float(C_um)) * F.tanh(raw)
    return anchored.withColumns({
        "correction_um": corr, "pred_norm": (F.col("anchor_um") + corr) / F.lit(WEAR_DIVISOR)})


def recommend_band(df: DataFrame, rates: DataFrame, train_sets: Sequence[int] | None = None, p: float = .95,
                   failure_um: float = FAILURE_UM, by: str = "Set", t: str = "t", w: str = "wear",
                   limit: int | None = None) -> DataFrame:
    """Band width: p-th percentile of |wear - anchor| over the training sets."""
    rows = df.filter(F.col(w).isNotNull() & F.col(by).isNotNull() & F.col(t).isNotNull())
    if train_sets is not None:
        rows = rows.filter(F.col(by).isin(*train_sets))
    resid = anchor_um(rows, rates, failure_um, by, t).select(F.abs(F.col(w) - F.col("anchor_um")).alias("_r"))
    q = exact_percentiles(resid, [], ["_r"], [p], **({} if limit is None else {"limit": limit}))
    return q.select(F.col("_r_q")[0].alias("band_um"))


def band_diagnostics(df: DataFrame, C_um: float, keys: Sequence[str] = ()) -> DataFrame:
    """Mean |correction| and share of rows beyond 95 % of the band."""
    size = F.abs("correction_um")
    return df.groupBy(*keys).agg(
        F.avg(size).alias("corr_abs_um"), F.avg((size > 0.95 * C_um).cast("double")).alias("sat_frac"),
        F.count(F.lit(1)).alias("n"))
