"""Column functions over cleaned labels: material, split, bins, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from condmon.constants import (
    CK45, DEFAULT_SPLIT, LAST_CK45_SET, RVS, SPLITS, STEP_SECONDS, WEAR_CAP_UM, WEAR_DIVISOR,
)


def material(set_id: Column, rvs: str = RVS) -> Column:
    return F.when(set_id <= LAST_CK45_SET, CK45).when(set_id.isNotNull(), rvs)


def split_label(set_id: Column, splits: dict = SPLITS, default: str = DEFAULT_SPLIT) -> Column:
    out = F.lit(default)
    for name, members in reversed(list(splits.items())):
        out = F.when(set_id.isin(*members), name).otherwise(out)
    return out


def bin_right_open(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open bin [edge, next edge); NULL outside all bins."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one more edge than labels is needed")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return out


def sample_time(pos: Column, step: float = STEP_SECONDS) -> Column:
    return pos * F.lit(step)


def normalise_wear(wear: Column, divisor: float = WEAR_DIVISOR) -> Column:
    return wear / F.lit(divisor)


def to_um(pred: Column, divisor: float = WEAR_DIVISOR, cap: float = WEAR_CAP_UM) -> Column:
    """Decode a normalised prediction to micrometres inside [0, cap]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), pred * F.lit(divisor)))
