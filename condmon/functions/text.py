"""Column functions that clean labels and process parameters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from condmon.constants import TYPE_MAP


def normalise_path(path: Column) -> Column:
    """Drop the dataset prefix and double the leading set folder."""
    bare = F.regexp_replace(path, r"^MATWI[\\/]", "")
    return F.regexp_replace(bare, r"^(Set\d+)[\\/]", "$1/$1/")


def canonical_type(raw: Column, type_map: dict[str, str] = TYPE_MAP) -> Column:
    """Lower-case, underscore, then synonyms; a missing type becomes the text 'nan'."""
    key = F.replace(F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit("nan")))), F.lit(" "), F.lit("_"))
    synonyms = F.create_map(*[F.lit(x) for x in chain(*type_map.items())])
    return F.coalesce(F.try_element_at(synonyms, key), key)


def to_number(raw: Column) -> Column:
    """Number or NULL; textual NaN counts as missing so that averages skip it."""
    value = F.trim(raw.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_ts(raw: Column) -> Column:
    return F.try_to_timestamp(raw.cast("string"))


def parse_param(cell: Column, mode: str = "mean") -> Column:
    """Parameter cell: '?' and blanks are NULL; 'a/b' is the mean of its numbers, or NULL in mode 'null'."""
    if mode == "null":
        return to_number(cell)
    if mode != "mean":
        raise ValueError(f"mode must be 'mean' or 'null', got {mode!r}")
    parts = F.filter(
        F.transform(F.split(cell.cast("string"), "/"), lambda p: to_number(p)),
        lambda v: v.isNotNull(),
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(parts) > 0, total / F.size(parts))


def set_number(label: Column) -> Column:
    """First run of digits in a label such as 'Set 12'."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


def is_rvs(material: Column) -> Column:
    return F.coalesce(F.upper(F.trim(material)).contains("RVS"), F.lit(False)).cast("double")


def name_matches(name: Column, pattern: str) -> Column:
    return F.coalesce(name.rlike(pattern), F.lit(False))
