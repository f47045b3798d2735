"""Registry of checked queries: a Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from condmon.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def nudge_of(digits: int) -> float:
    return 1.37 * 10.0 ** -(digits + 3)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded (and minus zero made zero) so that both engines compare equal.

    A nudge far below the last digit keeps exact halves from rounding differently.
    """
    nudge = nudge_of(digits)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float"):
            c = F.round(c.cast("double") + nudge, digits) + 0.0
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, dbl: str = "", digits: int = 6):
    """Register fn(spark, sf_dir); `dbl` lists the double columns of the oracle."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return rounded(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            cells = ", ".join(f'round({c} + {nudge_of(digits)!r}::DOUBLE, {digits}) + 0.0 AS {c}' for c in dbl.split())
            ORACLES[name] = f"SELECT * REPLACE ({cells}) FROM ({sql})" if cells else sql
        return fn
    return wrap
