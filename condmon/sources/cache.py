"""Feature table that grows: only recordings it does not hold yet are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

REC = "recording_id"


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything else must not lead to overwriting what is there
            raise
        return None


def cached_features(recordings: DataFrame, path: str, version: str,
                    extract: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Features of every recording, read from `path`/`version` where already stored.

    Missing recordings are found with an anti join on the id and appended, so nothing already
    stored is computed again. `force` recomputes all of them.
    """
    spark, where = recordings.sparkSession, f"{path}/{version}"
    stored = None if force else _existing(spark, where)
    if stored is None:
        extract(recordings).write.mode("overwrite").parquet(where)
    else:
        todo = recordings.join(stored.select(REC), REC, "left_anti")
        if not todo.isEmpty():
            extract(todo).write.mode("append").parquet(where)
    ids = recordings.select(REC).distinct()
    return spark.read.parquet(where).join(ids, REC, "left_semi")
