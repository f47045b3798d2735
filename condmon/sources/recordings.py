"""Sensor recordings: one headerless CSV per pass, file order is time order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from condmon.constants import CHANNELS
from condmon.session import stored


FILE_STEM = r"([^/]+)\.[^./]*$"


def fixed_folder(glob: str) -> str:
    """The folders of a path before its first wildcard; the folder itself for a path without one."""
    head = re.split(r"[*?\[{]", glob, maxsplit=1)[0]
    if head != glob:
        return head.rpartition("/")[0]
    return glob.rstrip("/") if "." not in glob.rpartition("/")[2] else glob.rpartition("/")[0]


def read_recordings(spark: SparkSession, glob: str, channels: Sequence[str] = CHANNELS,
                    id_pattern: str | None = None) -> DataFrame:
    """(recording_id, pos, channels.., ts); `pos` is the row number in the file.

    The id is the path below the folders that `glob` names in full, or what `id_pattern` (such as FILE_STEM) takes from
    the path. A file with a line that is no recording row (text, too few or too many cells), and one that cannot be read, is
    left out as a whole, so that `zero_fill_features` marks it as missing.

    With very many files, name their folders (`runs/*`) rather than the files: Spark lists folders in tasks, but looks up
    every file that a glob names one after another.

    A file may span many scan splits. Rows keep their place inside a split, and each split
    adds the number of rows in the earlier splits of its file, so no file is ever sorted or
    gathered in one task. The scan is stored once, in columns, because split numbering must not
    change between the two uses.
    """
    schema = ", ".join([f"`{c}` float" for c in channels] + ["ts timestamp", "_bad string"])
    scan = (
        spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad").option("ignoreCorruptFiles", True).csv(glob)
        .select("*", F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_row"))
    )
    kept = stored(scan, "recordings")
    blocks = kept.groupBy("_file", "_start").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.count("_bad").alias("_wrong"))
    file = Window.partitionBy("_file")
    earlier = file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_start", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_wrong").over(file).alias("_in_file")).filter(F.col("_in_file") == 0).drop("_in_file")
    path = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    if id_pattern is None:
        bare = fixed_folder(glob).split(":", 1)[-1].lstrip("/")
        id_pattern = "^[^:]*:/*" + re.escape(bare) + "/(.*)$"
    return kept.join(offsets, ["_file", "_start"]).select(
        F.regexp_extract(path, id_pattern, 1).alias("recording_id"),
        (F.col("_row") + F.col("_shift")).alias("pos"),
        *[F.col(c).cast("double").alias(c) for c in channels],
        "ts",
    )


def file_listing(spark: SparkSession, glob: str, root: str = "") -> DataFrame:
    """(path, length) of every file; contents are never read. `root` is cut from the path."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
             .select("path", "length"))
    if root:
        files = files.withColumn("path", F.substring_index("path", root.rstrip("/") + "/", -1))
    return files


def check_files(refs: DataFrame, listing: DataFrame, path_col: str) -> DataFrame:
    """One row: how many references there are, and how many point to a listed file."""
    wanted = refs.filter(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"))
    known = listing.select("path").distinct().withColumn("_seen", F.lit(1))
    return wanted.join(known, "path", "left").agg(
        F.count(F.lit(1)).alias("referenced"), F.count("_seen").alias("found"),
        (F.count(F.lit(1)) - F.count("_seen")).alias("missing"))


def existing_refs(refs: DataFrame, listing: DataFrame, path_col: str, missing: bool = False) -> DataFrame:
    """Rows whose file is listed (or, with `missing`, is not)."""
    files = listing.select(F.col("path").alias(path_col))
    return refs.join(files, path_col, "left_anti" if missing else "left_semi")
