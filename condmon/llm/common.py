"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from condmon.session import tune

# The ASCII white space that separates words and pads lines.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NO_TEXT = "\x00null"  # hashed in place of a NULL text

BATCH_ROWS = 256  # texts handed to a Python task at a time


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, since one text can be very long, and shuffle files that
    go when the job that wrote them has ended, since steps meet in stored tables."""
    tune(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(df: DataFrame, **cols: str) -> DataFrame:
    """Only the columns an operator works on, under its own names; all other columns are left out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def row_key(doc_id: str, text: str) -> Column:
    """Tells apart the rows of one id that have different texts; equal rows share it, and their results."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(NO_TEXT)))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str | T.StructType,
             flush: int = 2048) -> DataFrame:
    """Stream rows through Python: make() is called once per task and gives rows -> output tuples.

    The inner function gets an iterator of row dicts, and yields tuples in the order of `schema`. Output leaves in
    batches of at most `flush` rows or about 16 MB of text and bytes.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        held, weight = [], 0
        for row in make()(rows()):
            held.append(row)
            weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= flush or weight > 1 << 24:
                yield batch_of(held, arrow)
                held, weight = [], 0
        if held:
            yield batch_of(held, arrow)
        held = row = None
        give_back()

    return df.mapInArrow(run, out)


def give_back() -> None:
    """What a task has freed goes back to the system, because its Python worker stays and the next task may run in another."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def batch_of(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
