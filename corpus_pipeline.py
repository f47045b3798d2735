"""A corpus pipeline: toxic documents go, repeated lines go, near duplicates go, benchmark leaks go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their input.
NULL texts and ids pass through the stages as each operator's docstring says; extra columns are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from condmon.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from condmon.llm.common import free_name, prepare
from condmon.llm.queries import vocabulary
from condmon.session import stored

ORACLE_SQL = None  # tokenizing and learned scores are beyond SQL; tests compare with brute force


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is scored toxic go."""
    prepare(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    label, mark = free_name(docs, "_toxic"), free_name(docs, "_toxic_score")
    scored = toxicity.score(docs, model, score_col=mark, predicted_col=label)
    return scored.filter(F.col(label) == 0).drop(label, mark)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are taken out of the text."""
    prepare(spark)
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on word 5-grams the one with the smallest id stays; of repeated
    rows of that id the one with the smallest text, once. Documents without words all stay."""
    prepare(spark)
    return jaccard_join.representatives(docs, words=5, percent=80)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    n, spans, items = results = tuple(free_name(docs, c) for c in ("_words", "_hits", "_items"))
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), results=results)
    return found.filter(F.size(spans) == 0).drop(n, spans, items)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, one row per piece of a document."""
    prepare(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("near duplicates", near_duplicate_stage),
          ("decontamination", leak_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
