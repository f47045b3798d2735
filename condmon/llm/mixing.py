"""Mixing sources to target weights by a low-discrepancy schedule.

The mix has as many words as the documents. Every source gets a share by weight, but no more than `most` times its own
words; what is cut off goes to the others by weight. A source's words, in an order shuffled by a digest of the id and repeated
as often as needed, are cut into blocks of `block` words (the last one ends at the target). The blocks of all sources lie
side by side on a line of M slots, in cumulative order, and the van der Corput sequence (the bits of 0, 1, 2, .. reversed) visits the
slots: the k-th point belongs to the source in whose part it falls, and takes that source's next block. Points beyond M are passed
over, so that every source gets exactly its number of slots, spread evenly over the mix.

How many earlier points fall below a bound has a closed form in the bits of the bound, so neither the rank of a slot in
its source nor its position in the mix needs a sort or a shuffle. Words are laid out by prefix sums in two levels: buckets of the
digest inside a source, then documents inside a bucket; no source meets in one task. Only lengths travel, never texts.

Defined results:
* NULL or empty text has size 0 and is never taken. Without any words all targets are 0.
* A NULL source is a source of its own and comes last. Repeated rows are rows of their own. A NULL id takes part; ids repeated
  very often share a bucket.
* Other columns are ignored, names may clash. Reruns give the same mix, whatever the partitions.
* The list of sources, one row each, is ranked in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from condmon.llm.common import named, shuffle_partitions
from condmon.session import stored

CHUNK = 4096  # slots that one row of the slot table is unfolded into at a time


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, name, unnamed, size, digest) per row; `unnamed` marks a NULL source."""
    rows = named(docs, d=id_col, t=text_col, s=source_col)
    source = F.col("s").cast("string")
    return rows.select(
        F.col("d").alias("doc_id"), F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("unnamed"),
        F.coalesce(F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("d").cast("string"), F.lit(""))).alias("digest"))


def source_targets(totals: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(nth, name, unnamed, source_size, docs, weight, target) from (name, unnamed, source_size, docs).

    Sources that reach `most` times their size come first in the order of that cap per weight; each is held against what would be
    a weight's worth if all before it were capped.
    """
    everything = Window.orderBy("unnamed", "name")
    cycle = F.array(*map(F.lit, weights))
    ranked = totals.withColumn("nth", F.row_number().over(everything) - 1)
    ranked = ranked.withColumns({
        "weight": F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int")).cast("long"), "cap": most * F.col("source_size")})
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "all": F.sum("source_size").over(whole), "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(steps.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    full = F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("all") - F.col("capped_before"))
    ranked = ranked.withColumn("full", full)
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    share = F.col("weight") * rest / F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return ranked.select("nth", "name", "unnamed", "source_size", "docs", "weight",
                         F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def reversed_bits(v: str, bits: int) -> str:
    """SQL for the lowest `bits` bits of v in reverse."""
    return " + ".join(f"shiftleft(shiftright({v}, {i}) & 1L, {bits - 1 - i})" for i in range(bits))


def points_below(k: str, reversed_bound: str, bits: int) -> str:
    """SQL for the number of j < k whose reversed bits are below a bound, given the bound with its bits reversed.

    For each set bit of the bound, counted from the highest, the numbers that agree with it above that bit and have 0 there
    are those j of one residue class of a power of two.
    """
    return " + ".join(
        f"(shiftright({reversed_bound}, {i}) & 1L) * shiftright({k} + {2 ** (i + 1) - 1}L - ({reversed_bound} & {2 ** i - 1}L), {i + 1})"
        for i in range(bits))


def slot_table(sources: DataFrame, slots: int, parts: int) -> DataFrame:
    """(nth, block, position): the place in the mix of every block of every source, from (nth, blocks, first_slot)."""
    bits = max(1, int(slots).bit_length())
    bounds = sources.filter("blocks > 0").select(
        "nth", "blocks", "first_slot", F.expr(reversed_bits("first_slot", bits)).alias("low"),
        F.expr(reversed_bits("(first_slot + blocks)", bits)).alias("high"))
    chunks = bounds.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / CHUNK))))
    chunks = chunks.repartition(parts, "nth", "chunk")
    points = chunks.withColumn("i", F.expr(
        f"explode(sequence(chunk * {CHUNK}, least(blocks, (chunk + 1) * {CHUNK}) - 1))"))
    points = points.withColumn("k", F.expr(reversed_bits("(first_slot + i)", bits)))
    end = int(format(slots, f"0{bits}b")[::-1], 2)
    return points.select(
        "nth", F.expr(f"({points_below('k', 'high', bits)}) - ({points_below('k', 'low', bits)})").alias("block"),
        F.expr(points_below("k", f"{end}L", bits)).alias("position"))


@dataclass(frozen=True)
class Mix:
    """`rows`: (nth, bucket, place, doc_id, size, source_size, target), one per document.
    `pieces`: (position, at, nth, bucket, place, doc_id, start, words): what the mix holds, in order of (position, at)."""

    rows: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """rows with the number of words the mix takes of each."""
        kept = ("nth", "bucket", "place")
        words = self.rows.select(*kept, "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("words")).unionByName(
            self.pieces.select(*kept, *[F.lit(None).alias(c) for c in ("doc_id", "size", "source_size", "target")], "words"))
        return words.groupBy(*kept).agg(*[F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
                                        F.sum("words").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", most: int = 3, block: int = 4096) -> Mix:
    """The mix of `docs`. Weights are dealt to the sources in code point order, in turn."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    totals = sized.groupBy("name", "unnamed").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = source_targets(totals, weights, most)
    words = F.least(most * F.col("source_size"), F.floor(F.col("target") + 0.5)).alias("words")
    sources = sources.select("*", words).withColumn("blocks", F.ceil(F.col("words") / block))
    upto = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    sources = stored(sources.withColumn("first_slot", F.coalesce(F.sum("blocks").over(upto), F.lit(0).cast("long"))), "sources")
    whole = sources.agg(F.sum("blocks").alias("slots"), F.sum("docs").alias("docs")).first()
    # As many buckets as there are documents in one.
    bits = math.ceil(math.log2(max(1, whole["docs"] or 0)) / 2)
    bucket = F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - bits)
    placed = sized.withColumn("bucket", bucket)
    key = ["name", "unnamed", "bucket"]
    sums = placed.groupBy(*key).agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("name", "unnamed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0).cast("long"))).drop("held")
    starts = stored(starts.join(sources.select("name", "unnamed", "nth", "source_size", "target", "words"), ["name", "unnamed"]), "buckets")
    inside = Window.partitionBy(*key).orderBy("digest", "doc_id", "size")
    rows = placed.join(starts, key).select(
        "nth", "bucket", F.row_number().over(inside).alias("place"), "doc_id", "size", "source_size", "target", "words",
        (F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("offset"))
    rows = stored(rows, "layout")
    # Every time a document comes round it fills the words from `begin` to `end` of its source's part.
    rounds = rows.filter("size > 0").withColumn("begin", F.expr(f"explode(transform(sequence(0, {most} - 1), e -> e * source_size + offset))"))
    rounds = rounds.filter("begin < words").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    blocks = rounds.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest(F.col("begin"), F.col("block") * block)
    pieces = blocks.select("nth", "block", "bucket", "place", "doc_id", (first - F.col("begin")).alias("start"),
                           (F.least(F.col("end"), (F.col("block") + 1) * block) - first).alias("words"), (first % block).alias("at"))
    slots = slot_table(sources.select("nth", "blocks", "first_slot"), int(whole["slots"] or 0), parts)
    pieces = pieces.join(slots, ["nth", "block"]).select("position", "at", "nth", "bucket", "place", "doc_id", "start", "words")
    return Mix(rows.drop("words", "offset"), pieces)
