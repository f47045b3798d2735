"""Line dedup: a line that several documents hold stays only in the document with the smallest id.

Lines become 96-bit hashes of their keys. The hashes are range-partitioned with a secondary sort by document
and position, and first occurrences are found by streaming over each hash. Out come keep bitmaps per
document, never text. A hash that a great many documents hold is first cut by a salt of the document id: the first
round drops whatever is not first inside its salt, the second sees at most one document per salt.

Defined results:
* NULL or empty text is one empty line. Keys shorter than `min_chars` are always kept.
* Repeated rows of one id count as one document: they do not make a line repeated.
* A NULL id counts as one document that comes after all others.
* Other columns are ignored by `keep_bitmaps` and passed through by `apply_bitmaps`.
* An empty table gives no bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from condmon.llm.common import NO_TEXT, SPACES, free_name, lower_ascii, named, row_key, shuffle_partitions

WORD = 64  # lines per word of a bitmap


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(d, k, p, h, g): document id, row key, line position, and the two parts of the key's hash."""
    rows = named(docs, d=id_col, t=text_col)
    lines = rows.select("d", row_key("d", "t").alias("k"),
                        F.posexplode(F.split(F.coalesce("t", F.lit("")), "\n", -1)).alias("p", "line"))
    keys = lines.select("d", "k", "p", F.btrim("line", F.lit(SPACES)).alias("key"))
    keys = keys.filter(F.char_length("key") >= min_chars).withColumn("key", lower_ascii(F.col("key")))
    return keys.select("d", "k", "p", F.xxhash64("key").alias("h"), F.hash("key", F.lit(1)).alias("g"))


def _streamed(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Range-partition by hash, sort by document and position, and mark rows of later documents."""
    order = [F.col("d").asc_nulls_last(), F.col("k").asc(), F.col("p").asc()]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, *order)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("d").over(upto)
    return placed.withColumn("late", F.coalesce(first < F.col("d"), first.isNotNull() & F.col("d").isNull()))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(d, k, n_dropped, keep): one row per document that loses lines.

    `keep` is a compressed bitmap: an array of (word, bits) in order of word, where bit i of word w is line 64 w + i.
    Words whose lines all stay are left out.
    """
    parts = shuffle_partitions(docs.sparkSession)
    lines = hashed_lines(docs, id_col, text_col, min_chars)
    salted = lines.withColumn("s", F.pmod(F.xxhash64("d"), F.lit(parts)))
    inside = _streamed(salted, ["h", "g", "s"], parts)
    between = _streamed(inside.filter(~F.col("late")).drop("s", "late"), ["h", "g"], parts)
    dropped = (inside.filter("late").select("d", "k", "p")
               .unionByName(between.filter("late").select("d", "k", "p")))
    words = dropped.groupBy("d", "k", F.floor(F.col("p") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, p % {WORD})")).alias("lost"))
    return words.groupBy("d", "k").agg(
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"))


def kept_lines(text: Column, keep: Column) -> Column:
    """The lines a bitmap keeps, joined by newlines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    found = F.map_from_entries(keep)
    last = F.floor((F.size(lines) - 1) / WORD).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(found[w], F.lit(-1).cast("long")))

    def stays(bits: Column, i: Column) -> Column:
        word = F.element_at(bits, (F.floor(i / WORD) + 1).cast("int"))
        return F.getbit(word, (i % WORD).cast("int")) == 1

    # The bitmap is bound as an array element, so that it is expanded once per text.
    return F.element_at(F.transform(F.array(F.struct(dense.alias("bits"), lines.alias("lines"))), lambda b: F.array_join(
        F.filter(b["lines"], lambda line, i: stays(b["bits"], i)), "\n")), 1)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs with the kept text; untouched texts stay as they are, NULL included."""
    names = {c: free_name(docs, f"_line_{c}") for c in ("key", "d", "k", "n_dropped", "keep")}
    key, d, k, lost, keep = names.values()
    bits = bitmaps.select(*[F.col(c).alias(names[c]) for c in ("d", "k", "n_dropped", "keep")])
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.withColumn(key, F.xxhash64(doc_id, F.coalesce(text, F.lit(NO_TEXT))))
    joined = keyed.join(bits, (F.col(key) == F.col(k)) & doc_id.eqNullSafe(F.col(d)), "left")
    if n_lines:
        joined = joined.withColumn(n_lines, F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long"))
    if n_dropped:
        joined = joined.withColumn(n_dropped, F.coalesce(lost, F.lit(0)).cast("long"))
    new = F.when(F.col(keep).isNull(), text).otherwise(kept_lines(text, F.col(keep)))
    return joined.withColumn(text_col, new).drop(*names.values())
