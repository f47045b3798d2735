"""Phrase collocation mining by Rabin-Karp fingerprints.

Words and runs of words get 64-bit fingerprints from prefix polynomials in numpy: one over the bytes gives all words, one
over the words gives all runs of a length. Texts are read four times and never shuffled:

1. Pairs of words: every task counts its distinct fingerprints, the shuffle adds them up. Nothing longer can be frequent
   unless its pairs are.
2. Triples both of whose pairs may be frequent, in the same way. Nothing longer can be frequent unless its triples are, and most runs
   of frequent pairs are not.
3. Frequent pairs, their words, and runs of up to `longest` words all of whose triples may be frequent: fingerprints with counts and a pointer
   (document, byte) to an occurrence. Inside a chunk, occurrences that share a fingerprint are compared with the text at its pointer, and counted
   apart where they differ; between chunks a second fingerprint from other polynomials tells them apart (together 128 bits). This
   leaves out nearly all long runs, which are nearly all rare.
4. Where a pointer of a frequent run leads, its text is read, its fingerprints are checked, and it leaves as a phrase: one row each. Words
   of frequent pairs are counted by their text.

Steps 2 and 3 run in at most TASKS_PER_CORE tasks for each core: runs that come again in a task leave it once, so fewer and larger tasks send fewer
rows. What a task holds is bounded by HELD, whatever it reads.

Which fingerprints may be frequent reaches the tasks as a bit filter of at most FILTER_BITS (32 MB). A filter that fills up lets more
through and changes no result.

A phrase is scored by its weakest cut, floor(1000 a n / (l r)) with exact decimals. A phrase goes when a longer candidate
holds it and is as frequent, so that it never stands alone.

Defined results:
* NULL or empty text has no words. A NULL lang is `und`, together with a lang of that name.
* Repeated rows and NULL ids count like any other row. Texts of any length are read in chunks of about CHUNK bytes that overlap by
  `longest` - 1 words; only a single word longer than that is held whole.
* Ties in the ranking go to the more frequent phrase, then to the smaller one in byte order.
* Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from condmon.llm.common import named, shuffle_partitions
from condmon.session import stored

CHUNK = 1 << 20
HELD = 1 << 21                # distinct fingerprints a task holds before it lets them go
HELD_PHRASES = 1 << 17
TASKS_PER_CORE = 2
FILTER_BITS = 1 << 28
NO_LANG = "und"

# Which bytes part words and which part pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")
_PART = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")

# odd, so that they have inverses modulo 2^64; the second pair makes a second fingerprint, from other prefix polynomials
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BYTE_BASE_2, WORD_BASE_2 = 0x165667B19E3779F9, 0xA0761D6478BD642F


@lru_cache(8)
def _powers(base: int, room: int) -> np.ndarray:
    out = np.full(room, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64."""
    return _powers(base, 1 << max(16, int(n).bit_length()))[:n]


def prefix_polynomial(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[j] * base^j over all prefixes, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of each span, shifted to begin at exponent 0."""
    back = powers(pow(base, -1, 1 << 64), len(sums))
    return (sums[end] - sums[start]) * back[start]


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


@lru_cache(4096)
def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Chunk:
    """Words of a few short texts, or of a part of a long one, with the fingerprints of all their runs."""

    def __init__(self, data: bytes, firsts: list[int], docs: list, hashes: list[int], langs: list[str], base: int = 0,
                 limit: int | None = None, bits: int = 64):
        self.raw = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _KIND[self.raw]
        edges = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        self.doc = np.searchsorted(np.array(firsts), self.start, "right") - 1
        self.firsts, self.docs, self.hashes, self.langs, self.base = np.array(firsts), docs, np.array(hashes, np.int64), langs, base
        self.starts_here = int(np.searchsorted(self.start, len(data) if limit is None else limit))
        self.mask = np.uint64((1 << bits) - 1)
        sums = prefix_polynomial(self.raw.astype(np.uint64) + np.uint64(1), BYTE_BASE)
        self.word = mixed(spans_hash(sums, self.start, self.end, BYTE_BASE)) & self.mask
        self.sums, self.sums_2 = prefix_polynomial(self.word, WORD_BASE), None
        names, number = np.unique(langs, return_inverse=True)
        self.lang = number[self.doc]
        self.salt = np.array([lang_hash(str(g)) for g in names], np.uint64)[self.lang]

    def runs(self, k: int, beyond: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of all runs of k words inside a piece; `beyond`: those of the next chunk's first words as well."""
        at = np.arange(max(0, min(len(self.start) if beyond else self.starts_here, len(self.start) - k + 1)))
        at = at[self.piece[at] == self.piece[at + k - 1]]
        value = spans_hash(self.sums, at, at + k, WORD_BASE) + np.uint64(k)
        return at, mixed(value ^ self.salt[at]) & self.mask

    def checks(self, k: int, at: np.ndarray) -> np.ndarray:
        """Second fingerprints of runs, always of 64 bits."""
        if self.sums_2 is None:
            sums = prefix_polynomial(self.raw.astype(np.uint64) + np.uint64(1), BYTE_BASE_2)
            self.sums_2 = prefix_polynomial(mixed(spans_hash(sums, self.start, self.end, BYTE_BASE_2)), WORD_BASE_2)
        return mixed((spans_hash(self.sums_2, at, at + k, WORD_BASE_2) + np.uint64(k)) ^ self.salt[at])

    def ids(self) -> np.ndarray:
        """A number per word, equal for equal words only: those with one fingerprint are compared with the first of them."""
        _, first, group = np.unique(self.word, return_index=True, return_inverse=True)
        size, there = self.end - self.start, first[group]
        same = size == size[there]
        n = np.where(same, size, 0)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = self.raw[np.repeat(self.start, n) + step] != self.raw[np.repeat(self.start[there], n) + step]
        same[np.repeat(np.arange(len(n)), n)[differ]] = False
        if not same.all():
            known: dict[tuple, int] = {}
            group = group.copy()
            for i in np.flatnonzero(~same):
                group[i] = known.setdefault((self.word[i], self.raw[self.start[i]:self.end[i]].tobytes()), len(first) + len(known))
        return group

    def text(self, i: int, k: int) -> str:
        words = (self.raw[self.start[j]:self.end[j]].tobytes() for j in range(i, i + k))
        return b" ".join(words).decode("utf-8", "replace")

    def places(self, at: np.ndarray) -> np.ndarray:
        """Bytes of the text before each word."""
        return self.base + self.start[at] - self.firsts[self.doc[at]]

    def marks(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """One number for fingerprint, document and place."""
        where = self.places(at).astype(np.uint64) * np.uint64(BYTE_BASE) ^ self.hashes[self.doc[at]].view(np.uint64)
        return mixed(mixed(where) + fp)


def chunks(batches, longest: int, bits: int) -> Iterator[Chunk]:
    """Chunks of the texts in batches of (d, h, t, g)."""
    parts, firsts, whose, size = [], [], [], 0
    for batch in batches:
        texts = batch.column("t").cast(pa.binary())
        for d, h, text, lang in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), texts, batch.column("g").to_pylist()):
            data, lang = text.as_py(), NO_LANG if lang is None else lang
            if not data:
                continue
            if len(data) > CHUNK:
                yield from long_chunks(data, d, h, lang, longest, bits)
                continue
            parts.append(data)
            firsts.append(size)
            whose.append((d, h, lang))
            size += len(data) + 1
            if size >= CHUNK:
                yield Chunk(b"\n".join(parts), firsts, *map(list, zip(*whose)), bits=bits)
                parts, firsts, whose, size = [], [], [], 0
    if parts:
        yield Chunk(b"\n".join(parts), firsts, *map(list, zip(*whose)), bits=bits)


def long_chunks(data: bytes, doc, h: int, lang: str, longest: int, bits: int) -> Iterator[Chunk]:
    begin = 0
    while begin < len(data):
        found = _PART.search(data, begin + CHUNK)
        cut = found.start() if found else len(data)
        end = max((m.end() for m in islice(_WORD.finditer(data, cut), longest - 1)), default=cut)
        yield Chunk(data[begin:end], [0], [doc], [h], [lang], begin, cut - begin, bits)
        begin = cut


class BitFilter:
    """Two bits per fingerprint in a field of a power of two."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, found: DataFrame, most: int = FILTER_BITS) -> BitFilter:
        size = 1 << min(int(most).bit_length() - 1, max(16, math.ceil(math.log2(64 * found.count() + 1))))
        fp = F.col("fp")
        places = F.array(fp.bitwiseAND(size - 1), F.shiftrightunsigned(fp, 32).bitwiseAND(size - 1))
        rows = found.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        table = rows.toArrow()  # no more than size / 64 rows
        words = np.zeros(size // 64, np.uint64)
        words[table["w"].to_numpy()] = table["b"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, fp: np.ndarray) -> np.ndarray:
        out = np.ones(len(fp), bool)
        for p in (fp & self.mask, (fp >> np.uint64(32)) & self.mask):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
        return out


def combined(fps: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints and their added counts."""
    fp, count = np.concatenate(fps), np.concatenate(counts)
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    new = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    return fp[new], np.add.reduceat(count[order], new)


def in_large_tasks(rows: DataFrame) -> DataFrame:
    """rows in at most TASKS_PER_CORE tasks for each core, unless the number of cores may change."""
    spark = rows.sparkSession
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return rows
    return rows.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def run_totals(rows: DataFrame, k: int, longest: int, bits: int, pairs=None) -> DataFrame:
    """(fp, c): counts of runs of k words per task, of all or of those whose pairs may be frequent; few fingerprints come twice from one task."""
    out = T._parse_datatype_string("fp long, c long")
    arrow = to_arrow_schema(out)

    def run(batches):
        fps, counts, held = [], [], 0
        for chunk in chunks(batches, longest, bits):
            at, fp = chunk.runs(k)
            if pairs is not None:
                fp = fp[all_pass(chunk, 2, pairs.value)(at, k)]
            fp, n = np.unique(fp, return_counts=True)
            fps.append(fp)
            counts.append(n)
            held += len(fp)
            if held >= HELD:
                fp, n = combined(fps, counts)
                fps, counts, held = [fp], [n], len(fp)
                if held >= HELD // 2:
                    yield from sent(fp, n)
                    fps, counts, held = [], [], 0
        if held:
            yield from sent(*combined(fps, counts))

    def sent(fp, n):
        for i in range(0, len(fp), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(fp[part].view(np.int64)), pa.array(n[part], pa.int64())], schema=arrow)

    return rows.mapInArrow(run, out)


def all_pass(chunk: Chunk, size: int, known: BitFilter) -> Callable[[np.ndarray, int], np.ndarray]:
    """Which runs of k words from the given first words hold only runs of `size` words that pass."""
    at, fp = chunk.runs(size, beyond=True)
    good = np.zeros(len(chunk.start) + 1, bool)
    good[at[known.has(fp)]] = True

    def keep(at: np.ndarray, k: int) -> np.ndarray:
        out = np.ones(len(at), bool)
        for j in range(k - size + 1):
            out &= good[at + j]
        return out
    return keep


def frequent_runs(chunk: Chunk, pairs: BitFilter, triples: BitFilter, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first word, fingerprint) of pairs that pass, of the words in them, and of longer runs whose pairs and triples all pass."""
    by_pairs = all_pass(chunk, 2, pairs)
    good = by_pairs(np.arange(len(chunk.start)), 2)
    good[1:] |= good[:-1].copy()
    at, fp = chunk.runs(1)
    yield 1, at[good[at]], fp[good[at]]
    by_triples = all_pass(chunk, 3, triples)
    for k in range(2, longest + 1):
        at, fp = chunk.runs(k)
        keep = by_pairs(at, k)
        if k > 2:
            keep &= by_triples(at, k)
        yield k, at[keep], fp[keep]


def exact_groups(chunk: Chunk, ids: np.ndarray, k: int, at: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first word of the first occurrence, count) of each distinct text among runs, compared word by word."""
    if not len(at):
        return
    order = np.argsort(fp, kind="stable")
    at, fp = at[order], fp[order]
    new = np.concatenate(([True], fp[1:] != fp[:-1]))
    first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = chunk.lang[at] == chunk.lang[first]
    for j in range(k):
        same &= ids[at + j] == ids[first + j]
    yield from zip(at[new].tolist(), np.add.reduceat(same.astype(np.int64), np.flatnonzero(new)).tolist())
    others: dict[tuple, list[int]] = {}
    for i in at[~same].tolist():
        others.setdefault((chunk.lang[i], *ids[i:i + k]), []).append(i)
    for places in others.values():
        yield places[0], len(places)


def run_counts(rows: DataFrame, pairs, triples, longest: int, bits: int, id_type: str) -> DataFrame:
    """(fp, chk, c, doc, at, mark): counts of frequent pairs, of their words and of longer runs made of them.

    Occurrences that share a fingerprint in a chunk are compared word by word with the first, to which doc and at point; those that
    differ are counted apart. `chk` tells them apart between chunks.
    """
    out = (T.StructType().add("fp", "long").add("chk", "long").add("c", "long").add("doc", id_type).add("at", "long").add("mark", "long"))
    arrow = to_arrow_schema(out)

    def run(batches):
        held, size = [], 0
        for chunk in chunks(batches, longest, bits):
            docs, ids = pa.array(chunk.docs, arrow.field("doc").type), chunk.ids()
            for k, at, fp in frequent_runs(chunk, pairs.value, triples.value, longest):
                if len(fp):
                    first, n = (np.array(x) for x in zip(*exact_groups(chunk, ids, k, at, fp)))
                    fp = fp[np.searchsorted(at, first)]
                    held.append((fp, chunk.checks(k, first), n, docs.take(pa.array(chunk.doc[first])), chunk.places(first), chunk.marks(first, fp)))
                    size += len(fp)
            if size >= HELD:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def sent(held):
        fp, chk, n, places, marks = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4, 5))
        order = np.lexsort((chk, fp))
        new = np.flatnonzero(np.concatenate(([True], (fp[order][1:] != fp[order][:-1]) | (chk[order][1:] != chk[order][:-1]))))
        n, first = np.add.reduceat(n[order], new), order[new]
        docs = pa.concat_arrays([h[3] for h in held])
        for i in range(0, len(first), 1 << 16):
            part = first[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array(fp[part].view(np.int64)), pa.array(chk[part].view(np.int64)), pa.array(n[i:i + (1 << 16)]), docs.take(pa.array(part)),
                pa.array(places[part]), pa.array(marks[part].view(np.int64))], schema=arrow)

    return rows.mapInArrow(run, out)


def phrase_texts(rows: DataFrame, pairs, triples, wanted, pointers, longest: int, bits: int) -> DataFrame:
    """(lang, phrase, size, c, fp, chk): the texts that pointers lead to, with both fingerprints as read there; counts of the
    words that frequent pairs may hold; and a row without phrase for the words in all."""
    out = T._parse_datatype_string("lang string, phrase string, size int, c long, fp long, chk long")
    arrow = to_arrow_schema(out)

    def run(batches):
        held: dict[tuple, int] = {}
        for chunk in chunks(batches, longest, bits):
            if not len(chunk.start):
                continue
            per_doc = np.bincount(chunk.doc[:chunk.starts_here], minlength=len(chunk.docs))
            for lang, n in zip(chunk.langs, per_doc.tolist()):
                held[lang, None, 0] = held.get((lang, None, 0), 0) + n
            at, fp = chunk.runs(1)
            keep = wanted.value.has(fp)
            for i, n in exact_groups(chunk, chunk.ids(), 1, at[keep], fp[keep]):
                key = (chunk.langs[chunk.doc[i]], chunk.text(i, 1), 1)
                held[key] = held.get(key, 0) + n
            for k, at, fp in frequent_runs(chunk, pairs.value, triples.value, longest):
                if k > 1:
                    keep = pointers.value.has(chunk.marks(at, fp))
                    at, fp = at[keep], fp[keep].view(np.int64).tolist()
                    yield from sent((chunk.langs[chunk.doc[i]], chunk.text(i, k), k, None, f, c) for i, f, c in zip(
                        at.tolist(), fp, chunk.checks(k, at).view(np.int64).tolist()))
            if len(held) >= HELD_PHRASES:
                yield from sent((*key, n, None, None) for key, n in held.items())
                held = {}
        yield from sent((*key, n, None, None) for key, n in held.items())

    def sent(found):
        while part := list(islice(found, 1 << 13)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return rows.mapInArrow(run, out)


def count_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  min_count: int = 100, longest: int = 5, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, a, first_doc, first_at) of all runs of 2 to `longest` words found `min_count` times and of their words, (lang, n)).

    first_doc and first_at point to an occurrence: a document and a byte of its text in UTF-8. `bits` shortens the
    fingerprints; results stay the same.
    """
    spark = docs.sparkSession
    rows = named(docs, d=id_col, t=text_col, g=lang_col)
    rows = rows.select("d", F.xxhash64("d").alias("h"), F.col("t").cast("string").alias("t"), F.col("g").cast("string").alias("g"))
    often, share = F.col("c") >= min_count, spark.sparkContext.broadcast

    def frequent(counts: DataFrame, name: str):
        return share(BitFilter.of(stored(counts.groupBy("fp").agg(F.sum("c").alias("c")).filter(often), name)))

    pairs = frequent(run_totals(rows, 2, longest, bits), "pairs")
    large = in_large_tasks(rows)
    triples = frequent(run_totals(large, 3, max(longest, 3), bits, pairs), "triples")
    runs = run_counts(large, pairs, triples, longest, bits, rows.schema["d"].dataType).groupBy("fp", "chk").agg(
        F.sum("c").alias("c"), F.min(F.struct("doc", "at", "mark")).alias("pointer"))
    runs = stored(runs.filter(often), "runs")
    wanted, pointers = share(BitFilter.of(runs)), share(BitFilter.of(runs.select(F.col("pointer.mark").alias("fp"))))
    texts = stored(phrase_texts(rows, pairs, triples, wanted, pointers, longest, bits), "texts")
    words = texts.filter("size < 2").groupBy("lang", "phrase", "size").agg(F.sum("c").alias("a"))
    # Repeated rows lead to one text several times.
    read = texts.filter("size >= 2").groupBy("fp", "chk").agg(*[F.min(c).alias(c) for c in ("lang", "phrase", "size")])
    first = [F.col("pointer.doc").alias("first_doc"), F.col("pointer.at").alias("first_at")]
    longer = read.join(runs, ["fp", "chk"]).select("lang", "phrase", "size", F.col("c").alias("a"), *first)
    none = [F.lit(None).cast(rows.schema["d"].dataType).alias("first_doc"), F.lit(None).cast("long").alias("first_at")]
    counted = stored(longer.unionByName(words.filter((F.col("size") == 0) | (F.col("a") >= min_count)).select("*", *none)), "phrases")
    return counted.filter("size > 0"), counted.filter("size = 0").select("lang", F.col("a").alias("n"))


def weakest_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with l, r, n and score of their lowest-scoring cut, ties to the shortest first part."""
    counts = phrases.select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    cuts = phrases.filter("size >= 2").select(
        "lang", "phrase", "a", words.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(ws, 1, k)"), " ").alias("head"),
                       F.array_join(F.expr("slice(ws, k + 1, size(ws) - k)"), " ").alias("tail"))
    # A part is at least as frequent as the whole, so its count is among the phrases.
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    exact = {c: f"cast({c} as decimal(19, 0))" for c in ("a", "n", "l", "r")}
    score = F.expr("cast(1000 * {a} as decimal(22, 0)) * cast({n} as decimal(16, 0)) div ({l} * {r})".format(**exact))
    return cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")).select(
        "lang", "phrase", "cut.l", "cut.r", "cut.n", "cut.score")


def covered(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of candidates inside a longer one that has at least `percent` of their count."""
    ws = F.split("phrase", " ")
    longer = phrases.filter("size >= 3").select("lang", F.col("a").alias("whole"), "size", ws.alias("ws"))
    inner = longer.select("lang", "whole", "size", "ws", F.expr("explode(sequence(2, size - 1)) as len"))
    inner = inner.select("lang", "whole", "ws", "len", F.expr("explode(sequence(1, size - len + 1)) as i"))
    inner = inner.select("lang", "whole", F.array_join(F.expr("slice(ws, i, len)"), " ").alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    held = phrases.filter("size >= 2").join(most, ["lang", "phrase"])
    return held.filter(100 * F.col("whole") >= percent * F.col("a")).select("lang", "phrase")


def mine_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 min_count: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, first_doc, first_at): the `top` phrases of each lang."""
    phrases, totals = count_phrases(docs, id_col, text_col, lang_col, min_count, longest, bits)
    scored = phrases.filter("size >= 2").drop("size").join(covered(phrases, percent), ["lang", "phrase"], "left_anti").join(
        weakest_cuts(phrases, totals), ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    best = scored.withColumn("_salt", salt).withColumn(
        "_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc", "first_at")
