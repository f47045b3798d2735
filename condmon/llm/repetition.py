"""Quality rules with suffix-array repetition.

The words of a text form a suffix array by prefix doubling, in which only suffixes that still share their prefix are
sorted again. Longest common prefixes of neighbours give the maximal repeated substrings; the union of their spans
is what a text repeats. A text fails when the repeats cover too much of it, or one of them is too long.

Texts are handled several at a time in one array, whose first symbols tell texts apart, so that no repeat runs across texts.

Defined results:
* NULL or empty text has no words and no repeats; it fails the base rule of at least `min_words` words.
* Words differ by case. Lines of white space alone are no repeated lines.
* Repeated rows are handled row by row. An empty table gives an empty result.
* All columns of the documents are kept; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from condmon.llm.common import SPACES

CHUNK_WORDS = 200_000  # words whose suffixes are sorted together, one longer text aside
SYMBOLS = b"#*$%&|<>"
RESULTS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
           "n_repeat_words": "bigint", "longest_repeat": "bigint", "repeat_spans": "array<struct<start:bigint,end:bigint>>"}


@dataclass(frozen=True)
class Limits:
    window: int = 8               # words a repeat must have to count
    min_words: int = 20
    base_percent: int = 30        # of the words in repeats, for the base rule
    covered_percent: int = 25     # of the words in repeats, for the verdict
    longest: int = 200            # words in one repeat ...
    longest_percent: int = 15     # ... that is also this part of the text


def refined(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two are equal.

    A rank is the number of smaller prefixes, so a suffix alone with its rank keeps it for good.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    levels = [starts[inverse].astype(np.int64)]
    active = np.flatnonzero(counts[inverse] > 1)
    step = 1
    while len(active):
        rank = levels[-1]
        beyond = active + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        first = rank[active]
        order = np.argsort(first * (n + 1) + second, kind="stable")
        a, b, place = first[order], second[order], np.arange(len(active))
        new_group = np.concatenate([[True], a[1:] != a[:-1]])
        new_value = new_group | np.concatenate([[True], b[1:] != b[:-1]])
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        value_at = np.maximum.accumulate(np.where(new_value, place, 0))
        rank = rank.copy()
        rank[active[order]] = a + value_at - group_at
        levels.append(rank)
        alone = new_value & np.concatenate([new_value[1:], [True]])
        active = np.sort(active[order][~alone])
        step *= 2
    return levels


def longest_matches(symbols: np.ndarray, least: int) -> np.ndarray:
    """For every position the length of the longest substring from there that occurs again, 0 below `least`."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    levels = refined(symbols)
    first = least.bit_length() - 1
    if first >= len(levels):
        return out
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    near = levels[first][a] == levels[first][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.maximum(x, y) < n
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same << k
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    out[out < least] = 0
    return out


def repeats(texts: Sequence[list[bytes]], least: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Per text (a list of words): words covered by repeats, longest repeat, and the spans of their union."""
    import pandas as pd
    sizes = np.array([len(t) for t in texts])
    words = np.empty(int(sizes.sum()), object)
    words[:] = [w for t in texts for w in t]
    codes, names = pd.factorize(words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    match = longest_matches(codes.astype(np.int64) + owner * np.int64(len(names) + 1), least)
    turn = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(match)
    np.add.at(turn, at, 1)
    np.add.at(turn, at + match[at], -1)
    covered = np.cumsum(turn)[:-1] > 0
    ends = np.cumsum(sizes)
    out = []
    for start, end in zip(ends - sizes, ends):
        c = covered[start:end]
        if not c.any():
            out.append((0, 0, []))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((int(c.sum()), int(match[start:end].max()), spans))
    return out


def plain_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES.encode()):
            seen.add(line)
    return len(b"".join(words).decode()), len(raw) - len(raw.translate(None, SYMBOLS)), again


def measure(texts: Sequence[str | None], least: int) -> list[tuple]:
    """Rows of RESULTS."""
    out, chunk, held = [], [], 0
    raws = [(t or "").encode() for t in texts]
    words = [r.split() for r in raws]  # on bytes: ASCII white space only
    found: list[tuple] = []
    for ws in words:
        if chunk and held + len(ws) > CHUNK_WORDS:
            found += repeats(chunk, least)
            chunk, held = [], 0
        chunk.append(ws)
        held += len(ws)
    if chunk:
        found += repeats(chunk, least)
    for raw, ws, (covered, longest, spans) in zip(raws, words, found):
        out.append((len(ws), *plain_counts(raw, ws), covered, longest, [{"start": a, "end": b} for a, b in spans]))
    return out


def quality(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """docs with RESULTS, `base_failed` and `kept`."""
    source = docs.drop(*RESULTS, "base_failed", "kept")
    typed = source.withColumns({name: F.lit(None).cast(kind) for name, kind in RESULTS.items()})
    at = source.columns.index(text_col)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            measured = list(zip(*measure(columns[at].to_pylist(), limits.window))) or [()] * len(RESULTS)
            place = len(columns) - len(RESULTS)
            for i, values in enumerate(measured):
                columns[place + i] = pa.array(values, batch.schema.field(place + i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    n, again = F.col("n_words"), 100 * F.col("n_repeat_words")
    base = (n < limits.min_words) | (again > limits.base_percent * n)
    too_long = (F.col("longest_repeat") > limits.longest) & (100 * F.col("longest_repeat") > limits.longest_percent * n)
    return typed.mapInArrow(run, typed.schema).withColumn("base_failed", base).withColumn(
        "kept", ~base & ~too_long & (again <= limits.covered_percent * n))
