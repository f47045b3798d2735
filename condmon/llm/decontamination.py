"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in documents.

Words are the letters of the search. A table keyed by a block of two words says how far the search may jump; where
it may not jump at all, the block's bucket holds the windows that end in it, and comparing all words of the window
confirms an occurrence. Windows of different lengths (short items) are searched one length after the other.

Defined results:
* NULL or empty text has no words; a document without words is never hit, an item without words has no window.
* Items with a NULL id are searched for, mark words and are left out of the list of items.
* Equal items are all reported. Repeated documents are handled row by row.
* An empty benchmark or document table gives no hits.
* All columns of the documents are kept; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from condmon.llm.common import named
from condmon.session import stored

# Every ASCII character but digits and letters separates words; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SHARD_BYTES = 64 << 20  # benchmark text searched for at a time; a larger benchmark takes several rounds


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class WuManber:
    """Search for word windows of one length."""

    def __init__(self, windows: dict[tuple, list], length: int):
        self.length, self.block = length, min(2, length)
        self.shift, self.buckets = {}, {}
        for window, ids in windows.items():
            for end in range(self.block, length + 1):
                key, jump = window[end - self.block:end], length - end
                if jump < self.shift.get(key, length):
                    self.shift[key] = jump
            self.buckets.setdefault(window[-self.block:], {})[window] = ids

    def occurrences(self, words: Sequence[bytes]) -> Iterator[tuple[int, list]]:
        """(start, ids of the items) of every window found."""
        length, block, n = self.length, self.block, len(words)
        far, shift = length - block + 1, self.shift
        end = length
        while end <= n:
            key = tuple(words[end - block:end])
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            start = end - length
            ids = self.buckets[key].get(tuple(words[start:end]))
            if ids is not None:
                yield start, ids
            end += 1


def searchers(items: Sequence[tuple], window: int) -> list[WuManber]:
    """items: (id, text) pairs."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            ids = by_length.setdefault(length, {}).setdefault(tuple(words[start:start + length]), [])
            if item_id is not None and item_id not in ids[-1:]:
                ids.append(item_id)
    return [WuManber(windows, length) for length, windows in sorted(by_length.items())]


def hits_of(text: str | None, search: Sequence[WuManber]) -> tuple[int, list[tuple[int, int]], list]:
    """Number of words, word spans hit (apart from one another), and the items found."""
    words = words_of(text)
    spans, items = [], set()
    for s in search:
        for start, ids in s.occurrences(words):
            spans.append((start, start + s.length))
            items.update(ids)
    return len(words), united(spans), sorted(items)


def united(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       results: tuple[str, str, str] = ("n_words", "hit_spans", "items")) -> DataFrame:
    """docs with the number of words, the hit spans (word positions, end exclusive) and the items found, as `results` names them.

    The benchmark is sent to the tasks in shards of at most about SHARD_BYTES; each further shard is one more pass over the
    documents, and spans and items add up.
    """
    items = named(benchmark, i=item_id, t=item_text)
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    id_type = items.schema["i"].dataType
    empty = (F.lit(0).cast("long"), F.array().cast("array<struct<start:bigint,end:bigint>>"),
             F.array().cast(f"array<{id_type.simpleString()}>"))
    out = docs.drop(*results).withColumns(dict(zip(results, empty)))
    for shard in range(shards):
        part = items.filter(F.pmod(F.xxhash64("t"), F.lit(shards)) == shard) if shards > 1 else items
        rows = [tuple(r) for r in part.toLocalIterator()]
        out = _search(out, rows, window, text_col, results)
        if shard + 1 < shards:
            out = stored(out, "decontaminated")
    return out


def _search(docs: DataFrame, rows: list[tuple], window: int, text_col: str, results: tuple[str, str, str]) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(rows)
    at, n_at, spans_at, items_at = (docs.columns.index(c) for c in (text_col, *results))

    def run(batches):
        search = searchers(shipped.value, window)
        for batch in batches:
            columns = list(batch.columns)
            texts = batch.column(at).to_pylist()
            before = zip(batch.column(spans_at).to_pylist(), batch.column(items_at).to_pylist())
            counts, spans, items = [], [], []
            for text, (old_spans, old_items) in zip(texts, before):
                n, new_spans, new_items = hits_of(text, search)
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in
                              united([*new_spans, *((s["start"], s["end"]) for s in old_spans)])])
                items.append(sorted({*new_items, *old_items}))
            for place, values in ((n_at, counts), (spans_at, spans), (items_at, items)):
                columns[place] = pa.array(values, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
