"""N-gram Jaccard join by a grouped prefix filter, down to the components of linked documents.

1. A document is its set of word n-gram hashes. Equal sets are one class from here on; members find it by a digest.
2. The elements of a set have one global order: rare before frequent, then by hash. Frequencies are counted over all documents
   by the upper 32 bits of the hashes; any order is exact, so a table of at most COMMON of the most frequent is enough. Two sets
   that link share an element of their prefixes. Classes with the same prefix and size are one group, known by a hash (a chance meeting of two groups adds
   candidates and loses none).
3. Groups that share a prefix element held by few groups are paired directly, or by few groups in a range of sizes that
   linked sets share. An element held by more would pair all of them, so these must also agree on a part signature of
   some of their members: the hash range is cut into one part more than two linked sets can differ in elements, so at
   least one part of theirs is equal.
4. Pairs pass a parity sketch (differing bits never exceed differing elements), and then the sets themselves are compared.
5. Only components are wanted, so within groups and big buckets classes are first compared with a few leaders.
   Where that leaves several components in one group or bucket, its remaining pairs are all tested in blocks: first on their
   sketches, which gives the classes that may link at all, then those on their sets. A block gives a spanning forest of
   its links. No link between different texts is lost, and no group is expanded into all its pairs.

Defined results:
* NULL or empty text has an empty set: size 0, linked with nothing. Fewer words than n make one element.
* Repeated rows are in one class; rows of one id with different texts are separate documents.
* A NULL id takes part; a component's id is the smallest id that is not NULL, if there is one.
* Other columns are left out. An empty table gives an empty result.
* A very long text is held as one array of hashes by the task that reads or compares it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from condmon.llm.common import free_name, map_rows, named
from condmon.llm.components import components
from condmon.session import stored

FEW = 32       # groups that share an element or part and are paired directly
BLOCK = 2048   # classes compared with one another in one block of a big bucket
BLOCK_ELEMENTS = 1 << 21    # elements that the sets of a block have together, unless one set alone has more
COMMON = 1 << 21            # entries of the table of frequent elements, 5 bytes each, that is sent to all tasks
COUNTED = 1 << 22           # elements a task holds before it hands them on or adds them up
PART_BITS = 10              # the elements are counted in so many parts (as a power of two), each of at most 2^22 counters
LEADERS = 3    # classes of a big bucket that the others are first compared with
MIX, SPREAD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9  # odd multipliers for mixing hashes
SETS = ("d bigint, k bigint, c binary, n int, g bigint, prefix array<bigint>, sketch binary, label int, own array<int>, "
        "next array<int>")


class Rule:
    """Two sets link when 100 * intersection >= percent * union."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def most_apart(self, both: int) -> int:
        """The most elements that two linked sets of so many elements in total can differ in."""
        return both - 2 * -(-self.percent * both // (100 + self.percent))

    def sizes_fit(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def label(self, n: int) -> tuple[int, int]:
        """Number and upper end of the size interval that n is in; linked sizes are at most one interval apart."""
        i, top = 0, 1
        while n > top:
            i, top = i + 1, self.next_top(top)
        return i, top

    def next_top(self, top: int) -> int:
        return max(top + 1, (top + 1) * 100 // self.percent)

    def label_of(self, n: Column) -> Column:
        """The number of the size interval, as a column."""
        tops = [1]
        while tops[-1] < 1 << 31:
            tops.append(self.next_top(tops[-1]))
        return F.size(F.filter(F.lit(tops), lambda top: top < n))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    from xxhash import xxh3_64_intdigest
    found = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(hashes))
    if not k:
        return hashes
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(MIX) + hashes[j:len(hashes) - k + 1 + j]
        out ^= out >> np.uint64(29)
    out *= np.uint64(SPREAD)
    return np.unique(out ^ (out >> np.uint64(32)))


def frequent_elements(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted upper halves of the hashes, logarithms of their counts) of the most frequent elements, at most COMMON.

    All elements of all documents are counted. They travel as arrays of 4 bytes each, dealt by the top bits of their
    hashes; the rest of the upper half leaves at most 2^22 counters a part, however large the corpus. Counts below 4 do not matter.
    """
    low = 32 - PART_BITS

    def deal(batches):
        def parts(held):
            found = np.sort(np.concatenate(held))
            ends = np.searchsorted(found, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(low))
            keys = (found & np.uint64((1 << low) - 1)).astype(np.uint32)
            filled = np.flatnonzero(np.diff(ends))
            for some in np.array_split(filled, len(filled) // 64 + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([keys[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary())],
                    names=["part", "keys"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, words) >> np.uint64(32))
                size += len(held[-1])
                if size >= COUNTED:
                    yield from parts(held)
                    held, size = [], 0
        if held:
            yield from parts(held)

    def add_up(batches):
        def summed(keys, counts, held):
            if held:
                more, n = np.unique(np.concatenate(held), return_counts=True)
                both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
                keys, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            return keys, counts

        def batch_of_part(part, keys, counts):
            kept = counts >= 4
            key = (np.uint32(part) << np.uint32(low)) | keys[kept]
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.log2(counts[kept]).astype(np.int8))],
                                              names=["e", "size"])

        part, held, size = None, [], 0
        keys, counts = none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    if part is not None:
                        yield batch_of_part(part, *summed(keys, counts, held))
                    part, held, size, (keys, counts) = p, [], 0, none
                held.append(np.frombuffer(raw, np.uint32))
                size += len(held[-1])
                if size >= COUNTED:
                    keys, counts = summed(keys, counts, held)
                    held, size = [], 0
        if part is not None:
            yield batch_of_part(part, *summed(keys, counts, held))

    dealt = docs.select("t").mapInArrow(deal, "part int, keys binary").repartition("part").sortWithinPartitions("part")
    counted = stored(dealt.mapInArrow(add_up, "e bigint, size tinyint"), "frequent")
    least, total = 127, 0
    for r in sorted(counted.groupBy("size").count().collect(), reverse=True):  # at most 64 rows
        total += r["count"]
        if total > COMMON:
            break
        least = r["size"]
    table = counted.filter(F.col("size") >= least).toArrow()
    keys, sizes = table["e"].to_numpy().astype(np.uint32), table["size"].to_numpy()
    order = np.argsort(keys)
    return keys[order], sizes[order].astype(np.int8)


def rare_first(elements: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A set's elements in the global order."""
    if not len(keys):
        return elements
    upper = (elements >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(keys, upper), len(keys) - 1)
    return elements[np.argsort(np.where(keys[at] == upper, sizes[at], 0), kind="stable")]


def sketch_of(elements: np.ndarray) -> bytes:
    """Parity of the elements in each of about n / 2 or more bits; the number of bits is a power of two."""
    bits = max(64, 1 << int(len(elements) // 2).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the elements two sets differ in; the longer sketch is folded."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    long, short = len(a), len(b)
    if long < short:
        x, y, long, short = y, x, short, long
    while long > short:
        long //= 2
        x = (x >> (8 * long)) ^ (x & ((1 << (8 * long)) - 1))
    return (x ^ y).bit_count()


def part_signatures(elements: np.ndarray, rule: Rule) -> tuple[int, list[int], list[int]]:
    """The set's size interval, and signatures of its parts under that interval and, as the smaller partner, the next."""
    label, top = rule.label(len(elements))
    mixed = elements * np.uint64(SPREAD)
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(31)), dtype=np.uint64)])
    out = []
    for high in (top, rule.next_top(top)):
        parts = 2 * high * (100 - rule.percent) // (100 + rule.percent) + 1  # more than any two such sets can differ in
        ends = np.searchsorted(elements >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
        ends[-1] = len(elements)
        sums = (totals[ends[1:]] - totals[ends[:-1]]) * np.uint64(MIX)
        out.append((sums >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist())
    return label, *out


def set_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """SETS: one row per document (d, t); `k` is the key that leads back to its text."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_elements(docs, rule.words))

    def make():
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        def run(rows):
            for r in rows:
                s = shingles(r["t"], rule.words)
                if not len(s):
                    yield r["d"], r["k"], None, 0, None, None, None, None, None, None
                    continue
                prefix = rare_first(s, *frequent.value)[:rule.prefix(len(s))]
                group = xxh3_64_intdigest(prefix.tobytes(), seed=len(s)) - (1 << 63)
                yield (r["d"], r["k"], xxh3_128_digest(s.tobytes()), len(s), group, prefix.view(np.int64).tolist(),
                       sketch_of(s), *part_signatures(s, rule))

        return run

    return map_rows(docs.withColumn("k", F.xxhash64("d", "t")), make, SETS, flush=256)


def sizes_fit(a: Column, b: Column, rule: Rule) -> Column:
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def paired(rows: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """(a, b): groups `g` that share the keys and fit in size `n`."""
    other = rows.select(*keys, F.col("g").alias("g2"), F.col("n").alias("n2"))
    both = rows.join(other, keys).filter((F.col("g") < F.col("g2")) & sizes_fit(F.col("n"), F.col("n2"), rule))
    return both.select(F.col("g").alias("a"), F.col("g2").alias("b"))


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, g, n) whose keys several groups hold, with m, the number of rows they come from.

    The counts are combined before the shuffle, and hot keys are split at the join.
    """
    held = rows.groupBy(*keys).agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("m"))
    return rows.join(held.filter(F.col("lo") != F.col("hi")).select(*keys, "m"), keys).distinct()


def led(rows: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """(a, b): every id of a bucket with each of its leaders, the first ids under some orders of their hashes."""
    orders = [F.xxhash64(F.lit(i), ids) for i in range(LEADERS)]
    leaders = rows.groupBy(*keys).agg(*[F.min(F.struct(o.alias("o"), F.col(ids).alias("r"))).alias(f"l{i}")
                                        for i, o in enumerate(orders)])
    found = rows.join(leaders, keys)
    return found.select(F.col(ids).alias("a"), F.explode(F.array(*[F.col(f"l{i}.r") for i in range(LEADERS)])).alias("b"))


def sketched(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes whose sketches do not rule a link out."""
    side = classes.select("c", "n", "sketch")
    left = side.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = side.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(left, "a").filter(F.col("a") != F.col("b")).join(right, "b")

    def make():
        def run(rows):
            for r in rows:
                both = r["na"] + r["nb"]
                if rule.sizes_fit(r["na"], r["nb"]) and apart(r["sa"], r["sb"]) <= rule.most_apart(both):
                    yield r["a"], r["b"]

        return run

    return map_rows(joined, make, "a binary, b binary", flush=16384)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link."""
    full = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), docs, sets, rule)
    joined = (pairs.join(full.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
              .join(full.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b"))

    def make():
        def run(rows):
            for r in rows:
                if linked(np.frombuffer(r["sa"], np.uint64), np.frombuffer(r["sb"], np.uint64), rule):
                    yield r["a"], r["b"]

        return run

    return map_rows(joined, make, "a binary, b binary")


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    both = len(a) + len(b)
    common = both - len(np.union1d(a, b))
    return 100 * common >= rule.percent * (both - common)


def full_sets(wanted: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(c, s): the sets of some classes, formed again from one document of each."""
    holders = stored(sets.join(wanted, "c").groupBy("c").agg(F.min(F.struct("d", "k")).alias("at"))
                     .select("c", F.col("at.d").alias("d"), F.col("at.k").alias("k")), "holders")
    keyed = docs.withColumn("k", F.xxhash64("d", "t"))
    ids = holders.select(F.col("d").alias("d2"), F.col("k").alias("k2"))
    texts = keyed.join(ids, (F.col("k") == F.col("k2")) & F.col("d").eqNullSafe(F.col("d2")), "left_semi")

    def make_sets():
        from xxhash import xxh3_128_digest

        def run(rows):
            for r in rows:
                raw = shingles(r["t"], rule.words).tobytes()
                yield xxh3_128_digest(raw), raw

        return run

    return stored(map_rows(texts.select("t"), make_sets, "c binary, s binary").dropDuplicates(["c"]), "sets")


def block_members(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows (key, guest, c, n, comp, sketch) -> (unit, itself, first, c, comp): what has a partner in its unit that sketches allow.

    Hosts of a key are compared with one another and with its guests, where components differ. Both are dealt to blocks of at
    most about BLOCK classes and BLOCK_ELEMENTS elements, and two blocks are one unit of work, however many rows a key has.
    """
    def blocks(guest: bool) -> Column:
        mine = F.col("guest") == guest
        return F.ceil(F.greatest(F.count_if(mine) / BLOCK, F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)) / BLOCK_ELEMENTS)).cast("int")

    sizes = rows.groupBy("key").agg(blocks(False).alias("hosts"), blocks(True).alias("guests"))
    dealt = rows.join(sizes, "key").withColumn(
        "own", F.pmod(F.xxhash64("c"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("hosts"))).cast("int"))

    def unit(side: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))

    def numbers(count: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.col(count)), lambda i: i < F.col(count))

    own, hosts, guests = F.col("own"), numbers("hosts"), numbers("guests")
    units = F.when(F.col("guest"), F.transform(hosts, lambda i: unit(1, i, own))).otherwise(F.concat(
        F.transform(hosts, lambda i: unit(0, F.least(i, own), F.greatest(i, own))), F.transform(guests, lambda i: unit(1, own, i))))
    spread = dealt.select("key", F.explode(units).alias("unit"), "guest", "own", "c", "n", "comp", "sketch")
    ordered_ = spread.repartition("key", "unit").sortWithinPartitions("key", "unit")

    def make():
        def run(found) -> Iterator[tuple]:
            at, first, second = None, [], []
            for r in found:
                unit = (r["key"], r["unit"])
                if unit != at:
                    yield from allowed(first, second, at, rule)
                    at, first, second = unit, [], []
                mine = not r["guest"] if r["unit"]["side"] else r["own"] == r["unit"]["x"]
                (first if mine else second).append((r["c"], r["n"], r["comp"], r["sketch"]))
            yield from allowed(first, second, at, rule)

        return run

    return map_rows(ordered_, make, "unit binary, itself boolean, first boolean, c binary, comp binary", flush=16384)


def block_links(members: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): of the members of each unit, a spanning forest of the links between their components; `full` has their sets."""
    dealt = members.join(full, "c").repartition("unit").sortWithinPartitions("unit")

    def make():
        def run(found) -> Iterator[tuple]:
            at, held = None, []
            for r in found:
                if r["unit"] != at:
                    yield from forest(held, rule)
                    at, held = r["unit"], []
                held.append((r["itself"], r["first"], r["c"], r["comp"], np.frombuffer(r["s"], np.uint64)))
            yield from forest(held, rule)

        return run

    return map_rows(dealt, make, "a binary, b binary", flush=16384)


def forest(rows: list, rule: Rule) -> Iterator[tuple]:
    """Links of one unit that join two components each."""
    if not rows:
        return
    itself = rows[0][0]
    first, second = ([(c, len(s), comp, sketch_of(s), s) for _, one, c, comp, s in rows if itself or one == side] for side in (True, False))
    above = {}

    def top(x):
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for x, y in fitting(first, second, itself, rule):
        a, b = top(first[x][2]), top(second[y][2])
        if a != b and linked(first[x][4], second[y][4], rule):
            above[b] = a
            yield first[x][0], second[y][0]


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width in bytes, a row of 64-bit words each; longer ones are folded."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, width // 8), axis=0) for s in sketches])


def allowed(first: list, second: list, unit: tuple | None, rule: Rule) -> Iterator[tuple]:
    """The members of a unit with a partner in another component that can link; the unit may be a block with itself."""
    if not first:
        return
    from xxhash import xxh3_128_digest
    itself = not unit[1]["side"] and unit[1]["x"] == unit[1]["y"]
    xs, ys = set(), set()
    for x, y in fitting(first, first if itself else second, itself, rule):
        xs.add(x)
        (xs if itself else ys).add(y)
    name = xxh3_128_digest(repr((sorted(unit[0].items()), sorted(unit[1].items()))))
    for side, rows, found in ((True, first, xs), (False, second, ys)):
        for i in sorted(found):
            yield name, itself, side, rows[i][0], rows[i][2]


def fitting(first: list, second: list, itself: bool, rule: Rule) -> Iterator[tuple[int, int]]:
    """Places of pairs of different components that sizes and sketches allow; rows are (c, n, comp, sketch, ...)."""
    if not first or not second:
        return
    codes = {comp: i for i, comp in enumerate({r[2] for r in first} | {r[2] for r in second})}
    if len(codes) == 1:
        return
    width = min(len(r[3]) for r in (*first, *second))
    xs, ys = folded([r[3] for r in first], width), folded([r[3] for r in second], width)
    nx, ny = (np.array([r[1] for r in rows], np.int64) for rows in (first, second))
    cx, cy = (np.array([codes[r[2]] for r in rows]) for rows in (first, second))
    step = max(1, (1 << 21) // (len(second) * (width // 8)))
    for i in range(0, len(first), step):
        part = slice(i, i + step)
        both = nx[part, None] + ny[None, :]
        differ = np.bitwise_count(xs[part, None, :] ^ ys[None, :, :]).sum(axis=2, dtype=np.int64)
        fit = (cx[part, None] != cy[None, :]) & (differ <= both - 2 * -(-rule.percent * both // (100 + rule.percent)))
        fit &= 100 * np.minimum(nx[part, None], ny[None, :]) >= rule.percent * np.maximum(nx[part, None], ny[None, :])
        for x, y in zip(*(places.tolist() for places in np.nonzero(fit))):
            if not itself or y > x + i:
                yield x + i, y


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), one row per document."""
    sets, roots = _linked(docs, words, percent, id_col, text_col)
    return _labelled(sets, roots, id_col)


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when each component keeps one document: the one with the smallest id.

    Ids that are NULL come last, of several texts with that id the one with the smallest hash stays, and of equal rows one.
    Documents without words are linked with nothing and all stay. Every column is kept.
    """
    sets, roots = _linked(docs, words, percent, id_col, text_col)
    of_set = sets.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rows = of_set.groupBy("root", "d", "k").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    rows = rows.filter(F.col("n") > 0)
    first = F.min(F.struct(F.col("d").isNull().alias("last"), "d", "k", "rows"))
    chosen = stored(rows.groupBy("root").agg(first.alias("f")).select(
        "root", F.col("f.d").alias("fd"), F.col("f.k").alias("fk"), F.col("f.rows").alias("rows")), "chosen")
    other = rows.drop("rows").join(chosen.drop("rows"), "root")
    removed = stored(other.filter(~(F.col("d").eqNullSafe(F.col("fd")) & (F.col("k") == F.col("fk")))).select("d", "k"), "removed")
    again = chosen.filter(F.col("rows") > 1).select(F.col("fd").alias("d"), F.col("fk").alias("k"))
    key = free_name(docs, "_text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        names = [free_name(docs, "_text_d"), free_name(docs, "_text_k")]
        return left.join(right.toDF(*names), (F.col(key) == F.col(names[1])) & F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])), how)

    kept = joined(keyed, removed, "left_anti")
    if not again.isEmpty():  # rows of one chosen document that repeat, of which one stays
        kept = joined(kept, again, "left_anti").unionByName(joined(kept, again, "left_semi").dropDuplicates([key]))
    return kept.drop(key)


def _linked(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The set rows, and (node, root) of all classes with a link."""
    rule = Rule(words, percent)
    source = named(docs, d=id_col, t=text_col)
    sets = stored(set_rows(source, rule), "shingles")
    filled = sets.filter(F.col("n") > 0)
    classes = stored(filled.select("c", "n", "g", "sketch").distinct(), "classes")
    groups = stored(classes.groupBy("g").agg(F.min("c").alias("r"), F.count(F.lit(1)).alias("size")), "groups")

    postings = stored(shared(filled.select(F.explode("prefix").alias("e"), "g", "n"), ["e"]), "postings")
    cold = paired(postings.filter(F.col("m") <= FEW), ["e"], rule)
    label = rule.label_of(F.col("n"))
    sized = stored(shared(postings.filter(F.col("m") > FEW).select(
        "e", "g", "n", F.explode(F.array(label, label + 1)).alias("label")), ["e", "label"]), "sized-postings")
    cold = cold.unionByName(paired(sized.filter(F.col("m") <= FEW), ["e", "label"], rule))
    crowded = sized.filter(F.col("m") > FEW).select("g").distinct()
    keys = ["label", "part", "sig"]
    buckets = stored(shared(_parts(filled.join(crowded, "g", "left_semi")), keys), "buckets")
    small = paired(buckets.filter(F.col("m") <= FEW), keys, rule)
    pairs = stored(ordered(cold.unionByName(small)), "group-pairs")
    big = buckets.filter(F.col("m") > FEW)

    first = groups.select("g", "r")
    led_groups = pairs.unionByName(ordered(led(big, keys, "g")))
    led_classes = (led_groups.join(first.withColumnRenamed("g", "a").withColumnRenamed("r", "ra"), "a")
                   .join(first.withColumnRenamed("g", "b").withColumnRenamed("r", "rb"), "b")
                   .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    members = classes.join(groups.filter(F.col("size") > 1).select("g"), "g")
    tried = ordered(led_classes.unionByName(led(members.select("g", "c"), ["g"], "c")))
    candidates = stored(sketched(tried, classes, rule), "candidates")
    links = stored(verified(candidates, source, sets, rule), "links")

    roots = components(links)
    so_far = stored(classes.join(roots.withColumnRenamed("node", "c"), "c", "left")
                    .withColumn("comp", F.coalesce("root", "c")).drop("root"), "so-far")
    rest = stored(block_members(_unsettled(so_far, pairs, big, keys), rule), "rest")
    if rest.isEmpty():
        return sets, roots
    more = stored(block_links(rest, full_sets(rest.select("c").distinct(), source, sets, rule), rule), "more-links")
    return sets, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _parts(rows: DataFrame) -> DataFrame:
    """(label, part, sig, g, n) of all parts, under the sets' own and next intervals."""
    def under(label: Column, sigs: str) -> DataFrame:
        return rows.select(label.alias("label"), "g", "n", F.posexplode(sigs).alias("part", "sig"))

    return under(F.col("label"), "own").unionByName(under(F.col("label") + 1, "next"))


def _unsettled(so_far: DataFrame, pairs: DataFrame, big: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for `block_members`: the members of groups and big buckets that hold several components, and as guests of a group
    the members of smaller groups paired with it. What is one component already is told by group, before members are joined."""
    groups = stored(so_far.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")), "states")
    shown = so_far.select("g", "c", "n", "comp", "sketch")

    def key(kind: int, *cols: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.hash(*cols).alias("x"), F.xxhash64(*cols).alias("y")).alias("key")

    def side(name: str) -> DataFrame:
        return groups.select(F.col("g").alias(name), F.struct("size", F.col("g").alias("id"), "lo", "hi").alias(f"{name}_is"))

    # Groups of one class were compared in full already; of the others the larger group of a pair is the host.
    wide = (pairs.join(side("a"), "a").join(side("b"), "b").filter(F.greatest("a_is.size", "b_is.size") > 1)
            .filter((F.least("a_is.lo", "b_is.lo") != F.greatest("a_is.hi", "b_is.hi"))))
    hosted = stored(wide.select(F.greatest("a_is", "b_is")["id"].alias("host"), F.least("a_is", "b_is")["id"].alias("g")), "hosted")
    hosts = hosted.select(F.col("host").alias("g")).unionByName(groups.filter(F.col("lo") != F.col("hi")).select("g")).distinct()
    members = hosts.join(shown, "g").withColumn("key", key(0, "g")).withColumn("guest", F.lit(False))
    guests = hosted.join(shown, "g").withColumn("key", key(0, "host")).withColumn("guest", F.lit(True)).drop("host")
    mixed = (big.join(groups, "g").groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .filter(F.col("lo") != F.col("hi")).select(*keys))
    crowds = (big.join(mixed, keys).select("g", key(1, *keys)).distinct().join(shown, "g").withColumn("guest", F.lit(False)))
    return members.unionByName(guests).unionByName(crowds)


def _labelled(sets: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    least = sets.filter(F.col("n") > 0).groupBy("c").agg(F.min("d").alias("d0"))
    rooted = least.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named_roots = rooted.groupBy("root").agg(F.min("d0").alias("component_id"))
    of_class = rooted.join(named_roots, "root").select("c", "component_id")
    joined = sets.select("d", "c", "n").join(of_class, "c", "left")
    return joined.select(F.col("d").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                         F.when(F.col("c").isNull(), F.col("d")).otherwise(F.col("component_id")).alias("component_id"))
