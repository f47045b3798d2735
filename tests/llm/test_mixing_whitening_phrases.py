"""Source mixing, whitening and phrase mining on small tables, against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from condmon.llm import common, mixing, phrases, whitening


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.prepare(spark)


# source mixing

DOCS = "doc_id bigint, text string, source string, size int, nth string"


def plain_targets(held, weights=(5, 2, 1), most=3):
    names = sorted((s for s in held if s is not None), key=lambda s: s.encode()) + [s for s in held if s is None]
    weight, total = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(held.values())
    full = set()
    while True:
        rest = total - sum(most * held[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and Fraction(weight[s] * rest, free) >= most * held[s]}
        if not over:
            return {s: float(most * held[s]) if s in full else float(Fraction(weight[s] * rest, free)) for s in names}
        full |= over


def plain_mix(docs, block):
    """{source: [(doc, start, words) per block]} and the sources in the order of the slots."""
    held = Counter()
    for _, text, source in docs:
        held[source] += len((text or "").split())
    targets = plain_targets(dict(held))
    order, blocks = [], {}
    for source, target in targets.items():
        mine = sorted(((hashlib.md5(str(d).encode()).hexdigest(), d, len((t or "").split())) for d, t, s in docs if s == source))
        stream = [(d, i) for _ in range(3) for _, d, n in mine for i in range(n)][:min(3 * held[source], int(target + 0.5))]
        blocks[source] = [stream[i:i + block] for i in range(0, len(stream), block)]
        order += [source] * len(blocks[source])
    bits = max(1, len(order).bit_length())
    points = [int(format(k, f"0{bits}b")[::-1], 2) for k in range(2 ** bits)]
    return targets, blocks, [order[p] for p in points if p < len(order)]


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 16), (3, 1)])
def test_mixing_against_brute_force(spark, seed, block):
    rnd = random.Random(seed)
    sources = ["b", "a", "c", "é", None, "Z", "tiny"]
    docs = [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 3, 40]))), rnd.choice(sources[:6] + ["a"] * 4)) for i in range(90)]
    docs += [(900, "one two", "tiny"), (901, None, "tiny"), (902, "", "nothing")]
    targets, blocks, slots = plain_mix(docs, block)
    table = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in docs], DOCS).repartition(5)
    made = mixing.mix(table, block=block)
    by_slot = {}
    for p in made.pieces.orderBy("position", "at").collect():
        held = by_slot.setdefault(p["position"], [])
        assert p["at"] == len(held)
        held += [(p["doc_id"], i) for i in range(p["start"], p["start"] + p["words"])]
    upcoming = {s: iter(b) for s, b in blocks.items()}
    assert [by_slot[i] for i in range(len(slots))] == [next(upcoming[s]) for s in slots] and len(by_slot) == len(slots)
    counted = Counter(d for b in blocks.values() for words in b for d, _ in words)
    source_of = {d: s for d, _, s in docs}
    for r in made.taken().collect():
        assert r["taken"] == counted[r["doc_id"]] <= 3 * r["size"]
        assert r["target"] == pytest.approx(targets[source_of[r["doc_id"]]])


def test_mixing_prefixes_are_balanced(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3], 1, "") for i in range(600)], DOCS)
    made = mixing.mix(docs, block=10).pieces.groupBy("position").agg(F.first("nth").alias("nth")).orderBy("position").collect()
    seen = [0, 0, 0]
    for i, r in enumerate(made, 1):
        seen[r["nth"]] += 1
        assert all(abs(n - i * w / 8) <= 6 for n, w in zip(seen, (5, 2, 1)))


def test_mixing_edges(spark):
    rows = [(1, None, None, 1, "x"), (None, "a b", None, 1, "x"), (None, "a b", None, 1, "x"), (2, "", "s", None, None),
            (2, "", "s", None, None), (3, "x" * 100_000 + " y", "s", 1, "x")]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).taken()
    assert sorted((r["doc_id"] or 0, r["size"], r["source_size"]) for r in out.collect()) == [
        (0, 2, 4), (0, 2, 4), (1, 0, 4), (2, 0, 2), (2, 0, 2), (3, 2, 2)]
    assert out.agg(F.sum("taken")).first()[0] == 6
    silent = mixing.mix(spark.createDataFrame([(1, None, "a", 1, ""), (2, " ", None, 1, "")], DOCS)).taken().collect()
    assert [(r["taken"], r["target"]) for r in silent] == [(0, 0.0)] * 2
    assert mixing.mix(spark.createDataFrame([], DOCS)).taken().count() == 0
    one = mixing.mix(spark.createDataFrame([("id", "a b c", "s")], "doc_id string, text string, source string")).taken().first()
    assert (one["taken"], one["target"]) == (3, 3.0)


def test_mixing_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i % 70, "w " * (i % 9), "hot" if i % 3 else f"s{i % 5}", 1, "") for i in range(300)], DOCS)
    once, again = (sorted(map(tuple, mixing.mix(d, block=5).pieces.collect())) for d in (docs.repartition(2), docs.repartition(11)))
    assert once == again


# whitening

VECTORS = "vec_id bigint, embedding array<double>, n string, x int"


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    values, at = np.linalg.eigh(c.T @ c / n)
    return c @ at[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k]


@pytest.mark.parametrize("dims,k,decay", [(40, 5, 0.9), (40, 5, 0.2), (12, 32, 0.8), (60, 8, 1.0)])
def test_whitening_against_eigh(spark, dims, k, decay):
    rng = np.random.default_rng(dims)
    data = rng.standard_normal((400, dims)) * 50 * decay ** np.arange(dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(data.tolist())], VECTORS).repartition(4)
    got = whitening.whiten(table, k=k).toPandas()
    want, values = plain_whitening(data, min(k, dims))
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert white.shape == want.shape
    assert np.allclose(got.drop_duplicates("component")["eigenvalue"], values, rtol=1e-9)
    assert np.abs(white * np.sign((white * want).sum(0)) - want).max() < 1e-6
    assert got["identity_error"].max() < 1e-6


def test_whitening_edges(spark):
    rows = [(1, None, "x", 1), (2, [1.0, None], "x", 1), (3, [float("nan"), 1.0], "x", 1), (4, [float("inf"), 1.0], "x", 1), (5, [], "x", 1),
            (6, [1.0, 2.0, 3.0], "x", 1), (None, [0.0, 0.0], None, None), (7, [1.0, 0.0], "x", 1), (7, [1.0, 0.0], "x", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    # the second dimension is constant: one component
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"]) for r in got) == [
        (0, 1, 3, 128 ** 2), (7, 1, 3, 64 ** 2), (7, 1, 3, 64 ** 2)]
    assert got[0]["explained"] == pytest.approx(1.0) and got[0]["identity_error"] < 1e-12
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0], "", 1)] * 3, VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300], "", 1)], VECTORS)).count()


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[2 ** 40, 0], [3, 2 ** 41]])
    centred = whitening.Centred(2 ** 30, np.array([5, 7]))
    assert centred.deviation(x) == [sum((2 ** 30 * int(v) - s) ** 2 for v, s in zip(row, (5, 7))) for row in x]


def test_widening_the_block_still_converges():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    values = 1 + 1e-9 * np.arange(80)[::-1]  # hardly any gap anywhere
    found, vectors, residual = whitening.leading_components(lambda y: q @ (values[:, None] * (q.T @ y)), 80, 6, 1e-12, 1)
    assert residual < 1e-12 and np.allclose(found, values[:6], rtol=1e-8) and np.allclose(vectors.T @ vectors, np.eye(6))


# phrases

TEXTS = "doc_id bigint, text string, lang string, phrase string, a int"


def plain_phrases(rows, least, longest=5, percent=100, top=2000):
    import re
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            counts.update((lang, tuple(ws[i:i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    whole = Counter()
    for (lang, ws), a in found.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                whole[lang, ws[i:i + k]] = max(whole[lang, ws[i:i + k]], a)
    out = {}
    for (lang, ws), a in found.items():
        if 100 * whole[lang, ws] >= percent * a:
            continue
        score, _, l, r = min((1000 * a * totals[lang] // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]])
                             for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r, totals[lang]))
    return {(lang, i, p.decode(), -a, l, r, n, -s) for lang, ps in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(ps)[:top], 1)}


def random_texts(seed, n):
    rnd = random.Random(seed)
    words = ["der", "Der", "la", "é", "中文", "ab\x00", "ab", "x" * 30, "#", "rare1", "rare2"]
    return [(" ".join(rnd.choice(words[:rnd.choice([3, 11])]) + rnd.choice(["", "", "", ",", "\n", "\t ", "! "]) for _ in range(rnd.choice([0, 2, 40]))),
             rnd.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 14, 6])
def test_phrases_against_brute_force(spark, bits):
    rows = random_texts(bits, 150)
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], TEXTS).repartition(3)
    got = phrases.mine_phrases(docs, min_count=7, bits=bits)
    assert {tuple(r)[:8] for r in got.collect()} == plain_phrases(rows, 7)
    texts = dict(enumerate(rows))
    for r in got.collect():
        assert texts[r["first_doc"]][0].encode()[r["first_at"]:].decode().lower().startswith(r["phrase"].split(" ")[0])


def test_phrases_of_long_texts_and_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "HELD", 16)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 4)
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["a", "b", "c" * 90, "d."]) for _ in range(900))
    data = [long.encode(), ("same words here " * 50).encode()]
    for text in data:  # chunks begin every run once
        whole = phrases.Chunk(text, [0], [1], [7], ["en"])
        parts = list(phrases.long_chunks(text, 1, 7, "en", 5, 64))
        for k in range(1, 6):
            assert Counter(whole.runs(k)[1].tolist()) == sum((Counter(c.runs(k)[1].tolist()) for c in parts), Counter())
            starts = sorted(c.base + int(c.start[i]) for c in parts for i in c.runs(k)[0])
            assert starts == whole.start[whole.runs(k)[0]].tolist()
    rows = [(t.decode(), "en") for t in data] + [("one copy of it", "en")] * 40
    docs = spark.createDataFrame([(1, t, g, "x", 1) for t, g in rows], TEXTS)
    assert {tuple(r)[:8] for r in phrases.mine_phrases(docs, min_count=9).collect()} == plain_phrases(rows, 9)


def test_phrases_edges(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], TEXTS)).count() == 0
    rows = [(None, None, None, None, None), (1, "", "en", "", 1), (2, " \n\t", "en", "", 1)]
    assert phrases.mine_phrases(spark.createDataFrame(rows, TEXTS), min_count=1).count() == 0
    rows += [(None, "a b", None, None, None)] * 3 + [("3", "b c", "und", "", 1)]
    odd = spark.createDataFrame([(str(r[0]) if r[0] else None, *r[1:]) for r in rows], "doc_id string, text string, lang string, rank string, score int")
    got = phrases.mine_phrases(odd, min_count=1, top=1).collect()
    assert [tuple(r)[:8] for r in got] == [("und", 1, "a b", 3, 3, 4, 8, 2000)]  # as good as "b c", and more frequent


def test_large_counts_are_exact(spark):
    big = 10 ** 12 + 7
    counted = spark.createDataFrame([("en", "a b", 2, big, "1", 0), ("en", "a", 1, big + 5, "1", 0), ("en", "b", 1, big + 11, "1", 0)],
                                    "lang string, phrase string, size int, a long, first_doc string, first_at long")
    n = 10 ** 14 + 3
    row = phrases.weakest_cuts(counted, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row["score"] == 1000 * big * n // ((big + 5) * (big + 11))


def test_filter_lets_all_of_its_own_through(spark):
    rng = np.random.default_rng(1)
    fps = rng.integers(-2 ** 63, 2 ** 63 - 1, 4000)
    found = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    for most in (phrases.FILTER_BITS, 1 << 12):  # the second is crowded
        bits = phrases.BitFilter.of(found, most)
        assert bits.has(fps.view(np.uint64)).all() and 64 * len(bits.words) <= most
    assert phrases.BitFilter.of(found).has(rng.integers(0, 2 ** 63, 10000).astype(np.uint64)).mean() < 0.02


def test_runs_of_frequent_pairs_with_rare_triples_stay_in_their_tasks(spark, monkeypatch):
    """Only runs whose triples may be frequent are sent, from few tasks, however many parts the texts have."""
    rows = [(f"a{i} b{j} c{k}" + " d e" * (i == j == 0), "en") for i in range(6) for j in range(6) for k in range(6)]
    rows += [("x y z x", "en")] * 6
    made, real = [], phrases.run_counts
    monkeypatch.setattr(phrases, "run_counts", lambda *a: made.append(real(*a)) or made[-1])
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], TEXTS)
    got = phrases.mine_phrases(docs.coalesce(1), min_count=6).collect()
    assert {tuple(r)[:8] for r in got} == plain_phrases(rows, 6)
    # 23 words (a, b, c, d, e, x, y, z), 36 + 36 + 1 + 3 pairs, x y z, y z x and the four words; no a b c
    assert made[0].count() == 23 + 76 + 3
    monkeypatch.setattr(phrases, "TASKS_PER_CORE", 1)
    got = phrases.mine_phrases(docs.repartition(40), min_count=6).collect()
    assert {tuple(r)[:8] for r in got} == plain_phrases(rows, 6)
    assert made[1].rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
