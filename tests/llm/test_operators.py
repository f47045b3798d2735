"""Operators on small tables: NULLs, empty tables, repeated rows, clashing columns, hot groups, and brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from condmon.llm import (
    chat, common, components, decontamination, jaccard_join, line_dedup, packing, pii, repetition, secrets, toxicity, warc,
)
from condmon.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, k string, items string"
ODD = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "same line here", "x", "y"), (3, "same line here", "x", "y"),
       (None, "same line here\nanother", "x", "y"), (4, "SAME line here \nown words only", None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# line dedup

def test_line_dedup_edges(odd, empty):
    out = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd), n_lines="n", n_dropped="lost")
    assert rows_of(out.select("doc_id", "text", "k", "n", "lost")) == sorted([
        (1, None, "x", 1, 0), (2, "", "x", 1, 0), (3, "same line here", "x", 1, 0), (3, "same line here", "x", 1, 0),
        (None, "another", "x", 2, 1), (4, "own words only", None, 2, 1), (None, None, None, 1, 0)], key=repr)
    assert line_dedup.keep_bitmaps(empty).count() == 0
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).columns == empty.columns


def test_line_dedup_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(5, "only in one document"), (5, "only in one document"), (5, "only in one document\nx")],
                                 "doc_id bigint, text string")
    assert line_dedup.keep_bitmaps(docs).count() == 0


def test_line_dedup_long_and_hot(spark):
    rnd = random.Random(2)
    texts = [(d, "\n".join(rnd.choice(["A very common line", f"  a rare line {rnd.randrange(300)}", "short", f"line {d} {i} of its own"])
                           for i in range(rnd.choice([1, 5, 70, 400])))) for d in range(120)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    first = {}
    for d, t in texts:
        for line in t.split("\n"):
            first.setdefault(line.strip().lower(), d)
    want = {d: "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or first[x.strip().lower()] == d) for d, t in texts}
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


# packing

def test_packing_edges(odd, empty):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack(odd, path).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert len([r for r in rows if r["start"] == 0]) == len(ODD)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("sizes", [[], [1], [16], [17] * 9, [3, 200, 5, 15, 16, 1, 1], list(range(1, 60))])
def test_packed_windows_hold_every_id_once(sizes):
    docs = [(d, np.arange(n, dtype="<u4").tobytes()) for d, n in enumerate(sizes)]
    rows = list(packing.packed(iter(docs), 16, 3, 100))
    back = {}
    for d, start, n, ids, total, sequence, offset, length in rows:
        assert total == sizes[d] and n == len(ids) // 4 and offset + n <= length <= 16
        back.setdefault(d, {})[start] = ids
    assert {d: b"".join(p[s] for s in sorted(p)) for d, p in back.items()} == dict(docs)
    lengths = Counter()
    for row in rows:
        lengths[row[5], row[7]] += row[2]
    assert all(n == length and length & (length - 1) == 0 for (_, length), n in lengths.items())


# n-gram Jaccard join

def linked_by_force(texts, words, percent):
    sets = {}
    for d, t in texts:
        ws = [w.decode() for w in (t or "").encode().lower().split()]
        k = min(words, len(ws))
        sets[d] = {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if k else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common_part = len(sets[a] & sets[b])
            if common_part and 100 * common_part >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def noisy_copies(seed, n=140):
    rnd = random.Random(seed)
    vocabulary_ = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary_) for _ in range(40)]
    bases = [[rnd.choice(vocabulary_) for _ in range(rnd.choice([2, 8, 30, 60, 120]))] for _ in range(6)]
    out = []
    for d in range(n):
        kind = rnd.random()
        if kind < 0.6:
            words = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary_)
        elif kind < 0.9:  # a shared passage in otherwise different texts
            words = [rnd.choice(vocabulary_) for _ in range(20)] + passage + [rnd.choice(vocabulary_) for _ in range(20)]
        else:
            words = [rnd.choice(vocabulary_) for _ in range(rnd.randrange(4))]
        out.append((d, " ".join(words)))
    return out


@pytest.mark.parametrize("seed,few,block,words,percent", [(1, 16, 128, 3, 90), (2, 2, 4, 3, 90), (3, 2, 3, 2, 80)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, few, block, words, percent):
    """Low limits send the hot elements through part signatures, leaders and blocks."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1 if few == 2 else 3)
    texts = noisy_copies(seed)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    out = jaccard_join.jaccard_components(docs, words=words, percent=percent)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == linked_by_force(texts, words, percent)


def test_blocks_of_few_elements_and_a_short_table_of_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 1)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(jaccard_join, "COMMON", 40)
    texts = noisy_copies(4)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    out = jaccard_join.jaccard_components(docs, words=3, percent=80)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == linked_by_force(texts, 3, 80)


@pytest.mark.parametrize("partitions,most", [(1, 1 << 20), (7, 1 << 20), (3, 200)])
def test_frequent_elements_are_counted_over_all_documents(spark, monkeypatch, partitions, most):
    monkeypatch.setattr(jaccard_join, "COMMON", most)
    texts = noisy_copies(5)
    counts = Counter(int(e) >> 32 for _, t in texts for e in jaccard_join.shingles(t, 3))
    docs = spark.createDataFrame([(t,) for _, t in texts], "t string").repartition(partitions)
    keys, sizes = jaccard_join.frequent_elements(docs, 3)
    expected = {e: n.bit_length() - 1 for e, n in counts.items() if n >= 4}
    while len(expected) > most:
        expected = {e: n for e, n in expected.items() if n > min(expected.values())}
    assert dict(zip(keys.tolist(), sizes.tolist())) == expected and (np.diff(keys.astype(np.int64)) > 0).all()
    s = jaccard_join.shingles(texts[0][1], 3)
    ordered = jaccard_join.rare_first(s, keys, sizes)
    assert ordered.tolist() == sorted(s.tolist(), key=lambda e: (expected.get(e >> 32, 0), e))


def test_forest_joins_each_component_once():
    base = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.unique(np.concatenate([base[:-1], base[-1:] + np.uint64(i)])) for i in range(60)]
    rows = [(True, True, b"%d" % i, b"%d" % i, s) for i, s in enumerate(sets)]
    assert len(list(jaccard_join.forest(rows, jaccard_join.Rule(3, 90)))) == 59
    sides = [(False, i % 2 == 0, *r[2:]) for i, r in enumerate(rows)]
    assert len(list(jaccard_join.forest(sides, jaccard_join.Rule(3, 90)))) == 59


def test_jaccard_edges(odd, empty):
    out = rows_of(jaccard_join.jaccard_components(odd, words=3, percent=90))
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 2, None), (4, 4, 4), (None, 0, None)], key=repr)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.representatives(empty).columns == empty.columns
    kept = jaccard_join.representatives(odd, words=3, percent=50)
    assert kept.columns == odd.columns
    assert rows_of(kept.select("doc_id", "text")) == sorted(
        [(1, None), (2, ""), (3, "same line here"), (4, "SAME line here \nown words only"), (None, None)], key=repr)


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        pool = rnd.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = np.unique(rnd.choice(pool, rnd.integers(1, 300))), np.unique(rnd.choice(pool, rnd.integers(1, 300)))
        assert jaccard_join.apart(jaccard_join.sketch_of(a), jaccard_join.sketch_of(b)) <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_prefix_element_and_a_part():
    rnd = np.random.default_rng(1)
    for percent in (80, 90):
        rule = jaccard_join.Rule(3, percent)
        for _ in range(300):
            base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 200)).astype(np.uint64))
            other = np.unique(np.concatenate([rnd.choice(base, max(1, int(len(base) * rnd.uniform(0.85, 1))), replace=False),
                                              rnd.integers(0, 1 << 63, rnd.integers(0, 8)).astype(np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if 100 * shared < percent * len(np.union1d(base, other)):
                continue
            assert np.intersect1d(base[:rule.prefix(len(base))], other[:rule.prefix(len(other))]).size
            keys = [{(label + i, j, sig) for i, sigs in enumerate(both) for j, sig in enumerate(sigs)}
                    for label, *both in (jaccard_join.part_signatures(base, rule), jaccard_join.part_signatures(other, rule))]
            assert keys[0] & keys[1]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    out = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert {r["node"]: r["root"] for r in out.collect()} == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# decontamination

def test_contamination_edges(spark, odd, empty):
    items = spark.createDataFrame([(7, "Same LINE-here"), (7, "same line here"), (None, "own words"), (8, None), (9, "")],
                                  "item_id bigint, text string")
    out = decontamination.find_contamination(odd, items)
    assert set(out.columns) == {"doc_id", "text", "k", "n_words", "hit_spans", "items"}
    got = sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["hit_spans"]], r["items"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, 0, [], []), (2, 0, [], []), (3, 3, [(0, 3)], [7]), (3, 3, [(0, 3)], [7]),
                          (None, 4, [(0, 3)], [7]), (4, 6, [(0, 5)], [7]), (None, 0, [], [])], key=repr)
    assert decontamination.find_contamination(empty, items).count() == 0
    assert all(not r["items"] for r in decontamination.find_contamination(odd, items.limit(0)).collect())


def test_contamination_in_shards(spark, odd, monkeypatch):
    items = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate([("same", "line"), ("line", "here"), ("own", "words")])],
                                  "item_id bigint, text string")
    whole = rows_of(decontamination.find_contamination(odd, items).select("doc_id", "n_words", "hit_spans", "items"))
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 10)
    assert rows_of(decontamination.find_contamination(odd, items).select("doc_id", "n_words", "hit_spans", "items")) == whole


def test_wu_manber_against_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        letters = [b"a", b"b", b"c"][:rnd.choice([2, 3])]
        items = [(i, b" ".join(rnd.choice(letters) for _ in range(rnd.randrange(8))).decode()) for i in range(4)]
        words = [rnd.choice(letters) for _ in range(rnd.randrange(40))]
        hit, found = set(), set()
        for i, text in items:
            ws = text.encode().split()
            n = min(5, len(ws))
            windows = {tuple(ws[j:j + n]) for j in range(len(ws) - n + 1)} if n else set()
            for j in range(len(words) - n + 1):
                if tuple(words[j:j + n]) in windows:
                    hit.update(range(j, j + n))
                    found.add(i)
        n, spans, ids = decontamination.hits_of(b" ".join(words).decode(), decontamination.searchers(items, 5))
        assert n == len(words) and ids == sorted(found)
        assert {p for a, b in spans for p in range(a, b)} == hit


# WARC

def test_warc_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://B.a.org/x?q=1#f", "same"), (2, None, "same"), (2, None, "same"), (3, "http://B.a.org/x?q=1", None), (4, "", ""),
         (None, "no url", "same"), (5, "http://b.a.org:80/ü \r\nx", "é\r\n\r\nWARC/1.1\r\n"), (1, "twice", "same")],
        "page_id bigint, url string, html string")
    folder = warc.archive_folder(spark)
    captures = warc.write_archives(pages, folder)
    parts = warc.build_index(captures, folder)
    out = warc.read_records(warc.lookup(warc.key_table(pages), parts)).collect()
    got = sorted(((r["id"], r["kind"], r["payload_bytes"], r["refers_to"]) for r in out), key=repr)
    assert got == sorted([(1, "response", 4, None), (1, "response", 4, None), (2, "revisit", 4, 1), (2, "revisit", 4, 1),
                          (None, "revisit", 4, 1), (3, "response", 0, None), (4, "revisit", 0, 3),
                          (5, "response", len("é\r\n\r\nWARC/1.1\r\n".encode()), None)], key=repr)
    assert {bytes(r["payload"]) for r in out if r["id"] == 5} == {"é\r\n\r\nWARC/1.1\r\n".encode()}
    one = warc.lookup(spark.createDataFrame([("org,a,b)/x?q=1",), ("zz",), (None,)], "key string"), parts)
    assert sorted(r["id"] for r in one.collect()) == [1, 3]
    none = warc.write_archives(pages.limit(0), folder)
    assert warc.lookup(warc.key_table(pages), warc.build_index(none, folder)).count() == 0


def test_index_blocks_of_one_key(spark, monkeypatch):
    """A key that fills many blocks and parts is found whole."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, "http://a.org/hot" if i % 3 else f"http://a.org/{i}", f"p{i}") for i in range(200)],
                                  "page_id bigint, url string, html string")
    folder = warc.archive_folder(spark)
    parts = warc.build_index(warc.write_archives(pages, folder), folder)
    found = warc.read_records(warc.lookup(warc.key_table(pages), parts)).collect()
    assert sorted((r["id"], bytes(r["payload"]).decode()) for r in found) == [(i, f"p{i}") for i in sorted(range(200))]


@pytest.mark.parametrize("url,key", [("https://www.Ex.com:8443/a/b?c=d#e", "com,ex,www:8443)/a/b?c=d"), ("http://ex.com", "com,ex)/"),
                                     (None, ""), ("", ""), ("mailto:x", "mailto:x"), ("http://[bad", "http://[bad")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


# personal data

def test_pii_edges(odd, empty):
    out = pii.find_personal_data(odd)
    assert out.count() == len(ODD) and out.filter(F.size("base") + F.size("terms") > 0).count() == 0
    assert pii.find_personal_data(empty).count() == 0


def test_telling_terms_are_removed_only_near_their_entity(spark):
    rnd = random.Random(4)
    common_words = ["people", "there", "would", "about", "other"]
    texts = [f"{rnd.choice(common_words)} Quillon met {rnd.choice(common_words)} anna@ex.org {rnd.choice(common_words)}" for _ in range(6)]
    texts += [" ".join(rnd.choice(common_words) for _ in range(12)) for _ in range(200)] + ["Quillonia there bob@ex.org people"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find_personal_data(docs)
    terms = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["terms"]] for r in found.collect()}
    assert all(terms[d] == ["Quillon"] for d in range(6)) and not any(terms[d] for d in range(6, 207))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, found).collect()}
    assert "[EMAIL]" in clean[0] and "Quillon" not in clean[0] and "anna" not in clean[0]
    assert clean[10] == texts[10]


def test_telling_terms_go_everywhere_in_documents_of_their_entity(spark):
    far = "some other words stand here " * 10
    texts = [f"Quillon met anna@ex.org {far}and Quillon {far}" for _ in range(5)] + [f"here anna@ex.org stand {far}Quillon"] + [far] * 200
    docs = spark.createDataFrame(list(enumerate([*texts, "Quillon here"])), "doc_id bigint, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["terms"]]
             for r in pii.find_personal_data(docs).filter("doc_id < 206").collect()}
    assert all(found[d] == ["Quillon", "Quillon"] for d in range(5)) and found[5] == ["Quillon"]
    assert not any(found[d] for d in range(6, 206))


def test_an_entity_counts_in_documents_without_terms_around_it(spark):
    texts = ["Quillon met anna@ex.org"] * 4 + ["anna@ex.org"] * 6 + ["Quillon here"] + ["some other words"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "d bigint, t string")
    r, = pii.disclosing_terms(docs, pii.found_rows(docs)).collect()
    assert r["t"] == "quillon" and r["share"] == pytest.approx(np.log(4 * 211 / (10 * 5)) / np.log(211 / 10))


def test_terms_of_any_length_and_with_digits_can_tell(spark):
    long = "x" + "abcdefghij" * 5
    texts = [f"Lee 10115 {long} anna@ex.org"] * 4 + ["some other words"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["terms"]] for r in pii.find_personal_data(docs).collect()}
    assert all(found[d] == ["Lee", "10115", long] for d in range(4)) and not any(found[d] for d in range(4, 304))


def plain_terms(texts):
    """The term spans by definition: every entity with every term of the corpus."""
    entities = [[(pii.same_entity(k, t[a:b]), a, b) for k, a, b in pii.entities(t)] for t in texts]
    words = [[(m[0].lower(), *m.span()) for m in pii.TERM.finditer(t) if pii.is_term(m[0])] for t in texts]
    free = [[w for w in ws if all(w[2] <= a or b <= w[1] for _, a, b in es)] for ws, es in zip(words, entities)]
    out = [{} for _ in texts]
    for e in {e for es in entities for e, *_ in es}:
        holds = [any(x == e for x, *_ in es) for es in entities]
        for t in {t for ws in words for t, *_ in ws}:
            near = sum(any(x == e and y == t and (c > a - 80 or c == 0 >= a - 80) and (d < b + 80 or d == len(text) <= b + 80)
                           for x, a, b in es for y, c, d in ws) for es, ws, text in zip(entities, free, texts))
            if near < pii.SUPPORT:
                continue
            content = np.log(len(texts) / sum(holds))
            df = sum(any(y == t for y, *_ in ws) for ws in words)
            share = np.log(near * len(texts) / (sum(holds) * df)) / content if content > 0 else 0
            if share >= pii.GENERALISE:
                for i in (i for i, h in enumerate(holds) if h):
                    for y, c, d in free[i]:
                        if y == t:
                            out[i][c, d] = max(share, out[i].get((c, d), 0))
    return [sorted((c, d, "remove" if s >= pii.REMOVE else "generalise") for (c, d), s in o.items()) for o in out]


def test_terms_equal_brute_force(spark):
    rnd = random.Random(11)
    names = [f"name{i}" for i in range(12)]
    texts = []
    for i in range(160):
        parts = [rnd.choice(["people", "there", "would", "12", "ab"]) for _ in range(rnd.randint(0, 40))]
        for who in rnd.sample(range(6), rnd.choice([0, 0, 1, 1, 2])):
            at = rnd.randint(0, len(parts))
            parts[at:at] = [names[who], f"p{who}@ex.org", names[6 + rnd.randrange(6)]]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: sorted((s["start"], s["end"], s["how"]) for s in r["terms"]) for r in pii.find_personal_data(docs).collect()}
    want = dict(enumerate(plain_terms(texts)))
    assert got == want and sum(map(bool, want.values())) > 20


def test_a_hot_entity_with_as_many_rare_terms_stays_linear(spark):
    def rows(n):
        texts = [f"term{i // 3}x anna@ex.org" for i in range(n)] + ["some other words"] * n
        docs = spark.createDataFrame(list(enumerate(texts)), "d bigint, t string")
        found = pii.found_rows(docs)
        telling = pii.disclosing_terms(docs, found).cache()
        assert telling.count() == n // 3
        return pii.present_terms(found, telling).count()

    assert rows(300) == 300 and rows(1200) == 1200


# quality rules

def test_quality_edges(odd, empty):
    out = repetition.quality(odd)
    assert "k" in out.columns and out.filter("kept").count() == 0 and out.count() == len(ODD)
    assert repetition.quality(empty).count() == 0


def test_repeats_against_brute_force():
    rnd = random.Random(0)
    for _ in range(150):
        texts = [[rnd.choice([b"a", b"b", b"c"][:rnd.choice([1, 2, 3])]) for _ in range(rnd.randint(0, 50))] for _ in range(3)]
        texts.append(texts[0])
        for ws, (covered, longest, spans) in zip(texts, repetition.repeats(texts, 8)):
            counts = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
            hit = {p for i in range(len(ws) - 7) if counts[tuple(ws[i:i + 8])] > 1 for p in range(i, i + 8)}
            assert covered == len(hit) and {p for a, b in spans for p in range(a, b)} == hit
            best = 0
            for n in range(len(ws) - 1, 7, -1):
                if max(Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)).values()) > 1:
                    best = n
                    break
            assert longest == best


def test_quality_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 700}" for i in range(30_000))
    r = repetition.quality(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r["n_words"], r["n_repeat_words"], r["longest_repeat"], r["kept"]) == (30_000, 30_000, 29_300, False)


# chat

@pytest.mark.parametrize("text", ["", "plain", "[INST]", "[\\INST]", "<|end|><\\|end|>", "\\</s>[/INST]<s>", "<s<s>>", "<|turn|", "ünï\n"])
def test_escaping_is_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert not any(c in chat.escaped(text) for c in ("<|end|>", "<|turn|>", "<|text|>", "[INST]", "</s>"))


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, "assistant", "hi <|end|>", "x"), (1, None, None, "first", "x"),
                                   (None, 0, "assistant", "", "x"), (1, 1, "assistant", "hi <|end|>", "x")],
                                  "conv_id bigint, turn bigint, role string, text string, ids string")
    path = vocabulary("byte_bpe_50k.tiktoken")
    made = chat.assemble(turns, path)
    back = chat.read_back(made, path)
    assert [(r["role"], r["text"], r["loss"]) for r in back.filter("conv_id = 1").orderBy("position").collect()] == [
        ("", "first", ""), ("user", "", ""), ("assistant", "hi <|end|>", "hi <|end|>"), ("assistant", "hi <|end|>", "hi <|end|>")]
    out = {r["conv_id"]: r for r in chat.digests(back).collect()}
    assert out[1]["n_turns"] == 4 and out[1]["loss_chars"] == 20 and out[None]["n_turns"] == 1
    rows = made.filter("conv_id = 1").orderBy("position").collect()
    assert [r["offset"] for r in rows] == [sum(len(q["ids"]) // 4 for q in rows[:i]) for i in range(4)]
    assert chat.digests(chat.read_back(chat.assemble(turns.limit(0), path), path)).count() == 0


# toxicity

def test_decoder_restores_disguised_words():
    trigrams = Counter()
    for word, n in (("idiot", 40), ("stupid", 40), ("moron", 40), ("the", 400), ("letter", 60), ("scum", 30), ("loser", 40)):
        s = f"^^{word}^"
        for i in range(len(s) - 2):
            trigrams[s[i:i + 3]] += n
    decoder = toxicity.Decoder(trigrams)
    for seen, meant in (("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("m0r0n", "moron"), ("scuuuum", "scum"), ("l0s3r", "loser"),
                        ("$tupid", "stupid")):
        assert toxicity.disguised(seen) and decoder.decode(seen) == meant
    assert not toxicity.disguised("letter") and not toxicity.disguised("1234")
    assert {"idiot", "scum"} <= toxicity.restored_words("you i d i o t and s c u m", decoder)
    assert toxicity.restored_words(None, decoder) == set()


def small_decoder():
    trigrams = Counter()
    for word, n in (("idiot", 40), ("stupid", 40), ("ass", 40), ("the", 400), ("you", 300), ("are", 300), ("an", 300), ("scum", 30)):
        s = f"^^{word}^"
        for i in range(len(s) - 2):
            trigrams[s[i:i + 3]] += n
    return toxicity.Decoder(trigrams)


def test_spelled_passages_are_read_word_by_word_to_their_end():
    decoder = small_decoder()
    said = lambda text: toxicity.restored_words(text, decoder)
    assert {"you", "are", "an", "idiot"} <= said("y o u a r e a n i d i o t")
    assert "idiot" in said(" ".join("youarethe" * 60) + " i d i o t") and "idiot" in said("i  d  i  o  t")
    assert "idiot" in said("i\td\ti\no\nt") and "ass" in said("you a s s") and "idiot" in said("1 d 1 0 t")
    assert decoder.decode(list("youare" * 500), breaks=True).split() == ["you", "are"] * 500


@pytest.mark.parametrize("token,meant", [
    ("idi" + "o" * 60 + "t", "idiot"), ("i.d." * 1 + "i.o." + "." * 40 + "t", "idiot"), ("a$$", "ass"), ("$$tupid", "stupid"),
    ("(a$$)", "ass"), ("a$$!", "ass"), ("455", "ass"), ("4$$", "ass"), ("idiot!!!", "idiot"), ("(the", "the"), ("st" + "u" * 50 + "p1d", "stupid")])
def test_long_tokens_and_leet_edges_reach_the_decoder(token, meant):
    assert meant in toxicity.restored(token, small_decoder())


def test_a_number_stays_a_word_too():
    assert "1488" in toxicity.restored("1488", small_decoder()) and toxicity.restored("...", small_decoder()) == set()


def test_toxicity_trigrams_are_added_up_in_tasks(spark):
    """Trigrams counted by place equal those counted one by one, and no word leaves a task, only trigrams."""
    words = [("scum", 3), ("été", 2), ("a", 5), ("straße", 1), ("́", 2), ("ª", 1)]
    want = Counter()
    for word, n in words:
        s = f"^^{toxicity.plain(word)}^"
        for i in range(len(s) - 2):
            want[s[i:i + 3]] += n
    counts, many = toxicity.trigram_counts(words), len(toxicity.SYMBOLS)
    got = {toxicity.SYMBOLS[i // many ** 2] + toxicity.SYMBOLS[i // many % many] + toxicity.SYMBOLS[i % many]: int(counts[i])
           for i in counts.nonzero()[0]}
    assert got == want and not toxicity.trigram_counts([]).any()
    docs = spark.createDataFrame([("Scum, scum été",), (None,), ("SCUM a1 " + "x" * 33 + " " + "y" * 99,), ("été!",)], "text string")
    plain = Counter()
    for word, n in (("scum", 3), ("été", 2)):
        s = f"^^{toxicity.plain(word)}^"
        for i in range(len(s) - 2):
            plain[s[i:i + 3]] += n
    assert toxicity.trigram_table(docs) == plain


def test_toxicity_tokens_without_weight_are_looked_up_once():
    decoder = small_decoder()
    describe = toxicity.Describer(toxicity.Model({}, {"idiot$": 2.0, "scu": 1.5, "ab$": 1.0}), decoder)
    asked, weigh = [], describe.model.word_weight
    describe.model.word_weight = lambda word: asked.append(word) or weigh(word)
    first = describe("you idiot scummy ab house")
    assert first == describe("you idiot scummy ab house") and first[1] == 2.0 and set(asked) == {"idiot", "scummy", "ab"}
    assert len(asked) == 3 and describe.nothing == {"you", "house"}


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score(odd, model)
    assert out.count() == len(ODD) and {r["score"] for r in out.collect()} == {0.0}
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


# secrets

def test_random_strings_are_told_from_words_and_known_identifiers(spark, odd, empty):
    path = vocabulary("byte_bpe_50k.tiktoken")
    texts = ["key qX7vR2pLz9Kd4WbT8mYh here", "Donaudampfschifffahrtsgesellschaft", "550e8400-e29b-41d4-a716-446655440000",
             "www.example.com/some/path/to/file.html", "2024-01-02.2024-01-02", "d41d8cd98f00b204e9800998ecf8427e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["secrets"]]
           for r in secrets.scan(docs, path).collect()}
    assert got == {0: [("random", "qX7vR2pLz9Kd4WbT8mYh")], 1: [], 2: [], 3: [], 4: [], 5: [("hex", texts[5])]}
    assert secrets.scan(odd, path).filter(F.size("secrets") > 0).count() == 0 and secrets.scan(empty, path).count() == 0


def token_lengths():
    import tiktoken
    ranks = chat.load_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    encode = tiktoken.Encoding("t", pat_str=chat.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sizes = {rank: len(token) for token, rank in ranks.items()}
    return lambda part: [sizes[i] for i in encode(part)]


def random_parts(text, pieces):
    return [text[a:b] for _, a, b in secrets.random_spans(text, secrets.pattern_spans(text), pieces, secrets.CHARS_PER_TOKEN)]


def test_random_parts_of_links_and_paths_are_found():
    pieces = token_lengths()
    token = "qX7vR2pLz9Kd4WbT8mYh"
    for text in (f"hooks.example.com/services/{token}", f"0123456789abcdef/{token}", f"{token}.0123456789abcdef",
                 f"some/very/long/readable/path/with/many/ordinary/words/before/the/value={token}", f"1.2.3-{token}"):
        assert any(token in found for found in random_parts(text, pieces)), text
    for text in ("www.example.com/some/path/to/file.html", "0123456789abcdef/some/readable/words"):
        assert random_parts(text, pieces) == []


def test_random_strings_of_one_case_are_found_and_words_are_not():
    pieces = token_lengths()
    for text in ("xkqzjwvbnqpzmtrhgfdk", "mfrggzdfmztwq2lkmfrgg", "XKQZJWVBNQPZMTRHGFDK", "ABCD-1F3G-9K2L-X7Q4-ZZ8P"):
        assert random_parts(text, pieces) == [text]
    for text in ("INSUFFICIENT_PRIVILEGE_FOR_REQUEST", "getHTTPResponseCodeFromURLString", "a-b-c-d-e-f-g-h-i-j-k", "a" * 40,
                 "Donaudampfschifffahrtsgesellschaft", "MD5=D41D8CD98F00B204E9800998ECF8427E", "2024-01-02T10:11:12.123456"):
        assert random_parts(text, pieces) == []


def test_a_random_string_is_found_wherever_it_lies_in_a_long_run():
    pieces = token_lengths()
    token = "qX7vR2pLz9Kd4WbT8mYh4Jf8"
    for offset in (0, 1, 15, 3000, *range(4070, 4110), 8190, 100_003):
        for filler in ("a", "readable/words/", "somewordsthatfollow"):
            text = (filler * offset)[:offset] + token + "x" * 30 + "/readable/again"
            # a token may hold a character on either side of the border
            assert any(token[1:-1] in found for found in random_parts(text, pieces)), (offset, filler)


def test_stretches_equal_a_search_over_all_starts_and_ends():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = rng.choice([1, 1, 2, 3, 5], rng.integers(0, 30)).tolist()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        found = secrets.stretches(lengths, 2.0)
        score = {(i, j): 2.0 * (j - i) - sum(lengths[i:j]) for i in range(len(lengths)) for j in range(i + 1, len(lengths) + 1)}
        place = {int(e): i for i, e in enumerate(ends)}
        scores = [score[place[a], place[b]] for a, b in found]
        assert all(x > 0 for x in scores) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        # nothing positive is left outside of what was found, and no stretch gets better by its own ends
        covered = {k for a, b in found for k in range(place[a], place[b])}
        assert all(v <= 0 for (i, j), v in score.items() if not covered & set(range(i, j)))
        for (a, b), x in zip(found, scores):
            i, j = place[a], place[b]
            assert all(score[i, k] < x for k in range(i + 1, j))
