"""The corpus pipeline: each stage against brute force on a planted corpus, edge rows, and the whole run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from condmon.llm import toxicity
from condmon.llm.common import prepare
from condmon.llm.queries import vocabulary
from tests.llm.test_operators import linked_by_force

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def planted(seed=3, n=240):
    """(doc_id, text, toxic, kind): clean texts, toxic ones, copies, near copies, shared lines, leaks, empty ones."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ta", "re", "lo", "min", "sa", "du", "ke", "vor"]) for _ in range(rnd.randint(1, 3))) for _ in range(900)]
    bad = ["grobnik", "schlump", "dreckel"]
    items = [" ".join(rnd.choice(words) for _ in range(14)) for _ in range(4)]
    rows, bases = [], []
    for d in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(30, 90))]
        kind = rnd.choices(["clean", "toxic", "copy", "near", "line", "leak", "empty"], [40, 25, 8, 8, 10, 8, 2])[0]
        if kind == "toxic":
            for _ in range(4):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad + ["gr0bnik", "s c h l u m p", "drrreckel"]))
        if kind == "leak":
            text[5:5] = rnd.choice(items).split()
        if kind in ("copy", "near") and bases:
            text = list(rnd.choice(bases))
            if kind == "near":
                text[rnd.randrange(len(text))] = "anders"
        body = " ".join(text)
        if kind == "line":
            body = f"{body}\nA boilerplate line of every page\n{rnd.choice(words)}"
        if kind == "empty":
            body = rnd.choice([None, ""])
        if kind == "clean":
            bases.append(text)
        rows.append((d, body, int(kind == "toxic"), kind))
    return rows, items


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    prepare(spark)
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, items = planted()
    docs = [(d, t, "xx", "src", len(t or ""), "kept") for d, t, _, _ in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, y) for d, _, y, _ in rows], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def lines_by_force(texts):
    first = {}
    for d in sorted(texts):
        for line in (texts[d] or "").split("\n"):
            first.setdefault(line.strip().lower(), d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(x.strip()) < 10 or first[x.strip().lower()] == d]
        out[d] = t if len(stay) == len(lines) else "\n".join(stay)
    return out


def leaks_by_force(texts, items):
    windows = {tuple(i.split()[j:j + 10]) for i in items for j in range(len(i.split()) - 9)}
    hit = lambda t: any(tuple((t or "").split()[j:j + 10]) in windows for j in range(len((t or "").split()) - 9))
    return {d: t for d, t in texts.items() if not hit(t)}


def test_stages_against_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]

    kept = stages["toxicity"](spark, docs, folder)
    texts = texts_of(kept)
    wrong = [d for d, _, y, _ in rows if (d in texts) == bool(y)]
    assert len(wrong) <= 0.05 * len(rows) and kept.columns == docs.columns

    clean = spark.createDataFrame([(d, t, "xx", "src", 0, "kept") for d, t in texts.items()], SCHEMA).repartition(3)
    lined = stages["line dedup"](spark, clean, folder)
    assert texts_of(lined) == lines_by_force(texts) and lined.columns == docs.columns

    roots = linked_by_force(list(lines_by_force(texts).items()), 5, 80)
    single = stages["near duplicates"](spark, lined, folder)
    want = {d: t for d, t in lines_by_force(texts).items() if roots[d][0] == 0 or roots[d][1] == d}
    assert texts_of(single) == want and single.columns == docs.columns and len(want) < len(texts)

    safe = stages["decontamination"](spark, single, folder)
    assert texts_of(safe) == leaks_by_force(want, items) and safe.columns == docs.columns

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    back = {}
    for r in stages["packing"](spark, safe, folder).collect():
        back.setdefault(r["doc_id"], {})[r["start"]] = bytes(r["ids"])
    assert {d: b"".join(p[s] for s in sorted(p)) for d, p in back.items()} == {
        d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        for d, t in leaks_by_force(want, items).items()}


def test_run_gives_the_rows_of_the_stages(spark, corpus):
    folder, rows, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    found = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    by_kind = {d: kind for d, _, _, kind in rows}
    assert not any(by_kind[d] == "leak" for d in found)
    clean = [d for d, kind in by_kind.items() if kind == "clean"]
    assert len(found & set(clean)) >= 0.95 * len(clean)


def test_stages_take_odd_rows_and_empty_tables(spark, corpus):
    folder, _, _ = corpus
    clashing = SCHEMA.replace("extra", "hit_spans") + ", n_words string, score string, _text_key string, _line_keep string"
    odd = spark.createDataFrame([(*r, "a", None, "c", "d") for r in [(1, None, None, None, None, "a"), (None, "same words in this line here", None, "s", 1, None),
                                 (2, "same words in this line here", "x", None, None, None), (2, "same words in this line here", "x", None, None, None),
                                 (None, None, None, None, None, None), (3, "", "", "", 0, "")]], clashing)
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == odd.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        ids = sorted((r["doc_id"] for r in packed.filter(F.col("start") == 0).collect()), key=repr)
        # The line stays in the smallest id; of the repeated rows one document remains, the line's other holder is empty then.
        assert ids == ([] if rows is not odd else sorted([1, None, 2, None, 3], key=repr))


def test_labels_of_held_out_rows_are_not_learned(spark):
    import zlib
    labels = spark.createDataFrame([(d, 1) for d in range(200)], "doc_id bigint, toxic int")
    chosen = [r["d"] for r in toxicity.training_rows(labels, "doc_id", "toxic", 1000).collect()]
    assert sorted(chosen) == [d for d in range(200) if zlib.crc32(str(d).encode()) % 4 != 2]
    assert toxicity.training_rows(labels, "doc_id", "toxic", 10).count() == 10
