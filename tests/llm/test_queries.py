"""Every query of the package on the smallest tables: against its SQL, or against brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from checks.run import compare, connect
from condmon.llm import packing, pii, secrets
from condmon.llm.queries import ORACLES, QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(connect(DATA), ORACLES[name], QUERIES[name](spark, DATA)) is None


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_packing(spark, documents):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in documents.items()}
    rows = QUERIES["op2_packing"](spark, DATA).collect()
    at, by_sequence = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert r["start"] == at.get(r["doc_id"], 0) and r["length"] == len(part) // 4 > 0
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(x) for d, x in ids.items()}
    for pieces in by_sequence.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total == packing_window(total)


def packing_window(total):
    return total if total & (total - 1) == 0 and total <= 4096 else 4096


def test_warc(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in rows}
    first = {}
    for page, p in payloads.items():
        first[p] = min(first.get(p, page), page)
    want = {(page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == page else "revisit",
             None if first[p] == page else first[p]) for page, p in payloads.items()}
    got = [tuple(r) for r in QUERIES["op4_warc_index"](spark, DATA).collect()]
    assert len(got) == len(rows) and set(got) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_entities(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            total += int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c))
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(text):
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    assign = re.compile(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.mark.parametrize("name,plain,kinds", [("op5_pii", plain_entities, pii.BASE_KINDS),
                                              ("op10_secret_scan", plain_secrets, ("assign", "access", "hex"))])
def test_base_spans(spark, documents, name, plain, kinds):
    rows = QUERIES[name](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        spans = plain(documents[r["doc_id"]] or "")
        assert r["base_sha256"] == digest(spans)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(","))  or not spans
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)


def test_toxicity(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(rows[x["doc_id"]], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    toxic, clean = [r for r, y in held if y], [r for r, y in held if not y]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.9
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.03


def test_word_encoder_equals_the_tokenizer():
    import random
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        encode = packing.WordEncoder(f.read())
    rnd = random.Random(1)
    texts = ["a.. b., don't <|ENDoftext|> <|endoftext|>x. ÉCOLE ét. ﬁ ǅ 9. x9.", "ß. ẞ ΑΣ. ́a \x85b\xa0c a\x1cb.", ""]
    texts += ["".join(rnd.choice("aAéÉ.,!?' \n<|>s9́ßΣσİ中①ª ") for _ in range(25)) for _ in range(500)]
    for text in texts:
        want = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(want, "<u4").tobytes(), text


def test_word_encoder_remembers_words_that_come_again():
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        encode = packing.WordEncoder(f.read())
    once = " ".join(f"w{i:x}" for i in range(5000))
    first = encode(once)
    assert len(encode.young) + len(encode.old) < 500  # but for some that share a place, and their parts
    assert encode(once) == first == encode(once) and len(encode.young) >= 5000


def test_whitening(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], dtype=float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = centred @ vectors / np.sqrt(values)
    got = QUERIES["op12_embedding_whitening"](spark, DATA).toPandas()
    assert len(got) == n * 32 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-8
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < 1e-8
    first = got[got["component"] == 1].set_index("vec_id")
    assert first["deviation"].to_dict() == {r["vec_id"]: int(d) for r, d in zip(rows, ((n * x - sums) ** 2).sum(1))}
    explained = got.drop_duplicates("component").set_index("component")["explained"].sort_index()
    assert np.abs(explained.to_numpy() / (values / np.trace(centred.T @ centred / n)) - 1).max() < 1e-9
