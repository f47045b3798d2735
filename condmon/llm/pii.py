"""Personal data: protected entities by pattern, and terms that give them away by information theory.

Entities are e-mail addresses, IP addresses, card and phone numbers. Over the whole corpus the documents that hold an
entity, a term, and both near one another are counted. A term whose pointwise mutual information with an entity comes near the
entity's own information content reveals it: who reads the term can infer the entity. Such terms are removed wherever they stand in
a document that holds the entity; those that reveal a good part of it are generalised to their kind of word. Nearness serves
the estimate alone. Documents without the entity keep the term: a reader finds no entity there to tie it to, and it is
often a common word in them. Terms are words, numbers and their mixtures of any length; below four characters they need a
capital or a digit. Entities near a term in fewer than SUPPORT documents get no terms.

Defined results:
* NULL or empty text has no spans. Offsets count code points, ends are exclusive.
* Repeated rows count as so many documents, and get equal spans. Documents without an entity get none.
* A NULL id is passed through. Other columns are left out.
* An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from condmon.llm.common import map_rows, named
from condmon.session import stored

# The forms of protected entities. An address is found from its @; the part before it ends there.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")

NEAR_CHARS = 80     # how far from an entity a term is taken to be about it
SUPPORT = 3         # documents in which a term must stand near an entity
REMOVE, GENERALISE = 0.9, 0.75  # parts of an entity's information from which a term is removed or generalised
TERM = re.compile(r"[^\W_]{2,}")   # words, numbers and their mixtures, of any length; see is_term
HELD = 200_000      # terms counted in a task before they leave it
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
FOUND = ("d bigint, k bigint, base array<struct<kind:string,start:bigint,end:bigint>>, es array<bigint>, "
         "near array<struct<e:bigint,t:string>>, text string")
MARKED = ("d bigint, k bigint, base array<struct<kind:string,start:bigint,end:bigint>>, "
          "terms array<struct<start:bigint,end:bigint,how:string>>")


def emails(text: str) -> list[tuple[str, int, int]]:
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return spans


def luhn(digits: str) -> bool:
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def small_part(part: str) -> bool:
    """At most 255, leading zeros included, whatever the number of digits."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def entities(text: str) -> list[tuple[str, int, int]]:
    """All protected spans in order of start, then kind."""
    spans = emails(text) if "@" in text else []
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdecimal, m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def same_entity(kind: str, value: str) -> str:
    """One writing for one entity."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(filter(str.isdigit, value))}"


def is_term(word: str) -> bool:
    """Short words need a capital or a digit: names and numbers, but no 'the'."""
    return len(word) >= 4 or not word.isalpha() or word != word.lower()


def terms_of(text: str) -> set[str]:
    return {t.lower() for t in set(TERM.findall(text)) if is_term(t)}


class Outside:
    """Tells whether a stretch lies outside of all spans (start, end)."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []   # the spans without overlaps
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end) - 1
        return before < 0 or self.ends[before] <= start


def found_rows(docs: DataFrame) -> DataFrame:
    """FOUND: the entities of each document, the terms near them, and the text of a document that has any."""
    def make():
        from xxhash import xxh3_64_intdigest

        def run(rows):
            for r in rows:
                text = r["t"] or ""
                spans = entities(text)
                near, held = set(), set()
                outside = Outside([(a, b) for _, a, b in spans])
                for kind, a, b in spans:
                    e = xxh3_64_intdigest(same_entity(kind, text[a:b])) - (1 << 63)
                    held.add(e)
                    low, high = max(0, a - NEAR_CHARS), min(len(text), b + NEAR_CHARS)
                    for m in TERM.finditer(text, low, high):
                        cut = (m.start() == low and low > 0) or (m.end() == high and high < len(text))
                        if not cut and is_term(m[0]) and outside(*m.span()):
                            near.add((e, m[0].lower()))
                yield (r["d"], r["k"], [{"kind": k, "start": a, "end": b} for k, a, b in spans], list(held),
                       [{"e": e, "t": t} for e, t in near], text if spans else None)

        return run

    return map_rows(docs.withColumn("k", F.xxhash64("d", "t")), make, FOUND)


def term_documents(docs: DataFrame) -> DataFrame:
    """(t, df): documents that hold a term, over all documents; tasks add up before anything is shuffled."""
    def make():
        def run(rows):
            counts: Counter = Counter()
            for r in rows:
                counts.update(terms_of(r["t"] or ""))
                if len(counts) > HELD:
                    yield from counts.items()
                    counts.clear()
            yield from counts.items()

        return run

    return map_rows(docs.select("t"), make, "t string, n bigint", flush=16384).groupBy("t").agg(F.sum("n").alias("df"))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(e, t, share): terms that reveal an entity, and the part of its information that they reveal.

    share = PMI(t; e) / IC(e) = log(n_et N / (n_e n_t)) / log(N / n_e), with numbers of documents.
    """
    total = found.count()
    # A row holds a pair once; equal rows count as often as they come.
    together = (found.select(F.array_distinct(F.transform("near", lambda x: F.struct(x["e"].alias("e"), x["t"].alias("t")))).alias("p"))
                .select(F.inline("p")).groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support))
    alone = (found.select(F.explode("es").alias("e"))
             .groupBy("e").agg(F.count(F.lit(1)).alias("n_e")))
    joined = together.join(alone, "e").join(term_documents(docs), "t")
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    mutual = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("df")))
    return joined.filter(content > 0).withColumn("share", mutual / content).filter(F.col("share") >= generalise).select("e", "t", "share")


def present_terms(found: DataFrame, telling: DataFrame) -> DataFrame:
    """(d, k, t, share): the telling terms that stand in a document together with their entity.

    Documents and terms meet by the term, not by the entity: an entity in many documents has as many rare terms, and
    each is in few of them. Where several entities mark one term, the larger share counts.
    """
    at = stored(found.select("d", "k", F.explode("es").alias("e")).join(telling.select("e").distinct(), "e").distinct(), "holders")
    with_any = at.select(F.col("d").alias("d2"), F.col("k").alias("k2")).distinct()
    texts = found.select("d", "k", "text").join(with_any, (F.col("k") == F.col("k2")) & F.col("d").eqNullSafe(F.col("d2")), "left_semi")

    def make():
        def run(rows):
            for r in rows:
                for t in terms_of(r["text"]):
                    yield r["d"], r["k"], t

        return run

    there = map_rows(texts, make, "d bigint, k bigint, t string", flush=16384).join(telling, "t")
    holder = at.select(F.col("d").alias("d2"), F.col("k").alias("k2"), F.col("e").alias("e2"))
    same = (F.col("k") == F.col("k2")) & (F.col("e") == F.col("e2")) & F.col("d").eqNullSafe(F.col("d2"))
    return there.join(holder, same, "left_semi").groupBy("d", "k", "t").agg(F.max("share").alias("share"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE,
                       generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(id_col, k, base, terms): per document its entities and the terms to remove or generalise, as spans.

    `k` is xxhash64(id, text), which leads `sanitised` back to the text.
    """
    source = named(docs, d=id_col, t=text_col)
    found = stored(found_rows(source), "entities")
    telling = stored(disclosing_terms(source, found, support, generalise), "disclosing")
    per_term = present_terms(found, telling)
    wanted = per_term.groupBy(F.col("d").alias("d2"), F.col("k").alias("k2")).agg(F.collect_list(F.struct("t", "share")).alias("wanted"))
    joined = found.select("d", "k", "base", "text").join(wanted, (F.col("k") == F.col("k2")) & F.col("d").eqNullSafe(F.col("d2")), "left")

    def make():
        def run(rows):
            for r in rows:
                yield r["d"], r["k"], r["base"], term_spans(r["text"], r["base"], r["wanted"], remove) if r["wanted"] else []

        return run

    marked = map_rows(joined.select("d", "k", "base", F.when(F.col("wanted").isNotNull(), F.col("text")).alias("text"), "wanted"),
                      make, MARKED)
    return marked.withColumnRenamed("d", id_col)


def term_spans(text: str, base: list[dict], wanted: list[dict], remove: float) -> list[dict]:
    """All places of the wanted terms outside the entities."""
    how = {w["t"]: "remove" if w["share"] >= remove else "generalise" for w in wanted}
    outside = Outside([(s["start"], s["end"]) for s in base])
    found = []
    for m in TERM.finditer(text):
        if is_term(m[0]) and (what := how.get(m[0].lower())) is not None:
            if outside(*m.span()):
                found.append({"start": m.start(), "end": m.end(), "how": what})
    return found


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col): entities become their kind in brackets, terms [...] or the kind of word they are."""
    source = named(docs, d=id_col, t=text_col).withColumn("k", F.xxhash64("d", "t"))
    spans = found.select(F.col(id_col).alias("d2"), F.col("k").alias("k2"), "base", "terms").dropDuplicates(["d2", "k2"])
    joined = source.join(spans, (F.col("k") == F.col("k2")) & F.col("d").eqNullSafe(F.col("d2")), "left")

    def make():
        def run(rows):
            for r in rows:
                yield r["d"], None if r["t"] is None else replaced(r["t"], r["base"] or [], r["terms"] or [])

        return run

    return map_rows(joined.select("d", "t", "base", "terms"), make, f"`{id_col}` bigint, `{text_col}` string")


def replaced(text: str, base: list[dict], terms: list[dict]) -> str:
    def shape(term: str) -> str:
        return "[NAME]" if term[:1].isupper() else "[WORD]"

    changes = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
    changes += [(s["start"], s["end"], "[...]" if s["how"] == "remove" else shape(text[s["start"]:s["end"]])) for s in terms]
    out, at = [], 0
    for start, end, new in sorted(changes):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join([*out, text[at:]])
