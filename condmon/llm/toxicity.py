"""Toxicity: undo leetspeak, spacing and repetition with a noisy-channel decoder, then score the restored words.

The character language model (trigrams within words) is counted over the words of all texts. A token that looks disguised
becomes a lattice of the letters each character may stand for, and Viterbi decoding picks the reading that
language model and channel together find likeliest. Scores come from words and word beginnings that labelled documents show to be
toxic, calibrated on labelled documents that took no part in choosing them.

Defined results:
* NULL and empty texts have no words and get the score of a text in which nothing toxic is found.
* Labels with a NULL id or value are ignored; of several labels of one id the highest counts.
* A NULL id is not held out and never learned from. Repeated rows get equal scores.
* Without learned labels of both classes in both halves of the sample nothing can be told, and every score is 0.
* All columns of the documents are kept; result columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import filterfalse
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from condmon.llm.common import give_back, map_rows, named
from condmon.session import stored

TRAIN_ROWS = 20_000     # labelled documents learned from, the first under a hash of their ids
FEATURES = 20_000       # words and beginnings a model holds at most, the surest first
LEAST_TOXIC = 3         # toxic documents that must hold a feature
SURENESS = 1.64         # standard errors taken off a log odds ratio
LEAST_WEIGHT = 0.5
BEGINNINGS = (3, 4, 5, 6, 7, 8)
HEAD = min(BEGINNINGS)
CACHED_TOKENS = 200_000
LONGEST_TOKEN = 32      # longer words do not count in the language model; they are decoded all the same

# What characters stand for in leetspeak, and the marks put between spelled-out letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = ".-_*~'/"
OPEN_OR_END = "!("
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
OTHER, EDGE = "?", "^"
COST_LEET, COST_LITERAL, COST_DROP_MARK, COST_DROP_REPEAT, COST_KEEP_REPEAT = 1.5, 6.0, 0.5, 0.7, 2.5
COST_JOIN = 3.0     # a wide gap between spelled letters that ends no word
LIKELY = 5.0        # how much costlier than the best a division of spelled letters into words may be
SETTLED = 256       # symbols after which the letters that all readings share are written out

SPELLED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
GAP = re.compile(r"\s+")
REPEATED = re.compile(r"(.)\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
EDGES = ".,;:!?\"'()[]{}<>%#&*$|-_=~`^/\\"
BARE_EDGES = "".join(c for c in EDGES if c not in LEET)
SYMBOLS = ALPHABET + OTHER + EDGE


def plain(word: str) -> str:
    """A word in the letters the language model knows: accents off, all else OTHER."""
    if word.isascii() and word.isalpha():
        return word
    bare = (c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return "".join(c if c in ALPHABET else OTHER for c in bare)


def cleaned(tokens: Counter) -> Iterator[tuple[str, int]]:
    """(word, n) of the tokens that count in the language model."""
    for token, n in tokens.items():
        word = token.strip(EDGES)
        if word.isalpha() and len(word) <= LONGEST_TOKEN:
            yield word, n


def trigram_counts(words: Sequence[tuple[str, int]]) -> np.ndarray:
    """How often each trigram comes in words found n times, by the places of its characters in SYMBOLS."""
    many = len(SYMBOLS)
    place = np.zeros(128, np.int64)
    place[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(many)
    parts = [f"{EDGE}{EDGE}{plain(w)}{EDGE}" for w, _ in words]
    size = np.array([len(p) for p in parts], np.int64)
    code = place[np.frombuffer("".join(parts).encode(), np.uint8)]
    begins = np.ones(len(code), bool)   # the last two characters of a word begin no trigram
    ends = np.cumsum(size)
    begins[ends - 1] = begins[ends - 2] = False
    at = np.flatnonzero(begins)
    grams = (code[at] * many + code[at + 1]) * many + code[at + 2]
    n = np.repeat(np.array([n for _, n in words], np.int64), size - 2)
    out = np.zeros(many ** 3, np.int64)
    np.add.at(out, grams, n)
    return out


def trigram_table(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts of character trigrams over the words of all texts; the alphabet of 28 characters bounds them at 28 cubed, about 22,000.

    Tasks count their tokens, and add up trigrams before anything is shuffled."""
    def make():
        def run(rows):
            tokens: Counter = Counter()
            counts = np.zeros(len(SYMBOLS) ** 3, np.int64)
            for r in rows:
                found = (r["t"] or "").lower().split()
                if max(map(len, found), default=0) > 2 * LONGEST_TOKEN:
                    found = [t for t in found if len(t) <= 2 * LONGEST_TOKEN]
                tokens.update(found)
                if len(tokens) > CACHED_TOKENS:
                    counts += trigram_counts(list(cleaned(tokens)))
                    tokens.clear()
            counts += trigram_counts(list(cleaned(tokens)))
            many = len(SYMBOLS)
            for i in np.flatnonzero(counts).tolist():
                yield SYMBOLS[i // many ** 2] + SYMBOLS[i // many % many] + SYMBOLS[i % many], int(counts[i])

        return run

    grams = map_rows(named(docs, t=text_col), make, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in grams.collect()}


class Decoder:
    """Viterbi decoding of a token's character lattice; the state is the last two letters read."""

    def __init__(self, trigrams: dict[str, int]):
        pairs: Counter = Counter()
        for gram, n in trigrams.items():
            pairs[gram[:2]] += n
        self.trigrams, self.pairs, self.known, self.heard = trigrams, pairs, {}, {}

    def cost(self, state: str, letter: str) -> float:
        key = state + letter
        found = self.known.get(key)
        if found is None:
            found = math.log(self.pairs.get(state, 0) + 14) - math.log(self.trigrams.get(key, 0) + 0.5)
            self.known[key] = found
        return found

    def readings(self, symbol: str) -> list[tuple[str, float, str]]:
        """(reading, its cost, the letter that the language model hears) of a character."""
        found = self.heard.get(symbol)
        if found is None:
            ways = [(x, COST_LEET) for x in LEET.get(symbol, "")]
            ways.append((symbol, 0.0 if plain(symbol) in ALPHABET else COST_LITERAL))
            found = [(x, extra, c) for x, extra in ways for c in (plain(x) if x.isalpha() else OTHER)[:1]]
            self.heard[symbol] = found
        return found

    def decode(self, token: Sequence[str], breaks: bool = False, head: int = 0, tail: int = 0, exact: bool = False) -> str:
        """The likeliest word behind a lower-case token.

        The first `head` and last `tail` characters may be punctuation and be dropped. With `exact` no repeat is dropped.

        With `breaks`, the likeliest words behind spelled-out letters, with blanks between them: a word may end before any
        letter, is likely to end at a blank, and a letter that comes just twice is meant. What all readings share is written
        out on the way, so the work and the memory are linear in the length.
        """
        start = EDGE + EDGE
        best: dict[str, tuple[float, str]] = {start: (0.0, "")}
        before, done = "", []
        for at, symbol in enumerate(token):
            after: dict[str, tuple[float, str]] = {}

            def offer(state: str, cost: float, text: str) -> None:
                if state not in after or cost < after[state][0]:
                    after[state] = (cost, text)

            if breaks:
                ends = ((spent + self.cost(state, EDGE), text + " ") for state, (spent, text) in best.items() if state != start)
                ended = min(ends, default=None)
                if ended and (start not in best or ended[0] < best[start][0]):
                    best[start] = ended
                if symbol == " ":
                    best = {state: (spent + (state != start) * COST_JOIN, text) for state, (spent, text) in best.items()}
                    continue
            readings = self.readings(symbol)
            dropped = symbol in MARKS or at < head or at >= len(token) - tail
            again = symbol == before and not exact and not (breaks and twice(token, at))
            for state, (spent, text) in best.items():
                if dropped:
                    offer(state, spent + COST_DROP_MARK, text)
                repeat = again and bool(text)
                if repeat:
                    offer(state, spent + COST_DROP_REPEAT, text)
                for reading, extra, c in readings:
                    extra_now = extra + (COST_KEEP_REPEAT if repeat and text.endswith(reading) else 0.0)
                    offer(state[1] + c, spent + extra_now + self.cost(state, c), text + reading)
            best, before = after, symbol
            if at % SETTLED == SETTLED - 1:
                shared = len(commonprefix([text for _, text in best.values()])) - 1
                if shared > 0:
                    done.append(next(iter(best.values()))[1][:shared])
                    best = {state: (spent, text[shared:]) for state, (spent, text) in best.items()}
        ends = ((spent + (0.0 if breaks and state == start else self.cost(state, EDGE)), text) for state, (spent, text) in best.items())
        return "".join(done) + min(ends, default=(0.0, ""))[1]


def twice(token: Sequence[str], at: int) -> bool:
    """Whether the symbol at a place equals the one before it, and no third one stands beside them."""
    return not (at >= 2 and token[at - 2] == token[at]) and not (at + 1 < len(token) and token[at + 1] == token[at])


def likely_words(letters: str, decoder: Decoder) -> set[str]:
    """All words in some division of the letters that is at most LIKELY costlier than the best one.

    Trigrams leave it open whether `anidiot` is one word or two, so each reading near the best counts. Costs up to a
    place and from it on are minimal sums over states (before a word, inside one), found in one pass each way.
    """
    n, cost = len(letters), decoder.cost
    h = [(plain(c) if c.isalpha() else OTHER)[:1] or OTHER for c in letters]
    first = [cost(EDGE + EDGE, c) for c in h]
    second = [0.0, *(cost(EDGE + a, b) for a, b in zip(h, h[1:]))]
    later = [0.0, 0.0, *(cost(a + b, c) for a, b, c in zip(h, h[1:], h[2:]))]
    single = [math.inf, *(cost(EDGE + a, EDGE) for a in h)]      # ends of words of one letter
    end = [math.inf, math.inf, *(cost(a + b, EDGE) for a, b in zip(h, h[1:]))]
    to, inside = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for j in range(1, n + 1):
        if j > 1:
            inside[j] = min(inside[j - 1] + later[j - 1], to[j - 2] + first[j - 2] + second[j - 1])
        to[j] = min(inside[j] + end[j], to[j - 1] + first[j - 1] + single[j])
    rest, within = [math.inf] * n + [0.0], [math.inf] * (n + 2)
    for i in range(n, -1, -1):
        if i < n:
            rest[i] = first[i] + single[i + 1] + rest[i + 1]
            if i + 1 < n:
                rest[i] = min(rest[i], first[i] + second[i + 1] + within[i + 2])
        within[i] = min(end[i] + rest[i], later[i] + within[i + 1] if i < n else math.inf)
    most, words = to[n] + LIKELY, set()
    for i in range(n):
        if to[i] + rest[i] > most:
            continue
        if to[i] + first[i] + single[i + 1] + rest[i + 1] <= most:
            words.add(letters[i])
        spent, j = to[i] + first[i] + (second[i + 1] if i + 1 < n else math.inf), i + 2
        while j <= n and spent + within[j] <= most:
            if spent + end[j] + rest[j] <= most:
                words.add(letters[i:j])
            spent, j = spent + (later[j] if j < n else math.inf), j + 1
    return words


def disguised(token: str) -> bool:
    """Letters mixed with leet characters or marks, or a letter three times in a row."""
    if len(token) < 3:
        return False
    if token.isalpha():
        return REPEATED.search(token) is not None
    letters = sum(map(str.isalpha, token))
    return letters > 0 and all(c.isalpha() or c in LEET or c in MARKS for c in token)


def all_leet(token: str) -> bool:
    """Leet characters and marks alone, which may be a word or a number."""
    return len(token) >= 3 and any(c in LEET for c in token) and all(c in LEET or c in MARKS for c in token)


def edges(token: str) -> tuple[str, str, str]:
    """(core, head, tail): a token without punctuation, and the leet characters among the punctuation before and after it."""
    core = token.strip(EDGES)
    at = token.find(core) if core else len(token)
    head, tail = ("".join(c for c in part if c in LEET) for part in (token[:at], token[at + len(core):]))
    return core, head, tail


def restored(token: str, decoder: Decoder) -> set[str]:
    """The words that may be behind a lower-case token; none for punctuation.

    Leet characters at an edge may be letters or punctuation, and leet characters alone a number: each reading is
    a word of its own.
    """
    core = token.strip(BARE_EDGES)
    if core.isalpha() and not REPEATED.search(core):
        return {core}
    core, head, tail = (LONG_RUN.sub(r"\1\1\1", part) for part in edges(token))
    words = {decoder.decode(core) if disguised(core) else core}
    # Marks that also end or open sentences may stand outside those that are letters.
    for before in {"", head, head.lstrip(OPEN_OR_END)}:
        for after in {"", tail, tail.rstrip(OPEN_OR_END)}:
            whole = before + core + after
            if all_leet(whole) or (before or after) and disguised(whole):
                words.add(decoder.decode(whole, head=len(before), tail=len(after)))
                words.add(decoder.decode(REPEATED.sub(r"\1\1", whole), exact=True))
    words.discard("")
    return words


def spelled_words(low: str, tokens: set[str], decoder: Decoder) -> set[str]:
    """Words written letter by letter with white space between; gaps wider than the narrowest are likely to part words."""
    if 1 not in map(len, tokens):
        return set()
    words = set()
    for m in SPELLED.finditer(low):
        letters = m[0].split()
        if not any(c.isalpha() or c in LEET for c in letters):
            continue
        gaps = [len(g) for g in GAP.findall(m[0])]
        narrow = min(gaps)
        symbols = [letters[0]]
        for c, gap in zip(letters[1:], gaps):
            symbols += [" ", c] if gap > narrow else [c]
        # Punctuation that stands for no letter parts words.
        symbols = [" " if c in EDGES and c not in LEET and c not in MARKS else c for c in symbols]
        best = decoder.decode(symbols, breaks=True).split()
        words.update(best, likely_words("".join(best), decoder))
    return words


def restored_words(text: str | None, decoder: Decoder) -> set[str]:
    """The distinct words of a text after deobfuscation."""
    low = (text or "").lower()
    tokens = set(low.split())
    found = {word for t in tokens for word in restored(t, decoder)}
    found.update(spelled_words(low, tokens, decoder))
    return found


def features_of(word: str) -> list[str]:
    """A word as a whole, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    trigrams: dict[str, int]
    weights: dict[str, float] = field(default_factory=dict)
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None

    def word_weight(self, word: str) -> float:
        weights = self.weights
        best = weights.get(word + "$", 0.0)
        for n in BEGINNINGS:
            if n > len(word):
                break
            best = max(best, weights.get(word[:n], 0.0))
        return best

    def score(self, described: list[float]) -> float:
        if self.beta is None:
            return 0.0
        z = self.beta[0] + float(np.dot((np.array(described) - self.center) / self.scale, self.beta[1:]))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


class Describer:
    """What a model finds in texts; remembers what it found, or that it found nothing, behind a bounded number of tokens."""

    def __init__(self, model: Model, decoder: Decoder):
        self.model, self.decoder, self.known, self.nothing = model, decoder, {}, set()
        # no feature that a word has begins otherwise than the word and its end
        self.heads = {f[:HEAD] for f in model.weights}

    def weight(self, word: str) -> float:
        return self.model.word_weight(word) if f"{word}$"[:HEAD] in self.heads else 0.0

    def look_up(self, token: str) -> tuple:
        """(word, weight) of each word behind a token that has a weight."""
        found = tuple((word, weight) for word in restored(token, self.decoder) if (weight := self.weight(word)) > 0)
        if len(self.known) + len(self.nothing) >= CACHED_TOKENS:
            self.known.clear()
            self.nothing.clear()
        if len(token) <= 2 * LONGEST_TOKEN:
            if found:
                self.known[token] = found
            else:
                self.nothing.add(token)
        return found

    def __call__(self, text: str | None) -> list[float]:
        """All weights of the distinct words, the largest weight, share and number of words with one."""
        low = (text or "").lower()
        tokens, get = set(low.split()), self.known.get
        found = {}
        for token in filterfalse(self.nothing.__contains__, tokens):
            hit = get(token) or self.look_up(token)
            if hit:
                found.update(hit)
        for word in spelled_words(low, tokens, self.decoder):
            if (weight := self.weight(word)) > 0:
                found[word] = weight
        return [math.log1p(sum(found.values())), max(found.values(), default=0.0),
                math.sqrt(len(found) / (len(tokens) + 10)), math.log1p(len(found))]


def training_rows(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(d, y, half): at most `most` labelled ids outside the held-out fold, so its size is bounded."""
    known = named(labels, d=id_col, y=label_col).filter(F.col("d").isNotNull() & F.col("y").isNotNull())
    rows = known.groupBy("d").agg(F.max("y").alias("y")).filter(~in_held_out(F.col("d")))
    chosen = rows.orderBy(F.xxhash64("d"), "d").limit(most)
    return chosen.withColumn("half", F.pmod(F.xxhash64("d", F.lit(1)), F.lit(2)).cast("int"))


def in_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most_rows: int = TRAIN_ROWS) -> Model:
    """Language model from all documents, weights and calibration from the labelled sample.

    The calibration sees each half of the sample through weights that only the other half gave.
    """
    model = Model(trigram_table(docs, text_col))
    chosen = stored(training_rows(labels, id_col, label_col, most_rows), "labelled")
    # At most most_rows ids and labels are sent to the tasks.
    sample = named(docs, d=id_col, t=text_col).join(F.broadcast(chosen), "d")
    sample = stored(sample, "labelled-texts")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def make_features():
        decoder = Decoder(shipped.value.trigrams)

        def run(rows):
            counts: defaultdict[tuple, Counter] = defaultdict(Counter)
            for r in rows:
                words = restored_words(r["t"], decoder)
                counts[r["y"], r["half"]].update({f for w in words for f in features_of(w)})
                if sum(map(len, counts.values())) > CACHED_TOKENS:
                    yield from added(counts)
                    counts.clear()
            yield from added(counts)

        def added(counts):
            for (y, half), found in counts.items():
                for f, k in found.items():
                    yield f, y, half, k

        return run

    n = {(r["half"], r["y"]): r["n"] for r in sample.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not n.get((half, y)) for half in (0, 1) for y in (0, 1)):
        return model
    seen = map_rows(sample, make_features, "f string, y int, half int, k bigint", flush=16384)
    counts = stored(seen.groupBy("f").agg(*[
        F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("k")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)])
        .filter(F.col("n01") + F.col("n11") >= LEAST_TOXIC), "feature-counts")
    halves = [sure_weights(counts, [h], n) for h in (0, 1)]
    model.weights = sure_weights(counts, [0, 1], n)
    crossed = spark.sparkContext.broadcast([Model(model.trigrams, w) for w in halves])

    def make_described():
        models = crossed.value
        decoder = Decoder(models[0].trigrams)
        describers = [Describer(m, decoder) for m in models]

        def run(rows):
            for r in rows:
                yield describers[1 - r["half"]](r["t"]), r["y"]

        return run

    rows = map_rows(sample, make_described, "x array<double>, y int").collect()
    fit(model, np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float))
    return model


def sure_weights(counts: DataFrame, halves: list[int], n: dict[tuple[int, int], int]) -> dict[str, float]:
    """Log odds of the features in some halves, less SURENESS standard errors; at most FEATURES of them."""
    toxic, clean = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (1, 0))
    n1, n0 = (sum(n[h, y] for h in halves) for y in (1, 0))
    odds = F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    sure = counts.filter(toxic >= LEAST_TOXIC).withColumn("w", odds - SURENESS * error).filter(F.col("w") > LEAST_WEIGHT)
    return {r["f"]: r["w"] for r in sure.orderBy(F.desc("w"), "f").limit(FEATURES).collect()}


def fit(model: Model, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> None:
    """Logistic regression by Newton steps on at most TRAIN_ROWS rows of four numbers."""
    model.center, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(y)), (x - model.center) / model.scale])
    beta, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [ridge] * (z.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(beta)),
                               z.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.beta = beta


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, score_col: str = "score",
          predicted_col: str = "predicted") -> DataFrame:
    """docs with the score, and whether it reaches the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop(score_col, predicted_col)
    out = source.withColumns({score_col: F.lit(0.0), predicted_col: F.lit(0)})
    at = source.columns.index(text_col)

    def run(batches):
        known = shipped.value
        describe = Describer(known, Decoder(known.trigrams))
        for batch in batches:
            scores = [known.score(describe(t)) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(scores, pa.float64()),
                       pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, score_col, predicted_col])
        describe = batch = columns = None
        give_back()

    return source.mapInArrow(run, out.schema)
