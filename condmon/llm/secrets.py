"""Secret scans: patterns for known forms, and a token-efficiency test for random strings.

A tokenizer's vocabulary holds what is frequent in texts, so text needs few tokens for its length and random strings need
many. A string without spaces whose characters per token fall below a limit is reported, unless it is a known
digest or identifier (hex digests of usual lengths, UUIDs, numbers, dates, versions, hosts of links). Pattern spans are cut out
first. What is left is tested as a whole by its parts between marks; parts below four characters and known ones tell
nothing, letters of one case have a lower limit, three or more equal characters in a row count as one, and capitals alone are read as lower case where that needs fewer tokens.
What is not random as a whole is searched for random stretches, wherever they lie in a run of whatever length: stretches of tokens
whose characters stay below the limit in total, and which are random by themselves.

Defined results:
* NULL or empty text has no spans. Repeated rows are handled row by row.
* Offsets count code points, ends are exclusive. An empty table gives an empty result.
* All columns of the documents are kept; `secrets` replaces a column of the same name.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from condmon.llm.chat import PATTERN, load_ranks

# The forms looked for.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9._/+=-]+|v?[0-9]+(?:\.[0-9]+)+[A-Za-z0-9.+-]*"
    r"|(?:[A-Za-z0-9_-]*[A-Za-z_-]\.)+[a-z]{2,6})")
HOST = re.compile(r"/*(?:[A-Za-z0-9_-]*[A-Za-z_-]\.)+[a-z]{2,6}(?=/)")     # a link is known by its host alone
PART = re.compile(r"[A-Za-z0-9+]+")       # what lies between marks
REPEATED = re.compile(r"(.)\1{2,}")
CHARS_PER_TOKEN = 2.0
SHORTEST = 16     # characters of a random string
PLAIN = 0.875     # share of the limit for letters of one case, as rare words of any language have few frequent parts too
TELLING = 4       # characters of a part that counts
DROP = 12.0       # a stretch ends where readable tokens have taken so much from its best score


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lengths_in(part: str, pieces) -> list[int]:
    """The lengths of a part's tokens; capitals alone are words as well if they are so in lower case."""
    found = pieces(part)
    return min(found, pieces(part.lower()), key=len) if part.isupper() else found


def is_random(core: str, pieces, limit: float) -> bool:
    """Too few characters per token over all telling parts, which must have SHORTEST characters together."""
    if len(core) < SHORTEST or KNOWN.fullmatch(core):
        return False
    parts = [REPEATED.sub(r"\1", p) for p in PART.findall(core) if not KNOWN.fullmatch(p)]
    parts = [p for p in parts if len(p) >= TELLING]
    chars = sum(map(len, parts))
    if all(p[1:].islower() and p.isalpha() or p.isalpha() and p.isupper() for p in parts):
        limit *= PLAIN
    return chars >= SHORTEST and chars < limit * sum(len(lengths_in(p, pieces)) for p in parts)


def stretches(lengths: list[int], limit: float) -> list[tuple[int, int]]:
    """Stretches (start, end in characters) of tokens that score best, at `limit` less its length a token.

    Each ends at its best score, once that has dropped by DROP or to nothing; what follows its end is searched again.
    Scores drop at every return, so a token is read a bounded number of times.
    """
    ends = list(accumulate(lengths, initial=0))
    found, i, start, score, best, stop = [], 0, 0, 0.0, 0.0, 0
    while i < len(lengths) or best > 0:
        if i < len(lengths):
            score += limit - lengths[i]
            i += 1
            if score > best:
                best, stop = score, i
            if score > 0 and score > best - DROP:
                continue
        if best > 0:
            found.append((ends[start], ends[stop]))
            i = stop
        start, score, best = i, 0.0, 0.0
    return found


def random_spans(text: str, taken: list[tuple[str, int, int]], pieces, limit: float) -> list[tuple[str, int, int]]:
    """pieces(text) gives the lengths of its tokens."""
    def told(start: int, end: int) -> tuple[int, int] | None:
        """The span without marks at its ends, if it is random."""
        s = text[start:end]
        core = s.strip("._=-/+")
        if not is_random(core, pieces, limit):
            return None
        start += s.index(core)
        return start, start + len(core)

    spans = []
    for m in CANDIDATE.finditer(text):
        for a, b in free_parts(*m.span(), taken):
            host = HOST.match(text, a, b)
            a = host.end() if host else a
            if whole := told(a, b):
                spans.append(("random", *whole))
                continue
            # A readable part may hide a random one from the average.
            for p in PART.finditer(text, a, b):
                if p.end() - p.start() < SHORTEST or KNOWN.fullmatch(p[0]):
                    continue
                if whole := told(*p.span()):
                    spans.append(("random", *whole))
                    continue
                for first, last in stretches(lengths_in(p[0], pieces), limit):
                    if last - first >= SHORTEST and (part := told(p.start() + first, p.start() + last)):
                        spans.append(("random", *part))
    return spans


def free_parts(start: int, end: int, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the taken spans leave of a stretch."""
    parts = []
    for a, b in sorted((a, b) for _, a, b in taken if a < end and start < b):
        if start < a:
            parts.append((start, a))
        start = max(start, b)
    return parts + [(start, end)] if start < end else parts


def scan(docs: DataFrame, ranks_path: str, chars_per_token: float = CHARS_PER_TOKEN, text_col: str = "text") -> DataFrame:
    """docs with `secrets`: spans (kind, start, end) in order of start, then kind as in KINDS."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    source = docs.drop("secrets")
    out = source.withColumn("secrets", F.lit(None).cast(SPANS))
    at = source.columns.index(text_col)

    def run(batches):
        import tiktoken
        encode = tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        sizes = {rank: len(token) for token, rank in ranks.value.items()}

        def pieces(part: str) -> list[int]:
            return [sizes[i] for i in encode(part)]

        for batch in batches:
            found = []
            for text in batch.column(at).to_pylist():
                text = text or ""
                spans = pattern_spans(text)
                spans += random_spans(text, spans, pieces, chars_per_token)
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            columns = [*list(batch.columns)[:-1], pa.array(found, batch.schema.field(len(batch.columns) - 1).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return out.mapInArrow(run, out.schema)
