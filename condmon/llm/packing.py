"""Packing: token sequences of a fixed window from whole documents, with bounded memory and no padding.

Every task keeps a fixed number of open windows. A document goes into the open window that it fills best; if none
has room, the fullest takes as much of it as fits and is emitted. At the end the open windows are merged, and what
is left of the last one is cut into sequences whose lengths are powers of two. Nothing is shuffled.

Defined results:
* NULL or empty text is a document of the end id alone. A NULL id is passed through.
* Repeated rows are packed as often as they come.
* Other columns are left out. An empty table gives no pieces.
* Texts of any length are tokenized word by word, so that no encoding of a whole text is held.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame

from condmon.llm.common import map_rows, named

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "`offset` bigint, sequence_length bigint")
CACHED_WORDS = 250_000   # words whose ids a task remembers, in each of two generations
SEEN_PLACES = 1 << 21    # places that tell whether a word came before; words that come once are not remembered
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # neither letters nor digits: one unit where they stand together
LONGEST_KEPT = 64        # bytes of a word that is remembered
ID_BYTES = array("I").itemsize  # 4; the ids are written in the order of the machine, which is little-endian


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: visible ones stand for themselves, the others follow 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in visible)
    moved = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [moved.get(b, chr(b)) for b in range(256)]


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, put together from the ids of its white-space separated words.

    The tokenizer drops white space and never joins across it, nor letters with the symbols after them, so this equals
    encoding the text as a whole. Words of letters go to the tokenizer's model directly; others take the whole way. Words are remembered
    when they come again, in two generations, so that frequent words survive when the younger one is full.
    """

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenize, self.letter_of = self.tokenizer.model.tokenize, dict(enumerate(byte_letters()))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.seen, self.met = bytearray(SEEN_PLACES), 0

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw:  # special tokens are told by case, everything else is put in lower case anyway
            raw = raw.lower()
        words = raw.split()  # bytes split at ASCII white space only, as it must be here
        found = list(map(self.young.get, words))
        if None in found:
            found = [ids or self.look_up(w) for ids, w in zip(found, words)]
        return b"".join(found)

    def look_up(self, word: bytes) -> bytes:
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            ids = self.encode(word)
            if len(word) > LONGEST_KEPT or not self.again(word):
                return ids
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def again(self, word: bytes) -> bool:
        """Whether a word came before, or one that shares its place; half full, the places are cleared."""
        place = hash(word) % SEEN_PLACES
        if self.seen[place]:
            return True
        if self.met >= SEEN_PLACES // 2:
            self.seen, self.met = bytearray(SEEN_PLACES), 0
        self.seen[place] = 1
        self.met += 1
        return False

    def encode(self, word: bytes) -> bytes:
        letters = word.rstrip(SYMBOLS)
        if letters:
            written = self.unit(letters)
            if written is not None:
                if len(letters) < len(word):
                    return self.look_up(letters) + self.look_up(word[len(letters):])
                return array("I", [t.id for t in self.tokenize(written)]).tobytes()
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def unit(self, word: bytes) -> str | None:
        """A word of letters as the model wants it; None for all that has more to it than lower-casing."""
        if word.isascii():
            return word.decode() if word.isalpha() and word.islower() else None
        s = word.decode()
        small = s.lower()
        if not small.isalpha() or len(small) != len(s) or "\u03a3" in s or not unicodedata.is_normalized("NFC", small):
            return None
        return small.encode().decode("latin-1").translate(self.letter_of)


class Window:
    """An open sequence: pieces (doc_id, start, ids, doc_tokens) and the room left, in tokens."""

    def __init__(self, room: int):
        self.pieces, self.room = [], room

    def put(self, doc_id, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc_id, start, ids, total))
        self.room -= len(ids) // ID_BYTES


def packed(documents: Iterator[tuple], window: int, open_windows: int, first_id: int) -> Iterator[tuple]:
    """(doc_id, ids) -> rows of SCHEMA."""
    opened: list[Window] = []
    sequence = first_id

    def emitted(w: Window) -> Iterator[tuple]:
        nonlocal sequence
        length, offset = sum(len(p[2]) for p in w.pieces) // ID_BYTES, 0
        for doc_id, start, ids, total in w.pieces:
            n = len(ids) // ID_BYTES
            yield doc_id, start, n, ids, total, sequence, offset, length
            offset += n
        sequence += 1

    for doc_id, ids in documents:
        total, at = len(ids) // ID_BYTES, 0
        while at < total:
            rest = total - at
            fitting = [w for w in opened if w.room >= rest]
            if fitting:
                target = min(fitting, key=lambda w: w.room)
            elif rest >= window or len(opened) < open_windows:
                target = Window(window)
                opened.append(target)
            else:
                target = min(opened, key=lambda w: w.room)
            take = min(rest, target.room)
            target.put(doc_id, at, ids[at * ID_BYTES:(at + take) * ID_BYTES], total)
            at += take
            if not target.room:
                opened.remove(target)
                yield from emitted(target)
    yield from merged(opened, window, emitted)


def merged(opened: list[Window], window: int, emitted) -> Iterator[tuple]:
    """The open windows run together: full windows first, then powers of two, none with padding."""
    left = sum(window - w.room for w in opened)
    lengths = [window] * (left // window) + [1 << b for b in reversed(range(window.bit_length())) if (left % window) >> b & 1]
    pieces = [p for w in sorted(opened, key=lambda w: w.room) for p in w.pieces]
    for length in lengths:
        out = Window(length)
        while out.room:
            doc_id, start, ids, total = pieces.pop(0)
            take = out.room * ID_BYTES
            out.put(doc_id, start, ids[:take], total)
            if len(ids) > take:
                pieces.insert(0, (doc_id, start + take // ID_BYTES, ids[take:], total))
        yield from emitted(out)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, open_windows: int = 64,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with its ids and its place in a sequence. See SCHEMA.

    The tokenizer file (a few MB) is read here and sent to the tasks.
    """
    with open(tokenizer_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(ID_BYTES, "little")

    def make():
        encode = WordEncoder(shipped.value)
        first = TaskContext.get().partitionId() << 33

        def run(rows):
            return packed(((r["doc_id"], encode(r["text"] or "") + end) for r in rows), window, open_windows, first)

        return run

    return map_rows(named(docs, doc_id=id_col, text=text_col), make, SCHEMA)
