"""Chat formatting by token-level assembly.

Role and text of a turn are encoded separately, and reserved ids are put around them, so no text can make a control
token. Control strings that occur in a text are escaped reversibly, so that the rendered form is as safe as the ids. Where
a turn lies in its conversation, and which of its tokens carry loss, comes from prefix sums of segment lengths.

The output has one row per turn, not per conversation: a conversation of any length is streamed in order.

Defined results:
* NULL text or role is empty. Turns with equal numbers are ordered by role, then text; a NULL turn comes first.
* A NULL conv_id is a conversation of its own. Repeated rows are repeated turns.
* Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from condmon.llm.common import map_rows, named

# The template's control strings, and those of other templates that are escaped as well.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|(?:turn|text|end|im_start|im_end|endoftext)\|>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?SYS>|\|(?:turn|text|end|im_start|im_end|endoftext)\|>)")
TURNS = ("conv_id bigint, position bigint, `offset` bigint, ids binary, loss_start bigint, loss_length bigint")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # how byte-level vocabularies split texts


def escaped(text: str) -> str:
    """One more backslash inside every control string, which none has then."""
    return CONTROL.sub(r"\1\2\\\3", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class Codec:
    """Byte-level ids of texts, and three reserved ids after the vocabulary's last."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        last = max(ranks.values())
        self.turn, self.text, self.end = last + 2, last + 3, last + 4  # last + 1 is left to the end of a document

    def segments(self, role: str, text: str) -> list[list[int]]:
        encode = self.encoding.encode_ordinary
        return [[self.turn], encode(escaped(role)), [self.text], encode(escaped(text)), [self.end]]

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Escaped role and text of a turn's ids."""
        assert ids[0] == self.turn and ids[-1] == self.end
        middle = ids.index(self.text)
        decode = self.encoding.decode_bytes
        return decode(ids[1:middle]).decode(), decode(ids[middle + 1:-1]).decode()


def load_ranks(path: str) -> dict[bytes, int]:
    import base64
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def assemble(turns: DataFrame, ranks_path: str, trained_role: str = "assistant", id_col: str = "conv_id",
             turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Encode every turn, then place the turns of each conversation. See TURNS.

    Token positions count from the conversation's start; loss covers the texts of the trained role.
    The vocabulary (about 50,000 entries) is sent to the tasks.
    """
    ranks = turns.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def make_encoded():
        codec = Codec(ranks.value)

        def run(rows):
            for r in rows:
                role, text = r["role"] or "", r["text"] or ""
                parts = codec.segments(role, text)
                ends = np.cumsum([len(p) for p in parts]).tolist()
                loss = (ends[2], ends[3] - ends[2]) if role == trained_role else (ends[-1], 0)
                yield r["conv_id"], r["turn"], role, text, array("I", [i for p in parts for i in p]).tobytes(), *loss

        return run

    rows = named(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    encoded = map_rows(rows, make_encoded, "conv_id bigint, turn bigint, role string, text string, ids binary, s bigint, n bigint")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("role", "text")

    def make_placed():
        def run(found) -> Iterator[tuple]:
            at, position, offset = (), 0, 0
            for r in found:
                if at != (r["conv_id"],):
                    at, position, offset = (r["conv_id"],), 0, 0
                yield r["conv_id"], position, offset, r["ids"], offset + r["s"], r["n"]
                position, offset = position + 1, offset + len(r["ids"]) // 4

        return run

    return map_rows(ordered, make_placed, TURNS)


READ = "conv_id bigint, position bigint, role string, text string, loss string, formatted_chars bigint"


def read_back(assembled: DataFrame, ranks_path: str) -> DataFrame:
    """Role, text and text under the loss mask of every turn, from its ids alone; and the length of its rendered form."""
    ranks = assembled.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def make():
        codec = Codec(ranks.value)

        def run(rows):
            for r in rows:
                ids = array("I", r["ids"]).tolist()
                role, text = codec.read(ids)
                start = r["loss_start"] - r["offset"]
                loss = codec.encoding.decode_bytes(ids[start:start + r["loss_length"]]).decode()
                yield (r["conv_id"], r["position"], unescaped(role), unescaped(text), unescaped(loss),
                       len(TURN) + len(role) + len(TEXT) + len(text) + len(END))

        return run

    return map_rows(assembled, make, READ)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, streamed in order of position: see DIGESTS. Nothing but the running digests is held."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def make():
        def run(rows) -> Iterator[tuple]:
            at, whole, loss, n, n_loss, chars = (), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in rows:
                if at != (r["conv_id"],):
                    if at:
                        yield at[0], n, whole.hexdigest(), n_loss, loss.hexdigest(), chars
                    at, whole, loss, n, n_loss, chars = (r["conv_id"],), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                whole.update(f"{r['role']}\n{r['text']}\n".encode())
                loss.update(r["loss"].encode())
                n, n_loss, chars = n + 1, n_loss + len(r["loss"]), chars + r["formatted_chars"]
            if at:
                yield at[0], n, whole.hexdigest(), n_loss, loss.hexdigest(), chars

        return run

    return map_rows(ordered, make, DIGESTS)
