"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode by a UTF-8 state machine.

The encoding of a prefix ends in one token, and a token may follow another exactly if the two stay apart when
merged together. So reading a word byte by byte needs, for each place where a coming token may still
start, the last token up to there. That is the transducer's state: the longest suffix that begins some token, and the last tokens
at its places. A transition is computed when first met and kept. Tokens are emitted once every place
that is still open agrees in them, so they follow their bytes by a bounded lookahead. Words met before are kept as well, both in tables of bounded size.

As in the library that the rank files are made for, a word that is a token as a whole is that token.

Defined cases: a null text is empty and has no ids. Rows are independent: repeated rows and ties need nothing. Long texts
and words of any length are read once from left to right. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm import _words
from memspark.llm._shared import small_arrow_batches

#: What a worker keeps at most; when a table is full it starts anew.
MAX_STATES, MAX_WORDS, MAX_PAIRS, MAX_TAILS = 300_000, 500_000, 500_000, 100_000
#: Where a state keeps what it stands for; its other entries are bytes.
OWN = -1
NEVER = 1 << 60
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}


def word_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: word for word, rank in ranks.items()}
        self.begins = {word[:k] for word in ranks for k in range(len(word) + 1)}
        self.apart: dict[int, bool] = {}
        self.histories: dict[int, tuple] = {}
        self.tails: dict[bytes, tuple] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.states: dict[tuple, dict] = {}
        self._reset()

    def _reset(self) -> None:
        # What a state stands for: the suffix that begins a token, and the last token before each of its bytes and at its end (-1: none yet).
        for state in self.states.values():
            state.clear()
        self.states.clear()
        #: A state maps a byte to the next state and the last token.
        self.root: dict = {OWN: (b"", (-1,))}
        self.states[self.root[OWN]] = self.root

    def history(self, token: int) -> tuple[list[int], list[bytes], list[bytes], bool]:
        """How merging makes a token from its bytes: the rank of each merge, the leftmost and the rightmost part before
        the first merge and after each, and whether it comes to this one token at all. The plain definition: the
        leftmost pair of lowest rank goes first."""
        found = self.histories.get(token)
        if found is None:
            word = self.bytes_of[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            order, left, right = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                order.append(best)
                left.append(parts[0])
                right.append(parts[-1])
            found = self.histories[token] = ([*order, NEVER], left, right, len(parts) == 1)
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged together: both histories are replayed, lowest rank first, and no pair across may come in between."""
        found = self.apart.get(left << TOKEN_BITS | right)
        if found is None:
            ranks_a, _, edges_a, _ = self.history(left)
            ranks_b, edges_b, _, _ = self.history(right)
            i = j = 0
            while True:
                across, a, b = self.ranks.get(edges_a[i] + edges_b[j], NEVER), ranks_a[i], ranks_b[j]
                if across < a and across <= b and across != NEVER:
                    found = False
                    break
                if a == b == NEVER:
                    found = True
                    break
                i, j = (i + 1, j) if a <= b else (i, j + 1)
            if len(self.apart) >= MAX_PAIRS:
                self.apart.clear()
            self.apart[left << TOKEN_BITS | right] = found
        return found

    def tail(self, read: bytes) -> tuple[list[tuple[int, int]], int]:
        """The tokens that end ``read`` with their starts, longest first, and the start of the longest suffix that begins a token."""
        found = self.tails.get(read)
        if found is None:
            ends = [(k, token) for k in range(len(read)) if (token := self.ranks.get(read[k:])) is not None and self.history(token)[3]]
            found = ends, next(k for k in range(len(read) + 1) if read[k:] in self.begins)
            if len(self.tails) >= MAX_TAILS:
                self.tails.clear()
            self.tails[read] = found
        return found

    def move(self, state: dict, byte: int) -> tuple[dict, int]:
        """The next state, and the last token of what has been read."""
        suffix, lasts = state[OWN]
        read = suffix + bytes((byte,))
        ends, skip = self.tail(read)
        for k, token in ends:
            before = lasts[k]
            if before < 0 or self.may_follow(before, token):
                break
        else:
            raise ValueError("the ranks hold no token for a byte")
        key = (read[skip:], (*lasts[skip:], token))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = {OWN: key}
        found = state[byte] = to, token
        return found

    def _settled(self, lasts: list[int], first: int) -> tuple[list[int], int]:
        """The tokens that every place from ``first`` on agrees in, and where they end; ``lasts`` has the last token at each place."""
        size = self.bytes_of
        live = set(range(first, len(lasts) + 1))
        while len(live) > 1:  # step back from the furthest until all are at one place
            at = max(live)
            live.discard(at)
            live.add(at - len(size[lasts[at - 1]]))
        (end,) = live
        return self._back(lasts, end), end

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[lasts[end - 1]])
        return out[::-1]

    def encode_word(self, word: bytes, lookahead: int = 4096) -> list[int]:
        """The tokens of a word. They are emitted when the word ends, or after each ``lookahead`` bytes as far as all places where a token may still start agree."""
        token = self.ranks.get(word)
        if token is not None:
            return [token]
        if len(self.states) > MAX_STATES:
            self._reset()
        state, out, lasts = self.root, [], []
        add = lasts.append
        for at in range(0, len(word), lookahead):
            for byte in word[at : at + lookahead]:
                found = state.get(byte)
                if found is None:
                    found = self.move(state, byte)
                state, token = found
                add(token)
            if at + lookahead < len(word):
                tokens, end = self._settled(lasts, len(lasts) - len(state[OWN][0]))
                out += tokens
                del lasts[:end]
                if len(self.states) > 2 * MAX_STATES:
                    key = state[OWN]
                    self._reset()
                    state = self.states.setdefault(key, {OWN: key})
        return out + self._back(lasts, len(lasts))

    def encode(self, text: str, pattern: regex.Pattern) -> list[int]:
        out: list[int] = []
        words = self.words
        for word in pattern.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = tuple(self.encode_word(word.encode()))
                if len(word) <= 64:
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def encode_column(self, texts: pa.Array, pattern: regex.Pattern) -> pa.Array:
        """The ids of each text, as Arrow lists over one flat array."""
        flat: list[int] = []
        ends = [0]
        for text in texts.to_pylist():
            if text:
                flat += self.encode(text, pattern)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))

    def decode_column(self, ids: pa.Array, chunk: int = 8192) -> pa.Array:
        """The text of each row's ids, fed to a UTF-8 stream chunk by chunk."""
        word, texts = self.bytes_of.__getitem__, []
        ids = ids.fill_null([]) if ids.null_count else ids
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).tolist() if len(ids) else []
        for a, b in zip(ends, ends[1:], strict=False):
            stream = Utf8Stream()
            texts.append("".join([stream.feed(b"".join(map(word, flat[i : min(b, i + chunk)]))) for i in range(a, b, chunk)]) + stream.end())
        return pa.array(texts, pa.string())


class Utf8Stream:
    """Bytes in, text out: a state machine that holds back a character whose bytes have not all come.

    The state is the held bytes and how many more are due; ill-formed bytes give U+FFFD, as in a decode of the whole.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _due(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:  # where the last character starts
                if self._due(lead) > back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(ranks_path: str, pattern: str) -> tuple[Transducer, regex.Pattern]:
    return Transducer(read_ranks(ranks_path)), word_pattern(pattern)


def _added(docs: DataFrame, added: dict[str, T.DataType], column: str, make) -> DataFrame:
    """``docs`` with columns that ``make`` computes from the batches' ``column``; columns of these names are replaced."""
    small_arrow_batches(docs.sparkSession, 256)
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.pieces(batch, column, 2_000_000) if pa.types.is_string(batch.column(column).type) else [batch]:
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(column))], [*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` in ``ids_col`` (replaced if there). ``ranks_path`` is read on each worker."""

    def make(texts: pa.Array) -> list[pa.Array]:
        transducer, words = _loaded(ranks_path, pattern)
        return [transducer.encode_column(texts, words)]

    return _added(docs, {ids_col: T.ArrayType(T.IntegerType())}, text_col, make)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded", chunk: int = 8192) -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``text_col`` (replaced if there), decoded chunk by chunk. Null ids give an empty text."""
    return _added(docs, {text_col: T.StringType()}, ids_col, lambda ids: [_loaded(ranks_path, "")[0].decode_column(ids, chunk)])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids and decoded (from the ids alone) of each row, in one pass."""

    def make(texts: pa.Array) -> list[pa.Array]:
        transducer, words = _loaded(ranks_path, pattern)
        ids = transducer.encode_column(texts, words)
        return [ids, transducer.decode_column(ids)]

    coded = _added(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, "text", make)
    return coded.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
