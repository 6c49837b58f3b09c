"""An interpolated modified Kneser-Ney model of n-grams: counted in Spark, kept as sorted hash arrays, mapped into memory by workers.

1. Count. Words are 48-bit hashes. A text begins with one start mark and ends with an end mark, which is a token; the first tokens of a text, whose
   history is shorter, are counted at the level that their history has. Each task counts n-grams of the full order and sends them, packed by part
   with each column's distinct words apart, by the last word of the history. So one part holds all n-grams of a history, and also all that end
   alike in two words: each lower order, whose counts are the numbers of distinct words before, follows in the same place from the one above.
2. Hot words. A word that would be a large share of a part (the start mark always) is dealt by the word before it as well. Its pairs, the only level
   that this splits, meet again by their second word in a shuffle of their own, and the sums of its history are added up over the parts. Which words are hot is
   taken from one text in 64; that sets only where an n-gram lies, not what is counted.
3. Words, the last level, meet by a shuffle of distinct words. Discounts come from the counts of counts of each level, as the modified method sets them.
4. Store. Each part is written to the shared folder as sorted hash arrays under an index of their first bits: n-grams seen once, others with their counts, histories
   with their totals and numbers of n-grams seen once, twice and more often. A history seen once is not kept: it is an n-gram of the level below.
5. Score. Workers map the parts and look up a batch's distinct n-grams at once.

p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) * p(w | h without its first word),  p(w) = max(n(w) - D'(n(w)), 0) / n + g' / (V + 1), where
n(w) is the number of distinct words before w, n their sum, V the number of distinct tokens; an unknown history leaves the lower order.

Parts follow the bytes of text (``part_bytes`` each). The shared folder must be mounted on all machines (a ``file:`` path): that is what mapping files takes.

Defined cases: a null text is empty: it has the end token only. Rows are scored one by one; repeated rows count twice in training. An
empty training set gives p = 1 / (V + 1) with V = 0. Very long texts are counted and scored whole.
Ties: words of equal frequency at the bound of the hot ones are taken in order of their hash, which changes where n-grams lie and not what is counted. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import _words
from memspark.llm._shared import dealt, durable, local_path, shared_dir, small_arrow_batches

#: Words have so many bytes; marks are words of their own.
WORD = 6
START, END = np.uint64(0x5851F42D4C95), np.uint64(0x14057B7EF767)
_STEP, _BELOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(8 * WORD)
#: Bytes of tables that a worker maps at once. Mapped pages belong to the machine's page cache, which it takes back when it needs to; mapping anew touches them all again.
MAPPED = 4_000_000_000
#: N-grams that a task holds before it sends them on.
_HELD = 3_000_000
#: A word is hot from this share of a part on; of one text in SAMPLE; at most so many words.
HOT_SHARE, SAMPLE, MOST_HOT, MOST_PARTS = 1 / 4, 64, 4096, 65_536


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's tokens, the end included, and the offsets of the texts in these."""
    words, at = _words.word_hashes(texts)
    out = np.full(len(words) + len(at) - 1, END, np.uint64)
    ends = at + np.arange(len(at))
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    out[keep] = words >> np.uint64(64 - 8 * WORD)
    return out, ends


def marked(toks: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens with a start mark before each text, each token's place there, and the level of its longest n-gram."""
    inside = np.arange(len(toks)) - np.repeat(at[:-1], np.diff(at))
    text = np.repeat(np.arange(1, len(at)), np.diff(at))
    return np.insert(toks, at[:-1], START), np.arange(len(toks)) + text, np.minimum(inside + 2, order)


def grams_at(line: np.ndarray, place: np.ndarray, level: int) -> np.ndarray:
    """The ``level`` words that end at each place, as rows of words."""
    return np.stack([line[place - k] for k in range(level - 1, -1, -1)])


def gram_hash(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(grams.shape[1], np.uint64)
    for row in grams:
        out = _words.mix(out * _STEP + row + np.uint64(1))
    return out


class Deal:
    """Which part an n-gram lies in."""

    def __init__(self, parts: int, hot: tuple[int, ...]):
        self.parts, self.hot = parts, np.array(sorted({*hot, int(START)}), np.uint64)

    def is_hot(self, word: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)] == word

    def part_of(self, grams: np.ndarray) -> np.ndarray:
        """By the last word of the history; where that is hot, by the word before it as well, or in a pair by the word after it."""
        if len(grams) == 1:
            owner = _words.mix(grams[0])
        else:
            with_ = grams[-3] if len(grams) > 2 else grams[-1]
            owner = np.where(self.is_hot(grams[-2]), _words.mix(_words.mix(grams[-2]) + with_), _words.mix(grams[-2]))
        return (((owner >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int64)


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.argsort(keys, kind="stable")`` of 64-bit hashes and the keys in that order.

    Their first bits are sorted as plain numbers with their places in the last bits, which takes a fraction of the time; keys that differ in the last bits only are put in order after that.
    """
    low = np.uint64((1 << max(len(keys) - 1, 1).bit_length()) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    ordered, same = keys[order], packed[1:] ^ packed[:-1] <= low
    apart = same & (ordered[1:] != ordered[:-1])
    if apart.any():
        group = np.concatenate([[0], np.cumsum(~same)])
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][apart]] = True
        rows = np.flatnonzero(mixed[group])
        order[rows] = order[rows][np.argsort(ordered[rows], kind="stable")]
        ordered[rows] = keys[order[rows]]
    return order, ordered


def _new(ordered: np.ndarray) -> np.ndarray:
    """Which of the ordered keys are not the one before."""
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is first, in order of the keys, and which of these each key is."""
    order, ordered = _order(keys)
    new = _new(ordered)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _summed(grams: np.ndarray, first: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct columns of ``grams`` by ``first`` and then by hash, their ``first``, their hash and the sums of ``values``."""
    order, key = _order(gram_hash(grams))
    new = np.flatnonzero(_new(key))
    key, at = key[new], order[new]
    way, first = _order(first[at])
    sums = [np.add.reduceat(v[order], new)[way] if len(new) else v for v in values]
    return (grams[:, at[way]], first, key[way], *sums)


def _by(grams: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What packed rows are in order of: the part, and in it the word that they are dealt by."""
    return (part.astype(np.uint64) << _BELOW) | grams[max(len(grams) - 2, 0)]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, place by place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T).tobytes())


def _numbers(data: bytes, width: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.view(kind)[:, 0]


def _coded(grams: np.ndarray, numbers: list[np.ndarray]) -> bytes:
    """Rows of words and numbers, in order of the word that they are dealt by: each row's distinct words as differences, places in these (of the ordered row as differences), and numbers."""
    shape, blobs = [grams.shape[1]], []
    for k, row in enumerate(grams):
        first, at = _distinct(row)
        words = row[first]
        width = 2 if len(words) <= 65_536 else 4
        at = at.astype(np.uint32)
        blobs += [_planes(np.diff(words, prepend=np.uint64(0)), WORD), _planes(np.diff(at, prepend=np.uint32(0)) if k == max(len(grams) - 2, 0) else at, width)]
        shape += [WORD, len(blobs[-2]), width, len(blobs[-1])]
    for x in numbers:
        width = 1 if x.max(initial=0) < 256 else 8
        blobs.append(_planes(x.astype(np.int64), width))
        shape += [width, len(blobs[-1])]
    return np.array([len(shape), *shape], np.int32).tobytes() + b"".join(blobs)


def _decoded(data: bytes, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    shape, at, out = np.frombuffer(data, np.int32, n, 4).tolist(), 4 * (n + 1), []
    for k, (width, size) in enumerate(zip(shape[1::2], shape[2::2], strict=True)):
        kind = np.uint64 if k < 2 * words and k % 2 == 0 else np.uint32 if k < 2 * words else np.int64
        x = _numbers(data[at : at + size], width, kind)
        if k < 2 * words and (k % 2 == 0 or k // 2 == max(words - 2, 0)):
            x = np.cumsum(x, dtype=kind)
            x = x & kind((1 << 8 * width) - 1)
        out.append(x)
        at += size
    return np.stack([w[i] for w, i in zip(out[: 2 * words : 2], out[1 : 2 * words : 2], strict=True)]), out[2 * words :]


#: A row: packed n-grams of a level for a part; or (no data) sums of a level, or of a hot word's history.
_ROW = "part int, level int, data binary, word long, of array<long>"
_KINDS = (("part", pa.int32()), ("level", pa.int32()), ("data", pa.binary()), ("word", pa.int64()), ("of", pa.list_(pa.int64())))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_KINDS)], [name for name, _ in _KINDS])


def _packed(grams: np.ndarray, numbers: list[np.ndarray], part: np.ndarray, parts: int) -> list[tuple]:
    """Rows of n-grams that are in order of their part."""
    cut = np.searchsorted(part, np.arange(parts + 1))
    return [(k, len(grams), _coded(grams[:, cut[k] : cut[k + 1]], [x[cut[k] : cut[k + 1]] for x in numbers]), None, None) for k in np.flatnonzero(np.diff(cut)).tolist()]


def count_grams(train: DataFrame, text_col: str, deal: Deal, order: int) -> DataFrame:
    """Packed rows of distinct n-grams: those of the full order, and of lower levels those that begin with the start mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: [] for k in range(2, order + 1)}
        size = 0

        def packed() -> pa.RecordBatch:
            rows = []
            for kept in held.values():
                if kept:
                    grams = np.concatenate(kept, axis=1)
                    kept.clear()
                    grams, by, _, n = _summed(grams, _by(grams, deal.part_of(grams)), np.ones(grams.shape[1], np.int64))
                    rows += _packed(grams, [n], by >> _BELOW, deal.parts)
            return _rows(rows)

        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                line, place, level = marked(*tokens(batch.column("text")), order)
                for k in held:
                    held[k].append(grams_at(line, place[level == k], k))
                size += len(place)
                if size >= _HELD:
                    yield packed()
                    size = 0
        yield packed()

    return train.select(F.col(text_col).alias("text")).mapInArrow(run, _ROW)


def _gathered(batches: Iterator[pa.RecordBatch], levels: set[int], passed: list[tuple]) -> dict[int, dict[int, list]]:
    """The rows of ``levels`` by part and level, decoded; other rows go to ``passed``."""
    got: dict[int, dict[int, list]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["data"] is None or row["level"] not in levels:
                passed.append(tuple(row.values()))
            else:
                grams, numbers = _decoded(row["data"], row["level"])
                got.setdefault(row["part"], {}).setdefault(row["level"], []).append((grams, numbers[0], numbers[-1]))
    return got


def _joined(rows: list[tuple[np.ndarray, ...]], level: int) -> tuple[np.ndarray, ...]:
    """Rows of n-grams, counts and plain counts put together; histories in order, with their hash and the n-gram's."""
    grams, n, plain = (np.concatenate(x, axis=-1) for x in zip(*rows, strict=True)) if rows else (np.zeros((level, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return _summed(grams, gram_hash(grams[:-1]), n, plain)


class Table:
    """A sorted array of hashes with small numbers, in one file that is mapped into memory.

    The first bits of a hash choose a range of about eight; the next 32 are kept, so a wrong hit has odds of about 2 in a billion.
    Numbers have one byte; those of 255 and more stand in a list beside.
    """

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view of the map: slices of a map itself are slow to make
        head = raw[:24].view(np.int64)
        self.n, self.bits, columns = (int(x) for x in head)
        many = raw[24 : 24 + 8 * columns].view(np.int64)
        at = 24 + 8 * columns

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            out = raw[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += (count * np.dtype(kind).itemsize + 7) // 8 * 8
            return out

        self.starts, self.low = take((1 << self.bits) + 1, np.uint32), take(self.n, np.uint32)
        self.columns = [(take(self.n, np.uint8), take(int(m), np.int64), take(int(m), np.int64)) for m in many]

    @staticmethod
    def save(path: str, keys: np.ndarray, *columns: np.ndarray) -> int:
        """Its bytes. Written under another name and moved, so that a task that is run twice leaves one whole file."""
        order, keys = _order(keys)
        bits = max(0, (len(keys) >> 3).bit_length() - 1)
        parts = [np.array([len(keys), bits, len(columns)], np.int64)]
        big = [np.flatnonzero(c[order] >= 255) for c in columns]
        parts.append(np.array([len(x) for x in big], np.int64))
        parts += [np.searchsorted(_first(keys, bits), np.arange((1 << bits) + 1)).astype(np.uint32), _next(keys, bits)]
        for column, large in zip(columns, big, strict=True):
            parts += [np.minimum(column[order], 255).astype(np.uint8), large.astype(np.int64), column[order][large].astype(np.int64)]
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as file:
            for x in parts:
                file.write(x.tobytes() + bytes(-x.nbytes % 8))
            size = file.tell()
        os.replace(own, path)
        return size

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not."""
        if not self.n:
            return np.full(len(keys), -1)
        first, low = _first(keys, self.bits).astype(np.int64), _next(keys, self.bits)
        a, end = self.starts[first].astype(np.int64), self.starts[first + 1].astype(np.int64)
        b = end
        for _ in range(int((b - a).max(initial=0)).bit_length()):
            mid = (a + b) >> 1
            less = (a < b) & (self.low[np.minimum(mid, self.n - 1)] < low)
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
        hit = (a < end) & (self.low[np.minimum(a, self.n - 1)] == low)
        return np.where(hit, a, -1)

    def numbers(self, column: int, places: np.ndarray) -> np.ndarray:
        small, at, value = self.columns[column]
        out = small[places].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = value[np.searchsorted(at, places[large])]
        return out


def _first(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def _next(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(32 - bits)).astype(np.uint32)


def _heads(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct histories (in order in ``first``), where each begins, its total and its n-grams seen once, twice and more often."""
    new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x.astype(np.int64), new) if len(new) else np.zeros(0, np.int64) for x in (n, n == 1, n == 2, n > 2)]
    return (first[new], new, *sums)


def _of(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]


def _save_grams(folder: str, name: str, part: int, key: np.ndarray, n: np.ndarray) -> list[int]:
    once = n == 1
    return [Table.save(f"{folder}/{name}.once-{part}", key[once]), Table.save(f"{folder}/{name}.more-{part}", key[~once], n[~once])]


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = (float(max(x, 1)) for x in counts)
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])


def _discount(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(n, 3) - 1]


class Model:
    """The mapped tables of a folder. Each part's list of its files and their sizes is in a table of its own, so a file that this machine does not see, or sees in part, is an error and not an empty table."""

    def __init__(self, folder: str, deal: Deal, totals: dict[str, float], hot_heads: dict[int, tuple[int, ...]], sizes: dict[str, np.ndarray]):
        self.sizes = sizes
        self.folder, self.deal, self.totals = folder, deal, totals
        self.hot_heads = np.array([[0, 0, 0, 0]] + [hot_heads.get(int(w), (0, 0, 0, 0)) for w in deal.hot], np.int64)[1:]
        self.maps: dict[str, Table | None] = {}
        self.mapped = 0

    def table(self, name: str, part: int) -> Table | None:
        """A part's table. A worker maps at most about MAPPED bytes at once; the files stay in the machine's page cache."""
        path = f"{self.folder}/{name}-{part}"
        if path not in self.maps:
            size = int(self.sizes[name][part]) if name in self.sizes else 0
            if size and (not os.path.exists(path) or os.path.getsize(path) != size):
                raise FileNotFoundError(f"{path} of {size} bytes belongs to the model, but this machine does not see it whole: spark.checkpoint.dir must be a folder that all machines share")
            self.mapped += size
            if self.mapped > MAPPED:
                self.maps, self.mapped = {}, size
            self.maps[path] = Table(path) if size else None
        return self.maps[path]

    def look_up(self, name: str, keys: np.ndarray, part: np.ndarray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are in the table of their part, and their numbers (0 where they are not)."""
        known, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in range(columns)]
        order = np.argsort(part.astype(np.uint16), kind="stable")  # parts are below MOST_PARTS; two bytes are sorted by counting
        ordered = part[order]
        first = np.flatnonzero(_new(ordered))
        for k, mine in zip(ordered[first].tolist(), np.split(order, first[1:]), strict=False):
            table = self.table(name, k)
            if table is not None:
                place = table.find(keys[mine])
                hit = place >= 0
                known[mine[hit]] = True
                for c in range(columns):
                    out[c][mine[hit]] = table.numbers(c, place[hit])
        return known, out

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each word in the training tokens, and the number of distinct words before it."""
        grams = words[None, :]
        _, (count, cont) = self.look_up("word", gram_hash(grams), self.deal.part_of(grams), 2)
        return count, cont

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """The count of each n-gram at its level, 0 where it is unknown."""
        if len(grams) == 1:
            return self.words(grams[0])[0]
        key, part, out = gram_hash(grams), self.deal.part_of(grams), np.zeros(grams.shape[1], np.int64)
        apart = self.deal.is_hot(grams[-2]) if len(grams) == 2 else np.zeros(len(out), bool)
        for name, mine in ((str(len(grams)), np.flatnonzero(~apart)), ("hot", np.flatnonzero(apart))):
            _, (n,) = self.look_up(f"{name}.more", key[mine], part[mine], 1)
            rest = np.flatnonzero(n == 0)
            known, _ = self.look_up(f"{name}.once", key[mine[rest]], part[mine[rest]], 0)
            n[rest[known]] = 1
            out[mine] = n
        return out

    def histories(self, heads: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
        """The total of each history and its numbers of n-grams seen once, twice and more often."""
        apart = self.deal.is_hot(heads[0]) if len(heads) == 1 else np.zeros(heads.shape[1], bool)
        _, out = self.look_up(f"{len(heads) + 1}.head", gram_hash(heads), part, 4)
        if apart.any():
            found = self.hot_heads[np.searchsorted(self.deal.hot, heads[0][apart])]
            for c in range(4):
                out[c][apart] = found[:, c]
        rest = np.flatnonzero((out[0] == 0) & ~apart)
        once = rest[self.counts(heads[:, rest]) > 0]
        out[0][once] = out[1][once] = 1
        return tuple(out)

    def above(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The discounted share of each n-gram in its history, and the history's weight of the lower order."""
        d = np.array([self.totals[f"{len(grams)}.d{k}"] for k in (1, 2, 3)])
        n = self.counts(grams)
        first, which = _distinct(gram_hash(grams[:-1]))
        # A history of one word that is hot has no part of its own, and needs none.
        total, *seen = self.histories(grams[:-1, first], self.deal.part_of(grams[:, first]))
        weight = np.where(total > 0, sum(k * x for k, x in zip(d, seen, strict=True)) / np.maximum(total, 1), 1.0)
        return np.where(n > 0, n - _discount(np.maximum(n, 1), d), 0.0) / np.maximum(total, 1)[which], weight[which]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and log10 probability of each text."""
        toks, at = tokens(texts)
        t = self.totals
        first, which = _distinct(toks)
        words = toks[first]
        count, cont = self.words(words)
        base = np.log10((count + 0.1) / (t["N"] + 0.1 * (t["V"] + 1)))
        d = np.array([t["1.d1"], t["1.d2"], t["1.d3"]])
        p = (np.where(cont > 0, cont - _discount(np.maximum(cont, 1), d), 0.0) / max(t["pairs"], 1) + t["left"] / (t["V"] + 1))[which]
        order = int(t["order"])
        line, place, longest = marked(toks, at, order)
        for level in range(2, order + 1):
            spots = np.flatnonzero(longest >= level)
            grams = grams_at(line, place[spots], level)
            first, gram_of = _distinct(gram_hash(grams))
            high, weight = self.above(grams[:, first])
            p[spots] = (high + weight * p[spots[first]])[gram_of]
        p = np.log10(p)
        sums = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
        return np.diff(at), sums((count > 0)[which].astype(np.int64)), sums(base[which]), sums(p)


@lru_cache(maxsize=2)
def _model(folder: str, parts: int, hot: tuple, totals: tuple, heads: tuple, sizes: tuple) -> Model:
    return Model(folder, Deal(parts, hot), dict(totals), dict(heads), {name: np.frombuffer(x, np.int64) for name, x in sizes})


def hot_words(train: DataFrame, text_col: str, parts: int) -> tuple[int, ...]:
    """The words (48-bit hashes) that make up HOT_SHARE of a part or more in one text of SAMPLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                new, count = np.unique(tokens(batch.column("text"))[0], return_counts=True)
                words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, count]), len(words)).astype(np.int64)
        often = n * parts * 2 >= n.sum() * HOT_SHARE
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words[often].astype(np.int64), -1)), pa.array(np.append(n[often], n.sum()))], ["word", "n"])

    some = train.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("text"))
    found = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MOST_HOT + 1).collect()
    total = max((r["n"] for r in found if r["word"] == -1), default=0)
    return tuple(r["word"] for r in found if r["word"] != -1 and r["n"] * parts >= total * HOT_SHARE)


def train_model(train: DataFrame, text_col: str = "text", folder: str | None = None, order: int = 3, part_bytes: int = 16_000_000) -> tuple:
    """(folder, parts, hot words, totals, sums of the hot words' histories, sizes of the files): where the model of n-grams of up to ``order`` tokens lies, and its bounded rest."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = train.sparkSession
    small_arrow_batches(spark)
    folder = folder or local_path(f"{shared_dir(spark)}/kn-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    size = int(train.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    parts = min(MOST_PARTS, max(8, -(-size // part_bytes)))
    hot = hot_words(train, text_col, parts)
    deal = Deal(parts, hot)

    def words_below(grams: np.ndarray, plain: np.ndarray) -> list[tuple]:
        words = grams[-1:]
        words, by, _, cont, count = _summed(words, _by(words, deal.part_of(words)), np.ones(words.shape[1], np.int64), plain)
        return _packed(words, [cont, count], by >> _BELOW, parts)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the n-grams and histories of a part, from the full order down; sends words, pairs of hot words and counts of counts on."""
        passed: list[tuple] = []
        for part, rows in _gathered(batches, set(range(2, order + 1)), passed).items():
            below: list[tuple] = []
            for level in range(order, 1, -1):
                grams, first, key, n, plain = _joined([*rows.pop(level, []), *below], level)
                if level == 2:
                    apart = deal.is_hot(grams[0])
                    by = _by(grams[:, apart], deal.part_of(grams[:, apart]))
                    way = np.argsort(by)
                    yield _rows(_packed(grams[:, apart][:, way], [n[apart][way], plain[apart][way]], by[way] >> _BELOW, parts))
                    grams, first, key, n, plain = grams[:, ~apart], first[~apart], key[~apart], n[~apart], plain[~apart]
                written = _save_grams(folder, str(level), part, key, n)
                head, _, total, *seen = _heads(first, n)
                more = total > 1
                written.append(Table.save(f"{folder}/{level}.head-{part}", head[more], total[more], *[x[more] for x in seen]))
                yield _rows([(part, level, None, 0, _of(n)), *_listed([f"{level}.once", f"{level}.more", f"{level}.head"], written, part)])
                below = [(grams[1:], np.ones(len(n), np.int64), plain)]
            yield _rows(words_below(grams, plain))
        yield _rows(passed)

    def hot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the pairs of hot words that fall in a part; sends words, the sums of histories and counts of counts on."""
        passed: list[tuple] = []
        for part, rows in _gathered(batches, {2}, passed).items():
            grams, first, key, n, plain = _joined(rows[2], 2)
            written = _listed(["hot.once", "hot.more"], _save_grams(folder, "hot", part, key, n), part)
            _, at, *sums = _heads(first, n)
            yield _rows([(part, 2, None, 0, _of(n)), *written, *[(part, -1, None, int(w), [int(x) for x in s] + [0]) for w, *s in zip(grams[0, at], *sums, strict=True)], *words_below(grams, plain)])
        yield _rows(passed)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[tuple] = []
        for part, rows in _gathered(batches, {1}, passed).items():
            words, _, key, cont, count = _joined(rows[1], 1)
            passed += _listed(["word"], [Table.save(f"{folder}/word-{part}", key, count, cont)], part)
            passed += [(part, 1, None, 0, _of(cont)), (part, 0, None, 0, [int(count.sum())] + [0] * 4)]
        yield _rows(passed)

    def _listed(names: list[str], sizes: list[int], part: int) -> list[tuple]:
        """Rows of level -2: the sizes of a part's files."""
        return [(part, -2, None, files.index(name), [size, 0, 0, 0, 0]) for name, size in zip(names, sizes, strict=True)]

    files = ["word", "hot.once", "hot.more", *[f"{k}.{x}" for k in range(2, order + 1) for x in ("once", "more", "head")]]
    packed = count_grams(train, text_col, deal, order)
    for step in (levels, hot_pairs, vocabulary):
        packed = dealt(packed, parts, "part").mapInArrow(step, _ROW)
    done = durable(packed.select("part", "level", "word", "of"))  # the files are written once
    sizes = {name: np.zeros(parts, np.int64) for name in files}
    for r in done.where("level = -2").select("part", "word", F.col("of")[0].alias("size")).collect():  # a number for each file
        sizes[files[r["word"]]][r["part"]] = r["size"]
    packed = done.where("level != -2")
    sums = packed.groupBy("level", "word").agg(*[F.sum(F.col("of")[k]).alias(f"x{k}") for k in range(5)]).collect()
    of = {k: [0] * 5 for k in range(order + 1)} | {r["level"]: [int(x) for x in r[2:]] for r in sums if r["level"] >= 0}
    heads = tuple((r["word"], tuple(int(x) for x in r[2:6])) for r in sums if r["level"] < 0)
    discounts = {k: _discounts(np.array(of[k][:4])) for k in range(1, order + 1)}
    n, v, pairs, few, lower = of[0][0], of[1][4], of[2][4], of[1], discounts[1]
    left = (lower[0] * few[0] + lower[1] * few[1] + lower[2] * max(0, v - few[0] - few[1])) / max(pairs, 1)
    totals = (("order", order), ("N", n), ("V", v), ("pairs", pairs), ("left", float(left) if pairs else 1.0), *[(f"{k}.d{j + 1}", float(x)) for k, d in discounts.items() for j, x in enumerate(d)])
    return folder, parts, hot, totals, heads, tuple((name, x.tobytes()) for name, x in sizes.items())


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score (log10 probability) and perplexity of each row."""
    small_arrow_batches(docs.sparkSession, 1024)
    n = int(dict(model[3])["N"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _model(*model)
        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                count, known, base, p = found.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(count), n)), pa.array(base), pa.array(p), pa.array(10.0 ** (-p / np.maximum(count, 1)))], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)
