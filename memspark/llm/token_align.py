"""Alignment of two tokenizers: byte offsets where tokens of both end cut a text's tokens into groups.

A stretch of bytes is a fragment: its tokens up to the first common end (open prefix), closed groups, and tokens after the last common end (open suffix). Fragments compose:
suffix and prefix join, and the composition is associative, so fragments may meet in any tree order.

1. Both tokenizers keep apart what stands on the two sides of a single space between other characters (checked against the second one's vocabulary; the first one's splitter cuts there), so such
   pieces of a text are fragments by themselves. A batch's distinct pieces are encoded and cut into groups together, and a bounded table in each worker keeps them. Texts are read and encoded once: what
   is written of each are its numbers, its digest and its distinct pairs of tokens that end together.
2. Texts of more than ``chunk`` bytes are cut into byte ranges without regard to tokens. A range takes the pieces that reach into it as context and holds the tokens that end in it. Ranges are dealt
   to tasks, and their fragments meet in a tree, ``FAN`` at a time.
3. Pairs are counted over the corpus from these, in each task first. The most frequent (above the count that leaves ``hot`` of them at most) are looked up where they are
   read again; the others travel as (text, pair, number) and are joined with their counts.

Pieces of Latin letters (below U+0250) go through tiktoken, whose ranks and pattern are the same rules, and are many times faster; that the file states these rules is checked. Others go through the file's own library.

Defined cases: null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and ''. Repeated rows and equal ids are texts of their own and count again; null ids are kept. An
empty table gives an empty one. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import _words
from memspark.llm._shared import durable, small_arrow_batches, written
from memspark.llm.token_count import hot_from

#: Pieces that a worker keeps, and the longest that it does.
HELD, LONGEST = 400_000, 64
#: Fragments that one composition takes.
FAN = 16
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space, where pieces may not part.
_ODD = re.compile(r"[^\S ] | [^\S ]|  |^ | $")
#: Fixed value: the splitter that a byte-level file with ``use_regex`` stands for.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT_BYTES = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_SPACE = "▁"


class Fragment(NamedTuple):
    """Decimal ids, comma-joined: of the open prefix (a1, b1), the closed groups, and the open suffix (a2, b2). Without a common end (not ``cut``) all tokens are in the prefix."""

    a1: str = ""
    b1: str = ""
    groups: str = ""
    a2: str = ""
    b2: str = ""
    cut: bool = False


def _joined(x: str, y: str, by: str = ",") -> str:
    return f"{x}{by}{y}" if x and y else x or y


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of x's bytes followed by y's."""
    if not x.cut:
        return y._replace(a1=_joined(x.a1, y.a1), b1=_joined(x.b1, y.b1))
    a, b = _joined(x.a2, y.a1), _joined(x.b2, y.b1)
    if not y.cut:
        return x._replace(a2=a, b2=b)
    return Fragment(x.a1, x.b1, _joined(_joined(x.groups, f"{a}|{b}", ";"), y.groups, ";"), y.a2, y.b2, True)


def groups_of(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common ends, and how many tokens of a and of b lie up to and with each."""
    at = np.minimum(np.searchsorted(b_ends, a_ends), max(len(b_ends) - 1, 0))
    last = np.flatnonzero(b_ends[at] == a_ends) if len(b_ends) else np.zeros(0, np.int64)
    return a_ends[last], last + 1, at[last] + 1


def of_tokens(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, np.ndarray]:
    """The fragment of tokens with their ends, and the pairs (a, b) of them that end together."""
    common, i, j = groups_of(a, a_ends, b, b_ends)
    text = lambda ids: ",".join(map(str, ids.tolist()))
    if not len(common):
        return Fragment(text(a), text(b)), np.zeros((0, 2), np.int64)
    groups = [f"{text(a[p:q])}|{text(b[x:y])}" for p, q, x, y in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    return Fragment(text(a[: i[0]]), text(b[: j[0]]), ";".join(groups), text(a[i[-1] :]), text(b[j[-1] :]), True), np.stack([a[i - 1], b[j - 1]], 1)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others by code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def _ranks(rules: dict) -> dict[bytes, int]:
    """The vocabulary by its bytes, if merges make tokens in the order of their ids."""
    vocab, byte = rules["model"]["vocab"], _byte_of()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in rules["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of the ids")
    special = {x["content"] for x in rules["added_tokens"]}
    return {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}


class Tokenizers:
    """Both tokenizers, and a bounded table of pieces by place: token numbers and links (``numbers``), groups as text, and pairs of tokens that end together."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            rules = json.load(file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if rules["pre_tokenizer"].get("type") != "ByteLevel" or not rules["pre_tokenizer"].get("use_regex") or rules["normalizer"] or any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("these tokenizers do not keep apart what stands on the two sides of a space")
        ranks = _ranks(rules)
        self.plain = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        sizes = {k: len(token) for token, k in ranks.items()} | {self.a.token_to_id(x["content"]): len(x["content"].encode()) for x in rules["added_tokens"]}
        self.size_a = np.array([sizes.get(k, 0) for k in range(max(sizes) + 1)])
        self.size_b = np.array([1 if self.b.is_byte(k) else len(p.replace(_SPACE, " ").encode()) for k, p in enumerate(pieces)])
        self.names = [pa.array(list(map(str, range(len(x)))), pa.string()) for x in (self.size_a, self.size_b)]
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.held, self.used = 0, 0
        self.numbers, self.first, self.pairs = np.zeros((1024, 3), np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.size_b) + b

    def whole(self, text: str) -> bool:
        """Whether both give back the bytes of space and text; the first always does."""
        return bool(text) and self.b.normalize(text).replace(_SPACE, " ") == f" {text}"

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a for all pieces end to end and the number of each piece's, and the same of b; a space stands before each piece."""
        out = []
        a = [self.plain.encode_ordinary(f" {p}") if p.isascii() or max(p) < "\u0250" else self.a.encode(f" {p}", add_special_tokens=False).ids for p in pieces]
        for ids in (a, self.b.encode(pieces, num_threads=1)):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            out += [np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes]
        return tuple(out)

    def tokens(self, piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a and their ends in bytes, and the same of b; the space before the piece is its first byte."""
        a, _, b, _ = self.ids([piece])
        return a, np.cumsum(self.size_a[a]), b, np.cumsum(self.size_b[b])

    def add(self, pieces: list[str]) -> None:
        """Puts new pieces to the table. As both tokenizers give back all bytes, the ends of all pieces in turn are comparable."""
        a, n_a, b, n_b = self.ids(pieces)
        common, i, j = groups_of(a, np.cumsum(self.size_a[a]), b, np.cumsum(self.size_b[b]))
        upto = np.searchsorted(common, np.cumsum(self.size_a[a])[np.cumsum(n_a) - 1], "right")  # common ends up to and with each piece's
        lists = []
        for ids, ends, names in ((a, i, self.names[0]), (b, j, self.names[1])):
            lists.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), names.take(pa.array(ids))), ","))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pc.binary_join_element_wise(*lists, "|")), ";").to_pylist()
        at, links = len(self.groups), np.diff(np.concatenate([[0], upto]))
        while at + len(pieces) > len(self.numbers):
            self.numbers, self.first = np.concatenate([self.numbers, np.zeros_like(self.numbers)]), np.concatenate([self.first, np.zeros_like(self.first)])
        while self.used + len(common) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.numbers[at : at + len(pieces)] = np.stack([n_a, n_b, links], 1)
        self.first[at : at + len(pieces)] = self.used + np.concatenate([[0], upto[:-1]])
        self.pairs[self.used : self.used + len(common)] = self.pair(a[i - 1], b[j - 1])
        self.used += len(common)
        self.groups += groups
        self.held += sum(map(len, groups))
        self.places.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def of_pieces(self, texts: Sequence[list[str]]) -> list[list[int]]:
        """The places of the pieces of each text. Places hold until the next call."""
        if len(self.groups) > HELD or self.held > 1 << 26:
            self.clear()
        new = sorted(set(chain.from_iterable(texts)).difference(self.places))
        for at in range(0, len(new), 50_000):
            self.add(new[at : at + 50_000])
        out = [list(map(self.places.__getitem__, pieces)) for pieces in texts]
        for piece in new:
            if len(piece) > LONGEST:
                del self.places[piece]
        return out

    def links(self, places: np.ndarray) -> np.ndarray:
        """The pairs of all these places in turn."""
        n = self.numbers[places, 2]
        return self.pairs[np.repeat(self.first[places] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(places) else self.pairs[:0]


def pieces_of(text: str) -> list[str]:
    """What single spaces between other characters part."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


@lru_cache(maxsize=2)
def _loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def ranges(text: str, chunk: int) -> Iterator[tuple[int, int, int, str]]:
    """Byte ranges (after lo, up to hi) of space and text, each with its context from byte ``left`` on: whole pieces, the first one's space left out. A range ends in another piece than it begins in."""
    data = f" {text}".encode()
    lo = left = 0
    while lo < len(data):
        hi = lo + chunk
        cut = _CUT_BYTES.search(data, hi) if hi < len(data) else None
        right = cut.start() if cut else len(data)
        hi = hi if cut else len(data)
        yield lo, hi, left, data[left + 1 : right].decode()
        if cut and right > hi:
            # The piece that the range ends in is the next one's context too.
            starts = [m.start() for m in _CUT_BYTES.finditer(data, max(left, hi - (1 << 16)), hi + 1)]
            left = starts[-1] if starts else left
        else:
            left = right
        lo = hi


def in_range(made: Tokenizers, text: str, left: int, lo: int, hi: int) -> tuple[Fragment, np.ndarray, np.ndarray]:
    """The fragment of the tokens that end after ``lo`` and up to ``hi``, its numbers and its pairs; ``text`` begins at byte ``left`` with its space left out."""
    pieces = pieces_of(text)
    ends = left + np.cumsum([1 + len(p.encode()) for p in pieces])
    begins = np.concatenate([[left], ends[:-1]])
    inside = (begins >= lo) & (ends <= hi)
    first, last = (int(x) for x in (np.argmax(inside), len(inside) - np.argmax(inside[::-1]))) if inside.any() else (0, 0)
    out, numbers, pairs = Fragment(), np.zeros(3, np.int64), []

    def part(k: int) -> None:
        nonlocal out, numbers
        a, a_ends, b, b_ends = made.tokens(pieces[k])
        a_in, b_in = ((begins[k] + x > lo) & (begins[k] + x <= hi) for x in (a_ends, b_ends))
        f, both = of_tokens(a[a_in], a_ends[a_in], b[b_in], b_ends[b_in])
        out, numbers = compose(out, f), numbers + [a_in.sum(), b_in.sum(), len(both)]
        pairs.append(made.pair(both[:, 0], both[:, 1]))

    touched = np.flatnonzero((ends > lo) & (begins < hi) & ~inside).tolist()
    for k in touched:
        if k < first or first == last:
            part(k)
    if last > first:
        places = np.array(made.of_pieces([pieces[first:last]])[0], np.int64)
        begin, _, rest = ";".join(map(made.groups.__getitem__, places.tolist())).partition(";")
        out, numbers = compose(out, Fragment(*begin.split("|"), rest, cut=True)), numbers + made.numbers[places].sum(0)
        pairs.append(made.links(places))
        for k in touched:
            if k >= last:
                part(k)
    return out, numbers, np.concatenate([np.zeros(0, np.int64), *pairs])


_NUMBERS = ["n_a", "n_b", "n_links"]
_UNIT = "id {id}, h long, seq int, lo long, hi long, at long, part string"
_PART = "id {id}, h long, seq int, copies int, n_a long, n_b long, n_links long, pairs array<long>, times array<int>, a1 string, b1 string, groups string, a2 string, b2 string, cut boolean"
_SHORT = "id {id}, n_a long, n_b long, n_links long, pairs array<long>, times array<int>, groups_sha256 string"


def _lists(pairs: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of each row's pairs (end to end, so many each) the distinct ones and their numbers."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((pairs, row))
    pairs, row = pairs[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])])) if len(pairs) else np.zeros(0, np.int64)
    ends = pa.array(np.concatenate([[0], np.searchsorted(row[new], np.arange(len(sizes)), "right")]), pa.int32())
    times = np.diff(np.append(new, len(pairs)))
    return pa.ListArray.from_arrays(ends, pa.array(pairs[new], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def counted(rows: DataFrame) -> DataFrame:
    """pair, freq over all rows (pairs, times): added up in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs, times = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1))
            pairs, at = np.unique(pairs, return_inverse=True)
            held[:] = [(pairs, np.bincount(at, times, len(pairs)).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "freq"])

        for batch in batches:
            held.append(tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times")))
            size += len(held[-1][0])
            if size > 4_000_000:
                sums = out()
                size = sums.num_rows
                if size > 2_000_000:
                    yield sums
                    held, size = [], 0
        yield out()

    return rows.select("pairs", "times").mapInArrow(run, "pair long, freq long").groupBy("pair").agg(F.sum("freq").alias("freq"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, hot: int = 500_000) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row; see the module. Both paths are read on each worker."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    long = F.octet_length("text") > chunk
    short = rows.where(~F.coalesce(long, F.lit(False)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded(path_a, path_b)
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = ranges(text, chunk) if made.whole(text) else [(0, 0, 0, None)]
                for seq, (lo, hi, at, part) in enumerate(found):
                    one = [pa.array([x], t) for x, t in ((seq, pa.int32()), (lo, pa.int64()), (hi, pa.int64()), (at, pa.int64()), (part, pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 1), batch.column("h").slice(k, 1), *one], ["id", "h", "seq", "lo", "hi", "at", "part"])

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded(path_a, path_b)
        for full in batches:
            for batch in _words.pieces(full, "text"):
                texts = batch.column("text").to_pylist()
                places = made.of_pieces([pieces_of(t) if t and made.whole(t) else [] for t in texts])
                flat, sizes = np.fromiter(chain.from_iterable(places), np.int64), np.array(list(map(len, places)))
                total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(made.numbers[flat], 0)])
                ends = np.cumsum(sizes)
                numbers = total[ends] - total[ends - sizes]
                digests = [_digest(";".join(map(made.groups.__getitem__, p))) for p in places]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(numbers[:, k]) for k in range(3)], *_lists(made.links(flat), numbers[:, 2]), pa.array(digests, pa.string())], ["id", *_NUMBERS, "pairs", "times", "groups_sha256"])

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded(path_a, path_b)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                part, at, lo, hi = (row.column(c)[0].as_py() for c in ("part", "at", "lo", "hi"))
                f, numbers, pairs = in_range(made, part, at, lo, hi) if part is not None else (Fragment(), np.zeros(3, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([row.column("id"), row.column("h"), row.column("seq"), pa.array([1], pa.int32()), *[pa.array(numbers[j : j + 1]) for j in range(3)], *_lists(pairs, np.array([len(pairs)])), *[pa.array([x]) for x in f]], ["id", "h", "seq", "copies", *_NUMBERS, "pairs", "times", *Fragment._fields])

    def meet(table: pa.Table) -> pa.Table:
        """The fragments of a stretch as one. Repeated rows have the same fragments: one of each is taken, and the rows are counted."""
        found: dict[int, dict] = {}
        for row in table.to_pylist():
            if row["seq"] in found:
                found[row["seq"]]["copies"] += row["copies"]
            else:
                found[row["seq"]] = row
        in_order = [found[k] for k in sorted(found)]
        f = Fragment()
        for k, row in enumerate(in_order):
            mine = Fragment(*(row[x] for x in Fragment._fields))
            f = compose(f, mine) if k else mine
        pairs, times = (np.concatenate([np.array(r[x], np.int64) for r in in_order]) for x in ("pairs", "times"))
        pairs, at = np.unique(pairs, return_inverse=True)
        out = in_order[0] | {c: sum(r[c] for r in in_order) for c in _NUMBERS} | f._asdict() | {"seq": in_order[0]["seq"] // FAN, "pairs": pairs.tolist(), "times": np.bincount(at, times, len(pairs)).astype(np.int64).tolist()}
        return pa.Table.from_pylist([out], table.schema)

    units = rows.where(long).select("id", F.xxhash64("text", "id").alias("h"), "text").mapInArrow(cut, _UNIT.format(id=kind))
    parts = written(units.repartition("h", "seq").mapInArrow(fragments, _PART.format(id=kind)), "align-parts")
    while True:
        most = parts.agg(F.max("seq").alias("m")).first()["m"]
        parts = parts.groupBy("id", "h", F.floor(F.col("seq") / FAN).alias("stretch")).applyInArrow(lambda key, table: meet(table), _PART.format(id=kind))
        if (most or 0) < FAN:
            break
        parts = written(parts, "align-parts")
    groups = F.concat_ws(";", F.concat("a1", F.lit("|"), "b1"), F.when(F.col("groups") != "", F.col("groups")))
    done = parts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    done = done.select("id", *_NUMBERS, "pairs", "times", F.when(F.col("cut"), F.sha2(groups, 256)).otherwise("").alias("groups_sha256"))
    every = short.mapInArrow(whole_texts, _SHORT.format(id=kind)).unionByName(done)
    every = written(every.withColumn("row", F.monotonically_increasing_id()), "align-rows")  # numbered once, as written

    counts = durable(counted(every))
    second = F.col("pair") % _vocabulary(path_b)
    top = counts.groupBy(second.alias("b")).agg(F.max("freq").alias("top"))  # a row for each id of the second vocabulary at most
    highest = {r["b"]: r["top"] for r in top.collect()}
    often = counts.where(F.col("freq") >= hot_from(counts, hot)).orderBy("pair").toArrow()
    hot_pairs, freq = (often[c].to_numpy().copy() for c in ("pair", "freq"))
    best = freq == np.array([highest.get(k, 0) for k in (hot_pairs % _vocabulary(path_b)).tolist()], np.int64)
    known = spark.sparkContext.broadcast((hot_pairs, freq, best))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, freq, best = known.value
        for batch in batches:
            sizes = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums, ends = [], np.cumsum(sizes)
            for x in (np.where(hit, times * freq[at], 0) if len(keys) else times * 0, np.where(hit & best[at], times, 0) if len(keys) else times * 0):
                total = np.concatenate([[0], np.cumsum(x)])
                sums.append(pa.array(total[ends] - total[ends - sizes]))
            rest = np.flatnonzero(~hit)
            upto = pa.array(np.concatenate([[0], np.searchsorted(rest, ends)]), pa.int32())
            lists = [pa.ListArray.from_arrays(upto, pa.array(x[rest], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", *_NUMBERS, "groups_sha256")], *sums, *lists], ["row", "id", *_NUMBERS, "groups_sha256", "count_sum", "n_best", "pairs", "times"])

    found = every.mapInArrow(look_up, f"row long, id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, count_sum long, n_best long, pairs array<long>, times array<long>")
    open_pairs = found.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    joined = open_pairs.join(counts, "pair").withColumn("b", second).join(F.broadcast(top), "b")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("freq")).alias("more"), F.sum(F.when(F.col("freq") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
    out = found.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256")


@lru_cache(maxsize=8)
def _vocabulary(path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
