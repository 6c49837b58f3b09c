"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An edit changes at most q of a string's q-grams, so a stretch of text within k edits of a window of m characters keeps m - q + 1 - k*q
of the window's q-grams, at diagonals within k of each other. Passages are cut into overlapping windows of ``window`` bytes
(a shorter passage is one window with a smaller budget); their q-grams are the index. Three sieves follow one another:

* places of a document where enough q-grams of the index stand close together, whichever they are (over whole batches at once),
* bands of 2(k+1) diagonals, each overlapping the next by half, that hold the bound's number of one window's q-grams,
* alignment of the window with the text within the band's diagonals.

A document is contaminated if a window is found in it. Text is compared as UTF-8 bytes with A-Z lower-cased and each run of white
space as one space.

Passages shorter than ``least`` bytes hold too few q-grams for that: they are found where they stand as they are, between other
characters than letters and digits.

The index is broadcast; it is made of at most ``part_bytes`` of passages. A larger benchmark is cut into parts, each of which passes
over the documents, and their findings are united by row.

Defined cases: null and empty texts are clean; benchmark passages that are null or without a word are not looked for.
Rows are judged one by one, repeated rows alike. Texts are searched whole, whatever their length. Other columns are carried as they
are, ``items`` among them; columns that begin with ``_dc_`` are this module's own and are refused.
Ties: of passages that fit a text equally well all are named. An empty table of texts gives an empty one; with an empty benchmark all texts are clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm import _words
from memspark.llm._shared import small_arrow_batches, written

Q = 12
_FOLD = _words._LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 0x20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and runs of white space as one space, and the place that each came from."""
    low = _FOLD[raw]
    keep = low != 0x20
    keep[1:] |= keep[:-1]
    at = np.flatnonzero(keep)
    return low[at], at


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = np.empty(len(text) - 7, np.uint64)
    for shift in range(8):
        whole = (len(text) - shift) // 8
        eights[shift::8] = np.frombuffer(text[shift : shift + 8 * whole].tobytes(), "<u8")
    return (eights[:n] * _M1) ^ (eights[4 : 4 + n] * _M2)


def aligned(window: np.ndarray, text: np.ndarray, budget: int) -> bool:
    """Whether all of ``window`` aligns with a stretch of ``text`` within ``budget`` edits, starting anywhere and kept within the diagonals of ``text``."""
    width = max(1, len(text) - len(window) + budget + 1)
    steps = np.arange(width)
    padded = np.concatenate([text, np.full(len(window) + width, -1, np.int64)])
    row = np.zeros(width, np.int64)
    for i in range(len(window)):
        up = np.append(row[1:], budget + 1) + 1  # a byte of the window is missing in the text
        new = np.minimum(row + (padded[i : i + width] != window[i]), up)
        row = np.minimum.accumulate(new - steps) + steps  # a byte of the text is missing in the window
        if row.min() > budget:
            return False
    return True


class Index:
    """The windows of passages and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], window: int, edits: float, least: int):
        item, self.texts = [], []
        #: Short passages by their bytes (a character each), with their items.
        self.short: dict[str, list[int]] = {}
        for number, text in items:
            whole = folded(np.frombuffer((text or "").strip().encode(), np.uint8))[0]
            if 0 < len(whole) < max(least, 2 * Q):
                self.short.setdefault(whole.tobytes().decode("latin-1").strip(), []).append(number)
            if len(whole) >= max(least, 2 * Q):
                starts = {*range(0, max(1, len(whole) - window + 1), max(1, window // 2)), max(0, len(whole) - window)}
                for at in sorted(starts):
                    item.append(number)
                    self.texts.append(whole[at : at + window])
        self.item, self.sizes = np.array(item, np.int64), np.array([len(x) for x in self.texts], np.int64)
        self.budgets = np.minimum((self.sizes * edits).astype(np.int64), (self.sizes - Q) // Q)
        self.need = self.sizes - Q + 1 - self.budgets * Q
        codes = [grams(x) for x in self.texts]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.window = np.repeat(np.arange(len(codes), dtype=np.int32), [len(x) for x in codes])[order]
        self.at = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(x), dtype=np.int32) for x in codes]])[order]
        self.shift = np.uint64(64 - min(26, max(16, math.ceil(math.log2(max(1, len(code)) * 64)))))
        self.known = np.zeros(1 << (64 - int(self.shift)), bool)
        self.known[(self.code >> self.shift).astype(np.int64)] = True
        self.span = int((self.sizes + 2 * self.budgets).max(initial=1))
        self.fewest = int(self.need.min()) if len(self.need) else 1

    def dense(self, code: np.ndarray) -> np.ndarray:
        """Places within a stretch of ``span`` that holds ``fewest`` q-grams of the index."""
        seen = np.concatenate([[0], np.cumsum(self.known[(code >> self.shift).view(np.int64)], dtype=np.int32)])
        n = len(code)
        many = np.flatnonzero(seen[np.minimum(np.arange(n) + self.span, n)] - seen[:n] >= self.fewest)
        if not len(many):
            return many
        new = np.flatnonzero(np.concatenate([[True], np.diff(many) > self.span]))
        first, last = many[new], np.append(many[new[1:] - 1], many[-1])
        return np.concatenate([np.arange(a, min(n, b + self.span)) for a, b in zip(first, last, strict=True)])

    def search(self, text: np.ndarray, code: np.ndarray, place: np.ndarray) -> list[int]:
        """The items of which a window is found in ``text``, looking at the q-grams at ``place``."""
        low, high = np.searchsorted(self.code, code[place], "left"), np.searchsorted(self.code, code[place], "right")
        n = high - low
        hit = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window, at = self.window[hit].astype(np.int64), self.at[hit].astype(np.int64)
        step = self.budgets[window] + 1
        band = (np.repeat(place, n) - at) // step
        found = set()
        for back in (0, 1):
            rows = np.unique(np.stack([window, band - back, at], 1), axis=0)  # a q-gram of the window counts once
            if len(rows):
                new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
                enough = np.diff(np.append(new, len(rows))) >= self.need[rows[new, 0]]
                found |= {(int(w), int(b)) for w, b, _ in rows[new[enough]]}
        items = set()
        for w, b in sorted(found):
            if int(self.item[w]) not in items:
                k = int(self.budgets[w])
                start, end = b * (k + 1) - k, (b + 2) * (k + 1) + int(self.sizes[w]) + k
                if aligned(self.texts[w].astype(np.int64), text[max(0, start) : end].astype(np.int64), k):
                    items.add(int(self.item[w]))
        return sorted(items)


def _inner(byte: str) -> bool:
    return byte.isalnum() or byte >= "\x80"


def _short_found(automaton, text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """The row and the items of each short passage in ``text``, where words begin and end with it."""
    line = text.tobytes().decode("latin-1")
    for last, (size, items) in automaton.iter(line):
        first = last - size + 1
        row = int(np.searchsorted(bounds, first, "right")) - 1
        a, b = int(bounds[row]), int(bounds[row + 1])
        if last < b and (first == a or not _inner(line[first - 1])) and (last + 1 == b or not _inner(line[last + 1])):
            yield row, items


def _search_part(docs: DataFrame, index: Index, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns of ``docs`` and ``_dc_items``: the benchmark items found in each row."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        automaton = ahocorasick.Automaton()
        for word, items in index.short.items():
            automaton.add_word(word, (len(word), items))
        automaton.make_automaton()
        for whole in batches:
            for batch in _words.pieces(whole, "_dc_text"):
                raw, offsets = _words.utf8(batch.column("_dc_text"))
                text, came = folded(raw)
                code = grams(text)
                place = index.dense(code) if len(index.code) else np.zeros(0, np.int64)
                bounds = np.searchsorted(came, offsets)
                row = np.searchsorted(bounds, place, "right") - 1
                items = [[] for _ in range(batch.num_rows)]
                rows, first = np.unique(row, return_index=True)
                for r, inside in zip(rows.tolist(), np.split(place, first[1:]), strict=False):
                    a, b = bounds[r], bounds[r + 1]
                    items[r] = index.search(text[a:b], code[a:b], inside[inside + Q <= b] - a)
                if index.short:
                    for r, found in _short_found(automaton, text, bounds):
                        items[r] = sorted({*items[r], *found})
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(items, pa.list_(pa.int64()))], [*keep, "_dc_items"])

    kept = docs.select(*keep, F.col(text_col).alias("_dc_text"))
    return kept.mapInArrow(run, T.StructType([*[f for f in kept.schema.fields if f.name != "_dc_text"], T.StructField("_dc_items", T.ArrayType(T.LongType()))]))


def _parts(benchmark: DataFrame, item_col: str, item_text: str, window: int, edits: float, least: int, part_bytes: int) -> Iterator[Index]:
    """An index for each ``part_bytes`` of passages; one at least."""
    passages = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    parts = 1 + int(passages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // part_bytes
    for part in range(parts):
        rows = passages.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "text").collect()
        yield Index([(r["item"], r["text"]) for r in rows], window, edits, least)


def _found(docs: DataFrame, id_col: str, text_col: str, indexes: Iterator[Index]) -> DataFrame:
    """``docs`` with ``_dc_items``, sorted. Where there are several indexes, each is made, searched with and let go before the next, and what it finds (rows with a hit only) is written; it is put together by the row's id and a hash of its text."""
    if any(c.lower().startswith("_dc_") for c in docs.columns):
        raise ValueError("columns may not begin with _dc_")
    small_arrow_batches(docs.sparkSession)
    first, second = next(indexes), next(indexes, None)
    if second is None:
        return _search_part(docs, first, docs.columns, text_col)
    keyed = docs.withColumns({"_dc_id": F.col(id_col).cast("string"), "_dc_h": F.xxhash64(text_col)})
    hits = None
    for index in chain((first, second), indexes):
        one = _search_part(keyed.select("_dc_id", "_dc_h", text_col), index, ["_dc_id", "_dc_h"], text_col)
        one = written(one.where(F.size("_dc_items") > 0), "leaks")
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.select("_dc_id", "_dc_h", F.explode("_dc_items").alias("i")).groupBy("_dc_id", "_dc_h").agg(F.sort_array(F.collect_set("i")).alias("_dc_items")).toDF("_dc_i", "_dc_x", "_dc_items")
    joined = keyed.join(hits, F.col("_dc_id").eqNullSafe(F.col("_dc_i")) & (F.col("_dc_h") == F.col("_dc_x")), "left")
    return joined.select(*docs.columns, F.coalesce("_dc_items", F.array().cast("array<long>")).alias("_dc_items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 100, edits: float = 0.05, least: int = 40, part_bytes: int = 4_000_000) -> DataFrame:
    """id_col, contaminated and items (found benchmark items, sorted) of each row."""
    found = _found(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, _parts(benchmark, item_col, item_text, window, edits, least, part_bytes))
    return found.select(id_col, (F.size("_dc_items") > 0).alias("contaminated"), F.col("_dc_items").alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 100, edits: float = 0.05, least: int = 40, part_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns stay as they are."""
    found = _found(docs, id_col, text_col, _parts(benchmark, item_col, item_text, window, edits, least, part_bytes))
    return found.where(F.size("_dc_items") == 0).drop("_dc_items")
