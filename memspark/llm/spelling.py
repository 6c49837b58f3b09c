"""Spelling variants: frequent words one edit apart, by blocked Gram matrices of letter counts.

1. Words with their frequencies are counted by Spark; only the vocabulary goes further.
2. Words of a length meet words of the same and of the next length. One edit leaves the first half of the shorter word or what follows it as it was, so words are blocked by
   length and hash of the first half, and by length and hash of the rest: no pair is lost, and a pair that shares its first half is judged in the first of its two blocks only.
3. In each block the letter counts of all words form a matrix; its product with itself gives squared distances. A replaced letter makes 2, an inserted or deleted one 1; such pairs are
   then compared letter by letter. Large blocks are cut into bounded ones, each pair of which is a unit of work.
4. Each unit sends what a word has found (number, best form), not pairs. Forms are followed to their ends by doubling.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the hash of a run; repeated rows count again; very long texts and words are taken whole, and
blocks hold fewer of such words; ties between forms go to the smallest in code-point order; an empty table gives an empty one. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm._blocks import paired_blocks
from memspark.llm._shared import lower_ascii, written
from memspark.llm.graph import follow

RUN = "[A-Za-z\\u00C0-\\u00FF]"
#: Queries whose products with a block are held at once.
QUERIES = 1024


def words(docs: DataFrame, id_col: str, text_col: str, least: int = 6, often: int = 5, every: int = 199) -> DataFrame:
    """word, n of the words of at least ``least`` letters that occur ``often`` times or more.

    Of a run of letters whose hash with its document's id is divisible by ``every``, one letter is left out. A run too short for a word is not looked at.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least},}})"), 1)).alias("run"))
    runs = runs.select(lower_ascii(F.col("run")).alias("run"), F.crc32(F.concat("id", F.lit(":"), lower_ascii(F.col("run")))).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def _keyed(vocabulary: DataFrame, parts: int) -> DataFrame:
    """A row for each block of each word: as one of the length itself (a member) and as one of the next length. Halves fall in ``parts`` blocks of a length."""
    length, w = F.length("word"), F.col("word")

    def block(base, member, first):
        half = F.floor(base / 2).cast("int")
        key = F.substring(w, F.lit(1), half) if first else F.substring(w, F.length(w) - (base - half) + 1, base - half)
        return F.struct(F.lit(first).alias("first"), base.alias("length"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), F.lit(member).alias("member"))

    blocks = F.array(*[block(base, member, first) for base, member in ((length, True), (length - 1, False)) for first in (True, False)])
    return vocabulary.select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.*")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words end to end, and the offsets of the words."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _counts(letters: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray, kind: type) -> np.ndarray:
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cells = rows * len(alphabet) + np.searchsorted(alphabet, letters)
    return np.bincount(cells, minlength=(len(offsets) - 1) * len(alphabet)).reshape(-1, len(alphabet)).astype(kind)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each row of letters becomes its partner by one replaced letter (rows of equal length) or one inserted."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(1) == 1
    same, shifted = short == long[:, :n], short == long[:, 1:]
    before = np.where(same.all(1), n, same.argmin(1))
    after = np.where(shifted.all(1), n, shifted[:, ::-1].argmin(1))
    return before + after >= n


def _near(table: pa.Table) -> pa.Table:
    """word, near, best: of each word of a unit that is near another, how many and the most frequent of them."""
    e, q = table.filter(table["_e"]), table.filter(table["_q"])
    first, length = table["first"][0].as_py(), table["length"][0].as_py()
    half = length // 2
    entries = e["word"].to_pylist()
    names = sorted({*entries, *q["word"].to_pylist()})
    place = {w: k for k, w in enumerate(names)}
    often = np.zeros(len(names), np.int64)
    for t in (e, q):
        often[[place[w] for w in t["word"].to_pylist()]] = t["n"].to_numpy()
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if entries:
        letters, offsets = _letters(entries)
        rest = [(w, m) for w, m in zip(q["word"].to_pylist(), q["member"].to_pylist(), strict=True)]
        kind = np.float32 if length < 2000 else np.float64  # products of counts stay exact
        base = letters.reshape(len(entries), length)
        base_at = np.array([place[w] for w in entries])
        for member in (True, False):
            side = [w for w, m in rest if m == member]
            for begin in range(0, len(side), QUERIES):
                some = side[begin : begin + QUERIES]
                other, ends = _letters(some)
                alphabet = np.unique(np.concatenate([letters, other]))
                x, y = _counts(other, ends, alphabet, kind), _counts(letters, offsets, alphabet, kind)
                apart = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
                a, b = np.nonzero(apart == (2 if member else 1))
                some_at = np.array([place[w] for w in some])
                if member:  # of two words of a length, one is the other's query
                    a, b = a[some_at[a] < base_at[b]], b[some_at[a] < base_at[b]]
                rows = other.reshape(len(some), -1)
                for k in range(0, len(a), 65536):
                    i, j = a[k : k + 65536], b[k : k + 65536]
                    good = one_edit(base[j], rows[i])
                    good &= (base[j, :half] == rows[i, :half]).all(1) == first
                    pairs.append((some_at[i[good]], base_at[j[good]]))
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((other, -often[other], me))
    me, other = me[order], other[order]
    found, at, near = np.unique(me, return_index=True, return_counts=True)
    best = other[at]
    return pa.table([pa.array([names[k] for k in found], pa.string()), pa.array(near, pa.int64()), pa.array(often[best], pa.int64()), pa.array([names[k] for k in best], pa.string())], ["word", "near", "best_n", "best"])


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 5, block: int = 2048) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of ``docs``.

    Its form is the most frequent word one edit away, if that is ``ratio`` times as frequent; its root is where forms lead to.
    """
    vocabulary = written(words(docs, id_col, text_col), "vocabulary")
    bounded = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(4_000_000) / F.greatest(F.col("length"), F.lit(1)))))  # a block's letters are bounded too
    keyed = _keyed(vocabulary, 1 + vocabulary.count() // (2 * block))
    units = paired_blocks(keyed, ["first", "length", "part"], "member", "word", bounded)
    found = units.groupBy("first", "length", "part", "_i", "_j").applyInArrow(_near, "word string, near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("b"))
    judged = vocabulary.join(best.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.col1")).alias("best_n")), "word", "left")
    close = F.col("best_n") >= ratio * F.col("n")
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(close, F.col("best")).alias("form"), F.when(close, F.col("best_n")).alias("form_n")), "word-forms")
    roots = follow(judged.where("form is not null").select(F.col("word").alias("a"), F.col("form").alias("to")))
    return judged.join(roots.toDF("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
