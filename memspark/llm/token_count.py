"""Token counts without token ids: each distinct pre-token is encoded once, and documents sum over their pre-tokens.

1. The corpus's pre-tokens with their frequencies: counted in each task, then by a shuffle of distinct pre-tokens.
2. The number of pieces of each, by the tokenizer's library.
3. The most frequent ones (those above the frequency that leaves ``hot`` of them at most, so a bounded broadcast) are summed where documents are read; the rest travel as
   (row, pre-token, frequency), are joined with their piece counts and summed by row.

Pre-tokens are what the library's normaliser and splitter make of a text. For texts of Latin letters (below U+0250) the same
rules are applied here, with a check that the file states them; any other text goes through the library's own parts.
The strings of special tokens inside a text are one token each, as is the library's default.

Rows are told apart by id and a hash of the text, which a recomputed task finds again whatever the order of its rows; repeated rows sum to their number times one, and are given back as that many rows.

Defined cases: a null text is empty: 0 bytes and 0 tokens. Repeated rows and null ids have a row each. Very long texts are counted whole. A tie between pre-tokens at the bound of the frequent
ones changes where they are summed, not the sum. An empty table gives an empty one. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import _words
from memspark.llm._shared import durable, small_arrow_batches

#: Distinct pre-tokens that a task holds before it sends them on.
HELD = 300_000
#: The rules of the tokenizer file that the short way stands for.
_RULES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
_BEYOND = regex.compile("[ɐ-\U0010ffff]")


class PreTokens:
    """The pre-tokens of a text with their frequencies; special strings count under their own name."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules["pre_tokenizer"]["pretokenizers"][0] if rules["pre_tokenizer"].get("pretokenizers") else {}
        self.plain = rules["normalizer"].get("normalizers") == _RULES and split.get("pattern") == {"Regex": _SPLIT} and split.get("invert") is True and split.get("behavior") == "Removed"
        self.specials = [x["content"] for x in rules["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def count(self, text: str) -> Counter:
        out = Counter()
        parts = [text]
        if self.special and any(x in text for x in self.specials):
            out.update(self.special.findall(text))
            parts = self.special.split(text)
        for part in parts:
            if self.plain and not _BEYOND.search(part):
                out.update(_PLAIN.findall(unicodedata.normalize("NFC", part).lower()))
            else:
                clean = self.tokenizer.normalizer.normalize_str(part)
                out.update(clean[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean))
        return out

    def pieces(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _loaded(path: str) -> PreTokens:
    return PreTokens(path)


def piece_counts(docs: DataFrame, path: str, text_col: str) -> DataFrame:
    """word, freq, pieces of every distinct pre-token of ``docs``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = _loaded(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "freq"])

        for whole in batches:
            for text in whole.column("text").to_pylist():
                held.update(made.count(text or ""))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.pieces(batch.column("word").to_pylist()), pa.int64())], ["word", "freq", "pieces"])

    words = docs.select(F.col(text_col).alias("text")).mapInArrow(local, "word string, freq long")
    return words.groupBy("word").agg(F.sum("freq").alias("freq")).mapInArrow(encode, "word string, freq long, pieces long")


def hot_from(counts: DataFrame, hot: int) -> int:
    """The least frequency that at most ``hot`` pre-tokens have or exceed, to a part in 16, from a histogram of a few hundred rows."""
    step = F.floor(16 * F.log2("freq")).cast("long")
    bins = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("freq").alias("least")).orderBy(F.desc("b")).collect()
    least = 1 << 62
    for row in bins:
        hot -= row["n"]
        if hot < 0:
            break
        least = row["least"]
    return least


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, hot: int = 200_000) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of each row. ``path`` is read on each worker."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    counts = durable(piece_counts(docs, path, text_col))
    top = counts.where(F.col("freq") >= hot_from(counts, hot)).select("word", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(top["word"], top["pieces"].tolist(), strict=True)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pieces = _loaded(path), known.value
        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                at, sizes, sums, words = [], [], [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    text, total = text or "", 0
                    cold = []
                    for word, n in made.count(text).items():
                        if word in pieces:
                            total += n * pieces[word]
                        else:
                            cold.append((word, n))
                    # The row's own line has a word that no text has, so that it is dealt evenly and joined with nothing.
                    at += [k] * (len(cold) + 1)
                    sizes += [len(text.encode())] + [None] * len(cold)
                    sums += [total] + [n for _, n in cold]
                    words += [f"\n{batch.column('h')[k]}"] + [w for w, _ in cold]
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("h").take(at), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(words, pa.string())], ["id", "h", "n_bytes", "n", "word"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col, id_col).alias("h"), F.col(text_col).alias("text"))
    spread_rows = rows.mapInArrow(spread, "id long, h long, n_bytes long, n long, word string")
    joined = spread_rows.join(counts.select("word", "pieces"), "word", "left")
    summed = joined.groupBy("id", "h").agg(F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("total"))
    out = summed.select(F.col("id").alias(id_col), "n_bytes", F.expr("total div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
