"""Language ID by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard dictionary of raw text from labelled documents. A text, in lower case, is cut into blocks of whole characters, every
block of it is compressed with each dictionary, and the sizes are summed; the smallest total wins. Where the
margin to the next is narrow the answer is marked as rejected; the language named is still the best one.

The dictionaries are fitted on a bounded sample: for each language the ``sample_docs`` distinct texts with a letter of smallest hash, of each of
which at most ``sample_bytes`` characters around its middle are used, ``dict_bytes`` in all; where languages are many, each has its share of ``all_bytes``. Predictions read whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where nothing can be learned
(an empty table, no label). Ties go to the language of more training documents, then to the first by name. Rows are judged one by one,
repeated rows alike; the sample takes a repeated text once. Only the columns that are named are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm import _words
from memspark.llm._shared import small_arrow_batches

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 200, sample_bytes: int = 2048, dict_bytes: int = 112_640, all_bytes: int = 64_000_000) -> dict[str, bytes]:
    """A dictionary's content of at most ``dict_bytes`` bytes for each language of ``train``, languages of more documents first."""
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("distinct")).orderBy(F.desc("n"), "lang").collect()
    dict_bytes = min(dict_bytes, all_bytes // max(1, len(counted)))
    # Of a language of many texts only hashes below a bound are looked at: eight times as many as are wanted, before the first shuffle. Where fewer than wanted pass, the bound is raised until all do.
    share = {r["lang"]: min(1.0, 8 * sample_docs / max(1, r["distinct"])) for r in counted}
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counted}
    wanted = list(texts)
    while wanted:
        bound = F.create_map(*[F.lit(x) for lang in wanted for x in (lang, share[lang])])[F.col("lang")]
        near = known.where(F.col("lang").isin(wanted) & (F.col("h") / 2.0**64 + 0.5 <= bound))
        near = near.select("lang", "h", F.expr(f"substring(text, cast(greatest(1, length(text) div 2 - {sample_bytes // 2}) as int), {sample_bytes})").alias("text"))
        distinct = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
        ranked = distinct.withColumn("r", F.expr("row_number() over (partition by lang order by h)")).where(F.col("r") <= sample_docs)
        found: dict[str, list[str]] = {lang: [] for lang in wanted}
        for row in ranked.orderBy("lang", "h").collect():
            found[row["lang"]].append(row["text"])
        texts |= found
        wanted = [lang for lang in wanted if len(found[lang]) < sample_docs and share[lang] < 1]
        share |= {lang: min(1.0, 64 * share[lang]) for lang in wanted}
    out = {}
    for lang, of in texts.items():
        sizes = [0, *accumulate(map(len, of))]
        # What is nearest to a block's start is matched at the least cost: the first of the sample come last.
        out[lang] = "\n".join(reversed([t for t, before in zip(of, sizes, strict=False) if before < dict_bytes])).lower().encode()[-dict_bytes:]
    return out


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        self.block, self.langs, self.tools = block, list(dictionaries), []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        blocks, at = [], 0
        while at < len(data):
            end = min(len(data), at + self.block)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            blocks.append(data[at:end])
            at = end
        return [sum(len(tool.compress(b)) for b in blocks) for tool in self.tools]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, a score from 0 to 1 and the margin: by how much of the next one's size the best is smaller."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        margin = 1.0 if len(order) == 1 else (sizes[order[1]] - best) / sizes[order[1]]
        weights = [math.exp(-60 * (x - best) / best) for x in sizes]
        return self.langs[order[0]], 1 / sum(weights), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = 9, block: int = 4096, narrow: float = 0.01) -> DataFrame:
    """id_col, lang_pred, score, rejected of each row. The dictionaries, whose order settles ties, are broadcast; their sizes are bounded by ``fit``."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent = spark.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(sent.value, level, block)
        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                said = [tools.judge(x) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] < narrow for x in said], pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == 0, F.lit(False))
