"""From raw documents to encoded ones: clean, drop recurring lines, near copies and benchmark leaks, and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's input. All but the last return the columns of documents, and no others of their input. Near copies take the defaults of near-duplicate stages:
five words a shingle and a similarity of 0.8.

Defined cases, for each stage: an empty table gives an empty one; texts are taken whole, whatever their length; nulls in id, lang and source are carried. What a
null or an empty text, a repeated row or an equal id comes to is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import bpe, decontam, line_dedup, ngram_join, quality
from memspark.llm._shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that pass. A null or empty text has too few words and goes; repeated rows are judged alike."""
    judged = quality.judge(docs.select(*COLUMNS)).where("kept")
    return _documents(judged.withColumn("text", F.col("clean_text")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document goes only if it had text and all of it went. A null or empty text stays; repeated rows and equal ids keep or lose the same lines."""
    out = line_dedup.drop_recurring_lines(docs.select(*COLUMNS))
    return _documents(out.where("n_dropped = 0 or trim(text) != ''"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group of near copies. Rows are judged by id and text: of two texts of one id the one may go and the other stay. Texts without a word, null ones among them, and rows of a null id are nobody's copies and stay."""
    return ngram_join.one_of_each_group(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts hold none and stay; repeated rows go or stay alike."""
    return decontam.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number and the digest of what they decode to, for every row; a null text is empty and has no ids."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_lines), ("near_duplicates", one_of_each_group), ("decontamination", drop_leaks), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: The stages of components and tokens have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None
