"""Kept keyword statistics: posting lists by term, so a query reads its terms' lists and nothing else.

An index is three tables under a path. ``postings`` has a row for each term and block of documents: their ids in order with counts and lengths, and the largest count and smallest length, which bound
what the block can add to a score. It is partitioned by a hash of the term and sorted by term, so a query's scan is pruned to its terms; part -1 has a row of no term for each block, with all of its
documents. ``documents`` has each document's length. ``segments`` has a row for each batch that was added, with its number of documents and their lengths, and is written last: a batch whose row is
missing does not count. Numbers of documents and of those that hold a term are sums over batches, so adding a batch changes no file.

Texts are cut once, by their bytes. A block is a run of documents of one task, which counts them and sends a row for each term, in the order of the files: what is shuffled are lists and not words, and
what is sorted are runs in order.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions.text import token_text

#: Documents of a block, so of a list of a term; parts that the lists are dealt to by term.
BLOCK, PARTS = 65_536, 64
#: Bytes of texts from which on a block ends before it has as many documents, so that a task's memory does not follow their length.
BLOCK_BYTES = 16_000_000
_LISTS = "term string, block long, documents int, most int, least int, ids array<long>, times array<int>, lengths array<int>, part int"
_DOCUMENTS = "id long, length int, counted boolean, batch string"
#: What each byte of a text is for its words: itself in a token, a sign of words that are none (_, others beyond ASCII), or a space between words.
_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else ord("_") if b >= 128 or chr(b).isalnum() or b == ord("_") else ord(" ") for b in range(256))


def _parts(terms: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(terms)) % PARTS


def _block_lists(ids: np.ndarray, counted: np.ndarray, texts: pa.Array, block: int) -> pa.RecordBatch:
    """The lists of a block: the row of all documents, with 1 or 0 for counted ones in the place of counts, after a row for each token of ``texts`` (as ``token_text`` makes them), by part and term."""
    order = np.argsort(ids, kind="stable")
    ids, counted, texts = ids[order], counted[order].astype(np.int32), texts.take(pa.array(order))
    _, bounds, data = texts.buffers()
    cut = pc.split_pattern(pa.Array.from_buffers(texts.type, len(texts), [None, bounds, pa.py_buffer((data.to_pybytes() if data else b"").translate(_BYTES))]), " ")
    coded = cut.flatten().dictionary_encode()
    filled = np.flatnonzero(pc.match_substring_regex(coded.dictionary, "^[a-z0-9]{2,}$").to_numpy(zero_copy_only=False))  # each different word is judged once
    filled = filled[pc.sort_indices(coded.dictionary.take(pa.array(filled))).to_numpy()]
    parts = _parts(coded.dictionary.take(pa.array(filled)))
    by = np.argsort(parts, kind="stable")
    terms, parts, rank = coded.dictionary.take(pa.array(filled[by])), parts[by], np.full(len(coded.dictionary), -1, np.int64)
    rank[filled[by]] = np.arange(len(by))
    code, at = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(ids)), pc.list_value_length(cut).to_numpy())
    keep = code >= 0
    code, at = code[keep], at[keep]
    length = np.bincount(at, minlength=len(ids)).astype(np.int32)
    key = np.sort(code * len(ids) + at)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key))).astype(np.int32)
    code, at = np.divmod(key[new], len(ids))
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    bounds = pa.array(np.concatenate([starts, [len(code), len(code) + len(ids)]]).astype(np.int32))
    column = lambda *x: pa.array(np.concatenate(x).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in ((ids[at], ids), (times, counted), (length[at], length))]
    most, least = (f.reduceat(x, starts) if len(starts) else x for f, x in ((np.maximum, times), (np.minimum, length[at])))
    term = pa.concat_arrays([terms, pa.nulls(1, terms.type)]).cast(pa.string())
    sizes = column(np.diff(bounds.to_numpy()))
    return pa.RecordBatch.from_arrays([term, pa.array(np.full(len(term), block)), sizes, column(most, [0]), column(least, [0]), *lists, column(parts, [-1])], ["term", "block", "documents", "most", "least", "ids", "times", "lengths", "part"])


def _lists_of(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task that takes its documents (id, counted, text) in blocks of ``block``, or of BLOCK_BYTES of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, name = [], 0, 0, TaskContext.get().partitionId() << 32

        def lists() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return _block_lists(whole["id"].to_numpy(), whole["counted"].to_numpy(zero_copy_only=False), whole["text"], name)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - rows))
                at, rows, size = at + held[-1].num_rows, rows + held[-1].num_rows, size + held[-1]["text"].nbytes
                if rows >= block or size >= BLOCK_BYTES:
                    yield lists()
                    held, rows, size, name = [], 0, 0, name + 1
        if rows:
            yield lists()

    return run


def add_documents(docs: DataFrame, path: str, text: str = "memory", id_col: str = "id", block: int = BLOCK) -> str:
    """Adds a batch of documents (of new ids, none null) to the index at ``path``; the batch's name. A batch that dies on the way leaves files that no query reads."""
    batch, spark = uuid.uuid4().hex, docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")  # long texts make the default of 10,000 too many
    texts = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(text, F.lit("")) != "").alias("counted"), token_text(F.col(text)).alias("text"))
    lists = texts.mapInArrow(_lists_of(block), _LISTS).withColumn("batch", F.lit(batch))
    lists.hint("rebalance", "part").sortWithinPartitions("part", "term", "block").write.mode("append").partitionBy("part").parquet(f"{path}/postings")
    held = spark.read.schema(f"{_LISTS}, batch string").parquet(f"{path}/postings").where((F.col("part") == -1) & (F.col("batch") == batch)).select(F.explode(F.arrays_zip("ids", "times", "lengths")).alias("d"))
    held.select("d.ids", "d.lengths", F.col("d.times") > 0, F.lit(batch)).toDF("id", "length", "counted", "batch").write.mode("append").partitionBy("batch").parquet(f"{path}/documents")
    sums = spark.read.schema(_DOCUMENTS).parquet(f"{path}/documents").where(F.col("batch") == batch)
    sums = sums.agg(F.count_if("counted").alias("documents"), F.coalesce(F.sum(F.when(F.col("counted"), F.col("length"))), F.lit(0)).alias("length"))
    sums.select(F.lit(batch).alias("batch"), "documents", "length").coalesce(1).write.mode("append").parquet(f"{path}/segments")
    return batch


def _segments(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("batch string, documents long, length long").parquet(f"{path}/segments")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch string, documents long, length long")


def _lists(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The lists of the terms in all batches that count."""
    parts = sorted({*_parts(pa.array(terms, pa.string())).tolist()})
    lists = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts) & F.col("term").isin(terms))
    return lists.join(F.broadcast(_segments(spark, path).select("batch")), "batch", "left_semi")


def _gain(times: Column, length: Column, idf: Column, mean: float) -> Column:
    return idf * times * (C.BM25_K1 + 1) / (times + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / F.lit(mean)))


def bm25_scores(spark: SparkSession, path: str, query: Sequence[str], k: int | None = None) -> DataFrame:
    """id, bm25 of the documents that hold a term of ``query`` (a term counts as often as it is given), or of the ``k`` best, ties by id.

    For the k best, the blocks of highest bounds that hold k documents give a score that k reach; blocks whose bound is below it are not opened.
    """
    times = Counter(query)
    whole = _segments(spark, path).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
    none = spark.createDataFrame([], "id long, bm25 double")
    if not times or not whole["n"]:
        return none
    lists = _lists(spark, path, list(times))
    held = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum("documents").alias("n")).collect()}  # a row for each term of the query
    if not held:
        return none
    mean = whole["l"] / whole["n"]
    weights = spark.createDataFrame([(t, float(n), times[t]) for t, n in held.items()], "term string, n double, asked int")
    idf = F.col("asked") * F.log(F.lit(float(whole["n"])) / F.col("n"))
    lists = lists.join(F.broadcast(weights), "term").withColumn("idf", idf)

    def scored(some: DataFrame) -> DataFrame:
        flat = some.select("idf", F.explode(F.arrays_zip("ids", "times", "lengths")).alias("d"))
        return flat.groupBy(F.col("d.ids").alias("id")).agg(F.sum(_gain(F.col("d.times").cast("double"), F.col("d.lengths"), F.col("idf"), mean)).alias("bm25"))

    if k is None:
        return scored(lists)
    bounds = lists.groupBy("batch", "block").agg(F.sum(_gain(F.col("most").cast("double"), F.col("least"), F.col("idf"), mean)).alias("bound"), F.max("documents").alias("documents"))
    best = bounds.orderBy(F.desc("bound"), "batch", "block").limit(k).collect()  # k blocks hold k documents at least
    first, seen = [], 0
    for r in best:
        first.append(r)
        seen += r["documents"]
        if seen >= k:
            break
    opened = spark.createDataFrame([(r["batch"], r["block"]) for r in first], "batch string, block long")
    least = scored(lists.join(F.broadcast(opened), ["batch", "block"], "left_semi")).orderBy(F.desc("bm25")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("bm25").alias("b")).first()
    if least["n"] >= k:
        lists = lists.join(bounds.where(F.col("bound") >= least["b"] - 1e-9).select("batch", "block"), ["batch", "block"], "left_semi")
    return scored(lists).orderBy(F.desc("bm25"), "id").limit(k)


def all_scores(spark: SparkSession, path: str, query: Sequence[str]) -> DataFrame:
    """id, bm25 of every document of the index: 0 for those without a term of the query."""
    docs = spark.read.schema(_DOCUMENTS).parquet(f"{path}/documents").join(F.broadcast(_segments(spark, path).select("batch")), "batch", "left_semi").select("id")
    return docs.join(bm25_scores(spark, path, query), "id", "left").select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
