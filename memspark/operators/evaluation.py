"""Retrieval evaluation: set-based keyword scores, recall and gain at several depths.

Queries are a stated set: they are collected in blocks of a checked size, and each block passes once over all documents. A task keeps the best of
each query, so no more than ``k`` rows a query and task are shuffled, however common a word is.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions.text import word_tokens

#: Distinct words and characters of the queries of one pass over the documents.
BLOCK_WORDS, BLOCK_CHARS = 20_000, 4_000_000
#: Rows of a matrix of documents and words.
_ROWS = 64


def _blocks(rows: list, size, most: int) -> Iterator[list]:
    block, held = [], 0
    for row in rows:
        if block and held + size(row) > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += size(row)
    if block:
        yield block


class Best:
    """The k best (score, id) of each query so far, of scores beyond ``over``: ties by the smaller id."""

    def __init__(self, queries: int, k: int, over: float = -np.inf):
        self.k, self.over, self.least, self.held = k, over, np.full(queries, -np.inf), []
        self.most = max(200_000, 2 * queries * k)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.least) & (scores > self.over)
        if len(ids) > self.k and hit.sum() > self.most:  # before there are k of each query everything hits; only each query's k best of these rows, and their equals, are held
            hit &= scores >= np.partition(np.where(hit, scores, -np.inf), len(ids) - self.k, axis=0)[len(ids) - self.k]
        row, query = np.nonzero(hit)
        self.held.append((query, scores[row, query], ids[row]))
        if sum(len(x[0]) for x in self.held) > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        query, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        keep = place < self.k
        self.held = [(query[keep], score[keep], ids[keep])]
        return self.held[0]


def keyword_top(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank, score: the k best documents of each query by keywords.

    Each distinct word of the query counts once, without inverse frequencies; scores are shares of the query's largest. Documents of a null
    text have no words; ranks go by the score rounded to nine places, then by doc_id.
    """
    tok = docs.select("doc_id", word_tokens(F.col("text")).alias("t"))
    mean = tok.agg(F.avg(F.size("t"))).first()[0] or 1.0
    asked = queries.select("query_id", F.array_distinct(word_tokens(F.col("query"))).alias("w")).where("size(w) > 0").orderBy("query_id").collect()
    found = None
    for block in _blocks(asked, lambda r: len(r["w"]), BLOCK_WORDS):
        words = {w: i for i, w in enumerate(dict.fromkeys(w for r in block for w in r["w"]))}
        wanted = np.zeros((len(words), len(block)), np.float64)
        for j, r in enumerate(block):
            wanted[[words[w] for w in r["w"]], j] = 1.0
        sent, ids_of = docs.sparkSession.sparkContext.broadcast((words, wanted)), [r["query_id"] for r in block]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ids_of=ids_of) -> Iterator[pa.RecordBatch]:
            words, wanted = sent.value
            best = Best(wanted.shape[1], k, 0.0)
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(at, _ROWS)
                    tf = np.zeros((batch.num_rows, len(words)))
                    length = np.zeros(batch.num_rows)
                    for i, tokens in enumerate(batch.column("t").to_pylist()):
                        length[i] = len(tokens or ())
                        spots = [words[w] for w in tokens or () if w in words]
                        tf[i] = np.bincount(spots, minlength=len(words)) if spots else 0
                    part = tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length[:, None] / mean))
                    best.add(batch.column("doc_id").to_numpy(), np.round(part @ wanted, 9))
            query, score, ids = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array([ids_of[q] for q in query.tolist()], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "doc_id", "raw"])

        one = tok.mapInArrow(run, "query_id long, doc_id long, raw double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    w = Window.partitionBy("query_id")
    ranked = found.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("raw"), "doc_id")), "score": F.col("raw") / F.max("raw").over(w)})
    return ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def holding(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id of every document whose text holds the whole query: one pass of an automaton of all queries of a block."""
    asked, found = queries.where("query != ''").orderBy("query_id").collect(), None
    for block in _blocks(asked, lambda r: len(r["query"]), BLOCK_CHARS):
        texts: dict[str, list[int]] = {}
        for r in block:
            texts.setdefault(r["query"], []).append(r["query_id"])
        sent = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for text, ids in sent.value.items():
                automaton.add_word(text, ids)
            automaton.make_automaton()
            for batch in batches:
                pairs = [(q, i) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for q in {q for _, ids in automaton.iter(text or "") for q in ids}]
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], ["query_id", "doc_id"])

        one = docs.select("doc_id", "text").mapInArrow(run, "query_id long, doc_id long")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], "query_id long, doc_id long")


def corpus(turns: DataFrame, granularity: str = "session") -> DataFrame:
    """query_id, pos, doc_id, text, date of each question's own documents: the user's turns (query_id, session_id, session_pos, turn, role, content, date) of a session together, or each by itself."""
    own = turns.where("role = 'user'")
    if granularity == "session":
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n")
        return own.groupBy("query_id", "session_id", "session_pos").agg(text.alias("text"), F.min("date").alias("date")).select("query_id", F.col("session_pos").alias("pos"), F.col("session_id").cast("string").alias("doc_id"), "text", "date")
    n = F.row_number().over(Window.partitionBy("query_id", "session_id").orderBy("turn")) - 1
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("session_pos", "turn"))
    return own.select("query_id", pos.alias("pos"), F.concat(F.col("session_id").cast("string"), F.lit("_turn_"), n.cast("string")).alias("doc_id"), F.col("content").alias("text"), "date")


def session_of(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, "_turn_[0-9]+$", "")


def linear_recency(asked: Column, date: Column) -> Column:
    """From 1 on the day to 0 a year before; one half where a date is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.datediff(asked, date) / 365.0), F.lit(0.5))


def retrieved(docs: DataFrame, questions: DataFrame, mode: str = "hybrid", n: int = 50, bm25_weight: float = 0.10, recency_weight: float = 0.15) -> DataFrame:
    """query_id, doc_id, rank, score of each question's own documents (query_id, pos, doc_id, text, sim, date), by similarity alone (``raw``), with keywords (``hybrid``) or also with recency (``full``).

    The ``n`` most similar count with their similarity, the others without; raw ranks put these last, in order. ``questions``: query_id, query, asked (a date).
    """
    w = Window.partitionBy("query_id")
    rows = docs.join(questions, "query_id").withColumns({"_tok": word_tokens(F.col("text")), "_w": F.array_distinct(word_tokens(F.col("query")))})
    rows = rows.withColumn("_mean", F.greatest(F.avg(F.size("_tok")).over(w), F.lit(1e-9)))

    def part(x: Column) -> Column:
        tf = F.size(F.filter("_tok", lambda t: t == x))
        return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.size("_tok") / F.col("_mean")))

    rows = rows.withColumn("_raw", F.aggregate("_w", F.lit(0.0), lambda a, x: a + part(x)))
    top = F.max("_raw").over(w)
    rows = rows.withColumns({"_kw": F.when(top > 0, F.col("_raw") / top).otherwise(0.0), "_v": F.row_number().over(w.orderBy(F.desc("sim"), "pos"))})
    rest = {"raw": 0.0, "hybrid": bm25_weight, "full": bm25_weight + recency_weight}[mode]
    found = F.col("_v") <= n
    score = F.when(found, F.col("sim") * (1 - rest)).otherwise(0.0)
    score = score + (bm25_weight * F.col("_kw") if mode != "raw" else 0.0) + (recency_weight * linear_recency(F.col("asked"), F.col("date")) if mode == "full" else 0.0)
    rows = rows.withColumn("score", F.round(score, 9))
    order = [F.desc(found.cast("int")), F.when(found, F.col("_v")).otherwise(F.col("pos"))]
    rank = F.row_number().over(w.orderBy(*([] if mode == "raw" else [F.desc("score")]), *order))
    return rows.select("query_id", "doc_id", rank.alias("rank"), "score")


def _judged(scores: DataFrame, truth: DataFrame, at: tuple[int, ...]) -> DataFrame:
    """query_id, k, recall_any (0 or 1), ndcg_retrieved of each query of ``truth``; the ideal gain is that of the retrieved list."""
    top = scores.where(F.col("rank") <= max(at)).join(truth.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    gain = lambda k: F.sum(F.when((F.col("rank") <= k) & F.col("hit").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    hits = top.groupBy("query_id").agg(*[x for k in at for x in (F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias(f"h{k}"), gain(k).alias(f"g{k}"))])
    asked = truth.select("query_id").distinct().join(hits, "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(f"h{k}").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(F.col(f"h{k}"), F.lit(0)) > 0).cast("double").alias("r"), F.when(F.coalesce(F.col(f"h{k}"), F.lit(0)) > 0, F.col(f"g{k}") / ideal(k)).otherwise(0.0).alias("n")) for k in at])
    return asked.select("query_id", F.explode(cells).alias("c")).select("query_id", "c.k", F.col("c.r").alias("recall_any"), F.col("c.n").alias("ndcg_retrieved"))


def evaluate(scores: DataFrame, truth: DataFrame, at: tuple[int, ...] = C.RECALL_AT) -> DataFrame:
    """k, recall_any, ndcg_retrieved of ranked ``scores``: means over the queries of ``truth`` (query_id, doc_id)."""
    return _judged(scores, truth, at).groupBy("k").agg(F.avg("recall_any").alias("recall_any"), F.avg("ndcg_retrieved").alias("ndcg_retrieved"))


def evaluate_by_type(scores: DataFrame, truth: DataFrame, types: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """question_type, k, questions, recall_any: means over the queries of each type (query_id, question_type)."""
    rows = _judged(scores, truth, at).join(types, "query_id")
    return rows.groupBy("question_type", "k").agg(F.count(F.lit(1)).alias("questions"), F.avg("recall_any").alias("recall_any"))
