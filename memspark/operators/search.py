"""Retrieval: exact vector search, keyword scores over a candidate set, hybrid and composite ranking, z-score reranking.

A search plan filters and scores in one scan and keeps the top rows by a bounded sort; statistics of the
candidates are one-row or one-row-per-query aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions import scoring as S
from memspark.functions.text import tokens
from memspark.operators.evaluation import Best
from memspark.plans.shared import written

#: Scores that a task computes at once, so that its memory does not follow the number of queries or the size of a batch.
CELLS = 500_000


def lifecycle_filter(rows: DataFrame, include_deleted: bool = False, include_contradicted: bool = True, include_superseded: bool = False) -> DataFrame:
    gone = [s for s, keep in (("deleted", include_deleted), ("contradicted", include_contradicted), ("superseded", include_superseded)) if not keep]
    return rows.where(F.col("status").isNull() | ~F.col("status").isin(*gone)) if gone else rows


def payload_filter(rows: DataFrame, equal: dict | None = None, exclude_type: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Equalities are joined by AND; an excluded type keeps rows of no type; dates are inclusive and must look like dates."""
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == value)
    if exclude_type is not None:
        rows = rows.where(~F.col("memory_type").eqNullSafe(F.lit(exclude_type)))
    for value, keep in ((date_from, lambda c, v: c >= v), (date_to, lambda c, v: c <= v)):
        if value is not None:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}(T[\d:+Z.\-]+)?", value):
                raise ValueError(f"not a date: {value}")
            rows = rows.where(keep(F.col("created_at"), F.lit(value).cast("timestamp")))
    return rows


def projected(rows: DataFrame) -> DataFrame:
    """Rows with the defaults that a result shows: the text from ``memory`` or ``data``, and what is missing named."""
    have = {c for c in rows.columns}
    first = lambda *names, other=None: F.coalesce(*[F.col(c) for c in names if c in have], F.lit(other))
    return rows.withColumns({"memory": first("memory", "data"), "agent_id": first("agent_id", other="unknown"), "memory_type": first("memory_type", other="fact"), "source": first("source", other="unknown"), "status": first("status", other="active")})


def of_source(memory: DataFrame, source: str = "transcript", columns: tuple[str, ...] = ("id", "memory", "session_id", "created_at", "role")) -> DataFrame:
    """The memories of a source with the columns that chunking reads, so that a scan reads no others."""
    return memory.where(F.col("source") == source).select(*[c for c in columns if c in memory.columns])


def contents(memory: DataFrame, ids: DataFrame, chars: int = 300) -> DataFrame:
    """id, content: the start of each asked memory's text."""
    return memory.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.substring("memory", 1, chars).alias("content"))


def vector_top(rows: DataFrame, query: Sequence[float], k: int, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """The k rows most similar to ``query``, ties by id: a bounded sort in each task, then one of the tasks' tops."""
    scored = rows.withColumn("score", S.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def query_top(rows: DataFrame, queries: DataFrame, k: int, block: int = 1_000) -> DataFrame:
    """query_id, id, rank, score: the k rows of most cosine to each of a stated set of queries (query_id, query_vector).

    Queries are taken in blocks of ``block``, each of which passes once over all rows: a matrix product for each few rows (``CELLS`` scores), of which a task keeps the
    best k of each query. A row without a vector, or of length zero, has score 0, as has such a query.
    """
    asked = [(r["query_id"], r["query_vector"] or []) for r in queries.select("query_id", "query_vector").orderBy("query_id").toLocalIterator()]
    found = None
    for at in range(0, len(asked), block):
        part = asked[at : at + block]
        width = max(len(v) for _, v in part)
        wanted = np.array([[*v, *[0.0] * (width - len(v))] for _, v in part], np.float64)
        norm = np.linalg.norm(wanted, axis=1, keepdims=True)
        sent, ids = rows.sparkSession.sparkContext.broadcast(np.divide(wanted, norm, out=np.zeros_like(wanted), where=norm > 0)), [i for i, _ in part]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ids=ids, width=width) -> Iterator[pa.RecordBatch]:
            wanted, held, step = sent.value, Best(len(ids), k), max(1, CELLS // len(ids))
            for batch in batches:
                vectors = batch.column("vector")
                vectors = vectors.fill_null([]) if vectors.null_count else vectors
                n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
                x = np.zeros((len(n), width))
                whole = np.flatnonzero(n == width)
                x[whole] = vectors.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x, at = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), batch.column("id").to_numpy()
                for begin in range(0, len(x), step):
                    held.add(at[begin : begin + step], x[begin : begin + step] @ wanted.T)
            query, score, at = held.cut()
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in query.tolist()], pa.int64()), pa.array(at, pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])

        one = rows.select("id", "vector").mapInArrow(run, "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, id long, rank int, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def _count(word: str) -> Column:
    return F.size(F.filter("_tok", lambda t: t == F.lit(word)))


def bm25(docs: DataFrame, query: Sequence[str], text: str = "memory", out: str = "bm25", key: str | None = None) -> DataFrame:
    """``docs`` with their keyword score, or with ``key`` only that column and the score; terms of the query count as often as they are given; statistics are those of ``docs`` itself.

    What is kept of a text is its number of tokens and the count of each term of the query. With ``key`` that is written as a narrow table, so a large table's texts are cut into
    tokens once for statistics and scores; without it they are cut for each, which suits a few candidates that carry many columns.
    """
    terms = list(dict.fromkeys(query))
    columns = [key] if key else docs.columns
    if not terms:
        return docs.withColumn(out, F.lit(0.0)).select(*columns, out)
    rows = docs.withColumn("_tok", tokens(F.col(text)))
    counted = F.coalesce(F.col(text), F.lit("")) != ""
    rows = rows.withColumn("_k", F.struct(counted.alias("counted"), F.size("_tok").alias("dl"), *[_count(w).alias(f"t{i}") for i, w in enumerate(terms)])).select(*columns, "_k")
    rows = written(rows, "term-counts") if key else rows
    stats = rows.where("_k.counted").agg(F.count(F.lit(1)).alias("_n"), F.avg("_k.dl").alias("_mean"), *[F.count_if(F.col(f"_k.t{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    joined = rows.join(F.broadcast(stats))
    total: Column = F.lit(0.0)
    for word in query:
        i = terms.index(word)
        tf = F.col(f"_k.t{i}").cast("double")
        idf = F.when(F.col(f"_df{i}") > 0, F.log(F.col("_n") / F.col(f"_df{i}"))).otherwise(C.MISSING_IDF)
        norm = C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("_k.dl") / F.when(F.col("_mean") > 0, F.col("_mean")))
        total = total + F.when(tf > 0, idf * tf * (C.BM25_K1 + 1) / (tf + norm)).otherwise(0.0)
    return joined.withColumn(out, total).select(*columns, out)


def hybrid_search(memory: DataFrame, query_vector: Sequence[float], query: Sequence[str], q: DataFrame | Callable[[DataFrame], DataFrame], as_of: Column, k: int = 20, candidates: int | None = None, **filters) -> DataFrame:
    """Vector candidates, then the blend of similarity, keywords, recency, importance and usefulness, times the status's weight.

    ``q`` is a table of (id, q), or a function that gives it for the candidates' ids, so that no other memory's log is folded.
    """
    top = vector_top(lifecycle_filter(payload_filter(memory, **filters)), query_vector, candidates or min(3 * k, 100)).drop("vector")
    # At most 3 k (100 by default) candidates: they are fetched once, as statistics, usefulness and ranking all need them.
    found = memory.sparkSession.createDataFrame(top.collect(), top.schema)
    rows = bm25(found, query)
    rows = rows.join(q(rows.select("id")) if callable(q) else q, "id", "left").withColumn("q", F.coalesce("q", F.lit(C.Q_INIT)))
    score = S.hybrid(F.col("score"), F.col("bm25"), S.recency(F.col("created_at"), as_of), F.col("importance"), F.col("memory_type"), F.col("q"), F.col("status"))
    return rows.withColumn("hybrid_score", score).orderBy(F.desc("hybrid_score"), F.desc("score"), "id").limit(k)


def raw_similarity(rows: DataFrame) -> Column:
    """The first of the scores that a candidate carries: hybrid, composite, plain, else one half."""
    return F.coalesce(*[F.col(c).cast("double") for c in ("hybrid_score", "composite_score", "score") if c in rows.columns], F.lit(0.5))


def with_usefulness(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates with ``q``: the state's value, else the one in the memory's own metadata (``metadata_q``), else the initial one."""
    rows = candidates.join(state.select("id", F.col("q_value").alias("_q")), "id", "left")
    own = [F.col("metadata_q")] if "metadata_q" in candidates.columns else []
    return rows.withColumn("q", F.coalesce("_q", *own, F.lit(C.Q_INIT))).drop("_q")


def rerank(candidates: DataFrame, recency: Column, k: int = 5, group: str = "query_id", epsilon: float = 0.0, seed: int = 0, places: int | None = None) -> DataFrame:
    """Each query's top k by similarity and usefulness as z-scores (usefulness against the query's own candidates), recency and importance.

    With ``epsilon`` (C.EPSILON is the usual value), that share of the queries with more than k candidates gives the last place to one of the rest instead, chosen by a hash with ``seed``.
    Sums over a query's rows differ in their last digits with the order of the rows; with ``places``, ranks go by the score rounded to as many, then by id.
    """
    w = Window.partitionBy(group)
    deviation = F.coalesce(F.stddev_pop("q").over(w), F.lit(0.0))
    spread = F.when((F.count(F.lit(1)).over(w) == 1) | (deviation < 1e-9), 1.0).otherwise(deviation)
    z_sim = S.clamp((raw_similarity(candidates) - C.SIM_MEAN) / C.SIM_STD, -C.Z_CLAMP, C.Z_CLAMP)
    z_q = S.clamp((F.col("q") - F.avg("q").over(w)) / spread, -C.Z_CLAMP, C.Z_CLAMP)
    weight = C.RERANK_WEIGHTS
    out = candidates.withColumn("combined", weight["sim"] * z_sim + weight["q"] * z_q + weight["recency"] * recency + weight["importance"] * F.col("importance"))
    ordered = F.col("combined") if places is None else F.round("combined", places)
    out = out.withColumn("rank", F.row_number().over(w.orderBy(ordered.desc(), "id")))
    if epsilon > 0:
        share = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1_000_000)) / 1e6
        drawn = F.row_number().over(w.orderBy((F.col("rank") < k).cast("int"), F.xxhash64(F.lit(seed), F.col(group), F.col("id"))))
        swap = (share < epsilon) & (F.max("rank").over(w) > k)
        out = out.withColumns({"_swap": swap, "_drawn": drawn})
        out = out.withColumn("rank", F.when(F.col("_swap") & (F.col("rank") >= k), F.when((F.col("_drawn") == 1), k).otherwise(k + F.col("rank"))).otherwise(F.col("rank"))).drop("_swap", "_drawn")
    return out.where(F.col("rank") <= k)
