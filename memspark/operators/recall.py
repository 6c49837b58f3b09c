"""Recall for prompts and session starts: hybrid retrieval for a table of queries at once, what is shown of it, and the log of it.

A pass over the memories serves a block of queries, and of each memory that any query may want the words are cut once. What is then done for
a query (keyword statistics of its candidates, the blend, the best) is done on its candidates, of which there are ``min(3 k, 100)`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions import scoring as S
from memspark.functions import text as T
from memspark.operators import profiles, search
from memspark.plans.shared import written

# Results of a prompt and of a session's start; characters of a prompt that are searched, of a query that is logged, of a memory that is shown; the name of no session.
PROMPT_LIMIT, SESSION_LIMIT, SEARCHED, LOGGED, SHOWN, SHOWN_AT_START = 5, 10, 300, 200, 250, 200
NO_SESSION = "unknown"


def prompt_queries(prompts: DataFrame, known: list[tuple[str, list[str]]]) -> DataFrame:
    """``prompts`` (query_id, text, ...) that are worth a search, with ``query`` (the start of the text) and ``experience``, the profile that it calls for or ``default``."""
    query = T.strip(F.substring("text", 1, SEARCHED))
    rows = prompts.where(F.col("text").isNotNull() & ~T.trivial_prompt(F.col("text"))).withColumn("query", query).where("query != ''")
    return profiles.detected(rows, known, "query").withColumn("experience", F.coalesce("profile", F.lit("default"))).drop("profile")


def session_query(project: Column, day: Column, user: Column) -> Column:
    """What a session's start searches for: the project, unless that is the user's home, and the day."""
    today = F.date_format(day, "EEEE yyyy-MM-dd")
    return F.when((project == user) | (project == "~"), today).otherwise(F.concat(project, F.lit(" | "), today))


def _keyword(c: Column) -> Column:
    """The keyword score of a candidate, from its query's terms and the statistics of the query's candidates."""
    norm = C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * c["dl"] / F.when(F.col("mean") > 0, F.col("mean")))
    idf = F.transform("df", lambda n: F.when(n > 0, F.log(F.col("docs") / n)).otherwise(C.MISSING_IDF))
    share = F.transform(F.arrays_zip(F.col("times").alias("m"), c["tf"].alias("tf"), idf.alias("idf")), lambda z: F.when(z["tf"] > 0, z["m"] * z["idf"] * z["tf"] * (C.BM25_K1 + 1) / (z["tf"] + norm)).otherwise(0.0))
    return F.aggregate(share, F.lit(0.0), lambda a, x: a + x)


def hybrid_for_queries(memory: DataFrame, queries: DataFrame, state: DataFrame, as_of: Column, k: int = PROMPT_LIMIT, shown: int = SHOWN, **filters) -> DataFrame:
    """query_id, id, rank, score, bm25, q, hybrid_score, shown: the k best memories of each query (query_id, query_vector, query, experience).

    ``state`` (id, experience, q) is looked up in the query's experience. The memories' filters are those of a search.
    """
    pool = search.lifecycle_filter(search.payload_filter(memory, **filters))
    vectors = written(pool.select("id", "vector"), "recall-vectors")  # each block of queries passes over them
    found = written(search.query_top(vectors, queries.select("query_id", "query_vector"), min(3 * k, 100)), "recall-candidates")
    wanted = pool.join(found.select("id").distinct(), "id", "left_semi")
    text = F.coalesce("memory", F.lit(""))
    wanted = wanted.select("id", T.tokens(F.col("memory")).alias("tokens"), (text != "").alias("counted"), F.substring(text, 1, shown).alias("shown"), S.recency(F.col("created_at"), as_of).alias("recency"), "importance", "memory_type", "status")
    words = T.tokens(F.col("query"))
    terms = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("t"), F.size(F.filter(words, lambda w: w == t)).alias("m")))
    asked = queries.select("query_id", "experience", terms.alias("terms"))
    rows = found.join(wanted, "id").join(asked, "query_id").join(state.select("id", "experience", "q"), ["id", "experience"], "left")
    tf = F.transform("terms", lambda t: F.size(F.filter("tokens", lambda w: w == t["t"])).cast("double"))
    rows = rows.withColumns({"dl": F.size("tokens"), "tf": tf, "q": F.coalesce("q", F.lit(C.Q_INIT))})
    fields = ["id", "score", "q", "dl", "tf", "counted", "shown", "recency", "importance", "memory_type", "status"]
    one = rows.groupBy("query_id").agg(F.first("terms").alias("terms"), F.collect_list(F.struct(*fields)).alias("c"))
    counted = F.filter("c", lambda x: x["counted"])
    one = one.withColumns({"docs": F.size(counted), "times": F.col("terms.m"), "df": F.transform("terms", lambda t, i: F.size(F.filter(counted, lambda x: F.get(x["tf"], i) > 0)))})
    one = one.withColumn("mean", F.aggregate(counted, F.lit(0.0), lambda a, x: a + x["dl"]) / F.when(F.col("docs") > 0, F.col("docs")))
    scored = F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), _keyword(x).alias("bm25"), x["q"].alias("q"), *[x[f].alias(f) for f in ("shown", "recency", "importance", "memory_type", "status")]))
    flat = one.select("query_id", F.explode(scored).alias("x")).select("query_id", "x.*")
    blend = S.hybrid(F.col("score"), F.col("bm25"), F.col("recency"), F.col("importance"), F.col("memory_type"), F.col("q"), F.col("status"))
    flat = flat.select("query_id", "id", "score", "bm25", "q", "shown", blend.alias("hybrid_score"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("hybrid_score")).alias("a"), (-F.col("score")).alias("b"), "id", "score", "bm25", "q", "hybrid_score", "shown"))), 1, k)
    ranked = flat.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "x"))
    return ranked.select("query_id", "x.id", (F.col("rank") + 1).alias("rank"), "x.score", "x.bm25", "x.q", "x.hybrid_score", "x.shown")


def context_lines(found: DataFrame, start: bool = False) -> DataFrame:
    """query_id, context: a line for each memory in the order of the results, its usefulness (at a session's start the blend, too) cut to hundredths."""
    cut = lambda x: F.regexp_replace((F.floor(x * 100) / 100).cast("string"), r"\.0$", "")
    line = F.concat(F.lit("[q="), cut(F.col("q")), F.lit("] "), "shown")
    if start:
        line = F.concat(F.lit("[sim="), cut(F.col("hybrid_score")), F.lit("] "), line)
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return found.groupBy("query_id").agg(lines.alias("l")).select("query_id", F.array_join("l.line", "\n").alias("context"))


def retrieval_log(found: DataFrame, queries: DataFrame, as_of: Column, most: int = LOGGED) -> DataFrame:
    """session_id, ts, query, memory_ids, scores: what is logged of each query of a known session that found something."""
    asked = queries.where(F.coalesce("session_id", F.lit(NO_SESSION)) != NO_SESSION).select("query_id", F.col("session_id").cast("string").alias("session_id"), F.substring("query", 1, most).alias("query"))
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "score"))).alias("l"))
    return asked.join(lists, "query_id").select("query_id", "session_id", as_of.alias("ts"), "query", F.col("l.id").alias("memory_ids"), F.col("l.score").alias("scores"))
