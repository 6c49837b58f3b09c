"""The store's calls from Python: search, add, predict, resolve, stats. State is tables of append-only rows.

Embedding, enrichment and explanation are callables on columns that the caller may replace; the defaults are deterministic built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions import text as T
from memspark.operators import dashboard, lifecycle, outcomes, search, transcripts, usefulness

DIM = 64


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Token counts by hash, as a vector of length one: a stand-in where no model is at hand."""
    slot = F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


class MemoryStore:
    """Tables under ``path``: memory, prediction, outcome, reward_event, retrieval."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = hashed_embedding):
        self.spark, self.path, self.embed = spark, path.rstrip("/"), embed

    MEMORY = "id string, memory string, title string, vector array<double>, memory_type string, status string, importance double, client_id string, source string, created_at timestamp"
    PREDICTION = "id string, client_id string, ts timestamp, pack_id string, pack_author string, cited_step string, case_id string, applied_action string, prevented_action string, expected_signal string, expected_window_days int, notes string, prediction string, memory_ids_used array<string>, confidence double, strategic_value double"
    RETRIEVAL = "session_id string, ts timestamp, query string, memory_ids array<string>, scores array<double>"
    OUTCOME = "prediction_id string, ts timestamp, source_pos int, actual_signal string, reward double, days_to_resolve int, cause_category string"
    REWARD = "memory_id string, ts timestamp, seq string, reward double, context string"

    def table(self, name: str) -> DataFrame:
        schema = getattr(self, {"reward_event": "REWARD"}.get(name, name.upper()))
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def add_memories(self, rows: DataFrame) -> None:
        """Rows of (memory, memory_type, client_id, importance, source, created_at). Contents over MAX_CONTENT characters are refused: the call fails and adds nothing."""
        text = F.when(F.length("memory") <= C.MAX_CONTENT, F.col("memory")).when(F.col("memory").isNotNull(), F.raise_error(F.lit(f"a memory has over {C.MAX_CONTENT} characters")))
        kind = F.coalesce("memory_type", F.lit("fact"))
        out = rows.select(F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "memory", F.col("created_at").cast("string")), 256), 1, 16)).alias("id"), text.alias("memory"), T.title(text).alias("title"), self.embed(text).alias("vector"), kind.alias("memory_type"), F.lit("active").alias("status"), T.validated_weight(F.col("importance").cast("string")).alias("importance"), "client_id", F.coalesce("source", F.lit("api")).alias("source"), "created_at")
        out.write.mode("append").parquet(f"{self.path}/memory")

    def add_experiences(self, rows: DataFrame) -> None:
        """Rows of (situation, insight, applies_when, result, client_id, created_at) as memories that are searched by all they say."""
        text = T.experience_text(F.col("situation"), F.col("insight"), F.col("applies_when"), F.col("result"))
        self.add_memories(rows.select(text.alias("memory"), F.lit("insight").alias("memory_type"), "client_id", F.lit(0.8).alias("importance"), F.lit("experience_library").alias("source"), "created_at"))

    def ingest_messages(self, messages: DataFrame, force: bool = False) -> None:
        """Parsed messages (session_id, role, text, created_at) of sessions that the store does not know, as memories."""
        known = self.table("memory").where("source = 'transcript'").select(F.col("client_id").alias("session_id"))
        new = transcripts.ingest(messages, known, force=force)
        self.add_memories(new.select(F.col("text").alias("memory"), "memory_type", F.col("session_id").cast("string").alias("client_id"), "importance", "source", "created_at"))

    def log_retrieval(self, session_id: str, ts: str, query: str, memory_ids: Sequence[str], scores: Sequence[float] = ()) -> None:
        """What a session was shown; at most 100 ids."""
        row = self.spark.createDataFrame([(session_id, query, list(memory_ids)[:100], [float(x) for x in scores][:100])], "session_id string, query string, memory_ids array<string>, scores array<double>")
        row.withColumn("ts", F.lit(ts).cast("timestamp")).select("session_id", "ts", "query", "memory_ids", "scores").write.mode("append").parquet(f"{self.path}/retrieval")

    def retrieved(self, session_id: str) -> DataFrame:
        """The distinct ids that a session was shown."""
        return self.table("retrieval").where(F.col("session_id") == session_id).select(F.explode("memory_ids").alias("id")).distinct()

    def usefulness(self) -> DataFrame:
        return usefulness.fold(self.table("reward_event"))

    def search(self, query: str, as_of: str, limit: int = 10, **filters) -> DataFrame:
        limit = max(1, min(100, limit))
        asked = self.spark.createDataFrame([(query,)], "q string")
        vector, words = asked.select(self.embed(F.col("q")), T.tokens(F.col("q"))).first()
        q = self.usefulness().select(F.col("memory_id").alias("id"), F.col("q_value").alias("q"))
        return search.hybrid_search(self.table("memory"), list(vector), list(words), q, F.lit(as_of).cast("timestamp"), limit, **filters)

    #: What a prediction names that is grounded in a pack; otherwise it is a text.
    GROUNDED = ("pack_id", "pack_author", "cited_step", "case_id", "applied_action", "expected_signal", "expected_window_days")

    def log_prediction(self, identifier: str, ts: str, memory_ids: Sequence[str] = (), client_id: str | None = None, **fields) -> None:
        """A prediction with all GROUNDED fields, or with ``prediction``, its text; refused with neither. A case is the client where it is not named."""
        fields["case_id"] = fields.get("case_id") or client_id
        missing = [f for f in self.GROUNDED if fields.get(f) is None]
        if missing and not fields.get("prediction"):
            raise ValueError(f"a prediction needs a text, or also {', '.join(missing)}")
        for name in ("confidence", "strategic_value"):
            if fields.get(name) is not None:
                fields[name] = max(0.0, min(1.0, float(fields[name])))
        known = [f.name for f in self.spark.createDataFrame([], self.PREDICTION).schema]
        unknown = set(fields) - set(known)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        row = {**dict.fromkeys(known), **fields, "id": identifier, "client_id": client_id, "memory_ids_used": list(memory_ids)}
        schema = self.PREDICTION.replace("ts timestamp", "ts string")
        rows = self.spark.createDataFrame([tuple({**row, "ts": ts}[c] for c in known)], schema)
        rows.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{self.path}/prediction")

    def log_outcome(self, prediction_id: str, ts: str, actual_signal: str | None = None, reward: float | None = None, cause: str | None = None, outcome: str | None = None, days_to_resolve: int | None = None) -> None:
        """The outcome (``actual_signal``, or ``outcome``), and where there is a reward one event for each memory that the prediction used. Unknown and resolved predictions are refused."""
        actual_signal = actual_signal or outcome
        if not actual_signal:
            raise ValueError("an outcome needs an actual signal")
        found = self.predictions().where(F.col("id") == prediction_id)
        if found.where("status = 'pending'").isEmpty():
            raise ValueError(f"no pending prediction {prediction_id}")
        reward = None if reward is None else max(-1.0, min(1.0, reward))
        row = self.spark.createDataFrame([(prediction_id, 0, actual_signal, reward, days_to_resolve, cause)], "prediction_id string, source_pos int, actual_signal string, reward double, days_to_resolve int, cause_category string")
        if reward is not None:
            said = F.format_string(f"Pred {reward:+.2f}: '%s' -> '%s'", F.substring(F.coalesce("expected_signal", "prediction"), 1, 40), F.lit(actual_signal[:40]))
            events = found.select(F.explode("memory_ids_used").alias("memory_id"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(prediction_id).alias("seq"), F.lit(reward).alias("reward"), said.alias("context"))
            events.write.mode("append").parquet(f"{self.path}/reward_event")
        row.withColumn("ts", F.lit(ts).cast("timestamp")).write.mode("append").parquet(f"{self.path}/outcome")

    def predictions(self) -> DataFrame:
        return outcomes.resolve_predictions(self.table("prediction"), self.table("outcome"))

    def stats(self) -> dict[str, DataFrame]:
        memory = self.table("memory")
        return {"total": memory.agg(F.count(F.lit(1)).alias("total")), "sources": memory.groupBy("source").count(), "types": dashboard.memory_types(memory), "lifecycle": lifecycle.state_counts(memory), "predictions": outcomes.prediction_stats(self.predictions()), "usefulness": usefulness.stats(self.usefulness().withColumn("experience", F.lit("default")))}


#: Causes that an outcome may name without a warning.
KNOWN_CAUSES = C.CAUSES
