"""Dashboard data: what is shown of usefulness, observations, retrievals, predictions and states, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.operators import analytics, lifecycle, outcomes, usefulness

#: Layers with what counts where one is missing.
LAYERS = {"q_value": C.Q_INIT, "q_action": C.Q_INIT, "q_hypothesis": C.MISSING_LAYER, "q_fit": C.MISSING_LAYER}


def four(x: Column) -> Column:
    """Four places, halves up; what a sum of doubles is off by at the ninth does not decide a half."""
    return F.round(F.round(x, 9), 4)


def _filled(state: DataFrame) -> DataFrame:
    return state.withColumns({x: F.coalesce(x, F.lit(default)) for x, default in LAYERS.items()})


def _default(state: DataFrame) -> DataFrame:
    return state.where("experience = 'default'")


def layer_distributions(state: DataFrame, low: float = -0.5, high: float = 1.0, bins: int = 15) -> DataFrame:
    """layer, bin, count of the value and the three layers: one pass, four counters a bin."""
    long = _filled(_default(state)).select(F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("x")) for x in LAYERS])).alias("p")).select("p.*")
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((F.col("x") - low) / ((high - low) / bins)).cast("int")))
    found = long.groupBy("layer", index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = state.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*map(F.lit, LAYERS))).alias("layer"))
    return every.join(F.broadcast(found), ["layer", "bin"], "left").select("layer", "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def evolution(state: DataFrame, updated: str = "q_updated_at") -> DataFrame:
    """date, the mean of each layer and the number of values that were updated then; undated ones are left out."""
    rows = _filled(_default(state)).withColumn("date", F.substring(updated, 1, 10)).where("date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'")
    return rows.groupBy("date").agg(*[four(F.avg(x)).alias(f"mean_{x.removeprefix('q_')}") for x in LAYERS], F.count(F.lit(1)).alias("count_updated"))


def visits(state: DataFrame) -> DataFrame:
    return _default(state).groupBy(F.coalesce("q_visits", F.lit(0)).alias("visits")).agg(F.count(F.lit(1)).alias("count"))


def calibrations(state: DataFrame) -> DataFrame:
    return _default(state).groupBy(F.when(F.coalesce("calibration", F.lit("")) == "", "uncalibrated").otherwise(F.col("calibration")).alias("calibration")).agg(F.count(F.lit(1)).alias("count"))


def memory_types(memory: DataFrame, kind: str = "memory_type") -> DataFrame:
    return memory.groupBy(F.coalesce(kind, F.lit("unknown")).alias("memory_type")).agg(F.count(F.lit(1)).alias("count"))


def retrievals_by_date(retrievals: DataFrame, ts: str = "ts") -> DataFrame:
    return retrievals.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def score_histogram(retrievals: DataFrame, scores: str = "scores") -> DataFrame:
    """Ten bins from 0 to 1 over all scores of all retrievals."""
    return analytics.histogram(retrievals.select(F.explode(scores).alias("score")), "score", 0.0, 1.0, 10)


def by_date(rows: DataFrame, ts: str = "ts", session: str = "session_id") -> DataFrame:
    """date, observations, sessions: how many observations there were each day, in how many sessions."""
    return rows.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(session).alias("sessions"))


def memory_stats(memory: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """kind, name, count: all memories, those of each of ``sources`` (0 where there are none), of each role of a message, and of the experience library; one pass over the memories."""
    role = F.col("role") if "role" in memory.columns else F.lit(None).cast("string")
    marks = [("total", F.lit("all")), *[("source", F.when(F.col("source") == s, s)) for s in sources], ("role", F.when(role.isin("user", "assistant"), role)), ("library", F.when(F.col("source") == "experience_library", F.lit("experience_library")))]
    long = memory.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("name")) for k, n in marks])).alias("m")).select("m.*").where("name is not null")
    found = long.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("count"))
    every = memory.sparkSession.createDataFrame([("total", "all"), *[("source", s) for s in sources], ("role", "user"), ("role", "assistant"), ("library", "experience_library")], "kind string, name string").distinct()
    return every.join(found, ["kind", "name"], "left").select("kind", "name", F.coalesce("count", F.lit(0)).alias("count"))


def prediction_summary(resolved: DataFrame) -> DataFrame:
    """One row: totals and the mean reward of outcomes, a missing reward counting 0."""
    done = F.col("status") == "resolved"
    return resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("pending"), F.coalesce(four(F.avg(F.when(done, F.coalesce("reward", F.lit(0.0))))), F.lit(0.0)).alias("avg_reward"))


def daily_stats(state: DataFrame, date: str) -> DataFrame:
    """date, experience, count, mean, min, max (four places): a row a context, to be appended to the log of days."""
    out = usefulness.stats(state).withColumns({c: four(F.col(c)) for c in ("mean", "min", "max")})
    return out.select(F.lit(date).alias("date"), "experience", "count", "mean", "min", "max")


# What must not be in anything that is shown.
UNSAFE = (r"/Users/", r"/home/", r"sk-ant-", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")


def safe(text: Column) -> Column:
    """Whether a text shows no folder, key or address."""
    return ~F.coalesce(text.rlike("|".join(UNSAFE)), F.lit(False))


def assert_safe(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``, failing where a text column shows what it must not."""
    checked = rows
    for c in columns:
        checked = checked.withColumn(c, F.when(safe(F.col(c)), F.col(c)).otherwise(F.raise_error(F.lit(f"unsafe text in {c}"))))
    return checked


def export(state: DataFrame, memory: DataFrame, retrievals: DataFrame, resolved: DataFrame, observations: DataFrame | None = None) -> dict[str, DataFrame]:
    """The dashboard's tables by name; all are aggregates of few rows."""
    more = {"timeline": by_date(observations)} if observations is not None else {}
    meta = _default(state).agg(F.count(F.lit(1)).alias("total_memories"), F.min(F.substring("q_updated_at", 1, 10)).alias("first"), F.max(F.substring("q_updated_at", 1, 10)).alias("last"))
    return more | {
        "q_distribution": layer_distributions(state), "q_evolution": evolution(state), "visits_distribution": visits(state), "calibration_counts": calibrations(state),
        "retrievals_by_date": retrievals_by_date(retrievals), "retrieval_scores": score_histogram(retrievals), "predictions": prediction_summary(resolved),
        "prediction_stats": outcomes.prediction_stats(resolved), "lifecycle": lifecycle.state_counts(memory), "memory_types": memory_types(memory), "meta": meta,
    }
