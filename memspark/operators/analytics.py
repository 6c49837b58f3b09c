"""Dashboard aggregates, replay and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, value: str, low: float = -0.5, high: float = 1.0, bins: int = 15) -> DataFrame:
    """bin, count over equal widths, empty bins included; values beyond the ends go to the end bins. Only ``bins`` rows leave the aggregate."""
    step = (high - low) / bins
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((F.col(value) - low) / step).cast("int")))
    found = values.where(F.col(value).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def summary(values: DataFrame, value: str) -> DataFrame:
    """min, max, mean, median, sample deviation (0 for one value) and count."""
    return values.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("count"))


def calibration(values: DataFrame, value: str) -> DataFrame:
    """One row: mean and population deviation of a corpus's similarities, what z-scores are taken by."""
    return values.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def by_period(events: DataFrame, ts: str = "ts", value: str = "reward") -> DataFrame:
    """Counts and means by day, ISO week and month: events are added up by day, and the days by week and month."""
    days = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("k"), F.sum(value).alias("s"))
    period = {"day": F.date_format("day", "yyyy-MM-dd"), "week": F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("day")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("day").cast("string"), 2, "0")), "month": F.date_format("day", "yyyy-MM")}
    rows = days.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), p.alias("period")) for k, p in period.items()])).alias("p"), "n", "k", "s")
    return rows.groupBy("p.level", "p.period").agg(F.sum("n").alias("events"), (F.sum("s") / F.sum("k")).alias("mean_reward"))


def classify_step(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first rule whose text is contained."""
    out = F.lit(other)
    for part, label in reversed(rules):
        out = F.when(F.lower(text).contains(part), label).otherwise(out)
    return out


def next_step(queries: DataFrame, steps: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """For each query the first step at its time or later, else the last step: one union and two windows, no range join."""
    rows = queries.select(key, at, F.lit(0).alias("_kind"), F.col("query_id"), F.lit(None).cast("bigint").alias("step_id")).unionByName(steps.select(key, at, F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("query_id"), "step_id"))
    w = Window.partitionBy(key).orderBy(at, "_kind", "step_id", "query_id")
    after = F.first("step_id", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last("step_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("found", F.coalesce(after, last)).where("_kind = 0").select("query_id", F.col("found").alias("step_id"))


def beats(steps: DataFrame, session: str = "session_id", order: str = "pos") -> DataFrame:
    """Each user message opens a beat; what stands before the first goes to it."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("beat", F.greatest(F.lit(1), F.sum((F.col("role") == "user").cast("int")).over(w)).cast("long"))


def best_session(observations: DataFrame, kinds: dict[str, Column], session: str = "session_id", ts: str = "ts") -> DataFrame:
    """The session of most kinds, then most observations, then the latest."""
    rows = observations.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    rows = rows.withColumn("diversity", sum(((F.col(k) > 0).cast("int") for k in kinds), F.lit(0)))
    return rows.orderBy(F.desc("diversity"), F.desc("n"), F.desc("last"), session).limit(1)
