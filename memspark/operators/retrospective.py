"""Retrospectives: what a day, week or month has to look back on, and what comes of it. The judgement between is a callable of the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators import usefulness

LEVELS = ("daily", "weekly", "monthly")
#: What a level reads: the source or type of memory, and how many at most.
READS = {"daily": ("source", "decision_extraction", 50), "weekly": ("memory_type", "retrospective_daily", 7), "monthly": ("memory_type", "retrospective_weekly", 5)}
INSIGHTS, IDS_KEPT = 5, {"daily": 5, "weekly": 3, "monthly": 3}


def period_of(ts: Column, level: str) -> Column:
    """The day (2024-05-01), ISO week (2024-W18) or month (2024-05) of a time."""
    if level == "daily":
        return F.date_format(ts, "yyyy-MM-dd")
    if level == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM")


def usual_period(now: Column, level: str) -> Column:
    """Today, this week, or the month before."""
    return period_of(F.add_months(now, -1) if level == "monthly" else now, level)


def rewards_in(events: DataFrame, level: str, period: str, ts: str = "ts") -> DataFrame:
    """The reward events of a period, each with the first of its memories."""
    return events.where(period_of(F.col(ts), level) == period).withColumn("memory_ids", F.slice("memory_ids", 1, IDS_KEPT[level]))


def memories_in(memory: DataFrame, level: str, period: str, ts: str = "created_at") -> DataFrame:
    """Of the memories that a level reads those of the period, by id; the level's own number at most."""
    column, value, most = READS[level]
    return memory.where((F.col(column) == value) & (period_of(F.col(ts), level) == period)).orderBy("id").limit(most)


def gathered(memory: DataFrame, events: DataFrame, state: DataFrame, level: str, period: str) -> dict[str, DataFrame]:
    """What a retrospective of a period reads: its reward events with totals by type, its memories, and the present statistics."""
    if level not in LEVELS:
        raise ValueError(f"no such level: {level}")
    rewards = rewards_in(events, level, period)
    totals = rewards.groupBy("reward_type").agg(F.count(F.lit(1)).alias("events"), F.sum("reward").alias("total"))
    return {"rewards": rewards, "totals": totals, "memories": memories_in(memory, level, period), "stats": usefulness.stats(state)}


def new_periods(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """The periods (level, period) that have not been looked back on."""
    return wanted.join(ledger.select("level", "period").distinct(), ["level", "period"], "left_anti")


def memories_of(level: str, analyses: DataFrame) -> DataFrame:
    """What is remembered of analyses (period, summary, patterns, insights array of (content, importance)): one memory each, and its first five insights that say something."""
    text = F.when(F.size("patterns") > 0, F.concat("summary", F.lit("\nPatterns: "), F.array_join("patterns", "; "))).otherwise(F.col("summary"))
    own = analyses.select("period", text.alias("memory"), F.lit(f"retrospective_{level}").alias("memory_type"), F.lit("retrospective").alias("source"), F.lit(0.8).alias("importance"))
    said = analyses.select("period", F.explode(F.filter(F.slice("insights", 1, INSIGHTS), lambda x: F.coalesce(x["content"], F.lit("")) != "")).alias("x"))
    told = said.select("period", F.col("x.content").alias("memory"), F.lit("insight").alias("memory_type"), F.lit(f"retrospective_{level}").alias("source"), F.coalesce("x.importance", F.lit(0.7)).alias("importance"))
    return own.unionByName(told).withColumn("status", F.lit("active"))


def run(level: str, period: str, memory: DataFrame, events: DataFrame, state: DataFrame, ledger: DataFrame, judge: Callable[[dict[str, DataFrame]], tuple[DataFrame, DataFrame]]) -> dict[str, DataFrame] | None:
    """The new memories, the state after the adjustments and the ledger's new row; None where the period was done or has nothing to look back on.

    ``judge`` takes what was gathered and gives the analyses and the wanted adjustments (memory_id, pos, action, reward, target_q).
    """
    asked = memory.sparkSession.createDataFrame([(level, period)], "level string, period string")
    if new_periods(asked, ledger).isEmpty():
        return None
    found = gathered(memory, events, state, level, period)
    if found["rewards"].isEmpty() and found["memories"].isEmpty():
        return None
    analyses, wanted = judge(found)
    changes = usefulness.adjustments(state, wanted)
    return {"memories": memories_of(level, analyses), "changes": changes, "state": usefulness.adjusted(state, changes), "ledger": asked}


def busiest_folder(files: DataFrame, folder: str = "folder") -> DataFrame:
    """The folder of most files, ties by name."""
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), folder).limit(1)


def latest_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key its latest row."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
