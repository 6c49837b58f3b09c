"""Outcomes: stage changes between snapshots, their events, and the memories and predictions that they reach."""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.operators import usefulness
from memspark.plans.shared import written


def normalised_deals(raw: DataFrame, key: str = "deal_id", pos: str = "pos") -> DataFrame:
    """Trimmed ids and lower-case stages; no blank ids; a paid date makes the stage paid; of repeated ids the last row."""
    clean = raw.withColumns({key: F.trim(key), "stage": F.when(F.coalesce(F.trim("paid_date"), F.lit("")) != "", "paid").otherwise(F.lower(F.trim("stage")))}).where(F.col(key) != "")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))
    return clean.withColumn("_r", last).where("_r = 1").drop("_r")


def normalised_leads(raw: DataFrame, key: str = "lead_id", pos: str = "pos") -> DataFrame:
    """As deals, without a paid date."""
    return normalised_deals(raw.withColumn("paid_date", F.lit("")), key, pos).drop("paid_date")


def stage_events(before: DataFrame, after: DataFrame, transitions: Sequence[tuple[str, str, str, float]] = tuple(C.DEAL_TRANSITIONS), key: str = "deal_id") -> DataFrame:
    """Events of rows in both snapshots whose stage changed along a known transition; an exact one beats a wildcard."""
    event, reward = F.lit(None).cast("string"), F.lit(None).cast("double")
    for old, new, name, value in sorted(transitions, key=lambda t: t[0] != "*"):
        fits = (F.col("stage") == new) & (F.lit(True) if old == "*" else F.col("old_stage") == old)
        event, reward = F.when(fits, name).otherwise(event), F.when(fits, value).otherwise(reward)
    both = after.join(before.select(key, F.col("stage").alias("old_stage")), key).where("stage != '' and old_stage != '' and stage != old_stage")
    out = both.select(key, F.col("client_id").alias("entity_id"), "old_stage", "stage", event.alias("event_name"), F.when(reward.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), reward))).alias("reward"))
    return out.where("event_name is not null and coalesce(entity_id, '') != ''")


def crm_outcomes(deals: tuple[DataFrame, DataFrame], leads: tuple[DataFrame, DataFrame]) -> DataFrame:
    """kind, id, entity_id, old_stage, stage, event_name, reward of all changes between two snapshots (before, after) of deals and of leads.

    An entity is a deal's client or a lead's company. Rows that are new or gone say nothing, so a first run (an empty snapshot before) has no events.
    """
    of = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "entity_id", "old_stage", "stage", "event_name", "reward")
    led = stage_events(leads[0], leads[1].withColumnRenamed("company_id", "client_id"), tuple(C.LEAD_TRANSITIONS), "lead_id")
    return of(stage_events(*deals), "deal", "deal_id").unionByName(of(led, "lead", "lead_id"))


class OutcomeResolver(ABC):
    """A source of outcomes: events of (entity_id, event_name, reward, details map<string,string>, pos)."""

    name: str

    @abstractmethod
    def detect(self, spark: SparkSession) -> DataFrame: ...


def load_resolver(name: str, allowed: Sequence[str]) -> type[OutcomeResolver]:
    """The resolver class named ``module:Class``, if the name is on the list; nothing is imported that is not."""
    if name not in allowed:
        raise ValueError(f"{name} is not an allowed resolver")
    module, _, member = name.partition(":")
    found = getattr(importlib.import_module(module), member, None)
    if not (isinstance(found, type) and issubclass(found, OutcomeResolver)):
        raise TypeError(f"{name} is not a resolver")
    return found


EVENTS = "resolver string, turn int, pos long, entity_id string, event_name string, reward double, details map<string,string>"


def detected(spark: SparkSession, resolvers: Sequence[OutcomeResolver]) -> tuple[DataFrame, dict[str, dict]]:
    """The events of all resolvers with ``resolver`` and ``seq`` (resolvers in turn, each in order of ``pos``), and each one's count or error.

    Each resolver's rows are written once, and counted as written; so an error in any of them is that resolver's own and leaves the others be.
    """
    events, said = spark.createDataFrame([], EVENTS), {}
    for turn, resolver in enumerate(resolvers):
        try:
            found = resolver.detect(spark)
            rows = written(found.select(F.lit(resolver.name).alias("resolver"), F.lit(turn).alias("turn"), F.col("pos").cast("long").alias("pos"), "entity_id", "event_name", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("reward"))).alias("reward"), "details"), "events")
            said[resolver.name] = {"events": rows.count()}
        except Exception as error:  # noqa: BLE001 - whatever one resolver raises is its own
            said[resolver.name] = {"error": str(error)}
            continue
        events = events.unionByName(rows)
    return events.withColumn("seq", F.struct("turn", "pos")), said


def business_context(event: DataFrame) -> Column:
    """``Biz +0.80: deal_closed for cli-1 {k=v, ...}`` with three details at most."""
    shown = F.array_join(F.transform(F.slice(F.map_entries("details"), 1, 3), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    sign = F.when(F.col("reward") >= 0, "+").otherwise("")
    base = F.concat(F.lit("Biz "), sign, F.format_string("%.2f", "reward"), F.lit(": "), "event_name", F.lit(" for "), "entity_id")
    return F.when(F.size("details") > 0, F.concat(base, F.lit(" {"), shown, F.lit("}"))).otherwise(base)


def resolved_by_events(events: DataFrame, pending: DataFrame) -> DataFrame:
    """id, event_name, reward of each pending prediction whose client has an event: the client's first event resolves it."""
    first = events.groupBy(F.col("entity_id").alias("client_id")).agg(F.min_by(F.struct("event_name", "reward"), "seq").alias("e"))
    return pending.join(first, "client_id").select("id", "client_id", "e.event_name", "e.reward")


def rewarded_state(events: DataFrame, memory: DataFrame, state: DataFrame) -> DataFrame:
    """memory_id, events, and the usefulness layers and value after each memory has taken its client's events in order.

    A client's events are one function of a value, made once whatever the number of its memories and applied to each by one join.
    """
    of = usefulness.composed(events, "entity_id").withColumnRenamed("n", "events")
    rows = memory.select(F.col("id").alias("memory_id"), F.col("client_id").alias("entity_id")).join(of, "entity_id").join(state, "memory_id", "left")
    return usefulness.moved(rows).select("memory_id", "entity_id", "events", *[f"q_{x}" for x in C.Q_LAYERS], "q_value")


def reward_id(*parts: Column) -> Column:
    """rwd_ and eight hexadecimal digits of what identifies the event, so that a rerun names it alike."""
    return F.concat(F.lit("rwd_"), F.substring(event_key(*parts), 1, 8))


def event_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def reward_events(events: DataFrame, memory: DataFrame, experience: str = "default") -> DataFrame:
    """A row of the reward log for each event whose client has memories: event_key, reward_id, reward_type, reward, experience, entity_id, memories (their number), context, and the line that memories keep.

    Which memories an event reached is its client's memories, by ``reward_memories``: a list of them in each event of a large client would be its memories times its events.
    """
    held = memory.groupBy(F.col("client_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("memories"))
    named = [F.col("resolver"), F.col("seq.turn"), F.col("seq.pos"), F.col("entity_id"), F.col("event_name"), F.col("reward")]
    rows = events.withColumns({"event_key": event_key(*named), "reward_id": reward_id(*named)}).join(held, "entity_id")
    line = F.substring(F.concat(business_context(rows), F.lit(" ["), "reward_id", F.lit("]")), 1, C.CONTEXT_CHARS)
    context = F.struct("entity_id", "event_name", "details", "resolver")
    return rows.select("event_key", "reward_id", F.lit("business").alias("reward_type"), "reward", F.lit(experience).alias("experience"), "entity_id", "memories", context.alias("context"), line.alias("reward_context"))


def log_reward_events(rows: DataFrame, path: str) -> int:
    """Appends the events that the log at ``path`` does not hold yet, in one write that counts as a whole or not at all; how many they were. A rerun appends nothing."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select("event_key")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = spark.createDataFrame([], "event_key string")
    new = written(rows.dropDuplicates(["event_key"]).join(known, "event_key", "left_anti"), "reward-events")
    found = new.count()
    if found:
        new.write.mode("append").parquet(path)
    return found


def resolution(events: DataFrame, pending: DataFrame, memory: DataFrame) -> DataFrame:
    """One row: total_events, memories_rewarded (a memory counts for each event), predictions_resolved."""
    counts = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    rewarded = memory.groupBy(F.col("client_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("m")).join(counts, "entity_id").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("memories_rewarded"))
    total = events.agg(F.count(F.lit(1)).alias("total_events"))
    return total.crossJoin(rewarded).crossJoin(resolved_by_events(events, pending).agg(F.count(F.lit(1)).alias("predictions_resolved")))


def core_id(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "^(cli|comp|lead|deal)-", "")


def client_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of equal ids, or of equal cores of two characters or more: two equi-joins and their union."""
    a, b = left.select(left_id).distinct(), right.select(right_id).distinct()
    same = a.join(b, F.col(left_id) == F.col(right_id))
    cores = a.withColumn("_c", core_id(F.col(left_id))).where("length(_c) >= 2").join(b.withColumn("_c", core_id(F.col(right_id))), "_c").drop("_c")
    return same.unionByName(cores).distinct()


def reward_memories(events: DataFrame, memory: DataFrame) -> DataFrame:
    """One row for each event and memory of its client."""
    return events.join(memory.select(F.col("id").alias("memory_id"), F.col("client_id").alias("entity_id")), "entity_id")


def resolve_predictions(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with their first outcome and status; later outcomes and unknown ids change nothing."""
    first = F.row_number().over(Window.partitionBy("prediction_id").orderBy("ts", "source_pos"))
    once = outcomes.withColumn("_r", first).where("_r = 1").select(F.col("prediction_id").alias("id"), F.col("ts").alias("resolved_at"), "reward", "days_to_resolve")
    out = predictions.join(once, "id", "left")
    return out.withColumn("status", F.when(F.col("resolved_at").isNull(), "pending").otherwise("resolved"))


def prediction_stats(resolved: DataFrame) -> DataFrame:
    """Totals; positive and negative outcomes, the mean and the share of positive ones over outcomes with a reward where there are any."""
    done = F.col("status") == "resolved"
    out = resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("pending"), F.count_if(done & (F.col("reward") > 0)).alias("positive"), F.count_if(done & (F.col("reward") < 0)).alias("negative"), F.avg("reward").alias("avg_reward"))
    return out.withColumn("accuracy", F.when(F.col("resolved") > 0, F.col("positive") / F.col("resolved")))
