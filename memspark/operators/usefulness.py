"""Usefulness values: ordered clamped folds of a reward log, delta merges, eviction and statistics.

A reward moves a value and clamps it, so the order of a key's events counts. Such moves compose (a shift between two bounds),
so stretches of a key's time are folded apart and then put together. To fold only what is new, pass the last state as ``start``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions import scoring as S


#: Numbers of time (seconds: a month) that are folded in one go.
STRETCH = 2_592_000


def _then(f: Column, reward: Column) -> Column:
    """``f`` (shift, low, high: x goes to x + shift, held between low and high) and then one more reward. Such functions are closed under this, so parts of a log compose."""
    move = lambda x: F.greatest(F.lit(C.Q_FLOOR), F.least(F.lit(C.Q_CEILING), x + C.Q_ALPHA * reward))
    return F.struct((f["shift"] + C.Q_ALPHA * reward).alias("shift"), move(f["low"]).alias("low"), move(f["high"]).alias("high"))


def _through(x: Column, f: Column) -> Column:
    return F.greatest(f["low"], F.least(f["high"], x + f["shift"]))


def _folded(none: Column, layer: str) -> Column:
    return F.aggregate("_used", none, lambda f, e: _then(f, S.layer_rewards(e["reward"])[layer]))


def _along(first: Column, layer: str) -> Column:
    return F.aggregate("_parts", first, lambda q, p: _through(q, p[layer]))


def fold(events: DataFrame, key: str = "memory_id", protected: DataFrame | None = None, start: DataFrame | None = None, step: str = "month") -> DataFrame:
    """key, q_action, q_hypothesis, q_fit, q_value, q_visits and the last contexts after all events (ts, seq, reward, context).

    A protected key takes no negative reward but counts the visit; so does an event without a reward. Events are folded by key and ``step`` of
    time (texts: the first seven characters; numbers: STRETCH of them) to three numbers a layer, and these along the key's time, so the log of a hot key is never one array.
    """
    kind = dict(events.dtypes)["ts"]
    stretch = F.date_trunc(step, "ts") if kind.startswith(("timestamp", "date")) else F.substring("ts", 1, 7) if kind == "string" else F.floor(F.col("ts") / STRETCH)
    events = events.withColumns({"_t": stretch, "_guard": F.lit(False)})
    if protected is not None:
        held = protected.select(key, F.lit(True).alias("_held")).distinct()
        events = events.join(held, key, "left").withColumn("_guard", F.coalesce("_held", F.lit(False))).drop("_held")
    log = F.sort_array(F.collect_list(F.struct("ts", "seq", F.when(~(F.col("_guard") & (F.col("reward") < 0)), F.col("reward")).alias("reward"), F.substring("context", 1, C.CONTEXT_CHARS).alias("context"))))
    parts = events.groupBy(key, "_t").agg(log.alias("_log")).withColumn("_used", F.filter("_log", lambda e: e["reward"].isNotNull()))
    none = F.struct(F.lit(0.0).alias("shift"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    layers = [_folded(none, x).alias(x) for x in C.Q_LAYERS]
    parts = parts.select(key, F.struct("_t", F.size("_log").alias("n"), F.transform(F.slice("_log", F.greatest(F.lit(1), F.size("_log") - (C.CONTEXTS_KEPT - 1)), C.CONTEXTS_KEPT), lambda e: e["context"]).alias("contexts"), *layers).alias("_p"))
    out = parts.groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias("_parts"))
    if start is not None:
        out = out.join(start.select(key, *[F.col(f"q_{x}").alias(f"_{x}") for x in C.Q_LAYERS]), key, "left")
    for x in C.Q_LAYERS:
        first = F.coalesce(F.col(f"_{x}"), F.lit(C.Q_INIT)) if start is not None else F.lit(C.Q_INIT)
        out = out.withColumn(f"q_{x}", _along(first, x))
    contexts = F.flatten(F.transform("_parts", lambda p: p["contexts"]))
    visits = F.aggregate("_parts", F.lit(0), lambda n, p: n + p["n"])
    return out.withColumn("_c", contexts).select(key, *[f"q_{x}" for x in C.Q_LAYERS], S.combined_q(*[F.col(f"q_{x}") for x in C.Q_LAYERS]).alias("q_value"), visits.alias("q_visits"), F.slice("_c", F.greatest(F.lit(1), F.size("_c") - (C.CONTEXTS_KEPT - 1)), C.CONTEXTS_KEPT).alias("reward_contexts"))


def _after(f: Column, g: Column) -> Column:
    """``f`` and then ``g``."""
    return F.struct((f["shift"] + g["shift"]).alias("shift"), _through(f["low"], g).alias("low"), _through(f["high"], g).alias("high"))


def _chained(none: Column, layer: str) -> Column:
    return F.aggregate("_parts", none, lambda f, p: _after(f, p[layer]))


def composed(events: DataFrame, key: str, order: str = "seq", tasks: int | None = None) -> DataFrame:
    """key, n and ``move`` (a function for each layer): what all of a key's events (order, reward) do, in order, to any value; ``moved`` applies it.

    Events are dealt by ranges of key and order. Each range folds its events to one function a key, however many tasks a hot key's events fill, and a key's
    few functions are put together in turn. Events without a reward count in ``n`` and move nothing.
    """
    tasks = tasks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(key, order, "reward").repartitionByRange(tasks, key, order).withColumn("_t", F.spark_partition_id())
    log = dealt.groupBy(key, "_t").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("reward").isNotNull(), F.struct(F.col(order).alias("o"), "reward")))).alias("_used"))
    none = F.struct(F.lit(0.0).alias("shift"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    parts = log.select(key, F.struct("_t", "n", *[_folded(none, x).alias(x) for x in C.Q_LAYERS]).alias("_p")).groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias("_parts"))
    whole = F.struct(*[_chained(none, x).alias(x) for x in C.Q_LAYERS])
    return parts.select(key, F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n"), whole.alias("move"))


def moved(rows: DataFrame, move: str = "move") -> DataFrame:
    """``rows`` with the layers (q_action, ...; those missing begin at the initial value) after ``move``, and the value that they combine to."""
    layers = {f"q_{x}": _through(F.coalesce(F.col(f"q_{x}"), F.lit(C.Q_INIT)), F.col(move)[x]) for x in C.Q_LAYERS}
    return rows.withColumns(layers).withColumn("q_value", S.combined_q(*[F.col(x) for x in layers]))


def set_value(state: DataFrame, overrides: DataFrame, key: str = "memory_id") -> DataFrame:
    """All layers move by the difference to the target, each clamped; a difference under 1e-6 changes nothing."""
    rows = state.join(overrides.select(key, "target"), key, "left")
    delta = S.clamp(F.col("target"), C.Q_FLOOR, C.Q_CEILING) - F.col("q_value")
    moves = F.coalesce(F.abs(delta) >= 1e-6, F.lit(False))
    rows = rows.withColumns({f"q_{x}": F.when(moves, S.clamp(F.col(f"q_{x}") + delta, C.Q_FLOOR, C.Q_CEILING)).otherwise(F.col(f"q_{x}")) for x in ("action", "hypothesis", "fit")})
    return rows.withColumn("q_value", S.combined_q(F.col("q_action"), F.col("q_hypothesis"), F.col("q_fit"))).drop("target")


def merge_deltas(main: DataFrame, deltas: DataFrame, keys: tuple[str, ...] = ("memory_id", "experience"), ts: str = "q_updated_at") -> DataFrame:
    """Per key the strictly newest row; ties and undated deltas leave the main row, an undated main row gives way."""
    rows = main.withColumn("_d", F.lit(0)).unionByName(deltas.withColumn("_d", F.lit(1)))
    undated = (F.col(ts).isNull() | (F.col(ts) == "")).cast("int")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when((F.col("_d") == 0) & (undated == 1), 2).when(undated == 1, 1).otherwise(0), F.desc(ts), "_d"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r", "_d")


def save_merge(memory: DataFrame, disk: DataFrame, key: str = "memory_id") -> DataFrame:
    """What is in memory, and of what is on disk the ids that are not."""
    return memory.unionByName(disk.join(memory.select(key).distinct(), key, "left_anti"))


def evict(state: DataFrame, most: int, touched: str = "touched", key: str = "memory_id") -> DataFrame:
    """The ``most`` last touched rows, by a distributed sort with a limit."""
    return state.orderBy(F.desc(touched), key).limit(most)


def stats(state: DataFrame, group: str = "experience") -> DataFrame:
    return state.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.avg("q_value").alias("mean"), F.min("q_value").alias("min"), F.max("q_value").alias("max"))


def update_layer(state: DataFrame, rewards: DataFrame, layer: str, key: str = "memory_id") -> DataFrame:
    """``state`` after one reward to one layer of each key of ``rewards`` (key, reward), the visit counted; keys without one stay."""
    rows = state.join(rewards.select(key, F.col("reward").alias("_r")), key, "left")
    hit = F.col("_r").isNotNull()
    rows = rows.withColumns({f"q_{layer}": F.when(hit, S.clamp(F.col(f"q_{layer}") + C.Q_ALPHA * F.col("_r"), C.Q_FLOOR, C.Q_CEILING)).otherwise(F.col(f"q_{layer}")), "q_visits": F.col("q_visits") + hit.cast("int")})
    return rows.withColumn("q_value", S.combined_q(*[F.col(f"q_{x}") for x in C.Q_LAYERS])).drop("_r")


def with_defaults(keys: DataFrame, state: DataFrame, key: str = "memory_id") -> DataFrame:
    """A state for every key: zeros and no visits where there is none."""
    return keys.select(key).distinct().join(state, key, "left").fillna({**{f"q_{x}": C.Q_INIT for x in C.Q_LAYERS}, "q_value": C.Q_INIT, "q_visits": 0})


def load_and_merge(main: DataFrame, deltas: DataFrame, most: int = 100_000, touched: str = "q_updated_at") -> DataFrame:
    """The state at start: deltas merged in, and of the ids the ``most`` last touched."""
    merged = merge_deltas(main, deltas)
    kept = evict(merged.groupBy("memory_id").agg(F.max(touched).alias("_touched")), most, "_touched")
    return merged.join(kept.select("memory_id"), "memory_id", "left_semi")


def experience_names(state: DataFrame) -> DataFrame:
    """The contexts that any memory has a value in."""
    return state.select("experience").distinct()


def experiences(state: DataFrame) -> DataFrame:
    """memory_id, experiences: the contexts that each memory has values in, sorted."""
    return state.groupBy("memory_id").agg(F.sort_array(F.collect_set("experience")).alias("experiences"))


def reward_history(events: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """Every reward event that touched one of ``ids``, a row for each id: events are exploded and joined."""
    return events.withColumn(key, F.explode("memory_ids")).join(ids.select(key).distinct(), key, "left_semi")


def reward_detail(events: DataFrame, ids: DataFrame, order: str = "pos") -> DataFrame:
    """Of each reward id its first event in the log."""
    first = F.row_number().over(Window.partitionBy("reward_id").orderBy(order))
    return events.join(ids.select("reward_id").distinct(), "reward_id", "left_semi").withColumn("_r", first).where("_r = 1").drop("_r")


def adjusted(state: DataFrame, changes: DataFrame, key: str = "memory_id") -> DataFrame:
    """``state`` after the first ``adjustments``, in order: rewards move all layers, an override moves them by what is missing to its target.

    At most MAX_ADJUSTMENTS rows change, each folded by its key's few changes.
    """
    of = changes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "reward", "target"))).alias("_changes"))
    rows = state.join(F.broadcast(of), key, "left")
    layers = list(C.Q_LAYERS)
    begin = F.struct(*[F.col(f"q_{x}").alias(x) for x in layers])

    def change(q: Column, e: Column) -> Column:
        rewards = S.layer_rewards(e["reward"])
        delta = S.clamp(e["target"], C.Q_FLOOR, C.Q_CEILING) - S.combined_q(*[q[x] for x in layers])
        shift = F.when(F.abs(delta) >= 1e-6, delta).otherwise(0.0)
        return F.struct(*[S.clamp(q[x] + F.when(e["target"].isNotNull(), shift).otherwise(C.Q_ALPHA * rewards[x]), C.Q_FLOOR, C.Q_CEILING).alias(x) for x in layers])

    rows = rows.withColumn("_q", F.coalesce(F.aggregate("_changes", begin, change), begin))
    rows = rows.withColumns({**{f"q_{x}": F.col(f"_q.{x}") for x in layers}, "q_visits": F.col("q_visits") + F.when(F.col("_changes").isNotNull(), F.size("_changes")).otherwise(0)})
    return rows.withColumn("q_value", S.combined_q(*[F.col(f"q_{x}") for x in layers])).drop("_q", "_changes")


def adjustments(state: DataFrame, wanted: DataFrame, key: str = "memory_id") -> DataFrame:
    """The first adjustments by position (before unknown ids are dropped), as rewards: promote +|r|, demote -|r|, adjust r; override sets a target."""
    first = wanted.where(F.col("pos") < C.MAX_ADJUSTMENTS).join(state.select(key).distinct(), key, "left_semi")
    r = F.when(F.col("action") == "promote", F.abs("reward")).when(F.col("action") == "demote", -F.abs("reward")).when(F.col("action") == "adjust", F.col("reward"))
    return first.select(key, "pos", "action", r.alias("reward"), F.when(F.col("action") == "override", F.col("target_q")).alias("target"))
