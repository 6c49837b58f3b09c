"""Keyed state with timers: usefulness folded in the order of events however they arrive, and profiles that a session keeps for a day.

State lives in RocksDB (``stateful`` says so where a session has another store), so a key's state is not bound by memory. Timers run on the stream's
watermark: what is older than that is dropped by the engine, and what is younger waits until nothing older can come.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memspark.functions import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


def stateful(spark: SparkSession) -> None:
    """Fails early where the session's state store cannot hold state variables and timers."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")


def _ms(ts: dt.datetime) -> int:
    return (ts.replace(tzinfo=None) - _EPOCH) // dt.timedelta(milliseconds=1)


class _Timed(StatefulProcessor):
    """Keeps one timer a key, at the time of the earliest thing that waits."""

    handle: StatefulProcessorHandle

    def set_timer(self, when: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            if timer != when:
                self.handle.deleteTimer(timer)
            else:
                return
        if when is not None:
            self.handle.registerTimer(when)

    def close(self) -> None:
        pass


class Usefulness(_Timed):
    """Layers, visits, the protected flag and the last contexts of a (memory, experience); rows wait in a list until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "a double, h double, f double, visits int, protected boolean")
        self.contexts = handle.getListState("contexts", "context string")
        self.waiting = handle.getListState("waiting", "ms long, seq string, reward double, context string, protect boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(_ms(r["ts"]), r["seq"], r["reward"], r["context"], r["protect"]) for r in rows]
        self.waiting.appendList(new)
        earliest = min(x[0] for x in new)
        self.set_timer(min([earliest, *self.handle.listTimers()]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(x) for x in self.waiting.get())
        ready, later = [x for x in rows if x[0] <= now], [x for x in rows if x[0] > now]
        a, h, f, visits, protected = self.value.get() if self.value.exists() else (C.Q_INIT, C.Q_INIT, C.Q_INIT, 0, False)
        kept = [x[0] for x in self.contexts.get()] if self.contexts.exists() else []
        step = lambda q, r: max(C.Q_FLOOR, min(C.Q_CEILING, q + C.Q_ALPHA * r))
        for _, _, reward, context, protect in ready:
            if protect is not None:
                protected = protect
                continue
            visits += 1
            kept = [*kept, (context or "")[: C.CONTEXT_CHARS]][-C.CONTEXTS_KEPT :]
            if reward is not None and not (protected and reward < 0):
                a, h, f = step(a, reward), step(h, 0.8 * reward), step(f, reward if reward > 0 else 0.5 * reward)
        self.value.update((a, h, f, visits, protected))
        if kept:
            self.contexts.put([(x,) for x in kept])
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()
        q = sum(w * x for w, x in zip(C.Q_LAYERS.values(), (a, h, f), strict=True))
        yield Row(memory_id=key[0], experience=key[1], q_action=a, q_hypothesis=h, q_fit=f, q_value=q, q_visits=visits, protected=protected, reward_contexts=kept)


def usefulness_in_order(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """memory_id, experience, the layers, q_value, q_visits, protected and reward_contexts of a key each time the watermark lets rows of it through.

    ``events`` (memory_id, experience, ts, seq, reward, context, protect) may come in any order within ``delay``: rows are folded by (ts, seq) as the batch fold does. A row with
    ``protect`` sets the flag from its time on (true: negative rewards count as visits only) and is no visit.
    """
    stateful(events.sparkSession)
    rows = events.select(F.col("memory_id").cast("string").alias("memory_id"), F.coalesce("experience", F.lit("default")).alias("experience"), "ts", F.col("seq").cast("string").alias("seq"), F.col("reward").cast("double").alias("reward"), "context", "protect").withWatermark("ts", delay)
    out = "memory_id string, experience string, q_action double, q_hypothesis double, q_fit double, q_value double, q_visits int, protected boolean, reward_contexts array<string>"
    return rows.groupBy("memory_id", "experience").transformWithState(Usefulness(), out, "update", "eventTime")


class SessionProfile(_Timed):
    """The profile that a session saved last, until it is ``keep`` old."""

    def __init__(self, keep: dt.timedelta):
        self.keep = keep // dt.timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "ms long, profile string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        saved = self.saved.get() if self.saved.exists() else None
        for r in sorted(rows, key=lambda r: (r["ts"], r["text"] is not None)):
            at = _ms(r["ts"])
            if r["profile"] is not None and (saved is None or at >= saved[0]):
                saved = (at, r["profile"])
            if r["text"] is not None:
                fresh = saved is not None and 0 <= at - saved[0] <= self.keep
                yield Row(session_id=key[0], ts=r["ts"], text=r["text"], profile=saved[1] if fresh else "default")
        if saved is not None:
            self.saved.update(tuple(saved))
            self.set_timer(saved[0] + self.keep + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.saved.clear()
        yield from ()


def prompts_with_profiles(prompts: DataFrame, saved: DataFrame, keep: dt.timedelta = dt.timedelta(hours=24), delay: str = "10 minutes") -> DataFrame:
    """session_id, ts, text, profile of each prompt (session_id, ts, text, profile: what it calls for itself, or null): the profile its session saved last, by itself or in ``saved`` (session_id, ts, profile), and ``default`` when that is older than ``keep``."""
    stateful(prompts.sparkSession)
    both = prompts.select("session_id", "ts", "text", "profile").unionByName(saved.select("session_id", "ts", F.lit(None).cast("string").alias("text"), "profile"))
    rows = both.withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithState(SessionProfile(keep), "session_id string, ts timestamp, text string, profile string", "append", "eventTime")
