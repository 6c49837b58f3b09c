"""Streams: deduplicated ingestion, calendar and session windows, keyed usefulness state, and idempotent merges.

All sources are anything Structured Streaming reads; late rows beyond the watermark are dropped by the engine, as documented for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from memspark.functions import constants as C
from memspark.functions.text import redact_secrets
from memspark.operators.usefulness import merge_deltas

# Tools that are captured, commands that only read, and paths that are never captured.
TOOLS = ("Write", "Edit", "Bash")
READ_ONLY = (r"ls( |$)", r"pwd( |$)", "cat ", "echo ", "head ", "tail ", "wc ", "which ", "type ", "cd ", "test ", r"\[ ", "find ", "grep ", "rg ")
SENSITIVE = r"\.env$|\.env\.[^/]*$|credentials\.json$|token\.json$|secret|\.pem$|\.key$|/\.ssh/"


def capture(payloads: DataFrame) -> DataFrame:
    """Observations of tool calls (tool_name, session_id, cwd, tool_input): allowed tools, no read-only commands or sensitive paths.

    Secrets are redacted before a command is cut, so none is left readable by being cut short, and again in the summary.
    """
    path, command = F.col("tool_input.file_path"), F.regexp_replace("tool_input.command", r"^/[^ ]*/", "")
    read_only = F.coalesce(command.rlike(rf"^({'|'.join(READ_ONLY)})"), F.lit(False))
    given = F.coalesce(F.when(F.col("tool_name") == "Bash", F.col("tool_input.command")).otherwise(path), F.lit("")) != ""
    kept = payloads.where(F.col("tool_name").isin(*TOOLS) & given & ~((F.col("tool_name") == "Bash") & read_only) & ~F.coalesce(path.rlike(SENSITIVE), F.lit(False)))
    name = F.element_at(F.split(path, "/"), -1)
    summary = F.when(F.col("tool_name") == "Bash", F.concat(F.lit("Ran: "), F.substring(redact_secrets(F.col("tool_input.command")), 1, 300))).otherwise(F.concat(F.when(F.col("tool_name") == "Write", "Wrote ").otherwise("Edited "), name))
    return kept.select("session_id", F.col("tool_name").alias("tool"), redact_secrets(summary).alias("summary"), F.element_at(F.split("cwd", "/"), -1).alias("project"), path.alias("file_path"))


def once(rows: DataFrame, id_col: str, ts: str, delay: str = "30 days") -> DataFrame:
    """Each id once, remembered for ``delay``."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def daily(rows: DataFrame, ts: str, value: str, delay: str = "1 day") -> DataFrame:
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), "events", "total")


def sessions(rows: DataFrame, key: str, ts: str, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Sessions of a key that end after ``gap`` without a row; a stalled trajectory is one whose gap has passed."""
    return rows.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def usefulness_state(events: DataFrame, key: str = "memory_id") -> DataFrame:
    """key, q_action, q_hypothesis, q_fit, q_visits after each batch: the clamped fold, kept as state of three numbers and a count.

    Rows of a batch are folded in (ts, seq) order; rows that come in a later batch are folded after it.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        action, hypothesis, fit, visits = state.get if state.exists else (C.Q_INIT, C.Q_INIT, C.Q_INIT, 0)
        step = lambda q, r: max(C.Q_FLOOR, min(C.Q_CEILING, q + C.Q_ALPHA * r))
        for reward in pd.concat(list(frames)).sort_values(["ts", "seq"])["reward"]:
            visits += 1
            if reward == reward:
                action, hypothesis, fit = step(action, reward), step(hypothesis, 0.8 * reward), step(fit, reward if reward > 0 else 0.5 * reward)
        state.update((action, hypothesis, fit, visits))
        yield pd.DataFrame([(keys[0], action, hypothesis, fit, visits)], columns=[key, "q_action", "q_hypothesis", "q_fit", "q_visits"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, q_action double, q_hypothesis double, q_fit double, q_visits int", "a double, h double, f double, n int", "update", GroupStateTimeout.NoTimeout)


def merge_batches(path: str, keys: tuple[str, ...] = ("memory_id", "experience")):
    """A foreachBatch function that appends each batch of deltas under its batch id; ``merged_state`` reads the latest row of each key.

    A batch that is run again overwrites its own folder only, so it changes nothing, and the table is never rewritten for a batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run


def merged_state(main: DataFrame, path: str) -> DataFrame:
    """``main`` and all batches under ``path``: of each key the latest row; ties keep ``main`` and then the earlier batch."""
    deltas = main.sparkSession.read.option("basePath", path).schema(T.StructType([*main.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path).drop("batch_id")
    return merge_deltas(main, deltas.select(*main.columns))


def new_sessions(messages: DataFrame, known: DataFrame, session: str = "session_id") -> DataFrame:
    """What belongs to no session that is known already."""
    return messages.join(known.select(session).distinct(), session, "left_anti")
