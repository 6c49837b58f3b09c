"""Versioned tables: a state is written beside the last one and counts once it is whole, and deltas are folded into it and removed.

A version is a folder of Parquet files, and its commit is the marker that Spark leaves when the job that wrote it has ended. Readers take the last version that has
one, so a run that dies half-way leaves nothing that anyone reads. Folders are listed by Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import outcomes, usefulness
from memspark.sources.files import empty

MARKER = "_SUCCESS"


def _children(spark: SparkSession, path: str) -> dict[str, bool]:
    """Names of the folders in ``path``, and whether each is committed."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    return {s.getPath().getName(): fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), MARKER)) for s in fs.listStatus(folder) if s.isDirectory()}


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _number(name: str) -> int:
    found = re.fullmatch(r"v-(\d+)", name)
    return int(found[1]) if found else -1


def last_version(spark: SparkSession, path: str) -> int | None:
    return max((_number(name) for name, whole in _children(spark, path).items() if whole and _number(name) >= 0), default=None)


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The last committed version (or the one that is asked for); no rows where there is none yet."""
    version = last_version(spark, path) if version is None else version
    return empty(spark, schema) if version is None else spark.read.schema(schema).parquet(f"{path}/v-{version:08d}")


def write_version(rows: DataFrame, path: str, keep: int = 2) -> int:
    """Writes ``rows``, which may be made from the version before, as the next version, and removes committed ones but the last ``keep``. A folder without a marker is another run's, or a dead one's, and is passed over."""
    spark = rows.sparkSession
    version = 1 + max(map(_number, _children(spark, path)), default=-1)
    version = max(version, 0)
    rows.write.mode("errorifexists").parquet(f"{path}/v-{version:08d}")
    whole = sorted(_number(name) for name, done in _children(spark, path).items() if done and _number(name) >= 0)
    for old in whole[: -max(1, keep)]:
        _remove(spark, f"{path}/v-{old:08d}")
    return version


def save_state(memory: DataFrame, path: str, schema: str) -> int:
    """What is in memory, and of the last version the ids that are not, as the next version."""
    return write_version(usefulness.save_merge(memory, read_version(memory.sparkSession, path, schema)), path)


def save_delta(rows: DataFrame, path: str, session: str) -> None:
    """A session's changed rows, in a folder of its own; saving again replaces them."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", session):
        raise ValueError(f"not a session's name: {session!r}")
    rows.write.mode("overwrite").parquet(f"{path}/session-{session}")


def fold_deltas(spark: SparkSession, state: str, deltas: str, schema: str) -> int:
    """Merges the committed deltas into the next version of the state and removes them; how many they were.

    A row counts by its own time, so a delta that is merged again (after a run that died before it removed them) changes nothing. Folders that appear meanwhile are left for the next run.
    """
    found = sorted(name for name, whole in _children(spark, deltas).items() if whole and name.startswith("session-"))
    if found:
        rows = spark.read.schema(schema).parquet(*[f"{deltas}/{name}" for name in found])
        write_version(usefulness.merge_deltas(read_version(spark, state, schema), rows), state)
        for name in found:
            _remove(spark, f"{deltas}/{name}")
    return len(found)


DEALS, LEADS = "deal_id string, stage string, client_id string", "lead_id string, stage string, company_id string"


def crm_changes(spark: SparkSession, path: str, deals: DataFrame, leads: DataFrame) -> tuple[DataFrame, int]:
    """The events of what changed since the last run, and the number of this run's snapshot.

    The first run has nothing to compare with and no events. Events are those between two committed snapshots, so they are the same however often they are read; a
    rerun after a death before the commit finds the same ones again, which the log of rewards knows by their keys.
    """
    names = {"deals": (DEALS, deals), "leads": (LEADS, leads)}
    before = {name: last_version(spark, f"{path}/{name}") for name in names}
    old = {name: read_version(spark, f"{path}/{name}", schema, before[name]) for name, (schema, _) in names.items()}
    made = {name: write_version(rows.select(*[F.col(c.split()[0]).cast("string") for c in schema.split(", ")]), f"{path}/{name}", keep=3) for name, (schema, rows) in names.items()}
    new = {name: read_version(spark, f"{path}/{name}", schema, made[name]) for name, (schema, _) in names.items()}
    return outcomes.crm_outcomes((old["deals"], new["deals"]), (old["leads"], new["leads"])), made["deals"]
