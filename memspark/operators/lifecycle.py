"""Lifecycle states: counts and guarded transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.constants import LIFECYCLE_EDGES


def state_counts(rows: DataFrame) -> DataFrame:
    """One row: the total, each state's count, and what carries none of them."""
    states = list(LIFECYCLE_EDGES)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    return counts.withColumn("unlabeled", F.greatest(F.lit(0), F.col("total") - sum((F.col(s) for s in states), F.lit(0))).cast("long"))


def transition(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """The answer to each request (id, from_status, to_status): whether the row is there, the state agrees and the edge is legal; and the state after it."""
    edges = F.create_map(*[x for k, v in LIFECYCLE_EDGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    asked = requests.join(rows.select("id", F.col("status").alias("current")), "id", "left")
    legal = F.coalesce(F.array_contains(edges[F.col("from_status")], F.col("to_status")), F.lit(False))
    ok = F.coalesce(F.col("current") == F.col("from_status"), F.lit(False)) & legal
    return asked.select("id", "from_status", "to_status", ok.alias("accepted"), F.when(ok, F.col("to_status")).otherwise(F.col("current")).alias("status"), (ok & F.col("to_status").isin("superseded", "contradicted", "merged")).alias("stamped"))
