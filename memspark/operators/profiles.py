"""Profiles: where they come from, which one a prompt calls for, and how long a session keeps it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z0-9_-]{1,64}")
LEAST_PROMPT, LEAST_HITS = 10, 2


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^{NAME.pattern}$"), F.lit(False))


def shadowed(own: DataFrame, bundled: DataFrame) -> DataFrame:
    """The user's profiles, and the bundled ones whose name the user has none of; valid names only, and ``default`` in any case."""
    rows = own.withColumn("_p", F.lit(0)).unionByName(bundled.withColumn("_p", F.lit(1))).where(valid_name(F.col("name")))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("_p"))).where("_r = 1").drop("_r", "_p")
    default = own.sparkSession.createDataFrame([("default",)], "name string").join(first.select("name"), "name", "left_anti")
    return first.unionByName(default, allowMissingColumns=True)


def process_stages(stages: Column) -> Column:
    """The names of a process's stages, given as JSON: texts, or objects with a name; anything else is passed over."""
    items = F.try_variant_get(F.try_parse_json(stages), "$", "array<variant>")
    name = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.name", "string"))
    return F.filter(F.transform(items, name), lambda x: x.isNotNull())


def detected(prompts: DataFrame, profiles: list[tuple[str, list[str]]], text: str = "text") -> DataFrame:
    """``prompts`` with ``profile``: of those whose keywords stand in the prompt twice or more the one of most, the first in the list on a tie; null where there is none.

    ``profiles`` (name, keywords) is configuration of a handful of entries and becomes one expression.
    """
    low = F.lower(F.col(text))
    hits = F.array(*[F.struct(sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("p")) for i, (name, words) in enumerate(profiles)])
    best = F.array_max(hits)
    return prompts.withColumn("profile", F.when((F.length(text) >= LEAST_PROMPT) & (best["n"] >= LEAST_HITS), best["p"]))


def session_profiles(saved: DataFrame, as_of: Column, keep: str = "INTERVAL 24 HOURS", session: str = "session_id") -> DataFrame:
    """Of each session the profile saved last, unless that is older than ``keep``."""
    last = saved.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("ts")))).where("_r = 1").drop("_r")
    return last.where(F.col("ts") >= as_of - F.expr(keep))
