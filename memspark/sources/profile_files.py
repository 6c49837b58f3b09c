"""Profiles from files: one YAML file each, in the user's folder or among those that come with the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.profiles import shadowed
from memspark.sources.files import empty

PROFILE = "name string, description string, session_reward_weights map<string,double>, outcome_resolvers array<string>, retrieval_boosts map<string,double>, q_config_overrides map<string,double>, process_stages array<struct<name:string,description:string,reward_on_enter:double>>, reward_memory_types array<string>, detect_keywords array<string>"


def _profile(stem: str, content: str) -> tuple | None:
    """A profile's row; None for a file that is no mapping or is malformed. Stages are texts or mappings with a name; other entries are passed over."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("profiles in YAML files need the yaml package") from error
    try:
        data = yaml.safe_load(content)
        if not isinstance(data, dict):
            return None
        numbers = lambda name: {str(k): float(v) for k, v in (data.get(name) or {}).items()}
        texts = lambda name: [str(x) for x in data.get(name) or []]
        stages = [(x, "", 0.0) if isinstance(x, str) else (str(x["name"]), str(x.get("description", "")), float(x.get("reward_on_enter", 0.0))) for x in data.get("process_stages") or [] if isinstance(x, str) or isinstance(x, dict) and "name" in x]
        return (str(data.get("name", stem)), str(data.get("description", "")), numbers("session_reward_weights"), texts("outcome_resolvers"), numbers("retrieval_boosts"), numbers("q_config_overrides"), stages, texts("reward_memory_types"), texts("detect_keywords"))
    except (yaml.YAMLError, AttributeError, TypeError, ValueError):
        return None


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profiles of a folder's ``*.yaml`` files, with their stem; none where there is no folder."""
    columns = [c.split(" ", 1)[0] for c in PROFILE.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(stem, *found) for stem, content in zip(frame["stem"], frame["value"], strict=True) if (found := _profile(stem, content)) is not None]
            yield pd.DataFrame(rows, columns=["stem", *columns])

    try:
        files = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, f"stem string, {PROFILE}")
    return files.select(F.regexp_replace("_metadata.file_name", r"\.yaml$", "").alias("stem"), "value").mapInPandas(parse, f"stem string, {PROFILE}")


def load_profiles(spark: SparkSession, own: str, bundled: str) -> DataFrame:
    """All profiles: the user's files before the bundled ones of the same stem, those of valid names, and ``default`` in any case."""
    user, others = read_profiles(spark, own), read_profiles(spark, bundled)
    return shadowed(user, others.join(user.select("stem"), "stem", "left_anti")).drop("stem")


def resolve_profile(profiles: DataFrame, session: str | None = None, variable: str | None = None, project: str | None = None) -> str:
    """The profile of a run: the session's own, else the environment's, else the project's, if there is one of that name; ``default`` otherwise."""
    known = {r["name"] for r in profiles.select("name").collect()}  # a handful of files
    return next((name for name in (session, variable, project) if name and name in known), "default")
