"""Scores as column expressions: similarity, recency, boosts, and the blends of them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions import constants as C


def lookup(table: dict, key: Column, other) -> Column:
    """A small fixed table as a map expression."""
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[key], F.lit(other))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def age_days(created: Column, as_of: Column) -> Column:
    """Whole days passed, 0 if in the future, null for null."""
    return F.when(created.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(created)) / 86_400_000_000)).cast("long"))


def recency(created: Column, as_of: Column, half_life: float = C.HALF_LIFE_DAYS) -> Column:
    return F.coalesce(F.exp(-C.DECAY * age_days(created, as_of) / half_life), F.lit(C.UNKNOWN_RECENCY))


def squash(keyword: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-keyword / 3.0))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def hybrid(semantic: Column, keyword: Column, recent: Column, importance: Column, kind: Column, q: Column, status: Column) -> Column:
    w = C.HYBRID_WEIGHTS
    blend = w["semantic"] * semantic + w["keyword"] * squash(keyword) + w["recency"] * recent + w["importance"] * F.coalesce(importance, F.lit(0.8)) * lookup(C.TYPE_BOOST, kind, C.OTHER_BOOST) + w["q"] * q
    return clamp(blend * lookup(C.STATUS_WEIGHT, status, 1.0), 0.0, 1.0)


def composite(similarity: Column, recent: Column, importance: Column, kind: Column, accesses: Column) -> Column:
    """Importance of 0 counts as missing (0.8); lasting types keep a floor of recency."""
    w = C.COMPOSITE_WEIGHTS
    recent = F.when(kind.isin(*C.PERSISTENT_TYPES), F.greatest(recent, F.lit(C.PERSISTENT_RECENCY))).otherwise(recent)
    weight = F.when(F.coalesce(importance, F.lit(0.0)) == 0, 0.8).otherwise(importance)
    blend = w["semantic"] * similarity + w["recency"] * recent + w["importance"] * weight * lookup(C.TYPE_BOOST, kind, C.OTHER_BOOST)
    return clamp(blend * F.least(1.0 + 0.05 * accesses, F.lit(1.5)), 0.0, 1.0)


def layer_rewards(reward: Column) -> dict[str, Column]:
    return {"action": reward, "hypothesis": 0.8 * reward, "fit": F.when(reward > 0, reward).otherwise(0.5 * reward)}


def combined_q(action: Column, hypothesis: Column, fit: Column) -> Column:
    return C.Q_LAYERS["action"] * action + C.Q_LAYERS["hypothesis"] * hypothesis + C.Q_LAYERS["fit"] * fit
