"""A kept vector index: memories in lists by their nearest centre, so a search reads a few lists, and an exact way that says which others it must read.

Centres are fitted on a bounded sample (``sample_rows`` vectors of smallest hash); every row is in a list, whatever the sample. Lists are partitions of a Parquet table with the memories' own columns, so
filters reach the scan. The similarities of what is read are exact. With the largest angle between a list's members and its centre the exact way leaves out only lists that cannot hold a better row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.operators import search
from memspark.operators.graph import unit_rows

#: Rows of the sample for each list; lists at most; lists that a search reads first.
ROWS_PER_LIST, MOST_LISTS, PROBES = 32, 4096, 8
#: The list of vectors that are null, zero or of another length.
ASIDE = -1


def _centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical means of a sample, from rows of it as they come (by hash)."""
    out = x[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 8192] @ out.T).argmax(1) for a in range(0, len(x), 8192)])
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), out)
    return out


def build(memory: DataFrame, path: str, sample_rows: int = 65_536, lists: int | None = None) -> None:
    """Writes the index of ``memory`` (id, vector, and any other columns) to ``path``."""
    spark = memory.sparkSession
    width = memory.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()["d"]
    sample = memory.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("id")).limit(sample_rows).select("vector").toArrow()["vector"]
    x = unit_rows(sample, max(0, width))
    x = x[x.any(1)]
    k = min(max(1, lists or min(MOST_LISTS, len(x) // ROWS_PER_LIST)), max(1, len(x)))
    centres = _centres(x, k) if len(x) else np.zeros((0, max(1, width)))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if batch.num_rows and len(centres):
                x = unit_rows(batch.column("vector"), centres.shape[1])
                cosine = x @ centres.T
                own = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(x)), own], -1, 1))
                own = np.where(x.any(1), own, ASIDE)
            else:
                own, angle = np.full(batch.num_rows, ASIDE), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(angle)], [*batch.schema.names, "list", "angle"])

    schema = T.StructType([*memory.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = memory.mapInArrow(place, schema)
    placed.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    # The schema is written too: where there is no row there is no file that has it.
    spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    reach = _lists(spark, path).groupBy("list").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("rows"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    reach.join(named, "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["schema"]))).parquet(f"{path}/lists")


def top(spark: SparkSession, path: str, query: Sequence[float], k: int, probes: int = PROBES, exact: bool = False, **filters) -> DataFrame:
    """The k rows most similar to ``query`` in the ``probes`` nearest lists, with ``score``; ties by id. Filters are those of a search.

    Where these lists hold fewer than k rows that pass, twice as many are read, and so on. With ``exact`` every list is then read that may hold a row better than the k-th: its centre is nearer to
    the query than that row by no more than the list's largest angle.
    """
    known = spark.read.parquet(f"{path}/centres").collect()  # MOST_LISTS rows at most
    q = np.array(query, float)
    q = q / max(np.linalg.norm(q), 1e-300)
    away = {r["list"]: float(np.arccos(np.clip(np.dot(q[: len(r["centre"])], r["centre"]), -1, 1))) if r["centre"] is not None and len(r["centre"]) == len(q) else np.pi / 2 for r in known}
    order = sorted(away, key=lambda c: (c == ASIDE, away[c], c))
    rows = search.payload_filter(_lists(spark, path).drop("angle"), **filters)
    rows = search.lifecycle_filter(rows) if "status" in rows.columns else rows

    def best(lists: list[int]) -> DataFrame:
        return search.vector_top(rows.where(F.col("list").isin(lists)), query, k).drop("list")

    while True:
        chosen = order[: max(1, probes)]
        scores = [r["score"] for r in best(chosen).select("score").collect()]  # k rows at most
        if len(scores) >= k or len(chosen) == len(order):
            break
        probes *= 2
    if exact and len(scores) >= k:
        reach = {r["list"]: r["reach"] for r in known}
        limit = float(np.arccos(np.clip(min(scores), -1, 1))) + 1e-9
        chosen = [c for c in order if c in chosen or (min(scores) <= 0 if c == ASIDE else away[c] - reach[c] <= limit)]
    return best(chosen)
