"""Rows of one key compared with each other in bounded blocks, whatever the size of the key's group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired_blocks(df: DataFrame, keys: list[str], member: str, row_id: str, size: Column | int) -> DataFrame:
    """``df`` dealt to units (``keys``, _i, _j) of about ``2 * size`` rows at most, so that within its keys each row meets each member in one unit.

    ``size`` may depend on the keys. A unit compares its queries (_q) with its entries (_e). Members are entries, and every row is a query. A group of m members and v rows has
    m / size by v / size units; a member goes to a row of them and every row to a column. Groups without a second row or a member are left out.
    """
    sizes = df.groupBy(*keys).agg(F.sum(F.col(member).cast("long")).alias("_m"), F.count(F.lit(1)).alias("_v")).where("_m > 0 and _v > 1")
    sizes = sizes.select(*keys, F.ceil(F.col("_m") / size).cast("int").alias("_ni"), F.ceil(F.col("_v") / size).cast("int").alias("_nj"))
    i, j = F.pmod(F.xxhash64(row_id), F.col("_ni")).cast("int"), F.pmod(F.xxhash64(row_id, F.lit(1)), F.col("_nj")).cast("int")

    def unit(i, j, e, q):
        return F.struct(i.alias("_i"), j.alias("_j"), e.alias("_e"), q.alias("_q"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    entries = F.when(F.col(member), F.transform(F.sequence(zero, F.col("_nj") - 1), lambda x: unit(i, x, yes, no))).otherwise(F.expr("array()"))
    queries = F.transform(F.sequence(zero, F.col("_ni") - 1), lambda x: unit(x, j, no, yes))
    one = F.array(unit(zero, zero, F.col(member), yes))
    units = F.when((F.col("_ni") == 1) & (F.col("_nj") == 1), one).otherwise(F.concat(entries, queries))
    return df.join(sizes, keys).withColumn("_unit", F.explode(units)).select(*df.columns, "_unit.*")


def linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest known node of each node's group) after ``a`` and ``b`` have been linked pair by pair."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_pairs = low != high
        if not open_pairs.any():
            return root
        np.minimum.at(root, high[open_pairs], low[open_pairs])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
