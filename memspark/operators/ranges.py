"""Ordered scans of groups of any size: a group's rows are cut into ranges of its order, each range is summarised, and the few summaries are chained.

A range is a partition of a sort by (group, order), so a group that holds a third of all rows fills a third of the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.plans.shared import written


def in_ranges(rows: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``_t``, the number of the range that a row falls in, written once: ranges are cut by a sample, and another run might cut them elsewhere."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(ranges, *group, *order).withColumn("_t", F.spark_partition_id()), "ranges")


def _same(rows_group: list[str], other: list[str]) -> Column:
    out = F.col("_t") == F.col("_u")
    for mine, theirs in zip(rows_group, other, strict=True):
        out &= F.col(mine).eqNullSafe(F.col(theirs))
    return out


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: Column, out: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the group's rows up to and with each, in order (which should leave no ties).

    Sums run within each range; what the group's earlier ranges sum to is added by a join with one row for each group and range.
    """
    cut = in_ranges(rows.withColumn("_v", F.coalesce(value, F.lit(0))), group, order, ranges)
    # Without a group all rows are one: its ranges' totals, of which there are as many as ranges, are summed in one task.
    keys = [f"_g{k}" for k in range(len(group))]
    totals = cut.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col("_t").alias("_u")).agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.sum("_s").over(earlier)).where("_before != 0").drop("_s")
    inside = Window.partitionBy(*group, "_t").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_in", F.sum("_v").over(inside)).join(totals, _same(group, keys), "left")
    return summed.withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).select(*rows.columns, out)


def _chain(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a greedy sum over ``sizes``: for a part that starts at each place, the parts from there to the end, what the last of them holds, and where the next part starts."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    after = np.maximum(np.searchsorted(total, total[:-1] + most, "right") - 1, np.arange(n) + 1)
    parts, last = np.ones(n, np.int64), np.empty(n, np.int64)
    for k in range(n - 1, -1, -1):
        j = after[k]
        parts[k], last[k] = (1 + parts[j], last[j]) if j < n else (1, total[n] - total[k])
    return parts, last, after


def _started(sizes: np.ndarray, used: int, most: int) -> np.ndarray:
    """1 at each row that starts a part, where ``used`` is in the part before."""
    out, total, n = np.zeros(len(sizes), np.int64), np.concatenate([[0], np.cumsum(sizes)]), len(sizes)
    at = 0 if used > most else int(np.searchsorted(total[1:], most - used, "right"))
    while at < n:
        out[at] = 1
        at = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
    return out


def greedy_parts(rows: DataFrame, group: list[str], order: list[str], size: Column, most: int, ranges: int | None = None) -> DataFrame:
    """``group``, ``order``, size and part (from 1 on) of each row: a running sum of ``size`` (0 or more) that starts anew before the row that would take it over ``most``. A larger row is a part by itself.

    What a range does to the part before it depends only on which of its rows is the first to start a part: its first row, or one of those with a size in its first ``most``.
    A range says of its first and its last group, which may go on in other ranges, how many parts follow each of these rows and how full the last is. A group's ranges
    are followed in order by these tables, and each range then numbers its own rows.
    """
    names = group or ["_all"]
    narrow = rows.withColumn("_all", F.lit(0)).select(*names, *order, F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    kinds = dict(narrow.dtypes)
    cut = in_ranges(narrow, names, order, ranges)
    w = Window.partitionBy("_t").orderBy(*names, *order)
    key = F.struct(*names)
    placed = cut.withColumns({"_p": F.row_number().over(w), "_new": F.coalesce(~F.lag(key).over(w).eqNullSafe(key), F.lit(True)).cast("int")})
    key_schema = "".join(f"{g} {kinds[g]}, " for g in names)

    def tables(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_p", ignore_index=True)
        run = np.cumsum(frame["_new"].to_numpy()) - 1
        out = []
        for k in sorted({0, int(run[-1])}):
            at = np.flatnonzero(run == k)
            sizes = frame["size"].to_numpy()[at]
            parts, last, _ = _chain(sizes, most)
            before = np.concatenate([[0], np.cumsum(sizes)])
            can = np.flatnonzero((before[:-1] <= most) & ((sizes > 0) | (np.arange(len(sizes)) == 0)))
            out.append([*[frame[g].iloc[at[0]] for g in names], frame["_t"].iloc[0], int(before[-1]), *[x.tolist() for x in (before[can + 1], parts[can], last[can])]])
        return pd.DataFrame(out, columns=[*names, "_t", "total", "ends", "parts", "last"])

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        frame, used, done, out = frame.sort_values("_t", ignore_index=True), most + 1, 0, []
        for row in frame[["total", "ends", "parts", "last"]].itertuples(index=False):
            out.append((used, done))
            at = 0 if used > most else int(np.searchsorted(np.array(row.ends), most - used, "right"))
            if at < len(row.ends):
                used, done = int(row.last[at]), done + int(row.parts[at])
            else:
                used += int(row.total)
        return frame[[*names, "_t"]].assign(_used=[u for u, _ in out], _done=[d for _, d in out])

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_p", ignore_index=True)
        sizes, begin = frame["size"].to_numpy(), np.append(np.flatnonzero(frame["_new"].to_numpy()), len(frame))
        used, done = frame["_used"].to_numpy(), frame["_done"].to_numpy()
        parts = [done[a] + np.cumsum(_started(sizes[a:b], int(used[a]), most)) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        return frame[[*names, *order, "size"]].assign(part=np.concatenate(parts))

    told = placed.select(*names, "_t", "_p", "_new", "size").groupBy("_t").applyInPandas(tables, f"{key_schema}_t int, total long, ends array<long>, parts array<long>, last array<long>")
    states = told.groupBy(*names).applyInPandas(follow, f"{key_schema}_t int, _used long, _done long")
    other = [f"_k{k}" for k in range(len(names))]
    # At most two rows for each range, of which there are as many as partitions: a bounded broadcast.
    begun = placed.join(F.broadcast(states.toDF(*other, "_u", "_used", "_done")), _same(names, other), "left").fillna({"_used": most + 1, "_done": 0})
    schema = f"{key_schema}{''.join(f'{c} {kinds[c]}, ' for c in order)}size long, part long"
    out = begun.select(*names, *order, "size", "_t", "_p", "_new", "_used", "_done").groupBy("_t").applyInPandas(number, schema)
    return out if group else out.drop("_all")
