"""Groups of rows that links join: components of a graph, and links between vectors found in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.plans.shared import written

#: Room for rounding in the bounds, and what a row costs in one more cell, in comparisons.
SLACK, ROW_COST = 1e-6, 2_000
#: Edges that a task holds before they become a forest, and loose ones that it returns at most.
EDGES, LOOSE = 1 << 20, 1 << 19


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node that it is joined with. Edges with a null end, and of a node with itself, are left out.

    In each round a node moves to its smallest neighbour and from there along the moves to their end, in steps that double; edges follow. Minima are
    taken before rows are shuffled, so a hub sends one row a task. Each round is a table of its own.
    """
    edges = written(edges.where("a != b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "moves")
        while True:
            on = moves.where("to != a").select(F.col("a").alias("to"), F.col("to").alias("up"))
            moves = written(moves.join(on, "to", "left").select("a", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("went")), "moves")
            if moves.where("went").isEmpty():
                break
            moves = moves.drop("went")
        moves = moves.drop("went")
        if labels is None:
            labels = moves.toDF("node", "label")
        else:
            labels = written(labels.join(moves.toDF("label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        followed = edges.join(moves.toDF("a", "x"), "a").join(moves.toDF("b", "y"), "b")
        edges = written(followed.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b").distinct(), "edges")
    return edges.toDF("node", "label") if labels is None else labels


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one; those that are null, of another width or zero are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes == width)
    out = np.zeros((len(column), width))
    if width and len(whole):
        out[whole] = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and which pivots' cells may hold a row within ``radius``: those whose bounding plane is as near."""
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    own = d2.argmin(1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    return own, d2 - d2[np.arange(len(x)), own][:, None] <= 2 * radius * apart[own] + SLACK


def _pivots(sample: np.ndarray, rows: int, radius: float) -> np.ndarray:
    """As many of the sample's rows as make the least work: more pivots make smaller cells, and rows that visit more of them."""
    best = None
    for k in (1, 4, 16, 64, 256):
        if k > max(1, len(sample) // 8):
            break
        _, reach = _cells(sample, sample[:k], radius)
        cost = reach.sum(1).mean() * (ROW_COST + rows / k)
        if best is None or cost < best[0]:
            best = (cost, sample[:k])
    return best[1]


class _Joined:
    """Edges of rows by id: sure ones as a forest, loose ones once for each pair of the forest's trees. Loose ones beyond ``LOOSE`` become sure."""

    def __init__(self) -> None:
        none = np.zeros(0, np.int64)
        self.sure, self.loose, self.held = [(none, none)], [(none, none)], 0

    def add(self, a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> None:
        self.sure.append((a[sure], b[sure]))
        self.loose.append((a[~sure], b[~sure]))
        self.held += len(a)
        if self.held > EDGES:
            self.reduce()

    def reduce(self) -> None:
        (a, b), (c, d) = ([np.concatenate(x) for x in zip(*edges, strict=True)] for edges in (self.sure, self.loose))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root, a, b = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        rest = root != np.arange(len(nodes))
        self.sure = [(nodes[rest], nodes[root[rest]])]
        if len(c):
            ends, at = np.unique(np.concatenate([c, d]), return_inverse=True)
            if len(nodes):
                place = np.minimum(np.searchsorted(nodes, ends), len(nodes) - 1)
                ends = np.where(nodes[place] == ends, nodes[root[place]], ends)
            pairs = np.sort(np.stack([ends[at[: len(c)]], ends[at[len(c) :]]], 1), 1)
            c, d = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).T
        self.loose = [(c, d)]
        if len(c) > LOOSE:
            self.sure, self.loose = [*self.sure, (c, d)], [(c[:0], d[:0])]
            self.reduce()
        self.held = 0

    def batch(self) -> pa.RecordBatch:
        self.reduce()
        (a, b), (c, d) = self.sure[0], self.loose[0]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c])), pa.array(np.concatenate([b, d])), pa.array(np.arange(len(a) + len(c)) < len(a))], ["a", "b", "sure"])


def _few_a_batch(spark: SparkSession, df: DataFrame, name: str, rows: int = 4) -> DataFrame:
    """``df`` written while Python workers get so few rows a batch, as its rows are blocks of vectors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        return written(df, name)
    finally:
        spark.conf.set(key, before)


def vector_links(rows: DataFrame, least: float, vector: str = "vector", block: int = 4096, sample_rows: int = 2048) -> DataFrame:
    """Edges (a, b) between ids that join all pairs of a cosine of ``least`` (over 0) or more: a forest of each task, not the pairs."""
    return graded_links(rows, least, least, vector, block, sample_rows).select("a", "b")


def graded_links(rows: DataFrame, sure: float, least: float, vector: str = "vector", block: int = 4096, sample_rows: int = 2048) -> DataFrame:
    """Edges (a, b, sure) between ids. Those that are sure join all pairs of a cosine of ``sure`` or more, as a forest of each task; each pair of a cosine from ``least`` (over 0) to ``sure``
    has a loose edge between what sure edges join with its ends, or is joined by sure edges itself.

    A row is kept once, in single precision, in a block of rows that share their nearest pivot (one of a bounded sample's rows; any choice is exact). Blocks meet as a product of the
    table's partitions, each read where it is needed: nothing is copied for the pairs, so disk grows with the rows and only the comparisons with their square. Blocks out of each
    other's reach do not meet.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-3
    spark, whole = rows.sparkSession, rows.select("id", F.col(vector).alias("vector"))
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    width = max(0, size["d"])
    sample = unit_rows(whole.where("vector is not null").orderBy(F.xxhash64("id")).limit(sample_rows).select("vector").toArrow()["vector"], width)
    sample = sample[sample.any(1)]
    if not len(sample):
        return spark.createDataFrame([], "a long, b long, sure boolean")
    block = min(block, max(64, (1 << 20) // width))
    slack = (width + 8) * 6e-8  # room for rounding in a product in single precision
    chosen = _pivots(sample, size["n"], radius)
    share = np.bincount(_cells(sample, chosen, radius)[0], minlength=len(chosen)) / len(sample)
    shared = spark.sparkContext.broadcast((chosen, np.ceil(share * size["n"] / block).clip(1).astype(int)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, parts = shared.value
        for batch in batches:
            x = unit_rows(batch.column("vector"), width)
            at = np.flatnonzero(x.any(1))
            own = _cells(x[at], pivots, radius)[0]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array([v.tobytes() for v in x[at].astype(np.float32)], pa.binary()), pa.array(own, pa.int32()), pa.array(parts[own], pa.int32())], ["id", "x", "cell", "parts"])

    def pack(table: pa.Table) -> pa.Table:
        cell, part, out = table["cell"][0].as_py(), table["part"][0].as_py(), []
        for k, begin in enumerate(range(0, len(table), block)):
            some = table.slice(begin, block)
            x = b"".join(some["x"].to_pylist())
            reach = _cells(np.frombuffer(x, np.float32).reshape(-1, width).astype(float), shared.value[0], radius)[1].any(0)
            out.append({"no": (cell << 48) + (part << 24) + k, "cell": cell, "reach": reach.tolist(), "ids": some["id"].to_numpy().astype(np.int64).tobytes(), "x": x})
        return pa.Table.from_pylist(out, pa.schema({"no": pa.int64(), "cell": pa.int32(), "reach": pa.list_(pa.bool_()), "ids": pa.binary(), "x": pa.binary()}))

    placed = whole.mapInArrow(place, "id long, x binary, cell int, parts int").select("id", "x", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    blocks = written(placed.groupBy("cell", "part").applyInArrow(pack, "no long, cell int, reach array<boolean>, ids binary, x binary"), "blocks")
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    meet = (F.col("a_no") <= F.col("b_no")) & F.expr("element_at(a_reach, b_cell + 1) and element_at(b_reach, a_cell + 1)")
    pairs = a.join(b.hint("shuffle_replicate_nl"), meet).select("a_no", "a_cell", "a_ids", "a_x", "b_no", "b_cell", "b_ids", "b_x")

    def within(x: np.ndarray, own: int, other: int) -> np.ndarray:
        """Which rows of a pivot's block may have a partner at another pivot."""
        p, q = shared.value[0][[own, other]]
        return 2 * x @ (p - q) <= 2 * radius * np.linalg.norm(p - q) + SLACK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Joined()
        for batch in batches:
            for r in batch.to_pylist():
                (i, x), (j, y) = ((np.frombuffer(r[f"{s}_ids"], np.int64), np.frombuffer(r[f"{s}_x"], np.float32).reshape(-1, width)) for s in "ab")
                if r["a_cell"] != r["b_cell"]:
                    near = within(x, r["a_cell"], r["b_cell"]), within(y, r["b_cell"], r["a_cell"])
                    i, x, j, y = i[near[0]], x[near[0]], j[near[1]], y[near[1]]
                for begin in range(0, len(x), 256):
                    first = begin if r["a_no"] == r["b_no"] else 0  # of a block with itself, one half
                    c = (x[begin : begin + 256] @ y[first:].T).ravel()
                    at = np.flatnonzero(c >= least - slack)
                    if len(at):
                        u, v = np.divmod(at, len(y) - first)
                        found.add(i[begin + u], j[first + v], c[at] >= sure - slack)
        yield found.batch()

    return _few_a_batch(spark, pairs.mapInArrow(compare, "a long, b long, sure boolean"), "links")
