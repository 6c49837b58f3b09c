"""Near copies among embeddings: an inverted index of coarse lists with product-quantised residuals, and exact cosines of what it lets through.

1. Equal vectors of a label are one class; what follows works on classes, each with its number of rows.
2. Coarse centroids and the codebooks of the residual's subspaces are fitted on at most ``sample_rows`` classes (those of smallest hash). The number of lists is the
   one of least expected work there: unstructured vectors get few lists, clustered ones many.
3. Every class goes to its nearest list as a member, with its residual's code and the length of its quantisation error, and visits every later list beyond whose bisecting
   plane it reaches by less than the radius: a partner in another list lies behind that plane, so these probes are sufficient.
4. In bounded blocks of a list, table lookups give the distance of a query to each decoded member. A partner within the radius is at most its own quantisation error
   further away, so what is further is left out without loss, and the rest is decided by the exact cosine in double precision.

Blocks send each class's number of links and a spanning forest, not pairs. The index is exact by these two bounds: it was fitted on a sample, but recall is 1.

Defined cases: a null id or label, a null or empty vector, one with a null, NaN or infinite component and the zero vector link with nothing; their component is their own id, and they are kept. Vectors
of different length do not link. Repeated rows and equal ids are vectors of their own, judged by their components. An empty table gives an empty one. Only the three named
columns are read, so other columns' names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm._blocks import linked, paired_blocks
from memspark.llm._shared import small_arrow_batches, written
from memspark.llm.graph import components

#: Room for single precision in the two bounds; exact cosines decide what it lets through.
SLACK = 1e-3
#: What a visiting row costs (copying, shuffling), in table lookups.
ROW_COST = 20_000
#: Rows whose distances to a block are held at once.
QUERIES = 256


class Index(NamedTuple):
    lists: np.ndarray  # lists x dimension
    books: np.ndarray  # subspaces x codes x their dimension
    radius: float

    @property
    def dimension(self) -> int:
        return self.lists.shape[1]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the coarse centroids."""
        return np.maximum((x**2).sum(1)[:, None] + (self.lists**2).sum(1)[None] - 2 * x @ self.lists.T, 0)

    def visits(self, x: np.ndarray, own: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Whether a partner of each row may be in each list: the row is within the radius of the plane between that list's centroid and its own's."""
        apart = np.sqrt(np.maximum((self.lists**2).sum(1)[None] + (self.lists**2).sum(1)[:, None] - 2 * self.lists @ self.lists.T, 0))
        return d2 - d2[np.arange(len(x)), own][:, None] <= 2 * (self.radius + SLACK) * apart[own] + SLACK

    def subspaces(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.books.shape[0], -1)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each residual and the length of what the code leaves out."""
        parts = self.subspaces(residuals)
        codes = np.stack([_nearest(parts[:, m], self.books[m]) for m in range(len(self.books))], 1).astype(np.uint8)
        decoded = np.stack([self.books[m][codes[:, m]] for m in range(len(self.books))], 1)
        return codes, np.sqrt(((parts - decoded) ** 2).sum((1, 2)))

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of each residual's parts to all codes of their subspaces."""
        parts = self.subspaces(residuals)
        return np.maximum((parts**2).sum(2)[:, :, None] + (self.books**2).sum(2)[None] - 2 * np.einsum("qmd,mkd->qmk", parts, self.books, optimize=True), 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(half - x[at : at + 4096] @ centroids.T, 1)
    return out


def _k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(17)
    out = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, out)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out.astype(np.float32)


def unit_vectors(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of length one in double precision, with zeros behind the end of shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
    out = np.zeros((len(column), dimension))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[rows, :n] = flat[ends[rows][:, None] + np.arange(n)]
    out /= np.abs(out).max(1, keepdims=True, initial=1e-320)
    return out / np.sqrt((out**2).sum(1, keepdims=True))


def fit(sample: np.ndarray, rows_per_label: float, threshold: float, subspaces: int = 8) -> Index:
    """An index of the lists of least expected work for labels of so many classes; ``sample`` has rows of length one."""
    x = sample.astype(np.float32)
    radius = float(np.sqrt(2 - 2 * threshold))
    width = max(1, -(-x.shape[1] // subspaces))
    x = np.pad(x, ((0, 0), (0, width * subspaces - x.shape[1])))
    if not len(x):
        return Index(np.zeros((1, x.shape[1]), np.float32), np.zeros((subspaces, 1, width), np.float32), radius)
    best = None
    k = 1
    while k == 1 or k <= len(x) // 16:
        index = Index(_k_means(x, k), np.zeros((subspaces, 1, width), np.float32), radius)
        some = x[:2000]
        d2 = index.distances(some)
        visits = index.visits(some, d2.argmin(1), d2).sum(1).mean() / 2
        cost = visits * (ROW_COST + rows_per_label / k * subspaces) + k  # k: each row is held against every centroid
        if best is None or cost < best[0]:
            best = (cost, index.lists)
        elif cost > 2 * best[0]:
            break
        k *= 4
    lists = best[1]
    parts = (x - lists[_nearest(x, lists)]).reshape(len(x), subspaces, width)
    codes = min(256, len(x))
    return Index(lists, np.stack([_k_means(np.ascontiguousarray(parts[:, m]), codes) for m in range(subspaces)]), radius)


def _placed(classes: DataFrame, index: Index) -> DataFrame:
    """Each class as a member of its list, and as a visitor of the later lists that may hold a partner."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_vectors(batch.column("vec"), ix.dimension).astype(np.float32)
            d2 = ix.distances(x)
            own = d2.argmin(1)
            codes, left = ix.encode(x - ix.lists[own])
            reach = ix.visits(x, own, d2) & (np.arange(len(ix.lists))[None] > own[:, None])
            rows, to = np.nonzero(reach)
            at = np.concatenate([np.arange(len(x)), rows])
            member = np.arange(len(at)) < len(x)
            base = batch.select(["label", "cid", "n", "vec"]).take(pa.array(at))
            code = pa.array([codes[k].tobytes() if m else None for k, m in zip(at.tolist(), member.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(np.concatenate([own, to]), pa.int32()), pa.array(member), code, pa.array(left[at], pa.float32())], ["label", "cid", "n", "vec", "list", "member", "code", "left"])

    kinds = dict(classes.dtypes)
    return classes.mapInArrow(place, f"label {kinds['label']}, cid long, n long, vec {kinds['vec']}, list int, member boolean, code binary, left float")


def _links(placed: DataFrame, index: Index, threshold: float, block: int) -> DataFrame:
    """cid, links, parent: what each block found of each class in it, if anything: rows linked with it, and a node of its group in the block."""
    shared = placed.sparkSession.sparkContext.broadcast(index)

    def compare(table: pa.Table) -> pa.Table:
        ix, e, q = shared.value, table.filter(table["_e"]), table.filter(table["_q"])
        ids = [t["cid"].to_numpy() for t in (e, q)]
        nodes, at = np.unique(np.concatenate(ids), return_inverse=True)
        at_e, at_q = at[: len(ids[0])], at[len(ids[0]) :]
        n_e, n_q = e["n"].to_numpy(), q["n"].to_numpy()
        links, root = np.zeros(len(nodes)), np.arange(len(nodes))
        if len(e) and len(q):
            exact = unit_vectors(e["vec"], ix.dimension)
            codes = np.frombuffer(b"".join(e["code"].to_pylist()), np.uint8).reshape(len(e), -1)
            reach = (e["left"].to_numpy() + ix.radius + SLACK) ** 2
            size_e = e["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            centre = ix.lists[e["list"][0].as_py()]
            for begin in range(0, len(q), QUERIES):
                part = q.slice(begin, QUERIES)
                x = unit_vectors(part["vec"], ix.dimension)
                tables = ix.tables((x - centre).astype(np.float32))
                far = np.zeros((len(part), len(e)), np.float32)
                for m in range(codes.shape[1]):
                    far += tables[:, m][:, codes[:, m]]
                near = far <= reach[None]
                # Of two members, one is the other's query.
                near &= ~part["member"].to_numpy(zero_copy_only=False)[:, None] | (ids[1][begin : begin + QUERIES, None] < ids[0][None])
                near &= part["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)[:, None] == size_e[None]
                a, b = np.nonzero(near)
                if len(a) * 16 > near.size:
                    cosine = (x @ exact.T)[a, b]
                else:
                    cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[a[k : k + 65536]], exact[b[k : k + 65536]]) for k in range(0, len(a), 65536))])
                a, b = a[cosine >= threshold], b[cosine >= threshold]
                i, j = at_q[begin + a], at_e[b]
                links += np.bincount(i, n_e[b], len(nodes)) + np.bincount(j, n_q[begin + a], len(nodes))
                root = linked(root, i, j)
        found = np.flatnonzero(links)
        return pa.table([pa.array(nodes[found]), pa.array(links[found].astype(np.int64)), pa.array(nodes[root[found]])], ["cid", "links", "parent"])

    units = paired_blocks(placed, ["label", "list"], "member", "cid", block)
    return units.groupBy("label", "list", "_i", "_j").applyInArrow(compare, "cid long, links long, parent long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, sample_rows: int = 16_384, block: int = 2048) -> DataFrame:
    """id_col, n_links, component_id, kept of every row: how many other rows of its label have a cosine of ``threshold`` or more with it, the smallest id that links lead to, and whether that is its own."""
    spark = df.sparkSession
    small_arrow_batches(spark, 4096)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit_for_use = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~odd & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("ok", fit_for_use)
    classes = rows.where("ok").groupBy("label", "vec").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).first()
    sample = classes.select("vec").orderBy(F.xxhash64("vec")).limit(sample_rows).toArrow()["vec"]
    index = fit(unit_vectors(sample, total["d"]), total["n"] / max(1, total["labels"]), threshold)
    placed = written(_placed(classes.select("label", "cid", "n", "vec"), index), "vector-lists")
    found = written(_links(placed, index, threshold, block), "vector-links")
    groups = components(found.where("cid != parent").select(F.col("cid").alias("a"), F.col("parent").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = classes.join(groups.toDF("cid", "group"), "cid", "left").join(counts, "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    least = joined.groupBy("group").agg(F.min("first_id").alias("component_id"))
    decided = joined.join(least, "group").select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    whole = rows.where("ok").join(decided, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = whole.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
