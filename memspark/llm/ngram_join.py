"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, and their components.

1. Sets. Each document's distinct shingle hashes; documents of equal sets (by two 64-bit hashes) are one class, and links are between classes. Ids are joined at the end,
   so an id that stands at several texts links none of them.
2. Blocking without loss. Two linked sets differ in at most D = (1-t)/(1+t) * (|A|+|B|) shingles. For the sizes at hand the hash range is cut into
   groups, so many that one of them at least holds k = DIFFER differences or fewer, and each group into more than k cells, so a linked pair agrees on the
   whole content of a cell of that group. Each document emits a hash of each non-empty cell with a parity bitmap of the
   cell's group (bit i: whether an odd number of its shingles falls there), which k differences change in k bits at most. Documents
   that share a cell and whose bitmaps differ in k bits or fewer are joined, within each task and then across tasks. (Where a group has k
   non-empty cells or fewer, agreement may be on empty ones: it also emits its k + 1 smallest hashes, of which such groups share one if they have more than
   k shingles. A document with a group of 2 k shingles or fewer also emits a prefix of all its sorted hashes, which linked sets must share.)
   The components of these edges hold every link, and unlike sets that share a popular passage are not drawn in.
3. Signature trees. Within a component, representatives are ordered by their smallest hashes and put under a tree whose nodes hold an
   OR-combined bitmap of tokens, a range of sizes and the greatest excess of size over bits. The tree is traversed against itself;
   a pair of nodes goes when the sizes exclude each other, when the common bits and the excess cannot give the needed
   overlap, or when both sides are in one component already. What remains is verified on the sets themselves.
   A large component is cut into blocks, each pair of which is a task of its own.
4. The verified links' components.

No pairs are emitted, only edges to a root. Hashes have 64 bits.

Defined cases: null or wordless texts have an empty set, are linked with nothing and are their own component. Rows of
a null id are judged but have a null component. Rows of equal id and different texts are judged each by its text: its component is the smallest id of the
texts that this text is linked with. Texts are taken whole, whatever their length; an empty table gives an empty one; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import _words
from memspark.llm._shared import dealt, durable, small_arrow_batches, written
from memspark.llm.graph import components

_SALT1, _SALT2, _SALT3 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)
#: Sizes are taken in families, each this many times the one before.
_RATIO = 1.2
#: Differences that the best group of a linked pair may hold, and cells beyond the needed ones, as a share, for those that are empty.
DIFFER, SPARE = 16, 0.2
#: Cells kept in a task before they are sent on.
_HELD = 1_000_000
#: Documents of one cell whose bitmaps differ are compared with each other up to this many bitmaps; beyond, all are joined (which loses nothing).
COMPARED = 65_536
#: A component of more shingles than this is cut into blocks.
BLOCK_SHINGLES = 2_000_000
#: At most so many representatives (a long each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _words.sets(*_words.shingle_hashes(*_words.word_hashes(texts), n))


def set_hash(hashes: np.ndarray, at: np.ndarray, salt: np.uint64) -> np.ndarray:
    return _words.range_sums(_words.mix(hashes ^ salt), at).view(np.int64)


def set_sizes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """_id, _row (of its id and text), n_shingles, h1, h2 of each row: equal sets have equal h1 and h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                hashes, at = shingle_sets(batch.column("text"), n)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), pa.array(np.diff(at)), *[pa.array(set_hash(hashes, at, salt)) for salt in (_SALT1, _SALT2)]], ["_id", "_row", "n_shingles", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col, id_col).alias("_row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "_id long, _row long, n_shingles long, h1 long, h2 long")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of ``keys`` begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its count."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)


def cell_signatures(hashes: np.ndarray, at: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the parity bitmap that goes with each, and the index of the document of each. Linked sets share a signature at least whose bitmaps differ in DIFFER bits or fewer."""
    sizes = np.diff(at)
    alpha = (1 - t) / (1 + t)
    own = np.floor(np.log(np.maximum(sizes, 1)) / math.log(_RATIO) + 1e-9).astype(np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(2 + int(math.log(1 / t) / math.log(_RATIO))):
        family = own + step
        member = (sizes > 0) & ((step == 0) | (sizes >= np.floor(t * _RATIO**family)))
        most = np.floor(alpha * 2 * (np.ceil(_RATIO ** (family + 1)) - 1) + 1e-9).astype(np.int64)
        groups = -(-(most + 1) // (DIFFER + 1))
        differ = most // groups
        cells = differ + 1 + np.ceil(SPARE * (differ + 1)).astype(np.int64)
        rows = np.flatnonzero(np.repeat(member, sizes))
        if not len(rows):
            continue
        doc = np.repeat(np.arange(len(sizes)), sizes)[rows]
        h = hashes[rows]
        cell = (((h >> np.uint64(32)) * (groups * cells)[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        group = cell // cells[doc]
        label = family.astype(np.uint64)
        # Groups: their bitmap, shingles and non-empty cells. Cells: their content, with the group's bitmap.
        first, head = _starts(doc, cell), _starts(doc, group)
        bitmap = np.bitwise_xor.reduceat(np.uint64(1) << (_words.mix(h) & np.uint64(63)), head)
        many = np.diff(np.append(head, len(h)))
        inside = np.searchsorted(head, first, "right") - 1
        full = np.bincount(inside, minlength=len(head))
        total = _words.range_sums(_words.mix(h ^ _SALT1), np.append(first, len(h)))
        of = doc[first]
        out.append((_words.mix(total + _words.mix(cell[first].astype(np.uint64) * np.uint64(256) + label[of])), bitmap[inside], of))
        few = np.flatnonzero(full <= differ[doc[head]])
        spot = _spread(head[few], np.minimum(many[few], differ[doc[head[few]]] + 1))
        of = doc[spot]
        out.append((_words.mix((h[spot] ^ _SALT2) + _words.mix(group[spot].astype(np.uint64) * np.uint64(256) + label[of])), bitmap[np.searchsorted(head, spot, "right") - 1], of))
        seen = np.bincount(doc[head], minlength=len(sizes))
        thin = np.bincount(doc[head], many <= 2 * differ[doc[head]], len(sizes))
        rest = np.flatnonzero(member & ((thin > 0) | (seen < groups)))
        spot = _spread(at[rest], sizes[rest] - np.ceil(t * sizes[rest] - 1e-9).astype(np.int64) + 1)
        of = np.searchsorted(at, spot, "right") - 1
        out.append((_words.mix((hashes[spot] ^ _SALT3) + label[of]), np.zeros(len(spot), np.uint64), of))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``up`` (each place's parent, the smaller one) along the edges (a, b); a root is the smallest place of its tree."""

    def root(x: np.ndarray) -> np.ndarray:
        x = up[x]
        while (up[x] != x).any():
            x = up[x]
        return x

    x, y = root(a), root(b)
    while (x != y).any():  # of each pair of roots the larger goes under the smaller, as far as others of it have not gone lower
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        x, y = root(x), root(y)
    up[a], up[b] = x, y


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its tree) that join what the edges (a, b) join: one an id at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))
    _joined(up, at[: len(a)], at[len(a) :])
    while (up[up] != up).any():
        up = up[up]
    rest = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[rest], nodes[up[rest]]


def _stars(sigs: np.ndarray, maps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct signatures and bitmaps with the smallest id of each, and edges (id, smallest) of the others."""
    order = np.lexsort((ids, maps, sigs))
    sigs, maps, ids = sigs[order], maps[order], ids[order]
    new = _starts(sigs, maps)
    root = np.repeat(ids[new], np.diff(np.append(new, len(ids))))
    rest = root != ids
    return sigs[new], maps[new], ids[new], ids[rest], root[rest]


def _close(sigs: np.ndarray, maps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, among the rows of each signature (in order), those whose bitmaps differ in DIFFER bits or fewer: one a row at most."""
    up = np.arange(len(sigs))
    begin = _starts(sigs)
    size = np.diff(np.append(begin, len(sigs)))
    for a, n in zip(begin[size > COMPARED].tolist(), size[size > COMPARED].tolist(), strict=True):
        up[a : a + n] = a
    live = np.flatnonzero(np.repeat((size > 1) & (size <= COMPARED), size))
    apart = 0
    while len(live):
        apart += 1
        live = live[live + apart < len(sigs)]
        live = live[sigs[live] == sigs[live + apart]]
        near = live[np.bitwise_count(maps[live] ^ maps[live + apart]) <= DIFFER]
        _joined(up, near, near + apart)
    while (up[up] != up).any():
        up = up[up]
    rest = np.flatnonzero(ids != ids[up]) if len(ids) else np.zeros(0, np.int64)
    return ids[rest], ids[up[rest]]


def candidate_edges(docs: DataFrame, id_col: str, text_col: str, n: int, t: float) -> DataFrame:
    """Edges (a, b) between the first hashes of sets, whose components hold every linked pair. Signatures travel as packed arrays by range of the hash.

    Two sets that share the first hash by chance share a component, which is only somewhat larger for it.
    """
    spark = docs.sparkSession
    # An edge is sent by each bucket that finds it, so there are no more buckets than a task's memory asks for.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, 8)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    low = np.uint64((1 << 48) - 1)
    parts = ("high", "low", "maps", "docs", "at", "a", "b")

    def pack(sigs, maps, ids):
        # A signature keeps 48 bits beside its bucket; ids are places in the row's own list of documents. What the pack itself joins is dealt evenly.
        sigs, maps, ids, a, b = _stars(sigs, maps, ids)
        a, b = _forest(a, b)
        cuts = np.searchsorted(((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
        share = np.linspace(0, len(a), buckets + 1).astype(int)
        rows = []
        for k in range(buckets):
            own, m, (docs, at) = sigs[cuts[k] : cuts[k + 1]] & low, maps[cuts[k] : cuts[k + 1]], np.unique(ids[cuts[k] : cuts[k + 1]], return_inverse=True)
            edges = [x[share[k] : share[k + 1]] for x in (a, b)]
            rows.append((k, *[x.tobytes() for x in ((own >> np.uint64(16)).astype(np.uint32), (own & np.uint64(0xFFFF)).astype(np.uint16), m, docs, at.astype(np.uint16 if len(docs) <= 65536 else np.uint32), *edges)]))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), *[pa.binary()] * len(parts)))], ["bucket", *parts])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for whole in batches:
            for batch in _words.pieces(whole, "text"):
                hashes, at = shingle_sets(batch.column("text"), n)
                s, m, d = cell_signatures(hashes, at, t)
                kept.append((s, m, set_hash(hashes, at, _SALT1)[d]))
                held += len(s)
                if held >= _HELD:
                    yield pack(*map(np.concatenate, zip(*kept, strict=True)))
                    kept, held = [], 0
        if held:
            yield pack(*map(np.concatenate, zip(*kept, strict=True)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        pairs = []
        for batch in batches:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["docs"], np.int64)
                at = np.frombuffer(row["at"], np.uint16 if len(docs) <= 65536 else np.uint32)
                sigs = (np.frombuffer(row["high"], np.uint32).astype(np.uint64) << np.uint64(16)) | np.frombuffer(row["low"], np.uint16)
                got.setdefault(row["bucket"], []).append((sigs, np.frombuffer(row["maps"], np.uint64), docs[at]))
                pairs.append((np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)))
        for bucket in list(got):
            sigs, maps, ids, a, b = _stars(*map(np.concatenate, zip(*got.pop(bucket), strict=True)))
            pairs += [(a, b), _close(sigs, maps, ids)]
        if pairs:
            a, b = _forest(*[np.concatenate(x) for x in zip(*pairs, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    packed = rows.mapInArrow(emit, "bucket int, high binary, low binary, maps binary, docs binary, at binary, a binary, b binary")
    return dealt(packed, buckets, "bucket").mapInArrow(gather, "a long, b long")


class SignatureTree:
    """Sets under a tree of OR-combined bitmaps, joined with itself; ``root`` has the smallest member of each set's component."""

    LEAF, FANOUT = 32, 8

    def __init__(self, sets: list[np.ndarray], t: float):
        self.sets, self.t = sets, t
        self.sizes = np.array([len(x) for x in sets])
        self.root = np.arange(len(sets))
        bits = 1 << max(8, min(13, int(4 * self.sizes.mean()).bit_length()))
        self.bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, x in enumerate(sets):
            spot = (_words.mix(x) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(self.bitmaps[i], spot >> 6, np.uint64(1) << (spot & 63).astype(np.uint64))
        self.excess = self.sizes - np.bitwise_count(self.bitmaps).sum(1)
        order = np.lexsort(np.array([[int(x[min(k, len(x) - 1)]) for x in sets] for k in (1, 0)], np.uint64))
        #: Levels from the leaves up: members (ranges of the level below), bitmap, smallest and largest size, excess.
        self.levels = []
        groups = [order[i : i + self.LEAF] for i in range(0, len(order), self.LEAF)]
        self.leaves = groups
        level = [np.array([np.bitwise_or.reduce(self.bitmaps[g]) for g in groups]), *[np.array([f(x[g]) for g in groups]) for f, x in ((np.min, self.sizes), (np.max, self.sizes), (np.max, self.excess))]]
        self.levels.append(level)
        while len(level[1]) > 1:
            spans = [slice(i, i + self.FANOUT) for i in range(0, len(level[1]), self.FANOUT)]
            level = [np.array([np.bitwise_or.reduce(level[0][s]) for s in spans]), *[np.array([f(level[k][s]) for s in spans]) for k, f in ((1, np.min), (2, np.max), (3, np.max))]]
            self.levels.append(level)

    def may_link(self, level: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bitmap, low, high, excess = level
        common = np.bitwise_count(bitmap[a] & bitmap[b]).sum(1)
        need = np.ceil(self.t / (1 + self.t) * (low[a] + low[b]) - 1e-9)
        return (high[a] >= np.floor(self.t * low[b])) & (high[b] >= np.floor(self.t * low[a])) & (common + np.minimum(excess[a], excess[b]) >= need)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(b, a)
        common = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
        return 1_000_000 * common >= round(self.t * 1_000_000) * (len(a) + len(b) - common)

    def join_leaves(self, x: int, y: int) -> None:
        a, b = self.leaves[x], self.leaves[y]
        ra, rb = np.array([self.find(k) for k in a]), np.array([self.find(k) for k in b])
        keep = ra[:, None] != rb[None, :]
        p, q = np.nonzero(np.triu(keep, 1) if x == y else keep)
        i, j = a[p], b[q]
        if not len(i):
            return
        fits = self.may_link([self.bitmaps, self.sizes, self.sizes, self.excess], i, j)
        for p, q in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
            rp, rq = self.find(p), self.find(q)
            if rp != rq and self.linked(p, q):
                self.root[max(rp, rq)] = min(rp, rq)

    def join(self) -> np.ndarray:
        top = len(self.levels) - 1
        for x in range(len(self.leaves)):
            self.join_leaves(x, x)
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            k, a, b = stack.pop()
            if len(a) > 20_000:
                stack += [(k, a[:20_000], b[:20_000]), (k, a[20_000:], b[20_000:])]
                continue
            keep = self.may_link(self.levels[k], a, b)
            a, b = a[keep], b[keep]
            if k == 0:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if x != y:
                        self.join_leaves(x, y)
            elif len(a):
                n = len(self.levels[k - 1][1])
                i, j = (v.ravel() for v in np.meshgrid(np.arange(self.FANOUT), np.arange(self.FANOUT), indexing="ij"))
                ca, cb = (a[:, None] * self.FANOUT + i).ravel(), (b[:, None] * self.FANOUT + j).ravel()
                ok = (ca < n) & (cb < n) & (ca <= cb)
                stack.append((k - 1, ca[ok], cb[ok]))
        return np.array([self.find(k) for k in range(len(self.sets))])


def true_edges(members: DataFrame, n: int, t: float) -> DataFrame:
    """Edges (a, b) that span the linked classes of each group of ``members`` (class, h1, h2, text, comp, i, j). Of a class whose id stands at several texts only its own text counts."""

    def run(table: pa.Table) -> pa.Table:
        sets, own, begin = [], [], 0
        for whole in table.select(["text"]).to_batches():
            for batch in _words.pieces(whole, "text"):  # only the sets of a piece stay, not what hashing takes
                hashes, at = shingle_sets(batch.column("text"), n)
                mine = table.slice(begin, batch.num_rows)
                begin += batch.num_rows
                same = np.logical_and(*[set_hash(hashes, at, salt) == mine[h].to_numpy() for h, salt in (("h1", _SALT1), ("h2", _SALT2))])
                own.append(same)
                sets += [hashes[a:b].copy() for a, b, ok in zip(at[:-1], at[1:], same, strict=True) if ok]
        ids = table.column("class").to_numpy()[np.concatenate(own)]
        ids, first = np.unique(ids, return_index=True)  # repeated rows once
        root = SignatureTree([sets[k] for k in first], t).join()
        rest = root != np.arange(len(root))
        return pa.table({"a": pa.array(ids[rest], pa.int64()), "b": pa.array(ids[root[rest]], pa.int64())})

    return members.groupBy("comp", "i", "j").applyInArrow(run, "a long, b long")


def judged(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, salts: int = 8) -> DataFrame:
    """_id, _row, n_shingles, component_id of each row; see ``near_duplicates``."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sizes = written(set_sizes(docs, id_col, text_col, n), "shingle-sets")
    classes = sizes.where("n_shingles > 0 and _id is not null").groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "shingle-classes")  # numbered once, as written
    groups = components(candidate_edges(docs, id_col, text_col, n, threshold))
    found = durable(groups.join(classes.withColumnRenamed("h1", "node"), "node").select("class", F.col("node").alias("h1"), "h2", "rep", F.col("label").alias("comp"), "n"))
    totals = found.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where("members > 1")
    found = durable(found.join(totals, "comp").select("class", "h1", "h2", F.col("rep").alias("_id"), "comp", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    if found.isEmpty():
        labels = found.select(F.col("class").alias("node"), F.col("comp").alias("label"))
    else:
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(found, "_id")
        mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
        texts = texts.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        texts = texts.select("class", "h1", "h2", "text", "comp", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))
        labels = components(true_edges(texts, n, threshold))
    named = classes.join(labels.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    # A class of one row and no links says nothing that the row does not.
    named = named.join(least, "label").where("copies > 1 or component != rep").select("h1", "h2", "component").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = sizes.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")).join(named, ["h1", "h2", "_s"], "left")
    return rows.select("_id", "_row", "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """id_col, n_shingles, component_id of each row: the smallest id that its text is linked to, over any chain of links.

    Words are runs of characters other than space, \\t, \\n, \\v, \\f and \\r, A-Z as a-z; a text of fewer than
    ``n`` words has its whole sequence as one shingle. Linked: |A & B| >= threshold * |A | B|.
    """
    return judged(docs, id_col, text_col, n, threshold).select(F.col("_id").alias(id_col), "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text is nobody's copy, or belongs to the smallest id of its group. Repeated rows stay or go alike."""
    gone = judged(docs, id_col, text_col, n, threshold).where("component_id != _id").select(F.col("_id").alias("_gone"), "_row").distinct()
    key = F.xxhash64(text_col, id_col)
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone"]) & (key == gone["_row"]), "left_anti")
