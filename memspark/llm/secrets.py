"""Secret scans: candidates by pattern, and their corpus-wide ownership.

A candidate's value is hashed and counted by distinct owners and repositories; a repository is a text, so that exact copies are one. A value
that many owners or many repositories hold is a copied example; one that stays with few of both looks live. Patterns with clear markers (assignments,
access keys, hex strings) are reported either way; unmarked strings of letters and digits only where they look live.
All of it is DataFrame work; after the scan only candidates are shuffled, values as hashes.

Defined cases: a null text is scanned as empty. A null owner counts as one owner of its own. Repeated rows (equal id
and text) are scanned once and each gets the spans. Very long texts are scanned whole; the spans
of one text are bounded by its length. A hot value is counted over (value, owner) and (value, repository) first.
Ties: spans that begin at one place stand in the order of the kinds. An empty table gives an empty one. Only the columns that are named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from memspark.llm._shared import durable, row_key

# The kinds in the order they are listed, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BLOB = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "blob")
#: Pattern, group of the value, and the fewest characters of that group.
PATTERNS = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16), "blob": (BLOB, 0, 20)}


def _labelled(cut: Column, kind: str) -> Column:
    return F.transform(cut, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), x["gap"].alias("gap"), x["all"].alias("all"), x["value"].alias("value")))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row for each match: _rk, _repo, _owner, kind, start, end (code points, end exclusive), value hash.

    The text between matches and the matches themselves alternate, so starts are running sums of their lengths.
    """
    keyed = row_key(docs.select(id_col, text_col, F.col(owner_col).alias("_o")), id_col, text_col).withColumn("_repo", F.xxhash64(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = []
    for kind, (pattern, group, _) in PATTERNS.items():
        cut = F.when(text.rlike(pattern), F.arrays_zip(
            F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")))
        found.append(_labelled(cut, kind))
    none = F.array().cast("array<struct<kind:string,k:int,gap:int,all:string,value:string>>")
    rows = keyed.select("_rk", "_repo", F.coalesce("_o", F.lit("")).alias("_owner"), F.explode(F.concat(*[F.coalesce(x, none) for x in found])).alias("m"))
    rows = rows.select("_rk", "_repo", "_owner", "m.kind", "m.k", "m.gap", F.length("m.all").alias("n"), F.length("m.value").alias("nv"), F.xxhash64("m.value").alias("value"))
    rows = rows.where("n is not null").dropDuplicates(["_rk", "kind", "k"])
    before = W.Window.partitionBy("_rk", "kind").orderBy("k").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    rows = rows.select("_rk", "_repo", "_owner", "kind", (end - F.col("n")).alias("start"), end.alias("end"), "nv", "value")
    enough = F.lit(False)
    for kind, (_, _, least) in PATTERNS.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("nv") >= least))
    return rows.where(enough).drop("nv")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repos: how widely each value is held."""
    return found.groupBy("value").agg(F.count_distinct("_owner").alias("n_owners"), F.count_distinct("_repo").alias("n_repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = 3, salts: int = 16, example_repos: int = 10) -> DataFrame:
    """Each document with its spans: n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    A value with ``example_owners`` owners or more, or in ``example_repos`` different texts or more, is a copied example. Unmarked strings (kind ``blob``) are
    added where they are not examples and overlap no marked span.
    """
    found = durable(matches(docs, id_col, text_col, owner_col))
    held = ownership(found).select("value", ((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)).alias("_example"))
    salted = held.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spans = found.withColumn("_s", F.pmod(F.xxhash64("_rk"), F.lit(salts)).cast("int")).join(salted, ["value", "_s"])
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    each = spans.groupBy("_rk").agg(F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("o"), "end", "kind", "_example"))).alias("all"))
    each = each.withColumns({"base": F.expr("filter(all, s -> s.kind != 'blob')")})
    each = each.withColumn("added", F.expr("filter(all, s -> s.kind = 'blob' and not s._example and not exists(base, b -> b.start < s.end and s.start < b.end))"))
    say = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    each = each.select("_rk", F.expr(say.format("base")).alias("base_spans"), F.expr(say.format("sort_array(concat(base, added))")).alias("spans"),
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]],
        F.expr("cast(size(filter(concat(base, added), s -> not s._example)) as bigint)").alias("n_live"), F.expr("cast(size(filter(base, s -> s._example)) as bigint)").alias("n_example"))
    rows = row_key(docs.select(id_col, text_col), id_col, text_col).drop(text_col).join(each, "_rk", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_example")]
    return rows.select(id_col, *counts[:3], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *counts[3:])
