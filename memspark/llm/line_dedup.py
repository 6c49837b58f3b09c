"""Line dedup by a tree of log templates of fixed depth.

A line's path in the tree is its number of tokens, then its leading tokens; tokens that hold a digit, an address or
a link are variable from the start. At the leaf the rest of the line is four fields, and the line supports five
templates: the one that fixes all four, and the four that leave one of them variable. A template that recurs in
``min_docs`` documents or more is boilerplate: its lines are dropped, but (with ``keep_first``, the default) in the document of smallest id, so that
a text of which copies exist is not lost altogether. A line of more than ``long_tokens`` tokens that stands in two documents as it is, is
dropped likewise.

All of it is DataFrame work. Templates are 64-bit hashes; texts are moved once, to put the kept lines together.

Defined cases: a null text stays null, with no lines. Lines of fewer than ``min_tokens`` tokens support no template
and stay. Repeated rows count as documents of their own and are treated alike, both being first where one is; so are documents of equal id. Rows of a null
id are never first. A document all of whose lines go has an empty text and ``n_dropped`` = ``n_lines``. Very long texts are taken whole. An empty table gives an
empty one. Input columns ``n_lines`` and ``n_dropped`` are replaced in their place; all others are carried. A hot template is counted before the shuffle and
salted in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm._shared import carried, held, restored, row_key

DEPTH, FIELDS = 3, 4
#: Lines with fewer tokens behind the leading ones support only the template that fixes all of them.
LEAST_REST = 8


def _with_keys(docs: DataFrame, id_col: str, text_col: str, min_tokens: int, long_tokens: int) -> DataFrame:
    """_rk and _keys: (template, line number) of every template that each line supports, sorted. Templates are even; odd ones are long lines as they are."""
    out = row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    out = out.withColumn("_tok", F.expr(rf"transform(split(_text, '\n'), l -> struct(xxhash64(l) | 1L as h, filter(split(if(l rlike '[0-9@]|://', regexp_replace(l, '[^ ]*([0-9@]|://)[^ ]*', '<*>'), l), '[\\x20\\x09-\\x0D]+'), w -> w != '') as w))"))
    rest, step = f"(size(t.w) - {DEPTH})", f"cast(ceil((size(t.w) - {DEPTH}) / {FIELDS}) as int)"
    fields = ", ".join(f"if({rest} >= {LEAST_REST}, xxhash64(slice(t.w, {DEPTH + 1} + {i} * {step}, {step})), {'xxhash64(t.w)' if i == 0 else '0L'}) as f{i}" for i in range(FIELDS))
    out = out.withColumn("_seg", F.expr(f"transform(_tok, t -> struct(if(size(t.w) > {long_tokens}, t.h, null) as line, size(t.w) as n, xxhash64(size(t.w), slice(t.w, 1, {DEPTH})) as leaf, {fields}))"))
    templates = ["struct(xxhash64(s.leaf, s.f0, s.f1, s.f2, s.f3) & -2L as t, i as p)"]
    templates += [f"struct(xxhash64({g}, s.leaf, {', '.join(f's.f{j}' for j in range(FIELDS) if j != g)}) & -2L as t, i as p)" for g in range(FIELDS)]
    keys = f"if(s.n < {min_tokens}, array(), if(s.n - {DEPTH} < {LEAST_REST}, array({templates[0]}), array({', '.join(templates)})))"
    keys = keys.replace("array(),", "cast(array() as array<struct<t:bigint,p:int>>),")
    keys = f"concat({keys}, if(s.line is null, cast(array() as array<struct<t:bigint,p:int>>), array(struct(s.line as t, i as p))))"
    return out.select("_rk", F.expr(f"sort_array(flatten(transform(_seg, (s, i) -> {keys})))").alias("_keys"))


def recurring(keyed: DataFrame, min_docs: int) -> DataFrame:
    """t, first: the templates found in ``min_docs`` documents or more (long lines as they are: in two), and the smallest id that each is found in."""
    once = keyed.select(F.col("_rk.i").alias("_id"), F.explode_outer(F.expr("filter(_keys, (x, k) -> k = 0 or _keys[k - 1].t != x.t)")).alias("k")).where("k is not null")
    counted = once.groupBy(F.col("k.t").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    return counted.where(F.col("n") >= F.when(F.col("t") % 2 != 0, 2).otherwise(min_docs)).drop("n")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_tokens: int = 3, salts: int = 8, long_tokens: int = 50, keep_first: bool = True) -> DataFrame:
    """``docs`` with its recurring lines dropped from ``text_col``, and n_lines and n_dropped added."""
    keyed = _with_keys(docs, id_col, text_col, min_tokens, long_tokens)
    again = recurring(keyed, min_docs).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lines = keyed.select("_rk", F.explode_outer("_keys").alias("k")).where("k is not null").select("_rk", "k.t", "k.p", F.pmod(F.xxhash64("_rk"), F.lit(salts)).cast("int").alias("_s"))
    hit = lines.join(again, ["t", "_s"])
    hit = hit.where(~F.col("first").eqNullSafe(F.col("_rk.i"))) if keep_first else hit
    gone = hit.groupBy("_rk").agg(F.collect_set("p").alias("_gone"))
    out = row_key(carried(docs), f"_row.`{id_col}`", f"_row.`{text_col}`").join(gone, "_rk", "left").withColumn("_text", F.col("_row").getField(text_col))
    out = out.withColumns({"_l": F.split("_text", "\n"), "_g": F.coalesce("_gone", F.array().cast("array<int>"))})
    return restored(out, docs.columns, **{
        text_col: F.when(F.size("_g") == 0, F.col("_text")).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(_l) - 1), _g), i -> _l[i]), '\n')")),
        "n_lines": F.coalesce(F.size("_l"), F.lit(0)).cast("bigint"),
        "n_dropped": held(F.size("_g").cast("bigint")),
    })
