"""The queries that apply the operators to whole tables with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import bpe, decontam, kn_lm, lang_id, line_dedup, ngram_join, quality, secrets, spelling, token_align, token_count, url_filter, vector_dups

# The host rules, and listed sites and pages.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LISTED = ("spam-farm.example.org/", "m.thther.example.org/", "ththon.example.com/en/671", "ththon.example.com/en/825")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of op1 (there is no table of listed sites): the four fixed keys, the urls of the pages whose id is divisible by 50, and the hosts of those divisible by 250 as whole sites."""
    urls = pages.where("page_id % 50 = 0 and url like '%://_%'")
    host = url_filter.url_parts(F.col("url"))[0]
    sites = urls.where("page_id % 250 = 0").select(F.concat(host, F.lit("/")).alias("key")).where("key != '/'")
    fixed = pages.sparkSession.createDataFrame([(k,) for k in LISTED], "key string")
    return fixed.unionByName(urls.select(F.col("url").alias("key"))).unionByName(sites)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, listed_urls(pages), RULES)


#: The canonical spelling of escapes and of characters beyond ASCII in paths is left out: no url of the tables has any.
OP1_SQL = r"""
with p as (select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) x from pages),
q as (select page_id, url, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, x.p path from p),
r(rule, says) as (values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
f as (select q.page_id, arg_max(rule, length(rule)) rule, arg_max(says, length(rule)) says from q, r
      where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
        and starts_with(path, substr(rule, strpos(rule, '/'))) group by 1),
w(raw) as (values ('spam-farm.example.org/'), ('m.thther.example.org/'), ('ththon.example.com/en/671'), ('ththon.example.com/en/825')),
w2 as (select raw from w union all select url from pages where page_id % 50 = 0 and url like '%://_%' union all select host || '/' from q where page_id % 250 = 0 and url like '%://_%' and host <> ''),
b as (select raw, regexp_extract(regexp_replace(raw, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '(?s)^([^/?#]*)([^?#]*)', ['h', 'p']) x from w2),
c as (select 'l' side, null::bigint page_id, raw, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') h, x.p path from b union all select 'q', page_id, null, host, path from q),
d as (select side, page_id, raw, regexp_replace(regexp_replace(h, '(?s)^.*@', ''), '[.]*(:[0-9]*)?$', '') h, regexp_replace(path, '/+$', '') path from c),
e as (select side, page_id, raw, case when regexp_matches(h, '^www[.][^.]+[.]') then substr(h, 5) else h end h, path from d),
k as (select *, h || case when path = '' then '/' else path end as key, string_split(h, '.') s from e where h <> ''),
l as (select key, min(raw) raw from k where side = 'l' group by 1),
a as (select page_id, key from k where side = 'q' union all select page_id, unnest(list_transform(range(1, greatest(len(s) - 1, 1) + 1), lambda i: array_to_string(s[i:], '.') || '/')) from k where side = 'q'),
m as (select page_id, min(raw) raw from a join l using (key) group by 1)
select q.page_id, host, path, rule, coalesce(says, case when raw is null then 'allow' else 'block' end) verdict,
       case when rule is null then raw end listed_as
from q left join f using (page_id) left join m using (page_id)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_words")


OP2_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () r from documents),
a as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') ws, string_split(t, chr(10)) ls from d),
b as (select *, list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) wl,
  list_filter(ls, lambda l: not regexp_matches(l, '[^\x20\x09-\x0D]') or (
    regexp_matches(l, '[.!?:;…]["''”’»)\]]*[ \t\r]*\z')
    and length(l) - length(translate(l, '#*$%&<>', '')) <= 0.3 * len(string_split_regex(trim(l), ' +'))
    and (length(l) - length(replace(l, '!!', ''))) / 2 <= 0.3 * len(string_split_regex(trim(l), ' +'))
    and (length(l) - length(replace(l, '|', '')) < 3 or length(l) - length(replace(l, '|', '')) < 0.2 * len(string_split_regex(trim(l), ' +')))
    and not (len(string_split_regex(trim(l), ' +')) <= 25 and regexp_matches(lower(l), 'all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie policy|subscribe now|click here|sign up|log in|copyright [(]c[)]|enable javascript|read more')))) kl from a),
w as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select r, ws, unnest(range(1, len(ws) - 1)) i from a)),
g as (select r, i, count(*) over (partition by r, g) n from w),
c as (select r, count(distinct j) n from (select r, unnest([i, i + 1, i + 2]) j from g where n > 1) group by 1),
m as (select doc_id, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(wl) - len(list_distinct(wl)) n_dup_lines,
  coalesce(c.n, 0) n_repeat_words, len(list_filter(string_split_regex(array_to_string(kl, chr(10)), '[\x20\x09-\x0D]+'), lambda w: w <> '')) clean_words
  from b left join c using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * (n_words - clean_words) <= 50 * n_words kept from m
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=4, threshold=0.85)


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = lang_id.fit(docs.where(~lang_id.held_out(F.col("doc_id"))))
    out = lang_id.identify(docs, dictionaries)
    return out.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = kn_lm.train_model(docs.where(~lang_id.held_out(F.col("doc_id"), 10)))
    out = kn_lm.score(docs, model)
    return out.select("doc_id", lang_id.held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), "text")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


#: Classes of equal vectors, all pairs of a label's. Components take the least id reached.
OP11_SQL = """
with recursive e as (select vec_id, label, embedding::double[] v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
c as materialized (select label, v, min(vec_id) cid, count(*) n, sqrt(list_dot_product(v, v)) size from e group by 1, 2),
l as materialized (select a.cid a, b.cid b, b.n n from c a join c b on a.label = b.label and a.cid <> b.cid and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) >= 0.98 * a.size * b.size),
r(a, b) as (select cid, cid from c union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) least from r group by 1), k as (select a, sum(n) n from l group by 1)
select o.vec_id, coalesce(c.n - 1 + coalesce(k.n, 0), 0)::bigint n_links, coalesce(m.least, o.vec_id) component_id, coalesce(o.vec_id = coalesce(m.least, o.vec_id), true) kept
from embeddings o left join e on o.vec_id = e.vec_id and o.label = e.label left join c on c.label = e.label and c.v = e.v left join m on m.a = c.cid left join k on k.a = c.cid
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


#: The checksum is spelled out, a byte at a time; words near each other meet at what is left of them without one letter.
OP12_SQL = """
with recursive crc(k, c, i) as (select range::uinteger, range::uinteger, 0 from range(256) union all select k, case when c & 1 = 1 then xor(c >> 1, 3988292384::uinteger) else c >> 1 end, i + 1 from crc where i < 8),
t as (select list(c order by k) t from crc where i = 8),
r as (select coalesce(doc_id::varchar, '') id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents),
d as (select id, run, count(*) n, hex(encode(id || ':' || run)) x from r group by 1, 2),
h as (select run, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::uinteger), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::uinteger), 4294967295::uinteger) h from d, t),
w as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, n from h),
v as materialized (select word, sum(n)::bigint n from w where length(word) >= 6 group by 1 having sum(n) >= 5),
s as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from (select word, unnest(range(1, length(word) + 1)) i from v)),
p as (select a.word a, b.word b from s a join s b on a.i = b.i and a.rest = b.rest and a.word <> b.word union select v.word, s.word from v join s on v.word = s.rest union select s.word, v.word from v join s on v.word = s.rest),
b as (select a word, count(*) n_near, max(v.n) most from p join v on v.word = p.b group by 1),
g as (select b.word, n_near, most, min(v.word) best from b join p on p.a = b.word join v on v.word = p.b and v.n = most group by 1, 2, 3),
f as materialized (select v.word, v.n, coalesce(n_near, 0) n_near, case when most >= 5 * v.n then best end form, case when most >= 5 * v.n then most end form_n from v left join g using (word)),
u(word, root, form) as (select word, word, form from f union all select u.word, f.word, f.form from u join f on f.word = u.form)
select f.word, f.form, u.root, f.n, f.n_near, f.form_n from f join u on u.word = f.word and u.form is null
"""


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_url_filter": op1_url_filter, "op2_quality": op2_quality, "op3_ngram_join": op3_ngram_join, "op4_lang_id": op4_lang_id, "op5_token_count": op5_token_count, "op6_lm_score": op6_lm_score, "op7_line_dedup": op7_line_dedup, "op8_secrets": op8_secrets, "op9_decontamination": op9_decontamination, "op10_bpe": op10_bpe, "op11_embedding_dups": op11_embedding_dups, "op12_spelling": op12_spelling, "op13_token_align": op13_token_align}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_quality": OP2_SQL, "op11_embedding_dups": OP11_SQL, "op12_spelling": OP12_SQL}
