"""Every query of the engine by name, over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions import scoring as S
from memspark.functions import text as T
from memspark.operators import analytics, compaction, evaluation, lifecycle, outcomes, postings, profiles, search, transcripts, usefulness, vector_index
from memspark.plans import views as V
from memspark.plans.shared import shared_folder

QUERY = ["the", "thing", "of", "reer", "tion", "the"]
_QUERIES, _SQL = {}, {}

# The views of memspark.plans.views in SQL.
_M = """m as (select doc_id id, text memory, source,
 (['decision','preference','relationship','insight','commitment','procedure','plan','outcome','fact','action','intention','event','cancellation'])[doc_id % 13 + 1] memory_type,
 (['confirmed','active','outdated','archived','merged','superseded','contradicted','deleted'])[doc_id % 8 + 1] status,
 (doc_id * 7 % 11) / 10.0::double importance, 'cli-' || (doc_id % 37) client_id, doc_id % 50 session_id,
 timestamp '2024-06-01 00:00:00' - to_days((doc_id % 400)::int) - to_hours(doc_id % 24) created_at from documents)"""
_R = "r as (select event_id reward_id, ts, user_id memory_id, event_type reward_type, greatest(-1::double, least(1::double, (floor(value) - 50) / 100::double)) reward from events)"
_CRM = """o as (select o_orderkey deal_id, 'cli-' || (o_custkey % 37) client_id from orders),
 a as (select deal_id, client_id, (['negotiation','delivered','invoiced','new','qualified',''])[deal_id % 6 + 1] old_stage from o where deal_id % 11 <> 0),
 b as (select deal_id, client_id entity_id, (['won','invoiced','paid','lost','negotiation','closed','cancelled'])[deal_id % 7 + 1] stage from o where deal_id % 13 <> 0),
 t(f, stage, event_name, reward) as (values ('negotiation','won','deal_closed',0.8::double), ('negotiation','closed','deal_closed',0.8), ('delivered','invoiced','deal_closed',0.8), ('invoiced','paid','payment_received',1.0), ('*','lost','deal_lost',-0.5), ('*','cancelled','deal_lost',-0.5)),
 ev as (select deal_id, entity_id, old_stage, b.stage, coalesce(x.event_name, y.event_name) event_name, coalesce(x.reward, y.reward) reward from a join b using (deal_id) left join t x on x.f = old_stage and x.stage = b.stage left join t y on y.f = '*' and y.stage = b.stage where old_stage <> '' and b.stage <> '' and old_stage <> b.stage and coalesce(x.event_name, y.event_name) is not null)"""
_PO = """p as (select o_orderkey id, 'cli-' || (o_custkey % 37) client_id, o_orderdate ts from orders),
 f as (select l_orderkey id, min(l_shipdate) shipped from lineitem group by 1),
 oc as (select f.id, shipped resolved_at, date_diff('day', o_orderdate, shipped) days_to_resolve, case when f.id % 5 = 0 then null else (f.id % 21 - 10) / 10::double end reward from f join orders on o_orderkey = f.id where f.id % 3 <> 0),
 pr as (select p.id, client_id, ts, resolved_at, reward, days_to_resolve, case when resolved_at is null then 'pending' else 'resolved' end status from p left join oc using (id))"""
_TOK = r"list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{2,}}$'))"
_FOLD = "list_reduce(list_prepend(0::double, list({r} order by ts, reward_id)), lambda a, x: greatest(-0.5::double, least(1::double, a + 0.25::double * x)))"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _as_of():
    return F.lit(V.AS_OF).cast("timestamp")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return V.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rewards(spark, sf_dir).select("memory_id", "ts", F.col("reward_id").alias("seq"), "reward", F.concat(F.lit("Rwd "), F.col("reward_type"), F.lit(" [rwd_"), F.col("reward_id").cast("string"), F.lit("]")).alias("context"))


_BM25 = f"""tk as (select *, {_TOK.format(t="memory")} tok from SRC),
 st as (select count(*) n, avg(len(tok)) avgdl from tk where coalesce(memory, '') <> ''),
 df as (select w, count(*) filter (where list_contains(tok, w)) df from tk, (select distinct unnest(['the','thing','of','reer','tion']) w) group by w),
 bs as (select id, sum(case when tf > 0 then (case when df > 0 then ln(n / df) else 1 end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tok) / avgdl)) else 0 end) bm25
  from (select tk.id, tok, q.w, len(list_filter(tok, lambda t: t = q.w))::double tf from tk, (select unnest(['the','thing','of','reer','tion','the']) w) q) join df using (w), st group by id)"""


@query(f"""with {_M}, v as (select m.*, embedding from m join embeddings on vec_id = id where status not in ('deleted', 'superseded')),
 c as (select v.*, list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) score
  from v, (select embedding::double[] q from embeddings where vec_id = 0) order by score desc, id limit 60),
 {_BM25.replace("SRC", "c")}, {_R}, qs as (select memory_id id, {_FOLD.format(r="reward")} a, {_FOLD.format(r="reward * 0.8::double")} h, {_FOLD.format(r="case when reward > 0 then reward else reward * 0.5::double end")} f from r group by 1),
 h as (select c.id, score, bm25, greatest(0, least(1, (0.4 * score + 0.15 / (1 + exp(-bm25 / 3)) + 0.2 * exp(-0.693 * greatest(0, floor(date_diff('hour', created_at, timestamp '2024-06-01') / 24)) / 90)
  + 0.15 * importance * ([1.0,.95,.9,.9,.9,.85,.85,.85,.8,.8,.75,.7,.6])[c.id % 13 + 1]::double + 0.1 * coalesce(0.5 * a + 0.2 * h + 0.3 * f, 0)) * ([1.2,1,.5,.3,.2,.2,.1,0])[c.id % 8 + 1]::double)) hs from c join bs using (id) left join qs using (id))
 select id, round(score, 6) score, round(bm25, 6) bm25, round(hs, 6) hybrid_score from h order by hs desc, score desc, id limit 20""")
def hybrid_search(spark, sf_dir):
    def q(ids):
        log = _log(spark, sf_dir).join(F.broadcast(ids.toDF("memory_id")), "memory_id", "left_semi")  # 100 candidates at most
        return usefulness.fold(log).select(F.col("memory_id").alias("id"), F.col("q_value").alias("q"))

    out = search.hybrid_search(V.memory(spark, sf_dir), _first_vector(spark, sf_dir), QUERY, q, _as_of())
    return rounded(out.select("id", "score", "bm25", "hybrid_score"), "score", "bm25", "hybrid_score")


@query("""select vec_id id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) score
 from embeddings, (select embedding::double[] q from embeddings where vec_id = 0) order by list_dot_product(embedding::double[], q) desc, 1 limit 50""")
def vector_top(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(search.vector_top(e, _first_vector(spark, sf_dir), 50).select("id", "score"), "score")


@query(f"""with {_M}, v as (select m.id, status, memory_type, embedding from m join embeddings on vec_id = m.id where status not in ('deleted', 'superseded') and memory_type is distinct from 'fact')
 select id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) score
 from v, (select embedding::double[] q from embeddings where vec_id = 0) order by list_dot_product(embedding::double[], q) / sqrt(list_dot_product(embedding::double[], embedding::double[])) desc, 1 limit 20""")
def vector_index_top(spark, sf_dir):
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build(V.memory(spark, sf_dir).select("id", "vector", "status", "memory_type"), path)
    return rounded(vector_index.top(spark, path, _first_vector(spark, sf_dir), 20, exact=True, exclude_type="fact").select("id", "score"), "score")


@query("""with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 50 = 0),
 s as (select query_id, vec_id id, list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) score from embeddings, q),
 k as (select *, row_number() over (partition by query_id order by score desc, id) rank from s) select query_id, id, rank, round(score, 6) score from k where rank <= 10""")
def vector_top_per_query(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = search.query_top(e, e.where("id % 50 = 0").toDF("query_id", "query_vector"), 10)
    return rounded(out.select("query_id", "id", "rank", "score"), "score")


@query(f"with {_M}, {_BM25.replace('SRC', 'm')} select id, round(bm25, 6) bm25 from bs")
def bm25_scores(spark, sf_dir):
    return rounded(search.bm25(V.memory_text(spark, sf_dir), QUERY, key="id"), "bm25")


def _index(spark, sf_dir) -> str:
    """An index of all memories, added in two batches."""
    path, m = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", V.memory_text(spark, sf_dir)
    for part in ("id % 3 = 0", "id % 3 != 0"):
        postings.add_documents(m.where(part), path, block=4096)
    return path


@query(f"with {_M}, {_BM25.replace('SRC', 'm')} select id, round(bm25, 6) bm25 from bs")
def bm25_from_lists(spark, sf_dir):
    return rounded(postings.all_scores(spark, _index(spark, sf_dir), QUERY), "bm25")


@query(f"with {_M}, {_BM25.replace('SRC', 'm')} select id, round(bm25, 6) bm25 from bs order by bs.bm25 desc, id limit 50")
def bm25_top(spark, sf_dir):
    return rounded(postings.bm25_scores(spark, _index(spark, sf_dir), QUERY, 50), "bm25")


@query(f"""with {_M}, x as (select *, exp(-0.693 * floor(date_diff('hour', created_at, timestamp '2024-06-01') / 24) / 90) rec, ([1.0,.95,.9,.9,.9,.85,.85,.85,.8,.8,.75,.7,.6])[id % 13 + 1]::double boost from m)
 select id, round(rec, 6) recency, round(greatest(0, least(1, (0.5 * ((id % 101) / 100::double) + 0.3 * case when memory_type in ('decision','preference','relationship','commitment') then greatest(rec, 0.4) else rec end
 + 0.2 * case when importance = 0 then 0.8 else importance end * boost) * least(1 + 0.05 * (id % 14), 1.5))), 6) composite from x""")
def composite_scores(spark, sf_dir):
    m, rec = V.memory_text(spark, sf_dir), S.recency(F.col("created_at"), _as_of())
    score = S.composite((F.col("id") % 101) / 100.0, rec, F.col("importance"), F.col("memory_type"), F.col("id") % 14)
    return rounded(m.select("id", rec.alias("recency"), score.alias("composite")), "recency", "composite")


@query(f"""with {_M}, {_R}, qs as (select memory_id id, {_FOLD.format(r="reward")} q from r group by 1),
 c as (select session_id query_id, m.id, importance, created_at, (m.id % 101) / 100::double score, coalesce(q, 0) q from m left join qs using (id)),
 w as (select *, avg(q) over p mu, case when count(*) over p = 1 or stddev_pop(q) over p < 1e-9 then 1 else stddev_pop(q) over p end sd from c window p as (partition by query_id)),
 s as (select query_id, id, 0.5 * greatest(-3, least(3, (score - 0.2) / 0.1)) + 0.3 * greatest(-3, least(3, (q - mu) / sd)) + 0.1 * exp(-0.693 * floor(date_diff('hour', created_at, timestamp '2024-06-01') / 24) / 90) + 0.1 * importance combined from w),
 k as (select *, row_number() over (partition by query_id order by round(combined, 9) desc, id) rank from s) select query_id, id, rank, round(combined, 6) combined from k where rank <= 5""")
def rerank_by_usefulness(spark, sf_dir):
    q = usefulness.fold(_log(spark, sf_dir)).select(F.col("memory_id").alias("id"), F.col("q_action").alias("q"))
    c = V.memory_text(spark, sf_dir).join(q, "id", "left").select(F.col("session_id").alias("query_id"), "id", "importance", "created_at", ((F.col("id") % 101) / 100.0).alias("score"), F.coalesce("q", F.lit(0.0)).alias("q"))
    out = search.rerank(c, S.recency(F.col("created_at"), _as_of()), places=9)
    return rounded(out.select("query_id", "id", "rank", "combined"), "combined")


@query(f"""with {_R} select memory_id, round({_FOLD.format(r="reward")}, 6) q_action, round({_FOLD.format(r="reward * 0.8::double")}, 6) q_hypothesis,
 round({_FOLD.format(r="case when reward > 0 then reward else reward * 0.5::double end")}, 6) q_fit, count(*)::int q_visits,
 array_to_string(list(substr('Rwd ' || reward_type || ' [rwd_' || reward_id || ']', 1, 120) order by ts, reward_id)[greatest(1, count(*) - 4):], ';') contexts from r group by 1""")
def usefulness_fold(spark, sf_dir):
    out = usefulness.fold(_log(spark, sf_dir))
    return rounded(out.select("memory_id", "q_action", "q_hypothesis", "q_fit", "q_visits", F.array_join("reward_contexts", ";").alias("contexts")), "q_action", "q_hypothesis", "q_fit")


@query(f"""with {_R}, g as (select *, memory_id % 4 = 0 and reward < 0 skip from r) select memory_id, round(list_reduce(list_prepend(0::double, list(case when skip then null else reward end order by ts, reward_id)), lambda a, x: case when x is null then a else greatest(-0.5::double, least(1::double, a + 0.25::double * x)) end), 6) q_action, count(*)::int q_visits from g group by 1""")
def usefulness_protected(spark, sf_dir):
    log = _log(spark, sf_dir)
    out = usefulness.fold(log, protected=log.where("memory_id % 4 = 0").select("memory_id"))
    return rounded(out.select("memory_id", "q_action", "q_visits"), "q_action")


@query(f"""with {_R}, s as (select memory_id, {_FOLD.format(r="reward")} a, {_FOLD.format(r="reward * 0.8::double")} h, {_FOLD.format(r="case when reward > 0 then reward else reward * 0.5::double end")} f from r group by 1),
 d as (select *, greatest(-0.5, least(1, (memory_id % 5) / 2::double - 0.5)) - (0.5 * a + 0.2 * h + 0.3 * f) d from s), e as (select memory_id, case when memory_id % 3 <> 0 or abs(d) < 1e-6 then 0 else d end d, a, h, f from d)
 select memory_id, round(0.5 * greatest(-0.5, least(1, a + d)) + 0.2 * greatest(-0.5, least(1, h + d)) + 0.3 * greatest(-0.5, least(1, f + d)), 6) q_value from e""")
def usefulness_override(spark, sf_dir):
    state = usefulness.fold(_log(spark, sf_dir))
    wanted = state.where("memory_id % 3 = 0").select("memory_id", F.expr("(memory_id % 5) / 2.0D - 0.5D").alias("target"))
    return rounded(usefulness.set_value(state, wanted).select("memory_id", "q_value"), "q_value")


def _states(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    row = lambda df, late: df.groupBy(F.col("user_id").alias("memory_id"), F.col("event_type").alias("experience")).agg(F.max(F.floor("value")).cast("double").alias("q_value"), F.max(F.when(F.col("user_id") % 7 != late, F.date_format("ts", "yyyy-MM-dd"))).alias("q_updated_at"))
    return row(e.where("event_id % 2 = 0"), 0), row(e.where("event_id % 2 = 1"), 1)


_STATES = """a as (select user_id memory_id, event_type experience, max(floor(value)) q_value, max(case when user_id % 7 <> 0 then strftime(ts, '%Y-%m-%d') end) u from events where event_id % 2 = 0 group by 1, 2),
 b as (select user_id memory_id, event_type experience, max(floor(value)) q_value, max(case when user_id % 7 <> 1 then strftime(ts, '%Y-%m-%d') end) u from events where event_id % 2 = 1 group by 1, 2)"""


@query(f"""with {_STATES} select coalesce(a.memory_id, b.memory_id) memory_id, coalesce(a.experience, b.experience) experience,
 case when a.memory_id is null or (b.memory_id is not null and (a.u is null or b.u > a.u)) then b.q_value else a.q_value end q_value from a full join b using (memory_id, experience)""")
def delta_merge(spark, sf_dir):
    return usefulness.merge_deltas(*_states(spark, sf_dir)).select("memory_id", "experience", "q_value")


@query(f"with {_STATES} select memory_id, experience, q_value from a where q_value > 150 union all select memory_id, experience, q_value from b where memory_id not in (select memory_id from a where q_value > 150)")
def save_merge(spark, sf_dir):
    a, b = _states(spark, sf_dir)
    return usefulness.save_merge(a.where("q_value > 150"), b).select("memory_id", "experience", "q_value")


@query(f"with {_R}, s as (select memory_id, max(ts) t from r group by 1) select memory_id from s order by t desc, memory_id limit 100")
def evict_least_recent(spark, sf_dir):
    return usefulness.evict(V.rewards(spark, sf_dir).groupBy("memory_id").agg(F.max("ts").alias("touched")), 100).select("memory_id")


@query(f"with {_STATES} select experience, count(*) count, round(avg(q_value), 6) mean, min(q_value) min, max(q_value) max from a group by 1")
def usefulness_stats(spark, sf_dir):
    return rounded(usefulness.stats(_states(spark, sf_dir)[0]), "mean")


@query(f"""with {_R}, s as (select distinct memory_id from r where reward_type = 'purchase'), w as (select memory_id, reward, row_number() over (order by reward_id) - 1 pos from r)
 select memory_id, pos, case pos % 3 when 0 then 'promote' when 1 then 'demote' else 'adjust' end action, case pos % 3 when 0 then abs(reward) when 1 then -abs(reward) else reward end reward from w where pos < 20 and memory_id in (select memory_id from s)""")
def reward_adjustments(spark, sf_dir):
    r = V.rewards(spark, sf_dir)
    wanted = r.orderBy("reward_id").limit(C.MAX_ADJUSTMENTS).withColumn("pos", (F.row_number().over(Window.orderBy("reward_id")) - 1).cast("long"))
    wanted = wanted.withColumns({"action": F.expr("element_at(array('promote', 'demote', 'adjust'), cast(pos % 3 + 1 as int))"), "target_q": F.lit(None).cast("double")})
    return usefulness.adjustments(r.where("reward_type = 'purchase'"), wanted).select("memory_id", "pos", "action", "reward")


@query(f"with {_M} select count(*) total, {', '.join(f'count(*) filter (where status = {chr(39)}{s}{chr(39)}) {s}' for s in C.LIFECYCLE_EDGES)}, 0::bigint unlabeled from m")
def lifecycle_counts(spark, sf_dir):
    return lifecycle.state_counts(V.memory_text(spark, sf_dir))


@query(f"""with {_M}, q as (select id, (['active','confirmed','outdated'])[id % 3 + 1] from_status, (['merged','archived','active','superseded'])[id % 4 + 1] to_status from m),
 e as (select k, unnest(v) t from (values {', '.join(f"('{k}', {list(v)})" for k, v in C.LIFECYCLE_EDGES.items() if v)}) x(k, v)),
 a as (select q.*, m.status cur, m.status = from_status and exists (select 1 from e where k = from_status and t = to_status) ok from q join m using (id))
 select id, from_status, to_status, ok accepted, case when ok then to_status else cur end status, ok and to_status in ('superseded','contradicted','merged') stamped from a""")
def lifecycle_transitions(spark, sf_dir):
    m = V.memory_text(spark, sf_dir)
    return lifecycle.transition(m, m.select("id", F.expr("element_at(array('active','confirmed','outdated'), cast(id % 3 + 1 as int))").alias("from_status"), F.expr("element_at(array('merged','archived','active','superseded'), cast(id % 4 + 1 as int))").alias("to_status")))


@query(f"with {_M} select source, memory_type, count(*) memories, count(distinct client_id) clients from m where status not in ('deleted','superseded') and memory_type is distinct from 'event' and created_at >= timestamp '2023-08-01' and created_at <= timestamp '2024-05-01' group by 1, 2")
def filtered_counts(spark, sf_dir):
    m = search.lifecycle_filter(search.payload_filter(V.memory_text(spark, sf_dir), exclude_type="event", date_from="2023-08-01", date_to="2024-05-01"))
    return m.groupBy("source", "memory_type").agg(F.count(F.lit(1)).alias("memories"), F.count_distinct("client_id").alias("clients"))


@query(f"with {_CRM} select deal_id, entity_id, old_stage, stage, event_name, reward from ev")
def crm_events(spark, sf_dir):
    return outcomes.stage_events(*V.crm(spark, sf_dir))


@query(f"with {_CRM}, {_M}, k as (select entity_id, event_name, count(*) events, sum(reward) total from ev group by 1, 2) select m.id memory_id, count(*) event_kinds, sum(events)::bigint events, round(sum(total), 6) reward from k join m on client_id = entity_id group by 1")
def outcome_rewards(spark, sf_dir):
    ev = outcomes.stage_events(*V.crm(spark, sf_dir)).groupBy("entity_id", "event_name").agg(F.count(F.lit(1)).alias("events"), F.sum("reward").alias("total"))
    out = outcomes.reward_memories(ev, V.memory_text(spark, sf_dir)).groupBy("memory_id").agg(F.count(F.lit(1)).alias("event_kinds"), F.sum("events").alias("events"), F.sum("total").alias("reward"))
    return rounded(out, "reward")


@query("select distinct l, r from (select 'cli-dt-' || lpad((o_custkey % 400)::varchar, 3, '0') l from orders) a join (select 'comp-dt-' || lpad((c_custkey % 300)::varchar, 3, '0') r from customer) b on l = r or substr(l, 5) = substr(r, 6)")
def client_matches(spark, sf_dir):
    a = V.table(spark, sf_dir, "orders").select(F.concat(F.lit("cli-dt-"), F.lpad((F.col("o_custkey") % 400).cast("string"), 3, "0")).alias("l"))
    b = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("comp-dt-"), F.lpad((F.col("c_custkey") % 300).cast("string"), 3, "0")).alias("r"))
    return outcomes.client_matches(a, b, "l", "r")


@query(f"with {_PO} select id, client_id, status, reward, days_to_resolve from pr")
def predictions_resolved(spark, sf_dir):
    p, o = V.predictions(spark, sf_dir)
    return outcomes.resolve_predictions(p, o.withColumn("source_pos", F.lit(0))).select("id", "client_id", "status", "reward", "days_to_resolve")


@query(f"with {_PO} select count(*) total, count(*) filter (where status = 'resolved') resolved, count(*) filter (where status = 'pending') pending, count(*) filter (where reward > 0) positive, count(*) filter (where reward < 0) negative, round(avg(reward), 6) avg_reward, round(count(*) filter (where reward > 0) / count(*) filter (where status = 'resolved'), 6) accuracy from pr")
def prediction_stats(spark, sf_dir):
    p, o = V.predictions(spark, sf_dir)
    return rounded(outcomes.prediction_stats(outcomes.resolve_predictions(p, o.withColumn("source_pos", F.lit(0)))), "avg_reward", "accuracy")


@query(f"""with {_R}, p as (select unnest([{{'level': 'day', 'period': strftime(ts, '%Y-%m-%d')}}, {{'level': 'week', 'period': strftime(ts, '%G-W%V')}}, {{'level': 'month', 'period': strftime(ts, '%Y-%m')}}]) p, reward from r)
 select p.level, p.period, count(*) events, round(avg(reward), 6) mean_reward from p group by 1, 2""")
def rewards_by_period(spark, sf_dir):
    return rounded(analytics.by_period(V.rewards(spark, sf_dir)), "mean_reward")


@query(f"""with {_R}, h as (select greatest(0, least(14, trunc((reward + 0.5) / 0.1)::int)) b, count(*) n from r group by 1) select x::int bin, coalesce(n, 0) count from range(15) t(x) left join h on b = x""")
def reward_histogram(spark, sf_dir):
    return analytics.histogram(V.rewards(spark, sf_dir), "reward")


@query(f"with {_R} select min(reward) min, max(reward) max, round(avg(reward), 6) mean, median(reward) median, round(stddev_samp(reward), 6) std, count(reward) count from r")
def reward_summary(spark, sf_dir):
    return rounded(analytics.summary(V.rewards(spark, sf_dir), "reward"), "mean", "std")


@query("select conv_id session_id, turn pos, role, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 5000) text from conversations where role in ('user', 'assistant') and length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10")
def transcript_messages(spark, sf_dir):
    return transcripts.message_rules(V.messages(spark, sf_dir))


@query("select conv_id session_id, count(*) messages, sum(length(text))::bigint chars, min(turn) first, max(turn) last from conversations group by 1")
def session_rollup(spark, sf_dir):
    return transcripts.session_rollup(V.messages(spark, sf_dir))


@query("""with recursive s as (select conv_id, row_number() over (order by conv_id) i, sum(length(text))::bigint n from conversations group by 1),
 f as (select i, conv_id, n, 1 chunk_id, n used from s where i = 1 union all select s.i, s.conv_id, s.n, case when used + s.n > 4000 then chunk_id + 1 else chunk_id end, case when used + s.n > 4000 then s.n else used + s.n end from f join s on s.i = f.i + 1)
 select conv_id session_id, chunk_id, n chars from f""")
def chunk_packing(spark, sf_dir):
    sessions = transcripts.session_rollup(V.messages(spark, sf_dir)).withColumn("first", F.col("session_id"))
    return transcripts.pack_sessions(sessions, 4000)


@query("""with recursive m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i, length(text) n from conversations),
 f as (select conv_id, i, 1 part, n used, n from m where i = 1 union all select m.conv_id, m.i, case when used + m.n > 600 then part + 1 else part end, case when used + m.n > 600 then m.n else used + m.n end, m.n from f join m on m.conv_id = f.conv_id and m.i = f.i + 1)
 select conv_id session_id, part::int part, count(*)::int messages, sum(n)::int chars from f group by 1, 2""")
def split_sessions(spark, sf_dir):
    return transcripts.split_session(V.messages(spark, sf_dir), 600)


@query("""with x as (select *, count(*) over p n, row_number() over (partition by conv_id order by turn) u, row_number() over (partition by conv_id order by turn desc) d from conversations window p as (partition by conv_id))
 select conv_id session_id, turn pos from x where n <= 6 or u <= greatest(n // 3, 2) or d <= greatest(n // 3, 2)""")
def head_tail_sample(spark, sf_dir):
    return transcripts.head_tail(V.messages(spark, sf_dir), 6, 2).select("session_id", "pos")


@query("select conv_id session_id, turn pos from (select *, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) s from conversations) where s <= 1000")
def newest_within_budget(spark, sf_dir):
    return transcripts.newest_within(V.messages(spark, sf_dir), 1000).select("session_id", "pos")


@query(r"""with x as (select conv_id, turn, contains(lower(text), 'heth') rel, role = 'assistant' and length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 ans from conversations),
 y as (select *, max(case when rel then turn end) over w h, max(case when not rel and not ans then turn end) over w s from x window w as (partition by conv_id order by turn rows unbounded preceding))
 select conv_id session_id, turn pos from y where h is not null and (s is null or h > s)""")
def relevant_with_followers(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    return transcripts.with_followers(m, T.relevant(F.col("text"), T.keywords(F.lit("heth-a")))).select("session_id", "pos")


@query(r"""with x as (select doc_id, text, regexp_replace(split_part(text, '.', 1), '^\s+|\s+$', '', 'g') f from documents)
 select doc_id, case when length(f) > 50 then substr(f, 1, 47) || '...' when length(f) > 0 then f else substr(text, 1, 50) end title, substr(text, 1, 200) summary, length(text) // 4 tokens, case when length(text) > 120 then substr(text, 1, 119) || '…' else text end preview from x""")
def enrichment_defaults(spark, sf_dir):
    t = F.col("text")
    return V.table(spark, sf_dir, "documents").select("doc_id", T.title(t).alias("title"), F.substring(t, 1, 200).alias("summary"), T.token_estimate(t).alias("tokens"), T.truncate(t).alias("preview"))


@query(r"""with a as (select doc_id, regexp_replace(text, '(^|\s)([A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|API|PASS|PWD|AUTH)[A-Z0-9_]*)\s*=\s*\S+', '\1\2=[REDACTED]', 'g') t from documents),
 b as (select doc_id, regexp_replace(t, '(?i)(token|password|api[_-]?key|secret|credential|auth)\s*[:=]\s*["'']?[^\s"'']{4,}["'']?', '\1=[REDACTED]', 'g') t from a),
 c as (select doc_id, regexp_replace(regexp_replace(t, 'Bearer\s+[A-Za-z0-9._/+=\-]+', 'Bearer [REDACTED]', 'g'), '\bsk-[A-Za-z0-9_\-]{16,}|\bghp_[A-Za-z0-9]{20,}|\bAKIA[A-Z0-9]{16}\b', '[REDACTED]', 'g') t from b),
 d as (select doc_id, t, regexp_replace(t, '/(?:Users|home)/[\p{L}\p{N}_]+(?:/[^\s"'']*)?', '/~/...', 'g') u from c)
 select doc_id, md5(regexp_replace(regexp_replace(u, '([\p{L}\p{N}_.+-]{1,2})[\p{L}\p{N}_.+-]*@([\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+)', '\1***@\2', 'g'), 'sk-ant-\S+', 'sk-***', 'g')) redacted, contains(t, '[REDACTED]') had_secret from d""")
def redaction(spark, sf_dir):
    t = T.redact_secrets(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact_people(t)).alias("redacted"), t.contains("[REDACTED]").alias("had_secret"))


@query("""with q as (select user_id, event_id query_id, ts from events where event_type = 'view'), s as (select user_id, event_id step_id, ts from events where event_type = 'purchase'),
 a as (select q.user_id, query_id, arg_min(step_id, (s.ts, step_id)) step_id from q join s on s.user_id = q.user_id and s.ts >= q.ts group by 1, 2), l as (select user_id, arg_max(step_id, (ts, step_id)) step_id from s group by 1)
 select q.query_id, coalesce(a.step_id, l.step_id) step_id from q left join a using (query_id) left join l on l.user_id = q.user_id""")
def next_step_as_of(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return analytics.next_step(e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("query_id")), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("step_id")), "user_id")


@query("""with b as (select *, greatest(1, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding)) beat from conversations)
 select conv_id session_id, beat::bigint beat, count(*) steps, count(distinct role) roles, greatest(3500, 1200 * count(*) filter (where role = 'assistant')) duration from b group by 1, 2""")
def conversation_beats(spark, sf_dir):
    b = analytics.beats(V.messages(spark, sf_dir)).groupBy("session_id", "beat")
    return b.agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("role").alias("roles"), F.greatest(F.lit(3500), 1200 * F.count_if(F.col("role") == "assistant")).cast("long").alias("duration"))


@query("""with s as (select user_id session_id, count(*) n, max(ts) l, (count(*) filter (where event_type = 'purchase') > 0)::int + (count(*) filter (where event_type = 'signup') > 0)::int + (count(*) filter (where event_type = 'error') > 0)::int d from events group by 1)
 select session_id, n, d diversity from s order by d desc, n desc, l desc, session_id limit 1""")
def best_session(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return analytics.best_session(e, {k: F.col("event_type") == k for k in ("purchase", "signup", "error")}).select("session_id", "n", "diversity")


@query("""with j as (select event_id, user_id, ts, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) select event_id, user_id, event_type from j where r = 1""")
def first_seen(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))
    return compaction.first_of_each(e, ["user_id", "event_type"], "_o").select("event_id", "user_id", "event_type")


#: The vectors of the view lie close in sevens and far apart otherwise, so each seven is a cluster, in order of the ids.
_SEVENS = """v as (select a.vec_id id, a.vec_id // 7 g, a.vec_id % 5 = 3 archived, list_transform(range(1, len(a.embedding) + 1), lambda i: b.embedding[i]::double + 0.25 * a.embedding[i]::double) x from embeddings a join embeddings b on b.vec_id = a.vec_id - a.vec_id % 7 where a.vec_id in (select doc_id from documents))"""


@query(f"""with {_SEVENS}, u as (select id, g, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) x from v),
 s as (select g, i, sum(y) y from (select g, unnest(x) y, generate_subscripts(x, 1) i from u) group by 1, 2), c as (select g, list(y order by i) c from s group by 1), n as (select g, min(id) cluster from u group by 1 having count(*) >= 3)
 select id, cluster, (row_number() over (partition by g order by id) - 1)::int position, round(list_dot_product(x, c) / sqrt(list_dot_product(c, c)), 6) similarity from u join c using (g) join n using (g)""")
def compaction_clusters(spark, sf_dir):
    return rounded(compaction.greedy_clusters(V.variants(spark, sf_dir), 0.25, 3), "similarity")


@query(f"""with {_SEVENS}, n as (select min(id) cluster, count(*) n from v where not archived group by g having count(*) >= 3), d as (select * from n order by cluster limit 50)
 select (select count(*) from v where not archived) memories_found, (select count(*) from n) clusters, (select count(*) from d) compacted, (select sum(n)::bigint from d) memories_merged""")
def compaction_run(spark, sf_dir):
    state = V.usefulness_rows(spark, sf_dir).withColumnRenamed("memory_id", "id").where("experience = 'default'")
    return compaction.compact_memories(V.variants(spark, sf_dir), state)[0]


@query("""with e as (select label cluster, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings), m as (select cluster, i, avg(x) x from e group by 1, 2)
 select cluster, (i - 1)::int i, round(x / sqrt(sum(x * x) over (partition by cluster)), 6) x from m""")
def compaction_centroids(spark, sf_dir):
    m = V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    return rounded(compaction.centroids(m).select("cluster", F.posexplode("centroid").alias("i", "x")), "x")


_MEMBERS = "mb as (select doc_id id, doc_id % 40 cluster, doc_id position, 0.5 + (doc_id % 7) / 20::double similarity, case when doc_id % 3 = 0 then null else (doc_id % 10) / 10::double end qa, (doc_id % 4) / 4::double qh, (doc_id % 5) / 5::double qf, (doc_id % 9) / 9::double q_value, doc_id % 6 q_visits, case when doc_id % 4 = 0 then null else (doc_id % 3 - 1) / 2::double end last_reward, text from documents)"


@query(f"""with {_MEMBERS}, g as (select cluster, sum(similarity * coalesce(qa, 0.5)) / sum(similarity) a, sum(similarity * qh) / sum(similarity) h, sum(similarity * qf) / sum(similarity) f, sum(q_visits)::bigint q_visits,
 case when count(last_reward) > 1 then 1 / greatest(var_pop(last_reward), 0.01) else 1 end kappa, arg_max(id, (q_value, -position)) best, count(*) members from mb group by 1)
 select cluster, round(0.5 * a + 0.2 * h + 0.3 * f, 6) q_value, q_visits, round(kappa, 6) kappa, best, members from g""")
def merged_usefulness(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").selectExpr("doc_id id", "doc_id % 40 cluster", "doc_id position", "0.5D + (doc_id % 7) / 20.0D similarity", "if(doc_id % 3 = 0, null, (doc_id % 10) / 10.0D) q_action", "(doc_id % 4) / 4.0D q_hypothesis", "(doc_id % 5) / 5.0D q_fit", "(doc_id % 9) / 9.0D q_value", "doc_id % 6 q_visits", "if(doc_id % 4 = 0, null, (doc_id % 3 - 1) / 2.0D) last_reward")
    return rounded(compaction.merged_q(d).select("cluster", "q_value", "q_visits", "kappa", "best", "members"), "q_value", "kappa")


@query(r"""with x as (select label cluster, list_reverse(list(regexp_replace(text, '^\s+|\s+$', '', 'g') order by vec_id)) l from embeddings join documents on doc_id = vec_id group by 1),
 y as (select cluster, list_filter(l, lambda t: t <> '') l from x), z as (select cluster, list_filter(l, lambda t, i: list_position(l, t) = i) l from y)
 select cluster, array_to_string(l[1:5], ' | ') || case when len(l) > 5 then ' [+' || (len(l) - 5) || ' merged]' else '' end merged from z""")
def merged_texts(spark, sf_dir):
    m = V.memory(spark, sf_dir).groupBy(F.col("label").alias("cluster")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.col("memory").alias("t")))), lambda x: x["t"]).alias("l"))
    return m.select("cluster", compaction.merged_text(F.col("l")).alias("merged"))


_KW = r"""q as (select item_id query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w from benchmark), d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') t from documents),
 dl as (select avg(len(t)) a from d), x as (select doc_id, len(t) n, unnest(t) w from d), tf as (select doc_id, n, w, count(*) c from x group by all), u as (select query_id, unnest(w) w from q),
 raw as (select query_id, doc_id, sum(c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / a))) s from u join tf using (w), dl group by 1, 2), sc as (select query_id, doc_id, s, s / max(s) over (partition by query_id) score from raw)"""


def _asked(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"with {_KW}, k as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) rank from sc) select query_id, doc_id, rank, round(score, 6) score from k where rank <= 10")
def keyword_retrieval(spark, sf_dir):
    return rounded(evaluation.keyword_top(_asked(spark, sf_dir), V.table(spark, sf_dir, "documents"), 10), "score")


@query(f"""with {_KW}, tr as (select item_id query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)), k as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) rank from sc),
 h as (select query_id, rank, tr.doc_id is not null hit from k left join tr using (query_id, doc_id) where rank <= 50), ks as (select unnest([1,3,5,10,30,50]) k), qs as (select distinct query_id from tr),
 g as (select qs.query_id, ks.k, count(*) filter (where hit and rank <= ks.k) n, coalesce(sum(case when hit and rank <= ks.k then 1 / log2(rank + 1) end), 0) dcg from qs cross join ks left join h using (query_id) group by 1, 2)
 select k::int k, round(avg((n > 0)::int), 6) recall_any, round(avg(case when n > 0 then dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) else 0 end), 6) ndcg_retrieved from g group by 1""")
def retrieval_evaluation(spark, sf_dir):
    docs, asked = V.table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    out = evaluation.evaluate(evaluation.keyword_top(asked, docs, max(C.RECALL_AT)), evaluation.holding(asked, docs))
    return rounded(out, "recall_any", "ndcg_retrieved")


@query(f"""with {_KW}, tr as (select item_id query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)), k as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) rank from sc),
 h as (select query_id, rank, tr.doc_id is not null hit from k left join tr using (query_id, doc_id) where rank <= 10), ks as (select unnest([5, 10]) k), qs as (select distinct query_id from tr),
 g as (select qs.query_id, ks.k, count(*) filter (where hit and rank <= ks.k) n from qs cross join ks left join h using (query_id) group by 1, 2)
 select 'type-' || (query_id % 3) question_type, k::int k, count(*) questions, round(avg((n > 0)::int), 6) recall_any from g group by 1, 2""")
def retrieval_by_type(spark, sf_dir):
    docs, asked = V.table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    types = asked.select("query_id", F.concat(F.lit("type-"), (F.col("query_id") % 3).cast("string")).alias("question_type"))
    return rounded(evaluation.evaluate_by_type(evaluation.keyword_top(asked, docs, 10), evaluation.holding(asked, docs), types), "recall_any")


@query("""select label, count(*) events from (select case when contains(lower(event_type), 'error') then 'failure' when contains(lower(event_type), 'sign') then 'start' when contains(lower(event_type), 'purch') then 'deal' else 'activity' end label from events) group by 1""")
def step_labels(spark, sf_dir):
    label = analytics.classify_step(F.col("event_type"), [("error", "failure"), ("sign", "start"), ("purch", "deal")], "activity")
    return V.table(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("events"))


#: What users said, with an opening, and the profile that a text calls for.
_SAID = f"""said as (select conv_id session_id, turn pos, case when turn % 9 = 4 then ' Thanks ' else ({list(V.OPENINGS)})[(conv_id + turn) % {len(V.OPENINGS)} + 1] || text end as text from conversations where role = 'user')"""


def _profile_sql(text: str) -> str:
    sums = [f"list_sum([{', '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})::int' for w in words)}])" for _, words in C.PROFILE_WORDS]
    (a, b), (p, q) = sums, [name for name, _ in C.PROFILE_WORDS]
    return f"case when length({text}) < 10 then null when {a} >= 2 and {a} >= {b} then '{p}' when {b} >= 2 then '{q}' end"


@query(f"with {_SAID} select * from (select session_id, pos, {_profile_sql('text')} profile from said) where profile is not null")
def detected_profiles(spark, sf_dir):
    return profiles.detected(V.prompts(spark, sf_dir), list(C.PROFILE_WORDS)).where("profile is not null").select("session_id", "pos", "profile")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
