"""Queries of whole flows: outcomes to rewards, compaction, ingestion and chunks, dashboards, retrospectives, replays; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions import text as T
from memspark.operators import analytics, compaction, dashboard, evaluation, outcomes, recall, replay, retrospective, search, transcripts, usefulness
from memspark.plans import views as V
from memspark.queries import _CRM, _FOLD, _M, _PO, _R, _SAID, _TOK, _log, _profile_sql, rounded

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# Outcomes.

_LEADS = """l as (select c_custkey lead_id, 'cli-' || (c_custkey % 37) company_id from customer),
 la as (select lead_id, (['new','qualified','proposal','negotiation',''])[lead_id % 5 + 1] old_stage from l where lead_id % 11 <> 0),
 lb as (select lead_id, company_id, (['qualified','proposal','negotiation','won','lost','dead','closed'])[lead_id % 7 + 1] stage from l where lead_id % 13 <> 0),
 lt(f, stage, event_name, reward) as (values ('new','qualified','meaningful_response',0.4::double), ('qualified','proposal','client_yes',0.6), ('qualified','negotiation','client_yes',0.6), ('proposal','negotiation','client_yes',0.6), ('negotiation','won','deal_closed',0.8), ('negotiation','closed','deal_closed',0.8), ('*','lost','deal_lost',-0.5), ('*','dead','deal_lost',-0.5)),
 lev as (select lead_id, company_id entity_id, old_stage, lb.stage, coalesce(x.event_name, y.event_name) event_name, coalesce(x.reward, y.reward) reward from la join lb using (lead_id) left join lt x on x.f = old_stage and x.stage = lb.stage left join lt y on y.f = '*' and y.stage = lb.stage where old_stage <> '' and old_stage <> lb.stage and coalesce(x.event_name, y.event_name) is not null),
 outs as (select 'deal' kind, deal_id::varchar id, entity_id, old_stage, stage, event_name, reward, 0 turn, deal_id pos from ev union all select 'lead', lead_id::varchar, entity_id, old_stage, stage, event_name, reward, 1, lead_id from lev)"""


class CrmDeals(outcomes.OutcomeResolver):
    name = "deals"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def detect(self, spark):
        ev = outcomes.stage_events(*V.crm(spark, self.sf_dir))
        return ev.withColumns({"pos": F.col("deal_id"), "details": F.create_map(F.lit("deal"), F.col("deal_id").cast("string"))})


class CrmLeads(outcomes.OutcomeResolver):
    name = "leads"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def detect(self, spark):
        before, after = V.leads(spark, self.sf_dir)
        ev = outcomes.stage_events(before, after.withColumnRenamed("company_id", "client_id"), tuple(C.LEAD_TRANSITIONS), "lead_id")
        return ev.withColumns({"pos": F.col("lead_id"), "details": F.create_map(F.lit("lead"), F.col("lead_id").cast("string"))})


def _events(spark, sf_dir):
    return outcomes.detected(spark, [CrmDeals(sf_dir), CrmLeads(sf_dir)])[0]


@query(f"with {_CRM}, {_LEADS} select kind, id, entity_id, old_stage, stage, event_name, reward from outs")
def crm_outcomes(spark, sf_dir):
    return outcomes.crm_outcomes(V.crm(spark, sf_dir), V.leads(spark, sf_dir))


@query(f"""with {_CRM}, {_LEADS} select kind || 's' resolver, pos, 'Biz ' || case when reward >= 0 then '+' else '' end || printf('%.2f', reward) || ': ' || event_name || ' for ' || entity_id || ' {{' || kind || '=' || id || '}}' context from outs""")
def outcome_contexts(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.select("resolver", "pos", outcomes.business_context(ev).alias("context"))


_EVENT_FOLD = "list_reduce(list_prepend(coalesce({s}, 0::double), list_transform(l, lambda x: {r})), lambda a, x: greatest(-0.5::double, least(1::double, a + 0.25::double * x)))"


@query(f"""with {_CRM}, {_LEADS}, {_M}, {_R}, st as (select memory_id, {_FOLD.format(r="reward")} a, {_FOLD.format(r="reward * 0.8::double")} h, {_FOLD.format(r="case when reward > 0 then reward else reward * 0.5::double end")} f from r group by 1),
 e as (select entity_id, list(reward order by turn, pos) l from outs group by 1),
 x as (select m.id memory_id, len(l) events, {_EVENT_FOLD.format(s="st.a", r="x")} a, {_EVENT_FOLD.format(s="st.h", r="x * 0.8::double")} h, {_EVENT_FOLD.format(s="st.f", r="case when x > 0 then x else x * 0.5::double end")} f from m join e on client_id = entity_id left join st on st.memory_id = m.id)
 select memory_id, events, round(a, 6) q_action, round(0.5 * a + 0.2 * h + 0.3 * f, 6) q_value from x""")
def resolved_outcomes(spark, sf_dir):
    out = outcomes.rewarded_state(_events(spark, sf_dir), V.memory_text(spark, sf_dir), usefulness.fold(_log(spark, sf_dir)))
    return rounded(out.select("memory_id", "events", "q_action", "q_value"), "q_action", "q_value")


@query(f"""with {_CRM}, {_LEADS}, {_M}, k as (select client_id entity_id, count(*) memories from m group by 1),
 x as (select *, sha256(kind || 's|' || turn || '|' || pos || '|' || entity_id || '|' || event_name || '|' || reward::varchar) event_key from outs join k using (entity_id)),
 y as (select *, 'rwd_' || substr(event_key, 1, 8) reward_id from x)
 select event_key, reward_id, 'business' reward_type, reward, entity_id, memories, substr('Biz ' || case when reward >= 0 then '+' else '' end || printf('%.2f', reward) || ': ' || event_name || ' for ' || entity_id || ' {{' || kind || '=' || id || '}}' || ' [' || reward_id || ']', 1, 120) reward_context from y""")
def outcome_reward_events(spark, sf_dir):
    return outcomes.reward_events(_events(spark, sf_dir), V.memory_text(spark, sf_dir)).drop("experience", "context")


def _pending(spark, sf_dir):
    p, o = V.predictions(spark, sf_dir)
    return outcomes.resolve_predictions(p, o.withColumn("source_pos", F.lit(0))).where("status = 'pending'")


@query(f"""with {_CRM}, {_LEADS}, {_PO.replace(" f as (", " fs as (").replace("from f join", "from fs f join")}, {_M}, k as (select entity_id, count(*) n from outs group by 1)
 select (select count(*) from outs) total_events, (select sum(n)::bigint from k join m on client_id = entity_id) memories_rewarded, (select count(*) from pr where status = 'pending' and client_id in (select entity_id from k)) predictions_resolved""")
def outcome_resolution(spark, sf_dir):
    return outcomes.resolution(_events(spark, sf_dir), _pending(spark, sf_dir), V.memory_text(spark, sf_dir))


@query(f"""with {_CRM}, {_LEADS}, {_PO.replace(" f as (", " fs as (").replace("from f join", "from fs f join")}, k as (select entity_id, arg_min({{'e': event_name, 'r': reward}}, (turn, pos)) x from outs group by 1)
 select id, client_id, x.e event_name, x.r reward from pr join k on client_id = entity_id where status = 'pending'""")
def auto_resolved_predictions(spark, sf_dir):
    return outcomes.resolved_by_events(_events(spark, sf_dir), _pending(spark, sf_dir))


# Recall.

_ASKED = rf"""{_SAID}, aq as (select session_id * 1000 + pos query_id, case when session_id = 0 then 'unknown' else session_id::varchar end session_id, text, regexp_replace(substr(text, 1, 300), '^\s+|\s+$', '', 'g') query from said
  where session_id % 50 = 0 and text is not null and length(text) >= 10 and lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) not in {T.TRIVIAL}),
 asked as (select aq.*, coalesce({_profile_sql("query")}, 'default') experience, {_TOK.format(t="query")} words, embedding::double[] v from aq join embeddings on vec_id = query_id % 499 where query <> '')"""
_RECALL = f"""{_M}, {_ASKED}, qst as (select c_custkey id, case when c_custkey % 4 = 0 then 'sales' else 'default' end experience, (c_custkey % 151 - 50) / 100::double q from customer),
 pool as (select m.*, embedding::double[] e from m join embeddings on vec_id = m.id where status not in ('deleted', 'superseded')),
 sim as (select query_id, pool.id, list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))) score from pool, asked),
 cand as (select * from (select *, row_number() over (partition by query_id order by score desc, id) r from sim) where r <= 15),
 ct as (select cand.query_id, cand.id, score, asked.experience, words, {_TOK.format(t="memory")} tok, coalesce(memory, '') <> '' counted, m.memory, m.created_at, m.importance, m.status from cand join asked using (query_id) join m on m.id = cand.id),
 qs1 as (select query_id, count(*) filter (where counted) docs, avg(len(tok)) filter (where counted) mean from ct group by 1),
 wds as (select query_id, id, w, count(*) times from (select query_id, id, unnest(words) w from ct) group by 1, 2, 3),
 tfs as (select wds.*, len(list_filter(tok, lambda t: t = w))::double tf, counted, len(tok) dl from wds join ct using (query_id, id)),
 dfs as (select query_id, w, count(*) filter (where counted and tf > 0) df from tfs group by 1, 2),
 kw as (select query_id, id, sum(case when tf > 0 then times * (case when df > 0 then ln(docs / df) else 1 end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) else 0 end) bm25 from tfs join dfs using (query_id, w) join qs1 using (query_id) group by 1, 2),
 hy as (select ct.query_id, ct.id, score, coalesce(bm25, 0) bm25, coalesce(q, 0) q, memory, greatest(0, least(1, (0.4 * score + 0.15 / (1 + exp(-coalesce(bm25, 0) / 3)) + 0.2 * exp(-0.693 * greatest(0, floor(date_diff('hour', created_at, timestamp '2024-06-01') / 24)) / 90)
  + 0.15 * importance * ([1.0,.95,.9,.9,.9,.85,.85,.85,.8,.8,.75,.7,.6])[ct.id % 13 + 1]::double + 0.1 * coalesce(q, 0)) * ([1.2,1,.5,.3,.2,.2,.1,0])[ct.id % 8 + 1]::double)) hs from ct left join kw using (query_id, id) left join qst on qst.id = ct.id and qst.experience = ct.experience),
 best as (select * from (select *, row_number() over (partition by query_id order by hs desc, score desc, id) rank from hy) where rank <= 5)"""


def _recalled(spark, sf_dir):
    asked = recall.prompt_queries(V.prompt_queries(spark, sf_dir), list(C.PROFILE_WORDS))
    state = V.usefulness_rows(spark, sf_dir).select(F.col("memory_id").alias("id"), "experience", F.col("q_value").alias("q"))
    return asked, recall.hybrid_for_queries(V.memory(spark, sf_dir), asked, state, F.lit(V.AS_OF).cast("timestamp"))


@query(f"with {_RECALL} select query_id, id, rank::int rank, round(score, 6) score, round(bm25, 6) bm25, q, round(hs, 6) hybrid_score, substr(coalesce(memory, ''), 1, 250) shown from best")
def recall_hooks(spark, sf_dir):
    return rounded(_recalled(spark, sf_dir)[1], "score", "bm25", "hybrid_score")


@query(f"with {_RECALL} select query_id, session_id, substr(query, 1, 200) query, array_to_string(list(id order by rank), ',') memory_ids, array_to_string(list(printf('%.6f', score) order by rank), ',') scores from best join asked using (query_id) where session_id <> 'unknown' group by all")
def recall_log(spark, sf_dir):
    asked, found = _recalled(spark, sf_dir)
    log = recall.retrieval_log(found, asked, F.lit(V.AS_OF).cast("timestamp"))
    return log.select("query_id", "session_id", "query", F.array_join("memory_ids", ",").alias("memory_ids"), F.array_join(F.transform("scores", lambda x: F.format_string("%.6f", x)), ",").alias("scores"))


# Compaction.


def _members(spark, sf_dir):
    return V.memory(spark, sf_dir).selectExpr("id", "label cluster", "cast(id as int) position", "0.5D + (id % 7) / 20.0D similarity")


def _member_state(spark, sf_dir):
    return V.memory(spark, sf_dir).selectExpr("id", "if(id % 3 = 0, null, (id % 10) / 10.0D) q_action", "(id % 4) / 4.0D q_hypothesis", "(id % 5) / 5.0D q_fit", "(id % 9) / 9.0D q_value", "id % 6 q_visits", "if(id % 4 = 0, null, (id % 3 - 1) / 2.0D) last_reward")


@query(rf"""with {_M}, x as (select m.*, label cluster, 0.5 + (id % 7) / 20::double s, case when id % 3 = 0 then null else (id % 10) / 10::double end qa, (id % 4) / 4::double qh, (id % 5) / 5::double qf, (id % 9) / 9::double q, id % 6 v, case when id % 4 = 0 then null else (id % 3 - 1) / 2::double end lr from m join embeddings on vec_id = id),
 g as (select cluster, list(id order by id) ids, list_filter(list_reverse(list(regexp_replace(coalesce(memory, ''), '^\s+|\s+$', '', 'g') order by id)), lambda t: t <> '') l, arg_max({{'t': memory_type, 'c': client_id, 'i': importance}}, (q, -id)) b,
  sum(s * coalesce(qa, 0.5)) / sum(s) a, sum(s * qh) / sum(s) h, sum(s * qf) / sum(s) f, sum(v)::bigint q_visits, case when count(lr) > 1 then 1 / greatest(var_pop(lr), 0.01) else 1 end kappa from x group by 1),
 d as (select *, list_filter(l, lambda t, i: list_position(l, t) = i) u from g)
 select cluster, 'mem_' || substr(sha256(array_to_string(ids, ',')), 1, 16) id, md5(array_to_string(u[1:5], ' | ') || case when len(u) > 5 then ' [+' || (len(u) - 5) || ' merged]' else '' end) memory, b.t memory_type, b.c client_id, b.i importance, len(ids)::int merged, round(0.5 * a + 0.2 * h + 0.3 * f, 6) q_value, q_visits, round(kappa, 6) kappa from d""")
def compacted_memories(spark, sf_dir):
    merged, _ = compaction.compact(_members(spark, sf_dir), V.memory(spark, sf_dir), _member_state(spark, sf_dir))
    out = merged.select("cluster", "id", F.md5("memory").alias("memory"), "memory_type", "client_id", "importance", F.size("merged_from").alias("merged"), "q_value", "q_visits", "kappa")
    return rounded(out, "q_value", "kappa")


@query(f"with {_M} select m.id, case when status = 'active' then 'merged' else status end status from m join embeddings on vec_id = id")
def compaction_statuses(spark, sf_dir):
    return compaction.compact(_members(spark, sf_dir), V.memory(spark, sf_dir), _member_state(spark, sf_dir))[1]


@query(f"with {_M} select id, client_id from m where status = 'active' and (id % 5 = 0 or contains(lower(source), 'c')) order by id limit 10000")
def active_memories(spark, sf_dir):
    m = V.memory_text(spark, sf_dir).withColumn("project", F.expr("if(id % 5 = 0, null, source)"))
    return compaction.active_rows(m, project="C").select("id", "client_id")


# Transcripts.


@query(r"""select conv_id session_id, turn pos, role, case when role = 'user' then 0.5 else 0.4 end::double importance, 'conversation' memory_type from conversations where conv_id % 3 <> 0 and role in ('user', 'assistant') and length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10""")
def ingested_messages(spark, sf_dir):
    m = transcripts.message_rules(V.messages(spark, sf_dir))
    return transcripts.ingest(m, m.where("session_id % 3 = 0").select("session_id")).select("session_id", "pos", "role", F.col("importance").cast("double").alias("importance"), "memory_type")


@query(r"""select count(*) parsed, count(*) filter (where role = 'user') user_messages, count(*) filter (where role = 'assistant') assistant_messages from conversations where role in ('user', 'assistant') and length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10""")
def ingestion_counts(spark, sf_dir):
    return transcripts.ingest_counts(transcripts.message_rules(V.messages(spark, sf_dir)))


@query("""with recursive s as (select conv_id, count(*) c, sum(length(text))::bigint n from conversations group by 1),
 m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i, length(text) n from conversations where conv_id in (select conv_id from s where n > 1200)),
 f as (select conv_id, i, 1 part, n used, n from m where i = 1 union all select m.conv_id, m.i, case when used + m.n > 1200 then part + 1 else part end, case when used + m.n > 1200 then m.n else used + m.n end, m.n from f join m on m.conv_id = f.conv_id and m.i = f.i + 1),
 u as (select conv_id, 0 part, c, n, n size from s where n <= 1200 union all select conv_id, part, count(*), sum(n)::bigint, 1201 from f group by 1, 2),
 o as (select *, row_number() over (order by conv_id, part) i from u),
 p as (select i, conv_id, part, c, n, 1 chunk_id, size used from o where i = 1 union all select o.i, o.conv_id, o.part, o.c, o.n, case when used + o.size > 1200 then chunk_id + 1 else chunk_id end, case when used + o.size > 1200 then o.size else used + o.size end from p join o on o.i = p.i + 1)
 select chunk_id, count(distinct conv_id) sessions, sum(c)::bigint messages, sum(n)::bigint chars, sum(n)::bigint // 4 tokens from p group by 1""")
def transcript_chunks(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("first", F.col("session_id"))
    return transcripts.manifest(transcripts.chunk_transcripts(m, 1200))


@query("""with a as (select conv_id, conv_id % 20 thread, turn, length(text) n, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) own from conversations),
 b as (select *, sum(n) over (partition by thread order by conv_id, turn rows unbounded preceding) w from a where own <= 700) select thread, conv_id session_id, turn pos from b where w <= 3000""")
def thread_messages(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumns({"thread": F.col("session_id") % 20, "first": F.col("session_id")})
    return transcripts.within_budgets(m, 700, 3000).select("thread", "session_id", "pos")


@query(rf"""with c as (select conv_id session_id, conv_id % 10 chunk_id, turn pos, role, text, date '2024-01-01' + (conv_id % 300)::int d from conversations),
 th as (select n_nationkey thread, [n_nationkey % 10, (n_nationkey * 3 + 1) % 10] chunks, [({list(V.TOPICS)})[n_nationkey % 6 + 1], ({list(V.TOPICS)})[(n_nationkey * 5 + 2) % 6 + 1]] names from nation),
 kw as (select thread, chunks, list_distinct(list_filter(flatten(list_transform(names, lambda n: string_split(trim(regexp_replace(lower(n), '[-_\s]+', ' ', 'g')), ' '))), lambda w: length(w) > 2)) words from th),
 k as (select thread, words, unnest(list_distinct(chunks)) chunk_id from kw), st as (select session_id, chunk_id, count(*) n, min(d) d, lower(string_agg(text, ' ' order by pos)) t from c group by 1, 2),
 r as (select thread, chunk_id, session_id, n, d from k join st using (chunk_id) where len(list_filter(words, lambda w: contains(t, w))) >= case when len(words) <= 2 then 1 else 2 end),
 m as (select session_id, role, text, row_number() over (partition by session_id order by pos) pos from c),
 l as (select thread, chunk_id, session_id, 0 pos, 0 gap, true head, chr(10) || '=== ' || strftime(d, '%Y-%m-%d') || ' | session ' || substr(session_id::varchar, 1, 12) || ' | ' || n || ' messages ===' line from r
  union all select thread, chunk_id, session_id, pos, 0, false, case role when 'user' then 'USER: ' when 'assistant' then 'ASSISTANT: ' else '' end || substr(text, 1, 500) || chr(10) from r join m using (session_id) where (n <= 10 or pos <= 5 or pos > n - 3) and coalesce(text, '') <> ''
  union all select thread, chunk_id, session_id, 5, 1, false, '... [' || (n - 8) || ' messages omitted] ...' || chr(10) from r where n > 10),
 o as (select *, row_number() over w i, sum(length(line)) over (w rows unbounded preceding) s from l window w as (partition by thread order by chunk_id, session_id, pos, gap)),
 x as (select thread, min(i) filter (where not head and s > 3000) stop from o group by 1)
 select thread, count(*)::int lines, sum(length(line))::bigint chars, any_value(stop is not null) truncated, md5(string_agg(line, chr(10) order by i) || case when any_value(stop is not null) then chr(10) || '... [truncated] ...' else '' end) text
 from o join x using (thread) where stop is null or i < stop group by thread""")
def gathered_threads(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("created_at", F.expr("date_add(date '2024-01-01', cast(session_id % 300 as int))"))
    sessions = m.groupBy("session_id").agg(F.min("session_id").alias("first")).withColumn("chunk_id", F.col("session_id") % 10)
    return transcripts.gather_threads(V.threads(spark, sf_dir), sessions, m, 3000).withColumn("text", F.md5("text"))


# Dashboard.

_QS = """qs as (select c_custkey memory_id, case when c_custkey % 4 = 0 then 'sales' else 'default' end experience, (c_custkey % 151 - 50) / 100::double q_value, (c_custkey % 131 - 40) / 100::double q_action, case when c_custkey % 3 = 0 then null else (c_custkey % 7) / 10::double end q_hypothesis, case when c_custkey % 5 = 0 then null else (c_custkey % 9) / 10::double end q_fit,
 (c_custkey % 12)::int q_visits, (['', null, 'high', 'low'])[c_custkey % 4 + 1] calibration, case when c_custkey % 17 = 0 then null else strftime(date '2024-01-01' + (c_custkey % 60)::int, '%Y-%m-%d') end q_updated_at, (c_custkey % 21 - 10) / 10::double last_reward from customer),
 qd as (select * replace (coalesce(q_hypothesis, 0.5) as q_hypothesis, coalesce(q_fit, 0.5) as q_fit) from qs where experience = 'default')"""
_RT = "rt as (select event_id id, user_id session_id, ts, event_id % 3 = 0 short, [(event_id % 100) / 99::double, (event_id % 7) / 7::double] scores from events where event_type = 'view')"


@query(f"""with {_QS}, x as (select unnest([{{'l': 'q_value', 'x': q_value}}, {{'l': 'q_action', 'x': q_action}}, {{'l': 'q_hypothesis', 'x': q_hypothesis}}, {{'l': 'q_fit', 'x': q_fit}}]) p from qd), h as (select p.l layer, greatest(0, least(14, trunc((p.x + 0.5) / (1.5::double / 15))::int)) bin, count(*) n from x group by 1, 2)
 select layer, b::int bin, coalesce(n, 0) count from (select unnest(['q_value', 'q_action', 'q_hypothesis', 'q_fit']) layer) cross join range(15) t(b) left join h on h.layer = layer and h.bin = b""".replace("select layer, b::int bin", "select z.layer, b::int bin").replace(") cross join range", ") z cross join range").replace("on h.layer = layer", "on h.layer = z.layer"))
def layer_distributions(spark, sf_dir):
    return dashboard.layer_distributions(V.usefulness_rows(spark, sf_dir))


@query(f"with {_QS} select q_updated_at date, round(avg(q_value)::decimal(18, 9), 4)::double mean_value, round(avg(q_action)::decimal(18, 9), 4)::double mean_action, round(avg(q_hypothesis)::decimal(18, 9), 4)::double mean_hypothesis, round(avg(q_fit)::decimal(18, 9), 4)::double mean_fit, count(*) count_updated from qd where q_updated_at is not null group by 1")
def layer_evolution(spark, sf_dir):
    return dashboard.evolution(V.usefulness_rows(spark, sf_dir))


@query(f"with {_QS} select q_visits visits, count(*) count from qd group by 1")
def visits_distribution(spark, sf_dir):
    return dashboard.visits(V.usefulness_rows(spark, sf_dir))


@query(f"with {_QS} select case when coalesce(calibration, '') = '' then 'uncalibrated' else calibration end calibration, count(*) count from qd group by 1")
def calibration_counts(spark, sf_dir):
    return dashboard.calibrations(V.usefulness_rows(spark, sf_dir))


@query(f"with {_M} select memory_type, count(*) count from m group by 1")
def memory_type_counts(spark, sf_dir):
    return dashboard.memory_types(V.memory_text(spark, sf_dir))


@query(f"with {_RT} select strftime(ts, '%Y-%m-%d') date, count(*) count from rt group by 1")
def retrievals_by_date(spark, sf_dir):
    return dashboard.retrievals_by_date(V.retrievals(spark, sf_dir))


@query(f"with {_RT}, h as (select greatest(0, least(9, trunc(s / 0.1::double)::int)) b, count(*) n from (select unnest(scores) s from rt) group by 1) select x::int bin, coalesce(n, 0) count from range(10) t(x) left join h on b = x")
def retrieval_scores(spark, sf_dir):
    return dashboard.score_histogram(V.retrievals(spark, sf_dir))


@query(f"with {_PO} select count(*) total, count(*) filter (where status = 'resolved') resolved, count(*) filter (where status = 'pending') pending, round((avg(coalesce(reward, 0)) filter (where status = 'resolved'))::decimal(18, 9), 4)::double avg_reward from pr")
def prediction_summary(spark, sf_dir):
    p, o = V.predictions(spark, sf_dir)
    return dashboard.prediction_summary(outcomes.resolve_predictions(p, o.withColumn("source_pos", F.lit(0))))


@query(f"with {_QS} select '2024-06-01' date, experience, count(*) count, round(avg(q_value)::decimal(18, 9), 4)::double mean, round(min(q_value)::decimal(18, 9), 4)::double min, round(max(q_value)::decimal(18, 9), 4)::double max from qs group by 1, 2")
def daily_usefulness(spark, sf_dir):
    return dashboard.daily_stats(V.usefulness_rows(spark, sf_dir), "2024-06-01")


# Retrospectives.


def _reward_events(spark, sf_dir):
    return V.rewards(spark, sf_dir).withColumn("memory_ids", F.array("memory_id"))


@query(f"with {_R} select reward_type, count(*) events, round(sum(reward), 6) total from r where strftime(ts, '%G-W%V') = (select strftime(min(ts) + interval 7 day, '%G-W%V') from r) group by 1")
def weekly_rewards(spark, sf_dir):
    events = _reward_events(spark, sf_dir)
    week = events.agg(retrospective.period_of(F.min("ts") + F.expr("INTERVAL 7 DAYS"), "weekly").alias("w")).first()["w"]
    return rounded(retrospective.rewards_in(events, "weekly", week).groupBy("reward_type").agg(F.count(F.lit(1)).alias("events"), F.sum("reward").alias("total")), "total")


@query(f"""with {_QS}, s as (select * replace (coalesce(q_hypothesis, 0) as q_hypothesis, coalesce(q_fit, 0) as q_fit) from qs), w as (select memory_id, row_number() over (order by memory_id) - 1 pos from (select memory_id from s order by memory_id limit 20)),
 c as (select memory_id, case pos % 4 when 0 then 0.3 when 1 then -0.6 when 2 then 0.3 * (case when pos % 8 = 2 then -1 else 1 end) end::double r, case when pos % 4 = 3 then 0.25 end::double t from w),
 d as (select s.*, r, t, t - (0.5 * q_action + 0.2 * q_hypothesis + 0.3 * q_fit) delta from s left join c using (memory_id)),
 e as (select memory_id, q_visits + (r is not null or t is not null)::int q_visits, greatest(-0.5, least(1, q_action + case when t is not null then case when abs(delta) >= 1e-6 then delta else 0 end else coalesce(0.25 * r, 0) end)) a,
  greatest(-0.5, least(1, q_hypothesis + case when t is not null then case when abs(delta) >= 1e-6 then delta else 0 end else coalesce(0.25 * 0.8 * r, 0) end)) h, greatest(-0.5, least(1, q_fit + case when t is not null then case when abs(delta) >= 1e-6 then delta else 0 end else coalesce(0.25 * case when r > 0 then r else 0.5 * r end, 0) end)) f from d)
 select memory_id, q_visits, round(0.5 * a + 0.2 * h + 0.3 * f, 6) q_value from e""")
def adjusted_usefulness(spark, sf_dir):
    state = V.usefulness_rows(spark, sf_dir).fillna(0.0, ["q_hypothesis", "q_fit"])
    wanted = state.orderBy("memory_id").limit(C.MAX_ADJUSTMENTS).selectExpr("memory_id", "row_number() over (order by memory_id) - 1 pos")
    wanted = wanted.selectExpr("memory_id", "pos", "element_at(array('promote', 'demote', 'adjust', 'override'), cast(pos % 4 + 1 as int)) action", "case when pos % 4 = 1 then 0.6D when pos % 8 = 2 then -0.3D else 0.3D end reward", "0.25D target_q")
    return rounded(usefulness.adjusted(state, usefulness.adjustments(state, wanted)).select("memory_id", "q_visits", "q_value"), "q_value")


@query("""with b as (select item_id, text from benchmark), a as (select item_id::varchar period, substr(text, 1, 40) || case when item_id % 2 = 0 then chr(10) || 'Patterns: p' || item_id || '; q' else '' end memory, 'retrospective_daily' memory_type, 0.8::double importance from b),
 i as (select item_id::varchar period, substr(text, k * 10, case when k = 3 then 0 else 10 end) memory, 'insight' memory_type, case when k = 2 then 0.7 else 0.5 end::double importance from b, range(1, 8) t(k) where k <= 5 and k <> 3) select * from a union all select * from i""")
def retrospective_memories(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark")
    analyses = b.select(
        F.col("item_id").cast("string").alias("period"), F.substring("text", 1, 40).alias("summary"), F.expr("if(item_id % 2 = 0, array(concat('p', item_id), 'q'), cast(array() as array<string>))").alias("patterns"),
        F.expr("transform(sequence(1, 7), k -> struct(if(k = 3, '', substring(text, k * 10, 10)) as content, if(k = 2, cast(null as double), 0.5D) as importance))").alias("insights"),
    )
    return retrospective.memories_of("daily", analyses).select("period", "memory", "memory_type", "importance")


# Replays.

_OBS = f"ob as (select event_id id, user_id session_id, ts, (['Bash', 'Edit', 'Write'])[event_id % 3 + 1] tool, ({list(V.SUMMARIES)})[event_id % 10 + 1] summary from events where event_type <> 'view')"
_KIND = """case when contains(s, 'read_email') or contains(s, 'gmail') then case when contains(s, 'unread') or contains(s, 'inbox') then 'scan_inbox' when contains(s, 'from:') or contains(s, '--full') then 'read_email' when contains(s, 'in:sent') then 'check_sent' when contains(s, 'subject:') then 'search_email' else 'read_email' end
 when contains(s, 'send_email') then 'send_email' when contains(s, 'search_memory') or contains(s, 'search -q') then 'recall' when contains(s, 'add_memory') then 'store' when contains(s, 'crm') or contains(s, 'leads.csv') or contains(s, 'activities.csv') then 'crm' when tool = 'Edit' then 'edit' when tool = 'Write' then 'write'
 when contains(s, 'grep') or contains(s, 'search') then 'search' when contains(s, 'git commit') or contains(s, 'git push') then 'commit' else 'action' end"""
_STEPS = rf"""k as (select *, lower(summary) s from ob), w as (select session_id, row_number() over (partition by session_id order by ts, id)::int idx, {_KIND} kind, regexp_replace(summary, '/home/[\p{{L}}\p{{N}}_]+(?:/[^\s"'']*)?', '/~/...', 'g') summary, ts from k),
 e as (select session_id, min(ts) a, max(ts) b, max(idx) n from w group by 1), sp as (select session_id, 0 idx, 'session_start' kind, null summary, a ts from e union all select * from w union all select session_id, n + 1, 'session_end', null, b from e)"""


@query(f"with {_OBS}, {_STEPS} select session_id, idx::int \"index\", kind, summary from sp")
def replay_steps(spark, sf_dir):
    return replay.steps(V.observations(spark, sf_dir)).select("session_id", "index", "kind", "summary")


@query(f"""with {_OBS}, {_STEPS}, {_RT}, r2 as (select *, row_number() over (partition by session_id order by ts, id) n from rt),
 u as (select r.id, r.session_id, 'look at item ' || r.id t, min(idx) filter (where kind <> 'session_start' and sp.ts >= r.ts) x, max(idx) m from r2 r join sp using (session_id) where n > 1 and not short group by all)
 select session_id, coalesce(x, m)::int "index", 'user' as role, t as text from u union all select session_id, idx::int, case when kind = 'session_end' then 'system' else 'assistant' end, null from sp where kind <> 'session_start'""")
def replay_conversation(spark, sf_dir):
    said = replay.conversation(replay.steps(V.observations(spark, sf_dir)), V.retrievals(spark, sf_dir).join(V.observations(spark, sf_dir).select("session_id").distinct(), "session_id", "left_semi"))
    return said.select("session_id", "index", "role", F.when(F.col("role") == "user", F.col("text")).alias("text"))


@query(f"""with {_RT}, {_OBS}, r2 as (select *, row_number() over (partition by session_id order by ts, id) n from rt), f as (select session_id, id recall_id, ts from r2 where n = 2)
 select ob.id, case when f.ts <= ob.ts then recall_id end recall_id from ob left join f using (session_id)""")
def observation_recall(spark, sf_dir):
    return replay.with_recall(V.observations(spark, sf_dir), V.retrievals(spark, sf_dir)).select("id", "recall_id")


@query(f"""with {_OBS}, {_STEPS}, b as (select session_id, (idx - 1) // 4 + 1 beat, list(kind order by idx) ks from w group by 1, 2), v as (select *, list_transform(ks, lambda k: map {{'scan_inbox': 'checking the inbox', 'read_email': 'reading the email thread', 'check_sent': 'checking sent history', 'search_email': 'searching emails', 'send_email': 'sending the email reply', 'recall': 'recalling relevant memories', 'store': 'storing a new memory', 'crm': 'updating the CRM', 'edit': 'editing files', 'write': 'writing files', 'search': 'searching for context', 'commit': 'committing changes', 'action': 'working on it'}}[k]) a from b),
 d as (select *, list_filter(a, lambda t, i: list_position(a, t) = i) l from v) select session_id, beat::bigint beat, 'I''ll handle this by ' || case when len(l) = 1 then l[1] else array_to_string(l[1:-2], ', ') || ' and ' || l[-1] end || '.' subtitle, len(ks)::int actions, greatest(3500, 1200 * len(ks))::int duration from d""")
def beat_subtitles(spark, sf_dir):
    walk = replay.steps(V.observations(spark, sf_dir)).where("kind not in ('session_start', 'session_end')")
    return replay.beat_summaries(walk.withColumn("beat", F.expr("cast((index - 1) div 4 + 1 as bigint)")))


@query(f"with {_QS} select memory_id, experience, round(0.5 * 0.25 * last_reward, 4) q_delta, case when last_reward > 0 then 'positive' when last_reward < 0 then 'negative' else 'neutral' end direction from qs")
def usefulness_before(spark, sf_dir):
    return replay.before_after(V.usefulness_rows(spark, sf_dir)).select("memory_id", "experience", "q_delta", "direction")


@query(f"""with {_OBS}, k as (select *, lower(summary) s from ob), d as (select session_id, count(*) actions, count(*) filter (where contains(s, 'email') and (contains(s, 'read') or contains(s, 'inbox') or contains(s, 'gmail'))) email_read, count(*) filter (where contains(s, 'send_email')) email_sent, count(*) filter (where contains(s, 'crm') or contains(s, 'leads') or contains(s, 'activities')) crm_ops,
 count(*) filter (where tool in ('Edit', 'Write')) files_modified, count(*) filter (where contains(s, 'add_memory')) memories_stored, count(*) filter (where contains(s, 'git commit')) commits from k group by 1), t as (select user_id session_id, case when value > 60 then 1 when value < 40 then -1 else 0 end x from events where event_type = 'view'),
 m as (select session_id, count(*) filter (where x > 0) up, count(*) filter (where x < 0) down from t group by 1)
 select d.*, coalesce(up, 0) reinforced, coalesce(down, 0) penalized, case when coalesce(up, 0) > 0 and coalesce(down, 0) = 0 then 'productive' when coalesce(up, 0) > coalesce(down, 0) then 'mostly_productive' when coalesce(down, 0) > 2 * coalesce(up, 0) then 'unproductive' else 'mixed' end verdict from d left join m using (session_id)""")
def session_outcomes(spark, sf_dir):
    touched = V.table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr("user_id session_id", "case when value > 60 then 'positive' when value < 40 then 'negative' else 'neutral' end direction")
    return replay.session_outcome(V.observations(spark, sf_dir), touched)


@query(r"""with r as (select event_id id, case when event_id % 3 = 0 then null else 'look at item ' || event_id end t from events where event_type = 'view') select id, t query from r""")
def cleaned_queries(spark, sf_dir):
    return V.retrievals(spark, sf_dir).select("id", T.clean_query(F.col("query")).alias("query"))


@query(f"with {_R} select memory_id, reward_id, reward from r where memory_id % 10 = 3")
def reward_history(spark, sf_dir):
    events = _reward_events(spark, sf_dir).drop("memory_id")
    asked = V.table(spark, sf_dir, "events").where("user_id % 10 = 3").select(F.col("user_id").alias("memory_id"))  # the history of these memories is what is asked for
    return usefulness.reward_history(events, asked).select("memory_id", "reward_id", "reward")


# Questions with corpora of their own.

_HAY = r"""d as (select conv_id // 20 query_id, conv_id pos, conv_id::varchar doc_id, string_agg(text, chr(10) order by turn) text, (conv_id * 37 % 101) / 100::double sim, date '2024-01-01' + (conv_id % 400)::int dt from conversations where role = 'user' group by conv_id),
 w as (select conv_id // 20 query_id, list_distinct(regexp_extract_all(lower(arg_min(text, (conv_id, turn))), '[\p{L}\p{N}_]+')) qw from conversations where role = 'user' group by 1),
 t as (select d.*, qw, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') tk from d join w using (query_id)), a as (select *, avg(len(tk)) over (partition by query_id) av from t),
 b as (select *, list_sum(list_transform(qw, lambda x: len(list_filter(tk, lambda y: y = x)) * 2.5::double / (len(list_filter(tk, lambda y: y = x)) + 1.5 * (0.25 + 0.75 * len(tk) / av)))) bm from a),
 c as (select *, case when max(bm) over p > 0 then bm / max(bm) over p else 0 end kw, row_number() over (partition by query_id order by sim desc, pos) v from b window p as (partition by query_id))"""


def _haystack(spark, sf_dir):
    turns = V.messages(spark, sf_dir).selectExpr("session_id div 20 query_id", "session_id", "session_id session_pos", "pos turn", "role", "text content", "date_add(date '2024-01-01', cast(session_id % 400 as int)) date")
    docs = evaluation.corpus(turns).withColumn("sim", F.expr("(pos * 37 % 101) / 100.0D"))
    first = turns.where("role = 'user'").groupBy("query_id").agg(F.min_by("content", F.struct("session_id", "turn")).alias("query")).withColumn("asked", F.expr("date '2024-12-31'"))
    return docs, first


@query(f"""with {_HAY}, s as (select *, round(case when v <= 5 then sim * 0.75 else 0 end + 0.1 * kw + 0.15 * greatest(0, 1 - date_diff('day', dt, date '2024-12-31') / 365::double), 9) score from c)
 select query_id, doc_id, row_number() over (partition by query_id order by score desc, (v <= 5) desc, case when v <= 5 then v else pos end) rank, round(score, 6) score from s""")
def retrieval_full(spark, sf_dir):
    return rounded(evaluation.retrieved(*_haystack(spark, sf_dir), "full", 5), "score")


@query(f"with {_HAY} select query_id, doc_id, row_number() over (partition by query_id order by (v <= 5) desc, case when v <= 5 then v else pos end) rank from c")
def retrieval_raw(spark, sf_dir):
    return evaluation.retrieved(*_haystack(spark, sf_dir), "raw", 5).select("query_id", "doc_id", "rank")


@query("""select conv_id // 20 query_id, conv_id || '_turn_' || (row_number() over (partition by conv_id order by turn) - 1) doc_id, conv_id::varchar session_id, length(text) chars from conversations where role = 'user'""")
def question_corpora(spark, sf_dir):
    turns = V.messages(spark, sf_dir).selectExpr("session_id div 20 query_id", "session_id", "session_id session_pos", "pos turn", "role", "text content", "date '2024-01-01' date")
    out = evaluation.corpus(turns, "turn")
    return out.select("query_id", "doc_id", evaluation.session_of(F.col("doc_id")).alias("session_id"), F.length("text").cast("long").alias("chars"))


@query(f"""with {_OBS}, {_STEPS}, {_RT}, r2 as (select *, list_transform([3, 5, 7, 11, 13, 17, 19], lambda k: substr((id % (k * 10))::varchar, 1, 8)) ids, row_number() over (partition by session_id order by ts, id) n from rt),
 u0 as (select r.id, r.session_id, n, 'look at item ' || r.id t, min(idx) filter (where kind <> 'session_start' and sp.ts >= r.ts) x, max(idx) m from r2 r join sp using (session_id) where n > 1 and not short group by all),
 u as (select session_id, t, coalesce(x, m) idx, row_number() over (partition by session_id order by coalesce(x, m), t) beat from u0), ut as (select session_id, beat, last(t) over (partition by session_id, idx order by beat rows between unbounded preceding and unbounded following) title from u),
 st as (select w.session_id, w.idx, greatest(1, (select count(*) from u where u.session_id = w.session_id and u.idx <= w.idx)) beat, f.ids later from w left join r2 f on f.session_id = w.session_id and f.n = 2 and f.ts <= w.ts),
 b as (select session_id, beat, 'user_turn' as type, title from ut union all select distinct session_id, 1, 'auto', 'Automated work' from w where session_id not in (select session_id from u)),
 a as (select session_id, beat, count(*) actions, any_value(later) later from st group by 1, 2),
 t as (select b.session_id, b.beat, type, title, coalesce(actions, 0) actions, list_concat(case when b.beat = 1 then coalesce(s.ids[1:6], []::varchar[]) else []::varchar[] end, coalesce(later[1:4], []::varchar[])) l from b left join a using (session_id, beat) left join r2 s on s.session_id = b.session_id and s.n = 1),
 x as (select session_id, beat, type, title, actions, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') memories, greatest(3500, 1200 * actions) duration from t)
 select session_id, beat::int beat, type, title, actions::int actions, memories, duration::int duration from x union all select session_id, 0, 'system_start', 'Session Start', 0, '', 2000 from e union all select e.session_id, 1 + coalesce((select max(beat) from x where x.session_id = e.session_id), 0)::int, 'system_end', 'Session Complete', 0, '', 5000 from e""")
def session_beats(spark, sf_dir):
    out = replay.export_session("", V.observations(spark, sf_dir), V.retrievals(spark, sf_dir), V.usefulness_rows(spark, sf_dir).where("experience = 'default'"))["beats"]
    return out.drop("subtitle").withColumn("memories", F.array_join("memories", ","))


# Lists, counts and lookups.


@query(f"with {_QS} select distinct experience from qs")
def experiences_present(spark, sf_dir):
    return usefulness.experience_names(V.usefulness_rows(spark, sf_dir))


@query(f"with {_RT}, s as (select unnest(scores) x from rt) select round(avg(x), 6) mean, round(stddev_pop(x), 6) std from s")
def similarity_calibration(spark, sf_dir):
    return rounded(analytics.calibration(V.retrievals(spark, sf_dir).select(F.explode("scores").alias("x")), "x"), "mean", "std")


@query(f"with {_OBS} select strftime(ts, '%Y-%m-%d') date, count(*) observations, count(distinct session_id) sessions from ob group by 1")
def observation_timeline(spark, sf_dir):
    return dashboard.by_date(V.observations(spark, sf_dir))


@query("select count(*) total, count(*) filter (where quality = 1 and toxic = 0) processed, count(*) filter (where quality = 0 and toxic = 0) skipped, count(*) filter (where toxic = 1) failed from labels")
def run_counts(spark, sf_dir):
    status = F.expr("case when toxic = 1 then 'failed' when quality = 1 then 'processed' when quality = 0 then 'skipped' end")
    return transcripts.run_counts(V.table(spark, sf_dir, "labels").withColumn("status", status))


@query("with t as (select conv_id thread, count(*) total_messages from conversations group by 1) select thread, total_messages, row_number() over (order by total_messages desc, thread) place from t")
def threads_by_messages(spark, sf_dir):
    t = V.messages(spark, sf_dir).groupBy(F.col("session_id").alias("thread")).agg(F.count(F.lit(1)).alias("total_messages"))
    return transcripts.by_messages(t)


@query(f"with {_OBS} select id, tool, summary, case when id % 2 = 0 then 'feature' end as type, case when id % 3 <> 0 then '/tmp/f' || (id % 7) end file_path, case when id % 5 = 0 then '' else 't' || (id % 5) end tags from ob")
def compact_observations(spark, sf_dir):
    rows = V.observations(spark, sf_dir).selectExpr("*", "if(id % 2 = 0, 'feature', null) type", "if(id % 3 = 0, null, named_struct('file_path', concat('/tmp/f', id % 7), 'command', 'x')) context", "if(id % 5 = 0, null, array(concat('t', id % 5))) tags")
    return rows.select(*T.compact_observation()).withColumn("tags", F.array_join("tags", ","))


@query("select c_custkey id, coalesce(([0.0, 0.02, 0.05, 0.07, 0.10, 0.12, 0.15, 0.20, 0.25, 0.28, 0.30]::double[])[c_custkey % 14 + 1], 0) weight from customer")
def rating_weights(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.rating_weight((F.col("c_custkey") % 14).cast("int")).alias("weight"))


@query(f"with {_M} select id, md5(memory) memory, session_id, created_at from m where source = (select min(source) from m)")
def memories_of_source(spark, sf_dir):
    m = V.memory_text(spark, sf_dir)
    first = m.agg(F.min("source").alias("s")).first()["s"]
    return search.of_source(m, first).withColumn("memory", F.md5("memory"))


@query(f"""with {_M}, t as (select *, case id % 3 when 0 then 'user' when 1 then 'assistant' else 'tool' end as role, case when id % 11 = 0 then 'experience_library' else source end s from m), n as (select unnest(['experience_library', 'absent', (select min(source) from m)]) s)
 select 'total' kind, 'all' as name, (select count(*) from t) count union all select 'source', n.s, count(t.id) from n left join t using (s) group by n.s union all select 'role', role, count(*) from t where role <> 'tool' group by role union all select 'library', 'experience_library', (select count(*) from t where s = 'experience_library')""")
def memory_stats(spark, sf_dir):
    m = V.memory_text(spark, sf_dir)
    first = m.agg(F.min("source").alias("s")).first()["s"]
    rows = m.selectExpr("id", "if(id % 11 = 0, 'experience_library', source) source", "element_at(array('user', 'assistant', 'tool'), cast(id % 3 + 1 as int)) role")
    return dashboard.memory_stats(rows, ("experience_library", "absent", first))


@query(f"with {_M} select id, substr(memory, 1, 300) content from m where id % 50 = 0")
def memory_contents(spark, sf_dir):
    m = V.memory_text(spark, sf_dir)
    return search.contents(m, m.where("id % 50 = 0").select("id"))


@query(f"with {_M} select id, md5(coalesce(case when id % 4 <> 0 then memory end, source)) memory, 'unknown' agent_id, coalesce(case when id % 3 <> 0 then memory_type end, 'fact') memory_type, coalesce(case when id % 5 <> 0 then source end, 'unknown') source, coalesce(case when id % 7 <> 0 then status end, 'active') status from m")
def projected_rows(spark, sf_dir):
    m = V.memory_text(spark, sf_dir).selectExpr("id", "if(id % 4 = 0, null, memory) memory", "source data", "if(id % 3 = 0, null, memory_type) memory_type", "if(id % 5 = 0, null, source) source", "if(id % 7 = 0, null, status) status")
    return search.projected(m).drop("data").withColumn("memory", F.md5("memory"))


@query("select regexp_extract(url, '^[a-z]+://([^/]*)', 1) folder, count(*) files from pages group by 1 order by 2 desc, 1 limit 1")
def busiest_folder(spark, sf_dir):
    return retrospective.busiest_folder(V.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("folder")))


@query("""with c as (select conv_id session_id, conv_id % 10 chunk_id, turn pos, role, text, row_number() over (partition by conv_id order by turn) i, count(*) over (partition by conv_id) n from conversations where coalesce(text, '') <> ''),
 sh as (select conv_id % 10 chunk_id, greatest(9000 // count(distinct conv_id), 150) share from conversations group by 1), k as (select *, greatest(n // 3, 5) keep from c),
 e as (select chunk_id, session_id, i pos, 0 gap, case role when 'user' then 'USER: ' when 'assistant' then 'ASSISTANT: ' else '' end || text || chr(10) line from k where n <= 20 or i <= keep or i > n - keep
  union all select chunk_id, session_id, any_value(keep), 1, '... [' || (any_value(n) - 2 * any_value(keep)) || ' messages omitted] ...' || chr(10) from k where n > 20 group by 1, 2),
 o as (select *, sum(length(line)) over (partition by session_id order by pos, gap) own from e), q as (select * from o join sh using (chunk_id)),
 l as (select chunk_id, session_id, pos, gap, false head, line, length(line) size from q where own <= share
  union all select chunk_id, session_id, min(pos * 2 + gap) // 2, min(pos * 2 + gap) % 2, true, '... [session truncated] ...', 0 from q where own > share group by 1, 2
  union all select chunk_id, session_id, 0, 0, true, chr(10) || '=== SESSION ' || substr(session_id::varchar, 1, 12) || ' (' || any_value(n) || ' messages) ===', length(chr(10) || '=== SESSION ' || substr(session_id::varchar, 1, 12) || ' (' || any_value(n) || ' messages) ===') from k group by 1, 2),
 g as (select *, row_number() over w i, sum(size) over (w rows unbounded preceding) s from l window w as (partition by chunk_id order by session_id, pos, gap)), x as (select chunk_id, min(i) filter (where not head and s > 9000) stop from g group by 1)
 select chunk_id, count(*)::int lines, sum(size)::bigint chars, any_value(stop is not null) truncated, md5(string_agg(line, chr(10) order by i) || case when any_value(stop is not null) then chr(10) || '... [chunk truncated] ...' else '' end) text from g join x using (chunk_id) where stop is null or i < stop group by chunk_id""")
def chunk_texts(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    sessions = m.groupBy("session_id").agg(F.min("session_id").alias("first")).withColumn("chunk_id", F.col("session_id") % 10)
    return transcripts.chunk_texts(sessions, m, 9000, 150).withColumn("text", F.md5("text"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
