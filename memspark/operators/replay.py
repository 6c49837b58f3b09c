"""Replays: a session's observations and retrievals as steps, conversation and beats, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions.text import clean_query, redact_people, truncate

# The kinds of a step with their labels, each with the texts of which one must be in the summary (and a tool), in order.
STEPS = (
    ("send_email", "Sending email reply", ("send_email",), None),
    ("recall", "Recalling memories", ("search_memory", "search -q"), None),
    ("store", "Storing new memory", ("add_memory",), None),
    ("crm", "Updating CRM", ("crm", "leads.csv", "activities.csv"), None),
    ("edit", "Editing file", (), "Edit"),
    ("write", "Writing file", (), "Write"),
    ("search", "Searching context", ("grep", "search"), None),
    ("commit", "Committing changes", ("git commit", "git push"), None),
)
# What a summary of reading mail is, by the next text in it.
MAIL = (("scan_inbox", "Scanning inbox", ("unread", "inbox")), ("read_email", "Reading email thread", ("from:", "--full")), ("check_sent", "Checking sent history", ("in:sent",)), ("search_email", "Searching emails", ("subject:",)))
# What is said of each kind of step.
VERBS = {
    "scan_inbox": "checking the inbox", "read_email": "reading the email thread", "check_sent": "checking sent history", "search_email": "searching emails", "send_email": "sending the email reply", "recall": "recalling relevant memories",
    "store": "storing a new memory", "crm": "updating the CRM", "edit": "editing files", "write": "writing files", "search": "searching for context", "commit": "committing changes", "action": "working on it",
}
ROLES = ("user", "assistant", "system")
RECALLED_AT_START, RECALLED_LATER = 6, 4


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def step_kind(tool: Column, summary: Column) -> Column:
    """(kind, label) of an observation, by the first rule that fits."""
    s = F.lower(F.coalesce(summary, F.lit("")))
    said = lambda kind, label: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))
    out = said("action", "Working")
    for kind, label, parts, name in reversed(STEPS):
        fits = F.coalesce(tool == name, F.lit(False)) if name else _any(s, parts)
        out = F.when(fits, said(kind, label)).otherwise(out)
    mail = said("read_email", "Reading emails")
    for kind, label, parts in reversed(MAIL):
        mail = F.when(_any(s, parts), said(kind, label)).otherwise(mail)
    return F.when(_any(s, ("read_email", "gmail")), mail).otherwise(out)


def steps(observations: DataFrame, session: str = "session_id", ts: str = "ts") -> DataFrame:
    """session, index, kind, label, summary, ts: a start, each observation in order, and an end."""
    w = Window.partitionBy(session).orderBy(ts, "id")
    rows = observations.withColumns({"k": step_kind(F.col("tool"), F.col("summary")), "index": F.row_number().over(w)})
    work = rows.select(session, "index", "k.kind", "k.label", redact_people(F.col("summary")).alias("summary"), ts)
    edge = rows.groupBy(session).agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.max("index").alias("n"))
    start = edge.select(session, F.lit(0).alias("index"), F.lit("session_start").alias("kind"), F.lit("Session start").alias("label"), F.lit(None).cast("string").alias("summary"), F.col("a").alias(ts))
    end = edge.select(session, (F.col("n") + 1).alias("index"), F.lit("session_end").alias("kind"), F.lit("Session end").alias("label"), F.lit(None).cast("string").alias("summary"), F.col("b").alias(ts))
    return start.unionByName(work).unionByName(end)


def recalled(retrievals: DataFrame, session: str = "session_id", ts: str = "ts") -> DataFrame:
    """session, n, ts, query, memory_ids: retrievals in order; the first keeps six ids, later ones four."""
    rows = retrievals.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(ts, "id")))
    return rows.withColumn("memory_ids", F.slice("memory_ids", 1, F.when(F.col("n") == 1, RECALLED_AT_START).otherwise(RECALLED_LATER)))


def with_recall(observations: DataFrame, retrievals: DataFrame, session: str = "session_id", ts: str = "ts") -> DataFrame:
    """Each observation with ``recall_id``: the session's first retrieval after its opening one, if that is not later than the observation."""
    rows = retrievals.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(ts, "id"))).where("n > 1")
    first = rows.groupBy(session).agg(F.min_by(F.struct(F.col("id").alias("recall_id"), F.col(ts).alias("_at")), "n").alias("_r"))
    out = observations.join(first, session, "left")
    return out.withColumn("recall_id", F.when(F.col("_r._at") <= F.col(ts), F.col("_r.recall_id"))).drop("_r")


def conversation(walk: DataFrame, retrievals: DataFrame, session: str = "session_id", ts: str = "ts") -> DataFrame:
    """session, index, role, text, in order of ``place``: what the user asked (at the first later step, or the last), what was done, and the end.

    The opening retrieval is none of the user's. One union and a window find the step of each question.
    """
    asked = retrievals.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(ts, "id"))).where("n > 1")
    asked = asked.select(session, F.col(ts).alias("_t"), clean_query(F.col("query")).alias("text"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("index")).where("text is not null")
    at = walk.where("kind != 'session_start'").select(session, F.col(ts).alias("_t"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("_kind"), "index")
    w = Window.partitionBy(session).orderBy("_t", "_kind", "index")
    later = F.first("index", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.max("index").over(Window.partitionBy(session))
    user = asked.unionByName(at).withColumns({"_at": F.coalesce(later, last)}).where("_kind = 0").select(session, F.col("_at").alias("index"), F.lit("user").alias("role"), "text")
    work = walk.where("kind not in ('session_start', 'session_end')").select(session, "index", F.lit("assistant").alias("role"), F.col("label").alias("text"))
    end = walk.where("kind = 'session_end'").select(session, "index", F.lit("system").alias("role"), F.col("label").alias("text"))
    said = user.unionByName(work).unionByName(end)
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return said.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy("index", role, "text")))


def actions_sentence(kinds: Column) -> Column:
    """What the kinds of steps come to, in one sentence: each thing once, in order."""
    verb = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    verbs = F.array_distinct(F.transform(kinds, lambda k: F.coalesce(verb[k], F.lit(VERBS["action"]))))
    listed = F.concat(F.array_join(F.slice(verbs, 1, F.greatest(F.size(verbs) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(verbs, -1))
    return F.when(F.size(verbs) == 0, "Working on it.").otherwise(F.concat(F.lit("I'll handle this by "), F.when(F.size(verbs) == 1, F.element_at(verbs, 1)).otherwise(listed), F.lit(".")))


def beat_summaries(steps_in_beats: DataFrame, session: str = "session_id") -> DataFrame:
    """session, beat, subtitle, actions, duration of beats (rows with beat, index, kind)."""
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("index", "kind"))), lambda x: x["kind"])
    out = steps_in_beats.groupBy(session, "beat").agg(kinds.alias("k"))
    return out.select(session, "beat", actions_sentence(F.col("k")).alias("subtitle"), F.size("k").alias("actions"), F.greatest(F.lit(3500), 1200 * F.size("k")).alias("duration"))


def recalled_steps(walk: DataFrame, retrievals: DataFrame, session: str = "session_id", ts: str = "ts") -> DataFrame:
    """``walk`` with ``memory_ids``: at the start the first retrieval's, at a step those of the first later retrieval that is not after the step; the first eight characters of each."""
    short = F.transform("memory_ids", lambda m: F.substring(m.cast("string"), 1, 8))
    of = recalled(retrievals, session, ts).where("n <= 2").select(session, "n", F.col(ts).alias("_t"), short.alias("_ids"))
    both = of.groupBy(session).agg(F.max(F.when(F.col("n") == 1, F.col("_ids"))).alias("_first"), F.max(F.when(F.col("n") == 2, F.struct("_t", "_ids"))).alias("_later"))
    start, work = F.col("kind") == "session_start", ~F.col("kind").isin("session_start", "session_end")
    ids = F.when(start, F.col("_first")).when(work & (F.col("_later._t") <= F.col(ts)), F.col("_later._ids"))
    return walk.join(both, session, "left").withColumn("memory_ids", F.coalesce(ids, F.expr("cast(array() as array<string>)"))).drop("_first", "_later")


def session_beats(walk: DataFrame, said: DataFrame, session: str = "session_id") -> DataFrame:
    """session, beat, type, title, subtitle, actions, memories, duration of every session: a start, a beat for each user message (or one for all work where there is none), and an end.

    ``walk`` has ``memory_ids`` (``recalled_steps``), ``said`` is its conversation. A beat has the steps from its message to the next; those before the first message, and what was
    recalled at the start, go to the first. A memory counts where it is seen first in a beat.
    """
    work = walk.where("kind not in ('session_start', 'session_end')")
    asked = said.where("role = 'user'").select(session, "index", "place", "text")
    last = Window.partitionBy(session, "index").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    users = asked.select(session, F.row_number().over(Window.partitionBy(session).orderBy("place")).alias("beat"), F.last("text").over(last).alias("text"))
    users = users.select(session, "beat", F.lit("user_turn").alias("type"), F.when(F.coalesce("text", F.lit("")) != "", truncate(F.col("text"), 50)).otherwise("Continue work").alias("title"))
    auto = work.select(session).distinct().join(users.select(session).distinct(), session, "left_anti").select(session, F.lit(1).alias("beat"), F.lit("auto").alias("type"), F.lit("Automated work").alias("title"))
    marks = asked.select(session, "index", F.lit(1).alias("_user"), F.lit(None).cast("string").alias("kind"), F.expr("cast(null as array<string>)").alias("memory_ids"))
    line = marks.unionByName(walk.where("kind != 'session_end'").select(session, "index", F.lit(0).alias("_user"), "kind", "memory_ids"))
    upto = Window.partitionBy(session).orderBy("index", F.desc("_user")).rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumn("beat", F.greatest(F.lit(1), F.sum("_user").over(upto)).cast("int")).where("_user = 0")
    kinds = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") != "session_start", F.struct("index", "kind")))), lambda x: x["kind"])
    done = placed.groupBy(session, "beat").agg(kinds.alias("_kinds"))
    seen = placed.select(session, "beat", "index", F.posexplode("memory_ids").alias("_p", "id")).groupBy(session, "beat", "id").agg(F.min(F.struct("index", "_p")).alias("_at"))
    seen = seen.groupBy(session, "beat").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("memories"))
    none = F.expr("cast(array() as array<string>)")
    turns = users.unionByName(auto).join(done, [session, "beat"], "left").join(seen, [session, "beat"], "left").withColumns({"_kinds": F.coalesce("_kinds", none), "memories": F.coalesce("memories", none)})
    turns = turns.select(session, "beat", "type", "title", F.when(F.size("_kinds") > 0, truncate(actions_sentence(F.col("_kinds")), 150)).otherwise("").alias("subtitle"), F.size("_kinds").alias("actions"), "memories", F.greatest(F.lit(3500), 1200 * F.size("_kinds")).alias("duration"))
    count = turns.groupBy(session).agg(F.max("beat").alias("_n"))
    edges = walk.select(session).distinct().join(count, session, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    edge = lambda beat, kind, title, subtitle, ms: edges.select(session, beat.cast("int").alias("beat"), F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit(subtitle).alias("subtitle"), F.lit(0).alias("actions"), none.alias("memories"), F.lit(ms).alias("duration"))
    return turns.unionByName(edge(F.lit(0), "system_start", "Session Start", "Waiting for user request...", 2000)).unionByName(edge(F.col("_n") + 1, "system_end", "Session Complete", "", 5000))


def export_session(prefix: str, observations: DataFrame, retrievals: DataFrame, state: DataFrame, session: str = "session_id") -> dict[str, DataFrame]:
    """The replay of the sessions whose id begins with ``prefix``: meta, steps, conversation, beats, memories (their values before and after) and outcome, by name."""
    mine = observations.where(F.col(session).cast("string").startswith(prefix))
    shown = retrievals.where(F.col(session).cast("string").startswith(prefix)).join(mine.select(session).distinct(), session, "left_semi")
    walk = recalled_steps(steps(mine, session), shown, session)
    said = conversation(walk, shown, session)
    used = shown.select(session, F.explode("memory_ids").alias("memory_id")).distinct()
    values = before_after(used.join(state, "memory_id"))
    meta = walk.groupBy(session).agg(F.count(F.lit(1)).alias("total_steps"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("date")).join(used.groupBy(session).agg(F.count(F.lit(1)).alias("memories_retrieved")), session, "left").fillna(0, ["memories_retrieved"])
    return {"meta": meta, "steps": walk, "conversation": said, "beats": session_beats(walk, said, session), "memories": values, "outcome": session_outcome(mine, values, session)}


def before_after(state: DataFrame) -> DataFrame:
    """The value before the last reward, by taking it back, and its direction."""
    reward = F.coalesce("last_reward", F.lit(0.0))
    delta = F.round(C.Q_LAYERS["action"] * C.Q_ALPHA * reward, 4)
    direction = F.when(reward > 0, "positive").when(reward < 0, "negative").otherwise("neutral")
    return state.withColumns({"q_delta": delta, "q_before": F.round(F.col("q_value") - delta, 3), "direction": direction})


def session_outcome(observations: DataFrame, touched: DataFrame, session: str = "session_id") -> DataFrame:
    """Counts of what a session did, and its verdict from the directions of the memories that it touched (session, direction)."""
    s = F.lower(F.coalesce("summary", F.lit("")))
    counts = {
        "email_read": s.contains("email") & _any(s, ("read", "inbox", "gmail")), "email_sent": s.contains("send_email"), "crm_ops": _any(s, ("crm", "leads", "activities")),
        "files_modified": F.col("tool").isin("Edit", "Write"), "memories_stored": s.contains("add_memory"), "commits": s.contains("git commit"),
    }
    done = observations.groupBy(session).agg(F.count(F.lit(1)).alias("actions"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    moved = touched.groupBy(session).agg(F.count_if(F.col("direction") == "positive").alias("reinforced"), F.count_if(F.col("direction") == "negative").alias("penalized"))
    out = done.join(moved, session, "left").fillna(0, ["reinforced", "penalized"])
    up, down = F.col("reinforced"), F.col("penalized")
    return out.withColumn("verdict", F.when((up > 0) & (down == 0), "productive").when(up > down, "mostly_productive").when(down > 2 * up, "unproductive").otherwise("mixed"))
