"""Transcripts: parsing of union-typed lines, message rules, session order, chunk packing, sampling and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.functions.text import strip
from memspark.operators.ranges import greedy_parts, prefix_sums


def parse_lines(lines: DataFrame, value: str = "value", file: str = "file", pos: str = "pos") -> DataFrame:
    """Messages of JSON lines whose content is a string or an array of blocks; broken lines and other types go.

    The session is the first id met so far in the file. Injected blocks of list contents go; texts under 10 characters go, longer ones are cut at 5000.
    """
    v = lines.withColumn("_v", F.try_parse_json(value)).where("_v is not null")
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    before = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("session_id", F.first(get("$.sessionId", "string"), ignorenulls=True).over(before))
    v = v.withColumn("role", get("$.type", "string")).where(F.col("role").isin("user", "assistant"))
    blocks = get("$.message.content", "array<variant>")
    text_of = lambda b: F.try_variant_get(b, "$.text", "string")
    bare = lambda b: F.when((F.schema_of_variant(b) == "STRING") & (F.col("role") == "user"), F.try_variant_get(b, "$", "string"))
    texts = F.transform(blocks, lambda b: F.coalesce(F.when(F.try_variant_get(b, "$.type", "string") == "text", text_of(b)), bare(b)))
    texts = F.filter(texts, lambda t: t.isNotNull() & ~((F.col("role") == "user") & strip(t).startswith("<system-reminder>")))
    plain = F.when(F.schema_of_variant(F.try_variant_get("_v", "$.message.content", "variant")) == "STRING", get("$.message.content", "string"))
    v = v.withColumn("text", strip(F.coalesce(plain, F.array_join(texts, "\n"))))
    return v.where(F.length("text") >= C.MESSAGE_MIN).select(file, pos, "session_id", "role", F.substring("text", 1, C.MESSAGE_MAX).alias("text"), get("$.timestamp", "string").alias("timestamp"), get("$.uuid", "string").alias("message_id"))


def message_rules(messages: DataFrame, text: str = "text") -> DataFrame:
    """User and assistant messages of enough characters, cut at the longest allowed."""
    return messages.where(F.col("role").isin("user", "assistant") & (F.length(strip(F.col(text))) >= C.MESSAGE_MIN)).withColumn(text, F.substring(strip(F.col(text)), 1, C.MESSAGE_MAX))


def session_rollup(messages: DataFrame, session: str = "session_id", order: str = "pos", text: str = "text") -> DataFrame:
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length(text)).alias("chars"), F.min(order).alias("first"), F.max(order).alias("last"))


def split_session(messages: DataFrame, most: int, session: str = "session_id", order: str = "pos", text: str = "text") -> DataFrame:
    """session, part, messages, chars: a greedy running sum that starts anew before the message that would overflow. A session of any size is cut into ranges."""
    parts = greedy_parts(messages, [session], [order], F.length(text), most)
    return parts.groupBy(session, F.col("part").cast("int").alias("part")).agg(F.count(F.lit(1)).cast("int").alias("messages"), F.sum("size").cast("int").alias("chars"))


def pack_sessions(sessions: DataFrame, most: int = C.MAX_CHUNK_CHARS, session: str = "session_id", chars: str = "chars", order: str = "first", ranges: int | None = None) -> DataFrame:
    """session, chunk_id, chars: next-fit packing in order of ``order`` (missing ones first) and session; a session over the size stands alone, and closes the chunk before it."""
    packed = greedy_parts(sessions.select(F.col(order).alias("_o"), F.col(session).alias("_s"), F.col(chars).alias("_c")), [], ["_o", "_s"], F.col("_c"), most, ranges)
    return packed.select(F.col("_s").alias(session), F.col("part").cast("int").alias("chunk_id"), F.col("size").alias(chars))


def ingest(messages: DataFrame, known: DataFrame, experience: str = "default", force: bool = False, session: str = "session_id") -> DataFrame:
    """Messages as memories: of sessions that are not known yet (or of all), the user's own counting a little more."""
    new = messages if force else messages.join(known.select(session).distinct(), session, "left_anti")
    return new.withColumns({"memory_type": F.lit("conversation"), "source": F.lit("transcript"), "status": F.lit("active"), "importance": F.when(F.col("role") == "user", 0.5).otherwise(0.4), "experience": F.lit(experience)})


def ingest_counts(messages: DataFrame) -> DataFrame:
    """One row: what an ingestion would store, by role."""
    return messages.agg(F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"))


def chunk_transcripts(messages: DataFrame, most: int = C.MAX_CHUNK_CHARS, session: str = "session_id", order: str = "pos", text: str = "text", first: str = "first") -> DataFrame:
    """session, part, chunk_id, messages, chars: sessions in order of ``first`` (a number or a time of each session), packed; one over the size is split, and each part is a chunk of its own.

    ``messages`` has the session's ``first`` on every row.
    """
    sizes = messages.groupBy(session).agg(F.sum(F.length(text)).alias("chars"), F.count(F.lit(1)).alias("messages"), F.min(first).alias("first"))
    parts = split_session(messages.join(sizes.where(F.col("chars") > most).select(session), session, "left_semi"), most, session, order, text)
    units = sizes.where(F.col("chars") <= most).select(session, F.lit(0).alias("part"), F.col("messages").cast("long").alias("messages"), F.col("chars").cast("long").alias("chars"), "first")
    # A part counts as a full chunk, so it closes the one before and nothing is put to it.
    alone = parts.join(sizes.select(session, "first"), session).select(session, "part", F.col("messages").cast("long").alias("messages"), F.col("chars").cast("long").alias("chars"), "first")
    every = units.withColumn("size", F.col("chars")).unionByName(alone.withColumn("size", F.lit(most + 1).cast("long")))
    every = every.withColumn("unit", F.concat(F.col(session).cast("string"), F.lit("#"), F.lpad(F.col("part").cast("string"), 8, "0")))
    packed = pack_sessions(every, most, "unit", "size", "first")
    return packed.select("unit", "chunk_id").join(every, "unit").select(session, "part", "chunk_id", "messages", "chars")


def manifest(chunks: DataFrame, session: str = "session_id") -> DataFrame:
    """chunk_id, sessions, messages, chars, tokens of each chunk."""
    out = chunks.groupBy("chunk_id").agg(F.count_distinct(session).alias("sessions"), F.sum("messages").alias("messages"), F.sum("chars").alias("chars"))
    return out.withColumn("tokens", F.floor(F.col("chars") / C.CHARS_PER_TOKEN).cast("long"))


def within_budgets(messages: DataFrame, per_session: int, whole: int, session: str = "session_id", order: str = "pos", text: str = "text", first: str = "first", group: str = "thread") -> DataFrame:
    """Each session's messages up to the first that would exceed ``per_session`` characters, and of these, sessions in order, a group's up to ``whole``. Sums are put together from ranges."""
    own = prefix_sums(messages, [group, session], [order], F.length(text), "_own").where(F.col("_own") <= per_session)
    return prefix_sums(own, [group], [first, session, order], F.length(text), "_all").where(F.col("_all") <= whole).drop("_own", "_all")


# Fixed values of a thread's text: characters of all of it and of a message, messages of a session that are all taken, and the first and last ones of a longer session.
THREAD_CHARS, ENTRY_CHARS, SHORT_SESSION, FIRST_OF_LONG, LAST_OF_LONG = 100_000, 500, 10, 5, 3


def thread_keywords(topic_names: Column) -> Column:
    """The words of more than two characters of a thread's topics, in lower case; dashes and underscores part words."""
    names = F.transform(topic_names, lambda n: F.split(F.trim(F.regexp_replace(F.lower(n), r"[-_\s]+", " ")), " "))
    return F.array_distinct(F.filter(F.flatten(names), lambda w: F.length(w) > 2))


def gather_threads(threads: DataFrame, chunk_sessions: DataFrame, messages: DataFrame, most: int = THREAD_CHARS) -> DataFrame:
    """thread, lines, chars, truncated, text: what is read of each thread (thread, topic_names, chunks).

    The sessions of its chunks (chunk_id, session_id, first) count if they hold two of the thread's keywords (one, where it has two at most). Of each, in order of the chunk and then of ``first``,
    there is a heading, and its messages (session_id, pos, role, text, created_at): all of a short session, the first and last of a longer one with a line for what is left out. The text ends before the
    first message that would take it over ``most``. Places in sessions and lengths are prefix sums by ranges, so neither a session nor a thread has to fit in a task; the text that is left does, as ``most`` bounds it.
    """
    asked = threads.select("thread", thread_keywords(F.col("topic_names")).alias("_words"), F.explode(F.array_distinct("chunks")).alias("chunk_id"))
    placed = asked.join(chunk_sessions, "chunk_id").join(messages, "session_id")
    hits = placed.select("thread", "chunk_id", "session_id", "_words", F.explode_outer(F.filter("_words", lambda w: F.lower(F.col("text")).contains(w))).alias("_hit"))
    held = hits.groupBy("thread", "chunk_id", "session_id").agg(F.count_distinct("_hit").alias("_hits"), F.first(F.size("_words")).alias("_of"), F.count(F.lit(0)).alias("_rows"))
    relevant = held.where(F.col("_hits") >= F.when(F.col("_of") <= 2, 1).otherwise(2)).select("thread", "chunk_id", "session_id")
    sizes = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("created_at", "pos").alias("_date"))
    sampled = prefix_sums(messages.join(relevant.select("session_id").distinct(), "session_id", "left_semi"), ["session_id"], ["pos"], F.lit(1), "_at").join(sizes.select("session_id", "_n"), "session_id")
    sampled = sampled.where((F.col("_n") <= SHORT_SESSION) | (F.col("_at") <= FIRST_OF_LONG) | (F.col("_at") > F.col("_n") - LAST_OF_LONG)).where("coalesce(text, '') != ''")
    label = F.when(F.col("role") == "user", "USER: ").when(F.col("role") == "assistant", "ASSISTANT: ").otherwise("")
    entries = sampled.select("session_id", F.col("_at").cast("long").alias("_at"), F.lit(False).alias("_head"), F.concat(label, F.substring("text", 1, ENTRY_CHARS), F.lit("\n")).alias("line"))
    heading = F.concat(F.lit("\n=== "), F.coalesce(F.substring(F.col("_date").cast("string"), 1, 10), F.lit("?")), F.lit(" | session "), F.substring(F.col("session_id").cast("string"), 1, 12), F.lit(" | "), F.col("_n").cast("string"), F.lit(" messages ==="))
    known = sizes.join(relevant.select("session_id").distinct(), "session_id", "left_semi")
    heads = known.select("session_id", F.lit(0).cast("long").alias("_at"), F.lit(True).alias("_head"), heading.alias("line"))
    gap = known.where(F.col("_n") > SHORT_SESSION).select("session_id", F.lit(FIRST_OF_LONG).cast("long").alias("_at"), F.lit(False).alias("_head"), F.concat(F.lit("... ["), (F.col("_n") - FIRST_OF_LONG - LAST_OF_LONG).cast("string"), F.lit(" messages omitted] ...\n")).alias("line"))
    lines = entries.withColumn("_gap", F.lit(0)).unionByName(heads.withColumn("_gap", F.lit(0))).unionByName(gap.withColumn("_gap", F.lit(1)))
    of = relevant.join(chunk_sessions, ["chunk_id", "session_id"]).join(lines, "session_id").withColumn("_size", F.length("line"))
    return _assembled(of, "thread", ["chunk_id", "first", "session_id", "_at", "_gap"], most, "... [truncated] ...")


def _assembled(lines: DataFrame, group: str, order: list[str], most: int, end: str) -> DataFrame:
    """group, lines, chars, truncated, text: the lines (line, _size, _head) of each group in order, up to the first that is no heading and would take the sum of sizes over ``most``."""
    summed = prefix_sums(lines, [group], order, F.col("_size"), "_sum")
    over = summed.where(~F.col("_head") & (F.col("_sum") > most)).groupBy(group).agg(F.min(F.struct(*order)).alias("_stop"))
    kept = summed.join(over, group, "left").where(F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop")))
    out = kept.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("_l"), F.sum("_size").alias("chars"), F.first(F.col("_stop").isNotNull()).alias("truncated"))
    last = F.when(F.col("truncated"), F.array(F.lit(end))).otherwise(F.expr("cast(array() as array<string>)"))
    return out.select(group, F.size("_l").alias("lines"), "chars", "truncated", F.array_join(F.concat(F.col("_l.line"), last), "\n").alias("text"))


# Fixed values of a chunk's text: characters of all of it, the least for a session, messages of a session that are all taken, and the least of the first and last ones of a longer one.
CHUNK_TEXT_CHARS, SESSION_CHARS, WHOLE_SESSION, LEAST_ENDS = 50_000, 2_000, 20, 5


def chunk_texts(chunk_sessions: DataFrame, messages: DataFrame, most: int = CHUNK_TEXT_CHARS, least: int = SESSION_CHARS) -> DataFrame:
    """chunk_id, lines, chars, truncated, text: what is read of each chunk (chunk_id, session_id, first).

    Each session has a heading and an equal share of ``most`` (``least`` at least); its messages with a text are taken whole, or the first and last third of more than WHOLE_SESSION. A session ends
    before the first message over its share, a chunk before the first over ``most``.
    """
    shares = chunk_sessions.groupBy("chunk_id").agg(F.greatest(F.floor(F.lit(most) / F.count(F.lit(1))), F.lit(least)).alias("_share"))
    said = messages.where("coalesce(text, '') != ''")
    sizes = said.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    keep = F.greatest(F.floor(F.col("_n") / 3), F.lit(LEAST_ENDS))
    placed = prefix_sums(said, ["session_id"], ["pos"], F.lit(1), "_at").join(sizes, "session_id")
    placed = placed.where((F.col("_n") <= WHOLE_SESSION) | (F.col("_at") <= keep) | (F.col("_at") > F.col("_n") - keep))
    label = F.when(F.col("role") == "user", "USER: ").when(F.col("role") == "assistant", "ASSISTANT: ").otherwise("")
    entries = placed.select("session_id", F.col("_at").cast("long").alias("_at"), F.lit(0).alias("_gap"), F.concat(label, "text", F.lit("\n")).alias("line"))
    gap = sizes.where(F.col("_n") > WHOLE_SESSION).select("session_id", keep.cast("long").alias("_at"), F.lit(1).alias("_gap"), F.concat(F.lit("... ["), (F.col("_n") - 2 * keep).cast("string"), F.lit(" messages omitted] ...\n")).alias("line"))
    of = chunk_sessions.join(shares, "chunk_id").join(entries.unionByName(gap), "session_id").withColumn("_size", F.length("line"))
    own = prefix_sums(of, ["chunk_id", "session_id"], ["_at", "_gap"], F.col("_size"), "_own")
    fits = own.where(F.col("_own") <= F.col("_share")).select("chunk_id", "first", "session_id", "_at", "_gap", F.lit(False).alias("_head"), "line", "_size")
    cut = own.where(F.col("_own") > F.col("_share")).groupBy("chunk_id", "first", "session_id").agg(F.min(F.struct("_at", "_gap")).alias("_c"))
    cut = cut.select("chunk_id", "first", "session_id", "_c._at", "_c._gap", F.lit(True).alias("_head"), F.lit("... [session truncated] ...").alias("line"), F.lit(0).alias("_size"))
    heading = F.concat(F.lit("\n=== SESSION "), F.substring(F.col("session_id").cast("string"), 1, 12), F.lit(" ("), F.col("_n").cast("string"), F.lit(" messages) ==="))
    heads = chunk_sessions.join(sizes, "session_id").select("chunk_id", "first", "session_id", F.lit(0).cast("long").alias("_at"), F.lit(0).alias("_gap"), F.lit(True).alias("_head"), heading.alias("line")).withColumn("_size", F.length("line"))
    return _assembled(fits.unionByName(cut).unionByName(heads), "chunk_id", ["chunk_id", "first", "session_id", "_at", "_gap"], most, "... [chunk truncated] ...")


def by_messages(threads: DataFrame, total: str = "total_messages") -> DataFrame:
    """``threads`` with ``place``: those of most messages first, ties by thread. Places are prefix sums, so the sort is one of all tasks."""
    return prefix_sums(threads.withColumn("_least", -F.col(total)), [], ["_least", "thread"], F.lit(1), "place").drop("_least")


def run_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """One row for a run over topics, threads or labels: total, and those processed, skipped (done before) and failed."""
    return results.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == x).alias(x) for x in ("processed", "skipped", "failed")])


def head_tail(messages: DataFrame, whole: int = 20, least: int = 5, session: str = "session_id", order: str = "pos") -> DataFrame:
    """Short sessions whole; of others the first and last third (``least`` messages at least)."""
    w = Window.partitionBy(session)
    n = F.count(F.lit(1)).over(w)
    keep = F.greatest(F.floor(n / 3), F.lit(least))
    up, down = F.row_number().over(w.orderBy(order)), F.row_number().over(w.orderBy(F.desc(order)))
    return messages.withColumn("_k", (n <= whole) | (up <= keep) | (down <= keep)).where("_k").drop("_k")


def newest_within(messages: DataFrame, budget: int = C.CONDENSED_CHARS, session: str = "session_id", order: str = "pos", text: str = "text") -> DataFrame:
    """The newest messages whose lengths sum to the budget at most, up to the first that would exceed it."""
    w = Window.partitionBy(session).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_sum", F.sum(F.length(text)).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def with_followers(messages: DataFrame, relevant: Column, session: str = "session_id", order: str = "pos", text: str = "text") -> DataFrame:
    """Relevant messages, and the run of non-empty assistant messages that follows each."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    answer = (F.col("role") == "assistant") & (F.length(strip(F.col(text))) > 0)
    hit, stop = F.max(F.when(relevant, F.col(order))).over(w), F.max(F.when(~relevant & ~answer, F.col(order))).over(w)
    return messages.withColumn("_in", hit.isNotNull() & (stop.isNull() | (hit > stop))).where("_in").drop("_in")
