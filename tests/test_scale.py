"""Operators that cut hot groups into ranges or blocks, held against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.operators import compaction, graph, outcomes, postings, ranges, recall, search, transcripts, usefulness, vector_index



def plain_parts(sizes, most):
    part, used, out = 0, most + 1, []
    for n in sizes:
        if used + n > most:
            part, used = part + 1, 0
        used += n
        out.append(part)
    return out


@pytest.mark.parametrize("count", [1, 3, 40])
def test_greedy_parts_of_hot_groups(spark, count):
    rng = random.Random(count)
    groups = {"hot": 700, "other": 90, "one": 1, None: 5, **{f"g{k}": rng.randint(1, 4) for k in range(60)}}
    rows, want = [], {}
    for g, n in groups.items():
        sizes = [rng.choice([0, 0, 1, 7, 30, 99, 100, 101, 400, None]) for _ in range(n)]
        rows += [(g, k, x) for k, x in enumerate(sizes)]
        want |= {(g, k): p for k, p in enumerate(plain_parts([x or 0 for x in sizes], 100))}
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(5)
    got = ranges.greedy_parts(df, ["g"], ["k"], F.col("n"), 100, count).collect()
    assert {(r["g"], r["k"]): r["part"] for r in got} == want and len(got) == len(rows)
    alone = sorted((r["k"], r["g"] or "", r["part"]) for r in ranges.greedy_parts(df.where("g = 'hot'"), [], ["k", "g"], F.col("n"), 100, count).collect())
    assert [p for *_, p in alone] == [want["hot", k] for k in range(700)]
    assert ranges.greedy_parts(df.where("false"), ["g"], ["k"], F.col("n"), 100, count).count() == 0


@pytest.mark.parametrize("count", [1, 25])
def test_prefix_sums_of_hot_groups(spark, count):
    rng = random.Random(count)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), k, rng.choice([0, 1, 5, None])) for k in range(600)]
    sums, want = {}, {}
    for g, k, n in rows:
        sums[g] = want[k] = sums.get(g, 0) + (n or 0)
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(4)
    assert {r["k"]: r["s"] for r in ranges.prefix_sums(df, ["g"], ["k"], F.col("n"), "s", count).collect()} == want


@pytest.mark.parametrize("tasks", [1, 30])
def test_composed_rewards_equal_the_fold_in_order(spark, tasks):
    rng = random.Random(tasks)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), k, rng.choice([-1.0, -0.7, 0.4, 0.9, None])) for k in range(500)]
    df = spark.createDataFrame(rows, "entity_id string, seq int, reward double").repartition(6)
    state = spark.createDataFrame([("hot", 0.9, -0.2, 0.1), ("a", None, None, None), ("b", -0.5, 1.0, 0.0)], "entity_id string, q_action double, q_hypothesis double, q_fit double")
    got = {r["entity_id"]: r for r in usefulness.moved(state.join(usefulness.composed(df, "entity_id", tasks=tasks), "entity_id")).collect()}
    for g, *start in state.collect():
        q = [x or 0.0 for x in start]
        for name, _, r in rows:
            if name == g and r is not None:
                q = [max(C.Q_FLOOR, min(C.Q_CEILING, x + C.Q_ALPHA * m * r)) for x, m in zip(q, (1, 0.8, 1 if r > 0 else 0.5), strict=True)]
        assert np.allclose([got[g][f"q_{x}"] for x in C.Q_LAYERS], q) and got[g]["n"] == sum(x[0] == g for x in rows)


def grouped(n, edges):
    up = list(range(n))
    for a, b in edges:
        a, b = up[a], up[b]
        up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(250, 299)] + [(7, 7)]
    labels = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [labels.get(k, k) for k in range(300)] == grouped(300, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("least", "block"), [(0.9, 16), (0.5625, 2048)])
def test_vector_links_join_all_pairs(spark, least, block):
    rng = np.random.default_rng(block)
    x = np.concatenate([rng.normal(c, 0.25, (40, 8)) for c in rng.normal(0, 1, (20, 8))])[rng.permutation(800)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(800, None), (801, [0.0] * 8), (802, [1.0]), (803, x[5].tolist()), (804, x[5].tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    labels = {r["node"]: r["label"] for r in graph.components(graph.vector_links(df, least, block=block)).collect()}
    u = np.concatenate([x, np.zeros((3, 8)), x[[5, 5]]])
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    a, b = np.nonzero(np.triu(u @ u.T >= least, 1))
    assert [labels.get(k, k) for k in range(805)] == grouped(805, zip(a.tolist(), b.tolist(), strict=True))
    assert len(set(labels.values())) > 3 or least < 0.9


def test_clusters_of_all_rows_equal_the_plain_pass(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.3, (30, 12)) for c in rng.normal(0, 1, (15, 12))])[rng.permutation(450)]
    df = spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(7)
    want = {3 * m: (3 * i, k, round(s, 9)) for m, i, k, s in compaction._forward_pass(x / np.linalg.norm(x, axis=1, keepdims=True), 0.2, 3)}
    got = {r["id"]: (r["cluster"], r["position"], round(r["similarity"], 9)) for r in compaction.greedy_clusters(df, 0.2).collect()}
    assert got == want and len({c for c, *_ in want.values()}) > 5
    with pytest.raises(ValueError, match="every row"):
        compaction.greedy_clusters(df, 1.0)


def test_a_dry_run_and_a_run_of_compaction(spark):
    rows = [(k, f"text {k // 4}", [1.0 if j == k // 4 else 0.01 * (k % 4) for j in range(6)], "active" if k != 9 else "archived", "fact", "cli-1", 0.5, "p") for k in range(20)]
    memory = spark.createDataFrame(rows, "id long, memory string, vector array<double>, status string, memory_type string, client_id string, importance double, project string")
    state = spark.createDataFrame([(0, 0.4, 0.1, 0.2, 0.3, 2, None)], "id long, q_action double, q_hypothesis double, q_fit double, q_value double, q_visits int, last_reward double")
    summary, merged, states = compaction.compact_memories(memory, state, most=2)
    assert tuple(summary.first()) == (19, 5, 2, 8)
    assert sorted(map(tuple, merged.select("cluster", "memory", "status").collect())) == [(0, "text 0", "confirmed"), (4, "text 1", "confirmed")]
    assert sorted(map(tuple, states.collect())) == [(k, "merged") for k in range(8)]
    assert tuple(compaction.compact_memories(memory.where("false"), state)[0].first()) == (0, 0, 0, 0)


class Fails(outcomes.OutcomeResolver):
    name = "fails"

    def detect(self, spark):
        late = F.when(F.col("id") < 900, F.lit(0.5)).otherwise(F.raise_error(F.lit("late")).cast("double"))
        return spark.range(1000).select(F.col("id").alias("pos"), F.lit("c1").alias("entity_id"), F.lit("x").alias("event_name"), late.alias("reward"), F.expr("map('k', 'v')").alias("details"))


class Works(Fails):
    name = "works"

    def detect(self, spark):
        return super().detect(spark).where("pos < 3").withColumn("reward", F.lit(2.0))


def test_reward_events_are_logged_once(spark, tmp_path):
    events, said = outcomes.detected(spark, [Fails(), Works()])
    assert said["works"] == {"events": 3} and "late" in said["fails"]["error"] and events.count() == 3
    memory = spark.createDataFrame([("m1", "c1"), ("m2", "c1"), ("m3", "c2")], "id string, client_id string")
    log = outcomes.reward_events(events, memory)
    row = log.orderBy("reward_id").first()
    assert row["reward"] == 1.0 and row["memories"] == 2 and row["reward_id"][:4] == "rwd_" and len(row["reward_id"]) == 12
    assert row["reward_context"] == f"Biz +1.00: x for c1 {{k=v}} [{row['reward_id']}]" and row["context"]["resolver"] == "works"
    path = str(tmp_path / "log")
    assert [outcomes.log_reward_events(log, path) for _ in range(2)] == [3, 0]
    assert outcomes.log_reward_events(log.unionByName(log.withColumn("event_key", F.lit("new"))), path) == 1 and spark.read.parquet(path).count() == 4


def test_recall_of_prompts(spark):
    memory = spark.createDataFrame([("a", "price of the contract", [1.0, 0.0], "active", "fact", 0.5), ("b", None, [0.9, 0.1], "active", "fact", 0.5), ("c", "gone", [1.0, 0.0], "deleted", "fact", 0.5), ("d", "the weather", [0.0, 1.0], None, "odd", None)], "id string, memory string, vector array<double>, status string, memory_type string, importance double")
    memory = memory.selectExpr("hash(id) % 1000 id", "memory", "vector", "status", "memory_type", "importance", "timestamp'2024-01-01' created_at", "id name").withColumn("id", F.col("id").cast("long"))
    asked = spark.createDataFrame([(1, "s1", "the contract and the client's contract price"), (2, "unknown", "what about weather " + "x" * 400), (3, "s1", " Thank you "), (4, "s1", "short"), (5, "s2", None), (6, "s3", " " * 20)], "query_id long, session_id string, text string")
    asked = asked.withColumn("query_vector", F.when(F.col("query_id") == 2, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    queries = recall.prompt_queries(asked, list(C.PROFILE_WORDS))
    assert {r["query_id"]: (len(r["query"]), r["experience"]) for r in queries.collect()} == {1: (44, "sales"), 2: (300, "default")}
    state = memory.select("id", F.lit("sales").alias("experience"), F.when(F.col("name") == "b", 1.0).otherwise(0.25).alias("q"))
    names = {r["id"]: r["name"] for r in memory.collect()}
    found = recall.hybrid_for_queries(memory, queries, state, F.lit("2024-06-01").cast("timestamp"), 2, shown=5)
    rows = {(r["query_id"], r["rank"]): (names[r["id"]], r["q"], r["shown"]) for r in found.collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 1), (2, 2)} and rows[2, 1] == ("d", 0.0, "the w") and {rows[1, 1], rows[1, 2]} == {("a", 0.25, "price"), ("b", 1.0, "")}
    log = recall.retrieval_log(found, queries, F.lit("2024-06-01").cast("timestamp")).collect()
    assert [(r["session_id"], len(r["memory_ids"]), len(r["query"])) for r in log] == [("s1", 2, 44)]
    lines = {r["query_id"]: r["context"].split("\n") for r in recall.context_lines(found, True).collect()}
    assert len(lines[1]) == 2 and any(line.endswith("[q=1] ") for line in lines[1]) and lines[2][0].endswith("[q=0] the w")
    day = spark.range(1).select(*[recall.session_query(F.lit(p), F.lit("2024-06-03").cast("date"), F.lit("me")).alias(p) for p in ("crm", "me", "~")]).first()
    assert tuple(day) == ("crm | Monday 2024-06-03", "Monday 2024-06-03", "Monday 2024-06-03")


def test_gathered_threads_take_relevant_sessions(spark):
    rows = [(s, p, ("user", "assistant", "tool")[p % 3], f"{'crm bot' if s != 2 else 'other'} message {p}" if p != 1 else "", "2024-01-02") for s in (1, 2, 3) for p in range(4 if s == 1 else 14)]
    messages = spark.createDataFrame(rows, "session_id long, pos int, role string, text string, created_at string")
    sessions = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 8, 1)], "session_id long, chunk_id int, first int")
    threads = spark.createDataFrame([(1, ["CRM-bot to"], [8, 7]), (2, ["absent_words here"], [7]), (3, ["bot"], [7])], "thread int, topic_names array<string>, chunks array<int>")
    out = {r["thread"]: r for r in transcripts.gather_threads(threads, sessions, messages).collect()}
    head = "\n=== 2024-01-02 | session {} | {} messages ==="
    short = [head.format(1, 4), "USER: crm bot message 0\n", "crm bot message 2\n", "USER: crm bot message 3\n"]
    long = [head.format(3, 14), "USER: crm bot message 0\n", "crm bot message 2\n", "USER: crm bot message 3\n", "ASSISTANT: crm bot message 4\n", "... [6 messages omitted] ...\n", "crm bot message 11\n", "USER: crm bot message 12\n", "ASSISTANT: crm bot message 13\n"]
    assert set(out) == {1, 3} and out[3]["text"] == "\n".join(short) and not out[3]["truncated"]
    assert out[1]["text"] == "\n".join(short + long) and out[1]["lines"] == 13
    cut = transcripts.gather_threads(threads.where("thread = 3"), sessions, messages, 80).first()
    assert cut["text"] == "\n".join([*short[:2], "... [truncated] ..."]) and cut["truncated"]


def test_posting_lists_equal_the_scan(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(40)], k=rng.randint(1, 30)))) for k in range(400)] + [(400, ""), (401, None), (402, "!?")]
    docs = spark.createDataFrame(rows, "id long, memory string")
    path, query = str(tmp_path / "index"), ["w0", "w7", "absent", "w30", "w7"]
    assert postings.bm25_scores(spark, path, query).count() == 0
    for part in ("id < 150", "id >= 150"):
        postings.add_documents(docs.where(part), path, block=40)
    want = {r["id"]: round(r["bm25"], 9) for r in search.bm25(docs, query).select("id", "bm25").collect()}
    assert {r["id"]: round(r["bm25"], 9) for r in postings.all_scores(spark, path, query).collect()} == want
    best = sorted(want, key=lambda k: (-want[k], k))
    for k in (1, 5, 60):
        assert [r["id"] for r in postings.bm25_scores(spark, path, query, k).collect()] == best[:k]
    # A batch that died before its row was written does not count.
    spark.read.parquet(f"{path}/documents").limit(3).selectExpr("id + 9000 id", "length", "counted", "'dead' batch").write.mode("append").partitionBy("batch").parquet(f"{path}/documents")
    spark.read.parquet(f"{path}/postings").where("term = 'w0'").withColumn("batch", F.lit("dead")).write.mode("append").partitionBy("part").parquet(f"{path}/postings")
    assert {r["id"]: round(r["bm25"], 9) for r in postings.all_scores(spark, path, query).collect()} == want
    assert postings.bm25_scores(spark, path, ["absent"]).count() == postings.bm25_scores(spark, path, []).count() == 0


def test_the_vector_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[np.arange(2000) % 40] + 0.4 * rng.normal(size=(2000, 16))
    rows = [(k, v.tolist(), "deleted" if k % 5 == 0 else "active", "rare" if k % 400 == 1 else "fact") for k, v in enumerate(x)] + [(2000, None, "active", "fact"), (2001, [0.0] * 16, "active", "fact"), (2002, [1.0], "active", "fact")]
    memory = spark.createDataFrame(rows, "id long, vector array<double>, status string, memory_type string")
    path = str(tmp_path / "index")
    vector_index.build(memory, path, sample_rows=1000)
    asked = x[rng.permutation(2000)[:12]] + 0.2 * rng.normal(size=(12, 16))
    u, live = x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(2000) % 5 != 0
    hits = 0
    for n, q in enumerate(asked.tolist()):
        cosine = np.where(live, u @ q, -9)
        want = np.argsort(-cosine, kind="stable")[:10].tolist()
        hits += len({r["id"] for r in vector_index.top(spark, path, q, 10, probes=4).collect()} & set(want))
        if n < 4:
            assert [r["id"] for r in vector_index.top(spark, path, q, 10, probes=1, exact=True).collect()] == want
    assert hits / 120 >= 0.9
    rare = vector_index.top(spark, path, asked[0].tolist(), 5, probes=1, exclude_type="fact").collect()
    assert {r["id"] for r in rare} == {k for k in range(2000) if k % 400 == 1 and k % 5 != 0} and {r["memory_type"] for r in rare} == {"rare"}
    vector_index.build(memory.where("false"), path)
    assert vector_index.top(spark, path, asked[0].tolist(), 5).count() == 0
