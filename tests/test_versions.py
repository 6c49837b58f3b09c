"""Versioned state, deltas, snapshots and profiles in files."""

import os
import shutil

import pytest

from memspark.sources import files, profile_files, tail, versions

SCHEMA = "memory_id string, experience string, q_value double, q_updated_at string"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def read(spark, path):
    return sorted((r["memory_id"], r["q_value"]) for r in versions.read_version(spark, path, SCHEMA).collect())


def test_a_run_that_dies_before_its_commit_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    assert versions.last_version(spark, path) is None and read(spark, path) == []
    assert versions.save_state(rows(spark, ("a", "default", 0.1, "1"), ("b", "default", 0.2, "1")), path, SCHEMA) == 0
    assert versions.save_state(rows(spark, ("b", "default", 0.5, "2")), path, SCHEMA) == 1
    assert read(spark, path) == [("a", 0.1), ("b", 0.5)]
    # The files of a third version are there, but its job did not end.
    shutil.copytree(f"{path}/v-00000000", f"{path}/v-00000002", ignore=shutil.ignore_patterns("_SUCCESS", "._SUCCESS*"))
    assert read(spark, path) == [("a", 0.1), ("b", 0.5)] and versions.last_version(spark, path) == 1
    assert versions.save_state(rows(spark, ("c", "default", 0.7, "3")), path, SCHEMA) == 3
    assert read(spark, path) == [("a", 0.1), ("b", 0.5), ("c", 0.7)]
    assert sorted(x for x in os.listdir(path) if x.startswith("v-")) == ["v-00000001", "v-00000002", "v-00000003"]


def test_deltas_are_folded_once(spark, tmp_path, monkeypatch):
    state, deltas = str(tmp_path / "state"), str(tmp_path / "deltas")
    versions.save_state(rows(spark, ("a", "default", 0.1, "2024-01-02"), ("b", "default", 0.2, "2024-01-02")), state, SCHEMA)
    versions.save_delta(rows(spark, ("a", "default", 0.9, "2024-01-03")), deltas, "s1")
    versions.save_delta(rows(spark, ("a", "default", 0.3, "2024-01-03")), deltas, "s1")  # the session saved again
    versions.save_delta(rows(spark, ("b", "default", 0.8, "2024-01-01"), ("c", "default", 0.4, "")), deltas, "s2")
    with pytest.raises(ValueError, match="session's name"):
        versions.save_delta(rows(spark), deltas, "../x")
    with monkeypatch.context() as m:  # dies before the deltas are removed
        m.setattr(versions, "_remove", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            versions.fold_deltas(spark, state, deltas, SCHEMA)
    want = [("a", 0.3), ("b", 0.2), ("c", 0.4)]
    assert read(spark, state) == want
    assert versions.fold_deltas(spark, state, deltas, SCHEMA) == 2 and read(spark, state) == want
    assert versions.fold_deltas(spark, state, deltas, SCHEMA) == 0 and os.listdir(deltas) == []


def test_snapshots_of_runs(spark, tmp_path):
    def deals(*found):
        return spark.createDataFrame(list(found), "deal_id string, stage string, client_id string")

    leads = spark.createDataFrame([("l1", "new", "c9")], "lead_id string, stage string, company_id string")
    path = str(tmp_path / "crm")
    first, _ = versions.crm_changes(spark, path, deals(("d1", "negotiation", "c1"), ("d2", "invoiced", "c2")), leads)
    assert first.count() == 0
    later = deals(("d1", "won", "c1"), ("d2", "invoiced", "c2"), ("d3", "won", "c3"))
    events, number = versions.crm_changes(spark, path, later, leads.replace("new", "qualified"))
    assert sorted((r["id"], r["event_name"]) for r in events.collect()) == [("d1", "deal_closed"), ("l1", "meaningful_response")] and number == 1
    again, _ = versions.crm_changes(spark, path, later, leads.replace("new", "qualified"))
    assert again.count() == 0 and events.count() == 2


def test_profiles_in_files(spark, tmp_path):
    own, bundled = tmp_path / "own", tmp_path / "bundled"
    own.mkdir()
    bundled.mkdir()
    (own / "sales.yaml").write_text("name: sales\ndetect_keywords: [mine, two]\nprocess_stages: [lead, {name: won, reward_on_enter: 0.8}, 7]\n")
    (own / "broken.yaml").write_text("a: [b\n")
    (own / "list.yaml").write_text("- a\n- b\n")
    (bundled / "sales.yaml").write_text("name: sales\ndetect_keywords: [theirs]\n")
    (bundled / "ops.yaml").write_text("description: by its file's name\nsession_reward_weights: {commit: 0.3}\n")
    (bundled / "bad.yaml").write_text("name: ../../etc\n")
    (bundled / "note.txt").write_text("name: text\n")
    found = {r["name"]: r for r in profile_files.load_profiles(spark, str(own), str(bundled)).collect()}
    assert set(found) == {"sales", "ops", "default"}
    assert found["sales"]["detect_keywords"] == ["mine", "two"] and [tuple(x) for x in found["sales"]["process_stages"]] == [("lead", "", 0.0), ("won", "", 0.8)]
    assert found["ops"]["session_reward_weights"] == {"commit": 0.3} and found["default"]["detect_keywords"] is None
    none = profile_files.load_profiles(spark, str(tmp_path / "absent"), str(bundled))
    assert profile_files.resolve_profile(none, None, "gone", "ops") == "ops" and profile_files.resolve_profile(none, "ops2") == "default"


def test_lines_know_their_order_in_a_file_of_many_blocks(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [f"line {k} {'x' * (k % 50)}" for k in range(3000)]
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_lines(spark, str(path))
        assert df.rdd.getNumPartitions() > 5
        assert [r["value"] for r in df.orderBy("file", "pos").collect()] == lines
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_appended_lines_are_read_once(spark, tmp_path, monkeypatch):
    folder, seen = tmp_path / "logs", []
    folder.mkdir()

    def run():
        taken = []
        df = tail.appended_lines(spark, str(folder))
        query = df.writeStream.foreachBatch(lambda b, _: taken.extend((r["file"].rsplit("/", 1)[1], r["offset"], r["value"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        seen.extend(taken)
        return sorted((f, o, v) for f, o, v in taken)

    def add(name, text, mode="a"):
        with open(folder / name, mode) as file:
            file.write(text)

    add("a.jsonl", "one\ntwo\nthr")
    add("note.txt", "no\n")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    add("a.jsonl", "ee\nfour")
    add("b.jsonl", "é first\n")
    assert run() == [("a.jsonl", 8, "three"), ("b.jsonl", 0, "é first")]
    assert run() == []
    add("a.jsonl", "new\nlonger than all that was there before\n", "w")  # rotated: another first line
    assert run() == [("a.jsonl", 0, "new"), ("a.jsonl", 4, "longer than all that was there before")]


def test_ranges_of_a_file_have_each_line_once(tmp_path, monkeypatch):
    lines = [("x" * (k * 7 % 23)) + str(k) for k in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\nunfinished")
    for size in (1, 5, 64, 10_000):
        monkeypatch.setattr(tail, "RANGE", size)
        monkeypatch.setattr(tail, "BUFFER", 16)
        reader = tail.TailReader(str(tmp_path), ".jsonl")
        end = reader.latestOffset()
        found = [row for part in reader.partitions({}, end) for row in reader.read(part)]
        assert [v for _, _, v in found] == lines
        begins = [o for _, o, _ in found]
        assert begins == [sum(len(x) + 1 for x in lines[:k]) for k in range(200)]
