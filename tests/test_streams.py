"""Streams with state against the batch fold, and a profile that expires."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import constants as C
from memspark.operators import usefulness
from memspark.streaming import state

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def run(df, name, folder, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_other_stores_are_refused(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        state.usefulness_in_order(spark.range(1))


def test_the_stream_equals_the_batch_fold_on_shuffled_input(rocksdb, tmp_path):
    spark, rng = rocksdb, random.Random(3)
    schema = "memory_id string, experience string, ts timestamp, seq int, reward double, context string, protect boolean"
    rows = [(rng.choice("ab"), None, START + dt.timedelta(minutes=k // 2), k, rng.choice([-1.0, -0.6, 0.5, 0.9, None]), f"c{k} " + "x" * 130, None) for k in range(120)]
    rows += [("p", "sales", START + dt.timedelta(minutes=k), k, r, "c", None) for k, r in enumerate((0.8, -0.5, -0.5, 0.4))] + [("p", "sales", START + dt.timedelta(seconds=90), 0, None, None, True), ("p", "sales", START + dt.timedelta(seconds=150), 0, None, None, False)]
    rng.shuffle(rows)
    for k in range(4):  # files of a time each, in the order of their names and times
        part = rows[k::4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # A later row lets the watermark pass all others, and a last one lets a batch see that.
    for k in (10, 20):
        spark.createDataFrame([("z", None, START + dt.timedelta(days=k), k, 0.0, "end", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = run(state.usefulness_in_order(stream), "in_order", tmp_path / "c", "update")
    last = {(r["memory_id"], r["experience"]): r for r in sorted(out.collect(), key=lambda r: r["q_visits"])}
    batch = usefulness.fold(spark.createDataFrame([r[:1] + r[2:6] for r in rows if r[0] in "ab"], "memory_id string, ts timestamp, seq int, reward double, context string")).collect()
    for want in batch:
        got = last[want["memory_id"], "default"]
        assert got["q_visits"] == want["q_visits"] and list(got["reward_contexts"]) == list(want["reward_contexts"])
        assert all(abs(got[f"q_{x}"] - want[f"q_{x}"]) < 1e-12 for x in C.Q_LAYERS) and abs(got["q_value"] - want["q_value"]) < 1e-12
    # 0.8 and -0.5 count; the second -0.5 meets the flag, which is lifted before 0.4.
    q = max(-0.5, min(1.0, 0.25 * 0.8 - 0.25 * 0.5)) + 0.25 * 0.4
    assert abs(last["p", "sales"]["q_action"] - q) < 1e-12 and last["p", "sales"]["q_visits"] == 4 and not last["p", "sales"]["protected"]


def test_a_profile_expires_after_a_day(rocksdb, tmp_path):
    spark = rocksdb
    at = lambda hours: START + dt.timedelta(hours=hours)
    prompts = [("s", at(0), "before", None), ("s", at(2), "kept", None), ("s", at(24.5), "still", None), ("s", at(25.5), "gone", None), ("t", at(1), "sale", "sales"), ("t", at(3), "next", None), ("s", at(26), "own", "dealflow"), ("s", at(27), "after", None)]
    prompts.sort(key=lambda r: r[1])
    for k, row in enumerate(prompts):
        spark.createDataFrame([row], "session_id string, ts timestamp, text string, profile string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/prompts")
    spark.createDataFrame([("s", at(1), "sales"), ("u", at(1), "sales")], "session_id string, ts timestamp, profile string").coalesce(1).write.parquet(f"{tmp_path}/saved")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    out = state.prompts_with_profiles(read("prompts", "session_id string, ts timestamp, text string, profile string"), read("saved", "session_id string, ts timestamp, profile string"), delay="1 hour")
    got = {r["text"]: r["profile"] for r in run(out, "profiled", tmp_path / "c", "append").where(F.col("text").isNotNull()).collect()}
    assert got == {"before": "default", "kept": "sales", "still": "sales", "gone": "default", "sale": "sales", "next": "sales", "own": "dealflow", "after": "dealflow"}
