"""A test for each finding of round 3 that was right."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memspark.functions.text import tokens
from memspark.llm import bpe, kn_lm
from memspark.operators import postings, search
from memspark.operators.evaluation import Best


def test_f3_rerank_takes_scores_that_differ_by_rounding_for_ties(spark):
    rows = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5 + 1e-12), (1, 9, 0.4)], "query_id long, id long, r double").withColumns({"score": F.lit(0.3), "q": F.lit(0.0), "importance": F.lit(0.5)})
    assert [r["id"] for r in search.rerank(rows, F.col("r"), 3, places=9).orderBy("rank").collect()] == [7, 8, 9]


def test_f4_f5_f6_the_best_of_many_queries_are_held_in_little_memory():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 500, (10_000, 400)) / 500.0, rng.permutation(10_000)
    scores[5, 7] = np.nan
    tracemalloc.start()
    best = Best(400, 10)
    best.add(ids, scores)
    query, score, at = best.cut()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * scores.nbytes
    for q in (0, 7, 399):
        want = [int(i) for i in np.lexsort((ids, -scores[:, q])) if not np.isnan(scores[i, q])][:10]
        assert at[query == q].tolist() == ids[want].tolist() and score[query == q].tolist() == scores[want, q].tolist()


def test_op10_half_a_million_words_stay_known():
    transducer = bpe.Transducer({bytes((b,)): b for b in range(256)})
    pattern, text = bpe.word_pattern(r"\S+"), " ".join(f"{i:x}" for i in range(300_000, 550_000))
    first = transducer.encode(text, pattern)
    transducer.encode_word = None  # all words are known
    assert transducer.encode(text, pattern) == first == [b for b in text.replace(" ", "").encode()]


def test_f7_f8_texts_are_cut_once_and_blocks_hold_what_the_texts_hold(spark, tmp_path):
    texts = {9: "b a, b! the_x", 2: "a\u00e9 zz zz", 5: None, 4: "", 7: "?!", 3: "aa " * 300 + "\U0001d49cbc \U0001f600bb", 8: "aa", 1: "bb bb aa"}
    cuts = spark.sparkContext.accumulator(0)

    def seen(text):
        cuts.add(1)
        return text

    docs = spark.createDataFrame(list(texts.items()), "id long, raw string").repartition(2, "id").localCheckpoint().select("id", F.udf(seen, "string")("raw").alias("memory"))
    path = str(tmp_path / "index")
    postings.add_documents(docs, path, block=2)
    assert cuts.value == len(texts)
    words = {i: ["zz", "zz"] if i == 2 else ["aa"] * 300 + ["bb"] if i == 3 else ["aa"] if i == 8 else ["bb", "bb", "aa"] if i == 1 else [] for i in texts}
    rows = spark.read.parquet(f"{path}/postings").where("term is not null").collect()
    held = {(r["term"], i): (n, length) for r in rows for i, n, length in zip(r["ids"], r["times"], r["lengths"], strict=True)}
    assert held == {(t, i): (n, len(words[i])) for i in texts for t, n in Counter(words[i]).items()}
    assert all(r["ids"] == sorted(r["ids"]) and r["documents"] == len(r["ids"]) <= 2 and r["most"] == max(r["times"]) and r["least"] == min(r["lengths"]) for r in rows)
    assert {r["id"]: (r["length"], r["counted"]) for r in spark.read.parquet(f"{path}/documents").collect()} == {i: (len(words[i]), bool(t)) for i, t in texts.items()}
    postings.add_documents(docs.where("id > 99"), path)
    want = {r["id"]: round(r["bm25"], 9) for r in search.bm25(docs, ["aa", "zz"]).select("id", "bm25").collect()}
    assert {r["id"]: round(r["bm25"], 9) for r in postings.all_scores(spark, path, ["aa", "zz"]).collect()} == want


def test_f8_words_are_cut_by_bytes_as_tokens_cuts_them_and_lists_come_in_the_order_of_the_files(spark, tmp_path):
    signs = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + ["\U000e0041", "\U0010ffff"]
    texts = [" ".join(f"{c} ab{c}c9 {c}{k % 97:x}de f{c}" for c in signs[k : k + 500]) for k in range(0, len(signs), 500)] + ["", None, "_ab ab_ a b 9 AB K\u212aK \u0130ab I\u0307x", "q" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, memory string")
    path = str(tmp_path / "index")
    postings.add_documents(docs, path, block=50)
    cut = {r["id"]: r["w"] for r in docs.select("id", tokens(F.col("memory")).alias("w")).collect()}
    held = [(r["term"], i, n, length) for r in spark.read.parquet(f"{path}/postings").where("term is not null").collect() for i, n, length in zip(r["ids"], r["times"], r["lengths"], strict=True)]
    assert sorted(held) == sorted((t, i, n, len(w)) for i, w in cut.items() for t, n in Counter(w).items())
    assert len({t for t, *_ in held}) > 100
    some = pa.array(["bb aa cc", "", "aa dd-x ee", "ff gg hh"])
    rows = postings._block_lists(np.array([4, 1, 3, 2]), np.ones(4, bool), some, 0).to_pylist()
    order = [(r["part"], r["term"]) for r in rows[:-1]]
    assert order == sorted(order) and len(order) == 8 and rows[-1]["term"] is None and rows[-1]["part"] == -1 and rows[-1]["lengths"] == [0, 3, 3, 3]


def test_op6_hashes_are_put_in_order_as_by_a_stable_sort():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 2**64, 4000, dtype=np.uint64)[rng.integers(0, 4000, 20_000)]
    near = (hashes & ~np.uint64(0xFFFF)) | rng.integers(0, 5, len(hashes)).astype(np.uint64)  # differ in the bits that the places take
    for keys in (hashes, near, hashes & np.uint64(7), hashes[:1], hashes[:2], hashes[:0]):
        order, ordered = kn_lm._order(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and ordered.tolist() == keys[order].tolist()
        first, which = kn_lm._distinct(keys)
        want = np.unique(keys, return_index=True, return_inverse=True)
        assert first.tolist() == want[1].tolist() and which.tolist() == want[2].tolist()
