"""Rows of equal id, languages of few distinct texts and files that are not seen: each has a right answer or an error."""

import os
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from memspark.llm import kn_lm, lang_id, ngram_join, url_filter
from tests.llm.helpers import odd

A = " ".join(f"word{k}" for k in range(60))
NEAR = A.replace("word59", "other")
B = " ".join(f"thing{k}" for k in range(60))


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")


def test_equal_ids_are_judged_by_their_texts(spark):
    docs = documents(spark, [(1, A), (5, NEAR), (5, B), (5, B), (7, B), (None, A), (9, None)])
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 56, 1), (5, 56, 1), (5, 56, 5), (5, 56, 5), (7, 56, 5), (None, 56, None), (9, 0, 9)], key=repr)


def test_the_pipeline_keeps_unique_texts_of_an_id(spark):
    docs = documents(spark, [(1, A), (5, NEAR), (5, B)])
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(1, A), (5, B)]


def test_a_language_of_one_text_is_learned(spark):
    english = [(f"the quick brown fox number {k} jumps over the lazy dog", "en") for k in range(500)]
    german = [("der schnelle braune fuchs springt über den faulen hund", "de")] * 5000
    rows = spark.createDataFrame(english + german + [("", "fr"), (None, "es"), ("123", "it")], "text string, lang string")
    found = lang_id.fit(rows)
    assert list(found) == ["de", "en"]
    out = lang_id.identify(spark.createDataFrame([(1, "der braune fuchs springt"), (2, "the lazy dog jumps over")], "doc_id long, text string"), found).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in out} == {1: "de", 2: "en"}


def test_many_languages_share_the_room(spark):
    rows = spark.range(500).selectExpr("concat('words of language number ', id) text", "concat('l', id) lang")
    found = lang_id.fit(rows, all_bytes=10_000)
    assert len(found) == 500 and max(map(len, found.values())) <= 20


def test_a_missing_file_of_the_model_is_an_error(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    model = kn_lm.train_model(docs, part_bytes=20_000)
    want = sorted(map(tuple, kn_lm.score(docs, model).collect()))
    folder = shutil.copytree(model[0], f"{model[0]}-part")
    for name in sorted(os.listdir(folder))[::2]:
        os.remove(f"{folder}/{name}")
    with pytest.raises(Exception, match="must be a folder that all machines share"):
        kn_lm.score(docs, (folder, *model[1:])).collect()
    assert sorted(map(tuple, kn_lm.score(docs, model).collect())) == want


@pytest.mark.parametrize("left", [[], ["__init__.py"]])
def test_the_entry_imports_with_what_a_deletion_leaves(tmp_path, left):
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "memspark", tmp_path / "memspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "memspark/llm/__pycache__").mkdir(parents=True)
    for name in left:
        shutil.copy(root / "memspark/llm" / name, tmp_path / "memspark/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_clashing_names(spark):
    rows = odd(spark)
    plain = rows.select("doc_id", "text", "lang", "source")
    found = lang_id.fit(plain)
    assert sorted(map(repr, lang_id.identify(rows, found).collect())) == sorted(map(repr, lang_id.identify(plain, found).collect()))
    model = kn_lm.train_model(rows, part_bytes=20_000)
    assert sorted(map(repr, kn_lm.score(rows, model).collect())) == sorted(map(repr, kn_lm.score(plain, model).collect()))
    pages = spark.createDataFrame([(1, "http://a.org/x", "h"), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as key", "3 as rule")
    listed = spark.createDataFrame([("a.org/x",)], "key string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, listed, (("net/", "block"),)).collect()} == {1: "block", 2: "allow"}


def test_language_query_against_a_plain_version(spark, sf):
    """The query's rows: dictionaries of the texts of smallest hash, and the smallest sum of compressed blocks."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).collect()
    letter = re.compile(r"[^\W\d_]")
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    train = [r for r in rows if not held[r["doc_id"]] and r["lang"] is not None and letter.search(r["text"] or "")]
    sizes = Counter(r["lang"] for r in train)
    tools = {}
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        texts = {r["h"]: r["text"] for r in train if r["lang"] == lang}
        kept, total = [], 0
        for h in sorted(texts)[:200]:
            begin = max(1, len(texts[h]) // 2 - 1024) - 1
            if total < 112_640:
                kept.append(texts[h][begin : begin + 2048])
            total += len(texts[h][begin : begin + 2048])
        content = "\n".join(reversed(kept)).lower().encode()[-112_640:]
        tools[lang] = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op4_lang_id"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        said = got[r["doc_id"]]
        assert said["held_out"] == held[r["doc_id"]] and 0 <= said["score"] <= 1
        if not letter.search(r["text"] or ""):
            assert said["lang_pred"] == "und"
            continue
        data, blocks, at = r["text"].lower().encode(), [], 0
        while at < len(data):
            end = min(len(data), at + 4096)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            blocks.append(data[at:end])
            at = end
        sums = [sum(len(tool.compress(b)) for b in blocks) for tool in tools.values()]
        assert said["lang_pred"] == list(tools)[sums.index(min(sums))]
