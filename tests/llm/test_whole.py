"""Small cases of the whole job that smaller ones would not notice."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from memspark.llm import kn_lm, line_dedup, secrets, url_filter


def plain_model(texts, order):
    """Log10 probability of a text (list of words) by an interpolated modified Kneser-Ney model, from its definition."""
    counts = [Counter() for _ in range(order + 1)]
    for words in texts:
        toks = ["<s>", *words, None]
        for i in range(1, len(toks)):
            k = min(order, i + 1)
            counts[k][tuple(toks[i - k + 1 : i + 1])] += 1
    for k in range(order, 1, -1):  # distinct words before each shorter n-gram
        for gram in counts[k]:
            counts[k - 1][gram[1:]] += 1
    heads = [defaultdict(list) for _ in counts]
    for k in range(1, order + 1):
        for gram, c in counts[k].items():
            heads[k][gram[:-1]].append(c)

    def discounts(values):
        n1, n2, n3, n4 = (max(1, sum(c == k for c in values)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [min(max(x, low), high) for x, low, high in ((1 - 2 * y * n2 / n1, 0.05, 0.95), (2 - 3 * y * n3 / n2, 0.1, 1.9), (3 - 4 * y * n4 / n3, 0.15, 2.85))]

    d = [None, *[discounts(list(c.values())) for c in counts[1:]]]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        seen = heads[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        c = counts[k][gram]
        return ((c - d[k][min(c, 3) - 1] if c else 0) + sum(d[k][min(x, 3) - 1] for x in seen) * p(gram[1:])) / sum(seen)

    def score(words):
        toks = ["<s>", *words, None]
        return sum(math.log10(p(tuple(toks[max(0, i - order + 1) : i + 1]))) for i in range(1, len(toks)))

    return score


@pytest.mark.parametrize("order, hot", [(2, ""), (3, ""), (4, ""), (2, "a b x"), (3, "a b x"), (4, "a b c d e f g h x")])
def test_language_model_of_an_order(spark, monkeypatch, order, hot):
    if hot:
        monkeypatch.setattr(kn_lm, "hot_words", lambda *_: tuple(int(x) for x in kn_lm.tokens(pa.array([hot]))[0][:-1]))
    rng = random.Random(6)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(60)] + [["a", "b"]] * 300
    rows = [(k, " ".join(w)) for k, w in enumerate([*texts, ["x", "a"], ["a", "b", "x", "c", "d"]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_model(texts, order)
    got = kn_lm.score(df, kn_lm.train_model(df.where(f"doc_id < {len(texts)}"), order=order)).collect()
    assert all(math.isclose(r["score"], want(dict(rows)[r["doc_id"]].split()), rel_tol=1e-9) for r in got) and len(got) == len(rows)
    assert {r["train_tokens"] for r in got} == {sum(len(w) + 1 for w in texts)}


def test_language_model_knows_longer_contexts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d b e")] * 20, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b c"), (2, "a b e")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in kn_lm.score(asked, kn_lm.train_model(df)).collect()}
    assert got[1] > got[2] + 0.5


def test_urls_meet_by_canonical_keys(spark):
    listed = spark.createDataFrame([("TH.example.com/en/671",), ("https://www.site.org:443/",), ("a.org/caf%c3%a9/%7Ex/",), ("b.org/p?q",)], "key string")
    hit = ["http://www.th.example.com/en/671", "http://th.example.com/en/671/", "http://th.example.com:8080/en/671?x", "http://me:pw@TH.example.com./en/671#f", "http://th.example.com/%65n/671",
        "http://site.org", "http://sub.site.org/x", "http://www.site.org/", "http://a.org/café/~x", "http://a.org/caf%C3%A9/%7ex", "http://b.org/p"]
    miss = ["http://th.example.com/en/6711", "http://th.example.com/EN/671", "http://site.org.net/", "http://a.org/cafe/~x", "http://a.org/caf%C3%A9%2F~x", "http://www.org/", "http://a.org/%", "http://me@/x"]
    pages = spark.createDataFrame(list(enumerate(hit + miss)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert [got[k]["verdict"] for k in range(len(got))] == ["block"] * len(hit) + ["allow"] * len(miss)
    assert (got[3]["host"], got[3]["path"], got[0]["listed_as"]) == ("me:pw@th.example.com.", "/en/671", "TH.example.com/en/671")


def test_secrets_count_repositories(spark):
    spread, copied, few = "EXAMPLE1234567890example00", "Zq8vK2mX9wRt4Ly7Bn3Pd6", "Hn5cT1bV6xQs8Jk4Wm2Rf9"
    texts = [f"page {k} says {spread}" for k in range(10)] + [f"one text with {copied}"] * 30 + [f"page {k} says {few}" for k in range(9)]
    for source in ("hot", None):
        df = spark.createDataFrame([(k, t, source) for k, t in enumerate(texts)], "doc_id long, text string, source string")
        got = {r["doc_id"]: (r["spans"] != "", r["n_live"]) for r in secrets.scan(df).collect()}
        assert [got[k] for k in range(len(texts))] == [(False, 0)] * 10 + [(True, 1)] * 39
    counts = secrets.ownership(secrets.matches(spark.createDataFrame([(1, f"see {few}", "a"), (2, f"see {few}", "b"), (3, f"also {few}", "b")], "doc_id long, text string, source string")))
    assert [(r["n_owners"], r["n_repos"]) for r in counts.collect()] == [(2, 2)]


def test_long_lines_go_from_the_second_document_on(spark):
    words = lambda k, n: " ".join(f"{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))
    long, short, own = words(0, 51), words(1, 50), [words(k, 60) for k in range(2, 5)]
    texts = [f"{own[k]}\n{long}\n{short}" for k in range(2)] + [own[2]]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, texts[0]), 1: (1, f"{own[1]}\n{short}"), 2: (0, texts[2])}
