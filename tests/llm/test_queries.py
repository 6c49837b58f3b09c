import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from memspark.llm import bpe
from memspark.llm import queries as Q
from tests.compare import assert_same
from tests.llm import helpers as H
from tests.llm.test_whole import plain_model


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    assert_same(Q.queries()[name](spark, sf), Q.oracle_sql()[name], sf)


def test_op3_against_all_pairs(spark, sf, texts):
    want = H.near_groups(texts, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op3_ngram_join(spark, sf).collect()} == want


def test_op4_held_out(spark, sf):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op4_lang_id(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) >= 0.9 * len(out)


def test_op5_against_the_library(spark, sf, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in Q.op5_token_count(spark, sf).collect():
        n = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 2048)


def test_op6_against_a_plain_model(spark, sf, texts):
    toks = {i: H.words(H.lower(t)) for i, t in texts.items()}
    train = [w for i, w in toks.items() if zlib.crc32(str(i).encode()) % 10]
    uni = Counter(x for w in train for x in [*w, None])
    n, v = sum(uni.values()), len(uni)
    plain = plain_model(train, 3)
    better = []
    for r in Q.op6_lm_score(spark, sf).collect():
        w = [*toks[r["doc_id"]], None]
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = plain(w[:-1])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
        if r["held_out"]:
            better.append(score - base)
    assert sum(better) > 0


def test_op7_keeps_first_and_unique_lines(spark, sf, texts):
    where = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            where[line].add(i)
    for r in Q.op7_line_dedup(spark, sf).collect():
        lines, kept = texts[r["doc_id"]].split("\n"), (r["text"] or "").split("\n")
        assert r["n_lines"] == len(lines) and r["n_dropped"] == len(lines) - len(kept) + (r["text"] == "" and r["n_dropped"] == len(lines))
        for line in set(lines) - set(kept):
            assert len(H.words(line)) >= 3
        for line in lines:
            if len(where[line]) >= 3 and len(H.words(line)) >= 3 and min(where[line]) != r["doc_id"]:
                assert line not in kept


def line_templates(line):
    """The templates that a line supports, and the line itself where it is long."""
    if re.search(r"[0-9@]|://", line):
        line_ = re.sub(r"[^ ]*([0-9@]|://)[^ ]*", "<*>", line)
    else:
        line_ = line
    w = H.words(line_)
    out = [("line", line)] if len(w) > 50 else []
    if len(w) < 3:
        return out
    head, rest = (len(w), *w[:3]), w[3:]
    if len(rest) < 8:
        return [*out, (head, tuple(w))]
    step = -(-len(rest) // 4)
    fields = [tuple(rest[k * step : (k + 1) * step]) for k in range(4)]
    return [*out, (head, tuple(fields)), *[(head, tuple(None if j == k else f for j, f in enumerate(fields))) for k in range(4)]]


def test_op7_against_plain_templates(spark, sf, texts):
    lines = {i: [(x, line_templates(x)) for x in t.split("\n")] for i, t in texts.items() if t is not None}
    held = defaultdict(set)
    for i, own in lines.items():
        for _, keys in own:
            for k in keys:
                held[k].add(i)
    again = {k: min(ids) for k, ids in held.items() if len(ids) >= (2 if k[0] == "line" else 3)}
    for r in Q.op7_line_dedup(spark, sf).collect():
        i = r["doc_id"]
        kept = [x for x, keys in lines[i] if all(again.get(k, i) == i for k in keys)]
        assert r["text"] == "\n".join(kept) and r["n_dropped"] == len(lines[i]) - len(kept), i


def test_op8_against_plain_ownership(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kinds = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16), "blob": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}", 0, 20)}
    spans, owners, repos = {}, defaultdict(set), defaultdict(set)
    for d in docs:
        found = [(m.start(), list(kinds).index(k), m.end(), k, m[g]) for k, (p, g, least) in kinds.items() for m in re.finditer(p, d["text"] or "", re.ASCII) if len(m[g]) >= least]
        spans[d["doc_id"]] = sorted(found)
        for *_, value in found:
            owners[value].add(d["source"] or "")
            repos[value].add(d["text"])
    example = {v for v in owners if len(owners[v]) >= 3 or len(repos[v]) >= 10}
    for r in Q.op8_secrets(spark, sf).collect():
        base = [s for s in spans[r["doc_id"]] if s[3] != "blob"]
        added = [s for s in spans[r["doc_id"]] if s[3] == "blob" and s[4] not in example and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        every = sorted(base + added)
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in every)
        assert (r["n_live"], r["n_example"]) == (sum(s[4] not in example for s in every), sum(s[4] in example for s in base))


def test_op8_base_spans(spark, sf, texts):
    kinds = [(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
    for r in Q.op8_secrets(spark, sf).collect():
        found = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]] or "") if len(m[g]) >= least)
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert not said or set(said.split(",")) <= set(r["spans"].split(","))


def test_op9_finds_every_passage(spark, sf, texts):
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", H.lower(t)).strip()
    items = {r["item_id"]: fold(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in Q.op9_decontamination(spark, sf).collect():
        inside = {i for i, t in items.items() if t in fold(texts[r["doc_id"]] or "")}
        assert inside <= set(r["items"]) and r["contaminated"] == bool(r["items"])


def test_op10_against_the_library(spark, sf, texts):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in Q.op10_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[r["doc_id"]] or "").encode()))
