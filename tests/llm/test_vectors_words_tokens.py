"""Near copies of embeddings, spelling variants and token alignment against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import spelling, token_align, vector_dups
from tests.compare import assert_same
from tests.llm.helpers import ODD, odd

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Embeddings.


def linked_by_all_pairs(rows, threshold):
    """(id, links, component) of each row, in order."""
    ok = [i is not None and label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    n = len(rows)
    links, up = [set() for _ in range(n)], list(range(n))
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    seen = {}
    for a in range(n):
        group, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - group:
                group.add(b)
                todo.append(b)
        seen[a] = min(rows[b][0] for b in group) if rows[a][0] is not None else None
    return [(rows[a][0], len(links[a]), seen[a], rows[a][0] is None or seen[a] == rows[a][0]) for a in range(n)]


def vectors(n, dimension, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dimension))
    out = []
    for k in range(n):
        v = centres[k % clusters] * rng.choice([0.5, 1, 3]) + rng.normal(size=dimension) * rng.choice([0.02, 0.08, 0.15])
        out.append((k, [float(np.float32(x)) for x in v], k % 3))
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("clusters", "block"), [(4, 2048), (60, 16)])
def test_embeddings_equal_all_pairs(spark, clusters, block):
    rows = vectors(360, 10, clusters, clusters)
    rows += [(1000 + k, rows[k % 4][1], rows[k % 4][2]) for k in range(40)]  # exact copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = linked_by_all_pairs(rows, 0.98)
    assert sum(r[1] for r in want) > 500
    assert found(vector_dups.near_vectors(df, block=block)) == sorted(want, key=repr)


def test_odd_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0], None),
            (11, [1.0, 0.0, 0.0], 0), (12, [-0.0, 1e-30], 0), (12, [0.0, 1e-30], 0), (2, [0.0, 5.0], 0), (13, [1e30, 1.0], 0), (14, [0.2, 1.0], 0), (15, [0.2, 0.99], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cid", "2 as n", "3 as id", "'x' as vec", "0 as list")
    # Two vectors share the id 2: each has its own component, named by the least id in it.
    assert found(vector_dups.near_vectors(df)) == sorted(linked_by_all_pairs(rows, 0.98), key=repr)
    assert vector_dups.near_vectors(df.where("false")).count() == 0


def test_the_index_prunes_and_loses_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 16))
    x = vector_dups.unit_vectors(pa.array((centres[np.arange(4000) % 64] + 0.05 * rng.normal(size=(4000, 16))).tolist()), 16)
    index = vector_dups.fit(x, 1e7, 0.98)
    assert len(index.lists) > 16
    y = x.astype(np.float32)
    d2 = index.distances(y)
    own = d2.argmin(1)
    visits = index.visits(y, own, d2)
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert visits[a, own[b]].all() and visits.mean() < 0.2
    codes, left = index.encode(y - index.lists[own])
    some = own == own[0]
    far = sum(index.tables(y[some] - index.lists[own[0]])[:, m][:, codes[some][:, m]] for m in range(codes.shape[1]))
    near = x[some] @ x[some].T >= 0.98
    assert (far[near] <= ((left[some] + index.radius + vector_dups.SLACK) ** 2)[np.nonzero(near)[1]]).all()


# Words.


def variants_of(docs):
    run, low = re.compile("[A-Za-zÀ-ÿ]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for doc_id, text in docs:
        for w in run.findall(text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    without, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            without[k, w[:k] + w[k + 1 :]].add(w)
            without[w[:k] + w[k + 1 :]].add(w)
    for key, group in without.items():
        for w in group if isinstance(key, tuple) else ():
            near[w] |= group - {w}
        if key in n:
            near[key] |= group
            for w in group:
                near[w].add(key)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


@pytest.mark.parametrize("block", [2048, 5])
def test_spelling_equals_brute_force(spark, block):
    rng = random.Random(block)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Aaaaaab", "x" * 3000, "x" * 3001]
    docs = []
    for k in range(300):
        words = rng.choices(base, weights=[1 + 400 // (1 + j) for j in range(len(base))], k=60)
        docs.append((k if k % 7 else None, " ".join(w[: (p := rng.randrange(len(w)))] + rng.choice("abcé") + w[p + rng.randint(0, 1) :] if rng.random() < 0.2 else w for w in words)))
    docs += [(1000 + k, "plants " * 20 + "plantz " * (3 + k % 2) + "plantzy " * (k % 5 == 0)) for k in range(40)]  # a chain of forms
    docs += [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "2 as id", "3 as run")
    want = variants_of(docs)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != (r[1] or r[0]) for r in want)
    assert sorted(map(tuple, spelling.variants(df, block=block).collect()), key=lambda r: r[0]) == want
    assert spelling.variants(odd(spark).where("false")).count() == 0


def test_queries_equal_their_sql(spark, sf):
    import __spark_entry__

    for name in ("op11_embedding_dups", "op12_spelling"):
        assert_same(__spark_entry__.queries()[name](spark, sf), __spark_entry__.oracle_sql()[name], sf)


# Tokens.


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned(docs):
    a, b, byte = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B), byte_of()
    a.encode_special_tokens = True
    rows, counts = [], Counter()
    for doc_id, text in docs:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        of_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
        of_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or not b"".join(of_a) == b"".join(of_b) == f" {text}".encode():
            rows.append((doc_id, 0, 0, []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        both, groups = [0, *sorted({*ends_a} & {*ends_b})], []
        for lo, hi in zip(both, both[1:], strict=False):
            groups.append(([k for k, e in zip(ids_a, ends_a, strict=True) if lo < e <= hi], [k for k, e in zip(ids_b, ends_b, strict=True) if lo < e <= hi])) if len(text) < 3000 else None
        if len(text) >= 3000:
            at_a = at_b = 0
            for hi in both[1:]:
                x, y = at_a, at_b
                while at_a < len(ends_a) and ends_a[at_a] <= hi:
                    at_a += 1
                while at_b < len(ends_b) and ends_b[at_b] <= hi:
                    at_b += 1
                groups.append((ids_a[x:at_a], ids_b[y:at_b]))
        counts.update((x[-1], y[-1]) for x, y in groups)
        rows.append((doc_id, len(ids_a), len(ids_b), groups))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for doc_id, n_a, n_b, groups in rows:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(pairs), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


STRANGE = [" ", "  a  b ", " \n x", "a b", "a  b", "日本語 テキスト 。" * 30, "é" * 2000, "x" * 900 + " " + "y" * 40, "<|endoftext|> <s> <0x41> </s>", "a▁b c", "\t\tfoo\n\n  bar", "don't they'll  I'm 's", "🙂 🙂🙂  🙂", "a\x1c b \x85 c", "\x00 a", "word " * 4000, "word " * 4000, "ﬁ ½ ² é"]


@pytest.mark.parametrize(("chunk", "hot"), [(1 << 16, 500_000), (9, 3)])
def test_alignment_equals_the_libraries(spark, chunk, hot):
    rng = random.Random(chunk)
    parts = ["a", "b", " ", "  ", "\n", "é", "的", "the", "'s", ".", "12", "　", "🙂", "\r\n", "Ġ", "internationalisation", " of"]
    texts = STRANGE + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(60)]
    docs = [(k if k % 11 else None, t) for k, t in enumerate(texts)] + [(r[0], r[1]) for r in ODD[1:8]] + [(5, "x▁" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as row", "3 as h", "4 as seq", "5 as id").repartition(3)
    assert found(token_align.align(df, PATH_A, PATH_B, chunk=chunk, hot=hot)) == aligned(docs)


def test_alignment_of_no_rows(spark):
    assert token_align.align(odd(spark).where("false"), PATH_A, PATH_B).count() == 0


def test_fragments_compose_in_any_order():
    made = token_align.Tokenizers(PATH_A, PATH_B)
    text = "Unbelievably, the internationalisation of 12345 tokenisers; " * 3
    whole, numbers, pairs = token_align.in_range(made, text, 0, 0, len(text) + 1)
    parts = [token_align.in_range(made, part, at, lo, hi) for lo, hi, at, part in token_align.ranges(text, 3)]
    assert len(parts) > 50 and any(not f.cut for f, _, _ in parts)
    rng = random.Random(1)
    for _ in range(20):
        row = [f for f, _, _ in parts]
        while len(row) > 1:
            k = rng.randrange(len(row) - 1)
            row[k : k + 2] = [token_align.compose(row[k], row[k + 1])]
        assert row[0] == whole
    assert (sum(n for _, n, _ in parts) == numbers).all()
    assert sorted(np.concatenate([p for _, _, p in parts]).tolist()) == sorted(pairs.tolist())


def test_alignment_of_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500")
    assert found(token_align.align(docs, PATH_A, PATH_B, hot=2000)) == aligned([tuple(r) for r in docs.select("doc_id", F.col("text")).collect()])
