"""Plain definitions that the operators are held against."""

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, n):
    w = words(lower(text))
    return frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def near_groups(docs, n, percent):
    """component of each id, by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, n) for i, t in docs.items()}
    up = {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    held = {}
    for i, s in sets.items():
        for j in {j for g in s for j in held.get(g, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            held.setdefault(g, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


#: Nulls in any column, empty and very long texts, ties and repeated rows, and names that the operators use themselves.
ODD = [
    (1, "word " * 30000, "en", "a"), (2, "", "en", None), (3, None, None, "a"), (None, "no id here at all", "en", "a"),
    (4, "Same text as the next one, in five words.", "en", "a"), (5, "same text as the next one,  in five\nwords.", "en", "b"), (5, "same text as the next one,  in five\nwords.", "en", "b"),
    (6, "x", "de", "a"), (7, "\t \n \x0b\x0c\r", "fr", "c"), (8, "ünïcode 日本語 😀 " * 50, "xx", "c"), (9, "é" * 5000, "fr", "c"),
]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as n_words", "'k' as kind", "2 as _id", "3 as value", "'r' as row", "4 as t", "5 as h1", "6 as ids")
