"""Quality rules, line first: each line is judged by itself, failing lines go, and a document that loses too much goes.

All of it is one projection of built-in functions: no shuffle, no Python.

Defined cases: a null text has no words, lines or symbols, and fails (fewer than ``min_words`` words). An
empty text likewise. Repeated rows are judged alike, and nothing is ranked, so there are no ties. A line may end in blanks or \\r. Very long texts are judged whole:
the repeated-window count sorts window hashes inside the row, n log n in the row's words. An empty table gives an empty one. Columns of the
input that have a result's name are replaced in their place; all others are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm._shared import carried, held, restored

# Phrases of boilerplate lines, and the punctuation that may end a line.
BOILERPLATE = "all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie policy|subscribe now|click here|sign up|log in|copyright (c)|enable javascript|read more"
LINE_END = r"[.!?:;…][\"'”’»)\]]*[ \t\r]*\z"

#: What ``judge`` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "clean_words", "base_failed", "kept")
_SPLIT = r"'[\\x20\\x09-\\x0D]+'"


def words(text: str) -> str:
    """SQL of the words of a text."""
    return f"filter(split({text}, {_SPLIT}), w -> w != '')"


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (as ``_row``) with ``_words``, ``_lines`` and the measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    n_repeat_words counts the word positions that lie in a window of three words found twice or more. Windows
    are told apart by a 64-bit hash within their document.
    """
    out = carried(docs, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    out = out.withColumns({"_words": F.expr(words("_t")), "_lines": F.expr(r"filter(split(_t, '\n'), l -> trim(BOTH ' \t\u000b\u000c\r' FROM l) != '')")})
    out = out.withColumns({
        "n_words": F.expr("cast(size(_words) as bigint)"),
        "word_chars": F.expr(r"cast(length(translate(_t, ' \t\n\u000b\u000c\r', '')) as bigint)"),
        "n_symbols": F.expr("cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)"),
        "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
        "_win": F.expr("if(size(_words) < 3, cast(array() as array<struct<h:bigint,p:int>>), sort_array(transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as p))))"),
    })
    out = out.withColumn("_again", F.expr("sort_array(transform(filter(_win, (x, k) -> (k > 0 and _win[k - 1].h = x.h) or (k < size(_win) - 1 and _win[k + 1].h = x.h)), x -> x.p))"))
    return out.withColumn("n_repeat_words", F.expr("aggregate(_again, struct(cast(-9 as int) as last, cast(0 as bigint) as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"))


def clean_lines(docs: DataFrame, max_symbol_share: float = 0.3, nav_bars: int = 3, nav_share: float = 0.2, boilerplate_words: int = 25) -> DataFrame:
    """``docs`` of base_measures with ``_kept``: the lines that pass every rule.

    A line fails if it does not end with closing punctuation, if its symbols or shouted marks outnumber
    ``max_symbol_share`` of its words, if at least ``nav_bars`` bars make up ``nav_share`` of its words
    (navigation), or if it is short and holds a boilerplate phrase. Lines without words stay.
    """
    n = "size(split(trim(l), ' +'))"
    return docs.withColumn("_kept", F.expr(f"""filter(split(_t, '\\n'), l -> trim(BOTH ' \\t\\u000b\\u000c\\r' FROM l) = '' or (
        l rlike '{LINE_END.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'")}'
        and length(l) - length(translate(l, '#*$%&<>', '')) <= {max_symbol_share}D * {n}
        and (length(l) - length(replace(l, '!!', ''))) / 2 <= {max_symbol_share}D * {n}
        and (length(l) - length(replace(l, '|', '')) < {nav_bars} or length(l) - length(replace(l, '|', '')) < {nav_share}D * {n})
        and not ({n} <= {boilerplate_words} and lower(l) rlike '{BOILERPLATE.replace("(c)", "[(]c[)]")}')))"""))


def judge(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_loss: int = 50) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept``, ``clean_text`` and ``clean_words``.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat`` per cent of them in repeated windows.
    kept: not base_failed, and the lines that fail hold at most ``max_loss`` per cent of the words.
    """
    out = clean_lines(base_measures(docs, text_col)).withColumn("clean_text", F.expr(r"array_join(_kept, '\n')"))
    out = out.withColumns({"clean_words": F.expr(f"cast(size({words('clean_text')}) as bigint)"), "base_failed": F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words")})
    out = out.withColumn("kept", held(F.expr(f"not base_failed and 100 * (n_words - clean_words) <= {max_loss} * n_words")))
    return restored(out, docs.columns, **{c: c for c in RESULTS})
