"""URL filters: host rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list is held twice: as bits (one row of eight longs a block) that every page is tested against, and as
rows that only the possible hits are joined with, which removes the filter's false positives. Both tests
are DataFrame joins on integers.

Pages and listed keys meet by a canonical key: no scheme, user info, port, query or fragment, host in lower case without a final dot and a first
``www.``, path without final slashes, its escapes in one form. The host and path that are returned, and that rules see, are those of the URL;
``listed_as`` is the key as it was listed. A key without a path lists a whole site; ``www.a.org/`` is the site ``a.org``.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, is not listed
and is allowed. Repeated pages are judged alike, each for itself. Where several listed keys hit a page, ``listed_as`` is the first by name; where rules
tie in length, the last by name. Very long urls are judged whole. An empty list blocks nothing. Columns of the input that
clash with the result's are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm._shared import lower_ascii

#: Bits a listed key sets in its block of WORDS longs.
WORDS, PROBES = 8, 6
#: A filter of at most this many blocks (64 bytes each) is broadcast; a larger one is joined by block.
BROADCAST_BLOCKS = 65_536
#: Listed keys of at most so many bytes are broadcast for the exact test; more are joined by a shuffle, whose skewed parts are split at run time.
BROADCAST_BYTES = 32_000_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_BARE = r"(?s)^([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); empty where there is no ``://``."""
    clean = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(clean, _PARTS, 1)), F.regexp_extract(clean, _PARTS, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    ``rules`` is configuration of the driver, (``host/path``, verdict); they become one CASE expression, longest first.
    """
    if len(rules) > 2_000:
        raise ValueError("more than 2,000 rules: join them as a table instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def canonical_host(host: Column) -> Column:
    """``host`` in lower case without user info, port, final dots and a first ``www.`` (where two labels follow)."""
    bare = F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"\.*(:[0-9]*)?$", "")
    return F.regexp_replace(lower_ascii(bare), r"^www\.(?=[^.]+\.)", "")


def canonical_path(path: Column) -> Column:
    """``path`` without final slashes; unreserved characters stand for themselves, others beyond ASCII are escaped, escapes have capital digits."""
    escaped = F.when(path.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c)), "")).otherwise(path)

    def one(x: Column, i: Column) -> Column:
        char, rest = F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long")), F.substring(x, 3, 2**31 - 1)
        plain = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), rest))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), plain).otherwise(F.concat(F.lit("%"), x))

    spelled = F.when(escaped.contains("%"), F.array_join(F.transform(F.split(escaped, "%"), one), "")).otherwise(escaped)
    return F.regexp_replace(spelled, "/+$", "")


def canonical_key(host: Column, path: Column) -> Column:
    """The key of a page, or of a whole site (``host/``) where there is no path; null where there is no host."""
    host, path = canonical_host(host), canonical_path(path)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path)))


def listed_key(key: Column) -> Column:
    """The canonical key of a listed one, with or without a scheme."""
    bare = F.regexp_replace(key, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return canonical_key(F.regexp_extract(bare, _BARE, 1), F.regexp_extract(bare, _BARE, 2))


def site_keys(host: Column) -> Column:
    """What a host is looked up as: itself and its parents (two labels at least) as a whole site."""
    bare = canonical_host(host)
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    sites = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, n), "."), F.lit("/")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(sites)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _probes(key: Column) -> Column:
    """The positions of a key's bits in its block."""
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(F.xxhash64(key, i), F.lit(64 * WORDS)).cast("int"))


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: (block, bits), an array of WORDS longs for each block with bits; partly built before the shuffle."""
    bits = listed.select(_block(F.col(key), blocks).alias("block"), F.explode(_probes(F.col(key))).alias("p"))
    word = lambda w: F.expr(f"bit_or(if(p div 64 = {w}, shiftleft(1L, cast(p % 64 as int)), 0L))")
    return bits.groupBy("block").agg(F.array(*[word(w) for w in range(WORDS)]).alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", key_col: str = "key", bits_per_key: int = 16) -> DataFrame:
    """Each page with host, path, rule, verdict and ``listed_as`` (the listed key it was blocked for, else null)."""
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_says": says})

    keys = listed.select(listed_key(F.col(key_col)).alias("_key"), F.col(key_col).alias("_listed")).where("_key is not null").groupBy("_key").agg(F.min("_listed").alias("_listed"))
    n, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_key") + F.octet_length("_listed")), F.lit(0))).first()
    blocks = 1 << max(4, math.ceil(math.log2(max(1, n) * bits_per_key / (64 * WORDS))))
    exact = F.broadcast(keys) if size <= BROADCAST_BYTES else keys
    bloom = bloom_blocks(keys, "_key", blocks).toDF("_block", "_bits")
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom

    passes = F.expr("forall(_probes, p -> (shiftright(_bits[p div 64], p % 64) & 1L) = 1L)")

    def sure(asked: DataFrame, by: list[str], name: str) -> DataFrame:
        """Of the distinct rows of ``by`` with ``_key`` those that are listed: the filter passes possible hits to the exact join."""
        probe = asked.withColumns({"_block": _block(F.col("_key"), blocks), "_probes": _probes(F.col("_key"))})
        possible = probe.join(bloom, "_block").where(passes).select(*by, "_key")
        return possible.join(exact, "_key").groupBy(*by).agg(F.min("_listed").alias(name))

    # Sites are looked up once for each distinct host, pages once for each distinct host and path.
    open_ = judged.where("rule is null and host != ''")
    hosts = open_.select("host").distinct().select("host", F.explode(site_keys(F.col("host"))).alias("_key"))
    paths = open_.select("host", "path").distinct().withColumn("_key", canonical_key(F.col("host"), F.col("path"))).where("_key is not null")
    out = judged.join(sure(hosts, ["host"], "_site"), "host", "left").join(sure(paths, ["host", "path"], "_page"), ["host", "path"], "left")
    out = out.withColumn("listed_as", F.when(F.col("rule").isNull(), F.least("_site", "_page")))
    verdict = F.coalesce(F.col("_says"), F.when(F.col("listed_as").isNotNull(), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "listed_as")
