"""Text expressions: tokens, titles, redaction, enrichment defaults. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.constants import CHARS_PER_TOKEN, ENRICHMENT_TYPES, RATING_WEIGHTS


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of two characters or more; words with other letters are no tokens. Null gives none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[a-z0-9]{2,}$"))


def token_text(text: Column) -> Column:
    """The lower-cased text with a space for each character beyond ASCII that is no letter or digit: every byte of 128 or more is then of a word, and ``tokens`` can be found by bytes alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.regexp_replace(low, r"[^\x00-\x7F\p{L}\p{N}]", " "))


def word_tokens(text: Column) -> Column:
    """Lower-case words of any letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def title(text: Column) -> Column:
    """The first sentence, or 47 characters of it and dots; the text's start where that is empty."""
    first = strip(F.split(text, r"\.")[0])
    return F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 47), F.lit("..."))).when(F.length(first) > 0, first).otherwise(F.substring(text, 1, 50))


def truncate(text: Column, n: int = 120) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


# What is taken for a secret, in the order of the rules, and its replacement.
SECRETS = (
    (r"(^|\s)([A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|API|PASS|PWD|AUTH)[A-Z0-9_]*)\s*=\s*\S+", "$1$2=[REDACTED]"),
    (r"""(?i)(token|password|api[_-]?key|secret|credential|auth)\s*[:=]\s*["']?[^\s"']{4,}["']?""", "$1=[REDACTED]"),
    (r"Bearer\s+[A-Za-z0-9._/+=\-]+", "Bearer [REDACTED]"),
    (r"\bsk-[A-Za-z0-9_\-]{16,}", "[REDACTED]"),
    (r"\bghp_[A-Za-z0-9]{20,}", "[REDACTED]"),
    (r"\bAKIA[A-Z0-9]{16}\b", "[REDACTED]"),
)
# Home folders, addresses (two characters and the domain stay) and keys in what is displayed.
PEOPLE = (
    (r"""/Users/[\p{L}\p{N}_]+(?:/[^\s"']*)?""", "/~/..."),
    (r"""/home/[\p{L}\p{N}_]+(?:/[^\s"']*)?""", "/~/..."),
    (r"([\p{L}\p{N}_.+-]{1,2})[\p{L}\p{N}_.+-]*@([\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+)", "$1***@$2"),
    (r"sk-ant-\S+", "sk-***"),
)


def _replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def redact_secrets(text: Column) -> Column:
    """Assignments of names that imply a secret, keyword values, then tokens of known shapes become [REDACTED]."""
    return _replaced(text, SECRETS)


def redact_people(text: Column) -> Column:
    """Home folders with what is below them, addresses but two characters and the domain, and keys. Null stays null."""
    return _replaced(text, PEOPLE)


def validated_type(kind: Column) -> Column:
    return F.when(kind.isin(*ENRICHMENT_TYPES), kind).otherwise("fact")


def validated_weight(weight: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(weight.try_cast("double"), F.lit(0.5))))


def validated_hours(hours: Column) -> Column:
    """Whole hours between 1 and 8760, null where there is no number."""
    return F.greatest(F.lit(1), F.least(F.lit(8760), hours.try_cast("int")))


def keywords(text: Column) -> Column:
    """Distinct lower-case parts of more than two characters, cut at spaces, dashes and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s_-]+"), lambda w: F.length(w) > 2))


def relevant(text: Column, words: Column) -> Column:
    """Whether enough of the words are in the text: one if there are two at most, else two."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: low.contains(w))) >= F.when(F.size(words) <= 2, 1).otherwise(2)


def validated_tags(tags: Column) -> Column:
    """At most five non-empty tags of 20 characters."""
    return F.slice(F.transform(F.filter(tags, lambda t: t != ""), lambda t: F.substring(t, 1, 20)), 1, 5)


def validity_end(now: Column, hours: Column) -> Column:
    return now + F.make_interval(hours=validated_hours(hours))


def expired(end: Column, now: Column) -> Column:
    """Whether the time is past; no time, or none that can be read, never is."""
    return F.coalesce(now > end.try_cast("timestamp"), F.lit(False))


def experience_text(situation: Column, insight: Column, applies_when: Column, result: Column) -> Column:
    """What an experience is searched by: its non-empty parts."""
    return F.array_join(F.filter(F.array(situation, insight, applies_when, result), lambda x: x != ""), " ")


def json_body(text: Column) -> Column:
    """The text in a fence of backquotes (with or without ``json``), or the whole; null where that is no JSON."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    body = strip(F.when(text.contains("```"), inside).otherwise(text))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def enrichment(response: Column) -> Column:
    """type, weight, title, tags and validity_hours of the first object in a response, validated; what is missing or broken has its default."""
    v = F.try_parse_json(F.regexp_extract(response, r"(?s)\{.*\}", 0))
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    return F.struct(
        validated_type(get("type", "string")).alias("type"), validated_weight(get("weight", "string")).alias("weight"), get("title", "string").alias("title"),
        F.coalesce(validated_tags(get("tags", "array<string>")), F.array().cast("array<string>")).alias("tags"), validated_hours(get("validity_hours", "string")).alias("validity_hours"),
    )


# Prompts that ask for nothing.
TRIVIAL = ("yes", "no", "ok", "continue", "go", "done", "next", "thanks", "thank you")


def trivial_prompt(prompt: Column) -> Column:
    """Prompts under ten characters, and plain confirmations."""
    return (F.length(prompt) < 10) | F.lower(strip(prompt)).isin(*TRIVIAL)


def decision_type(kind: Column) -> Column:
    return F.when(kind.isin("decision", "insight"), kind).when(kind == "commitment", "action").otherwise("decision")


def stage_rewards(n: Column) -> Column:
    """The rewards of a process of ``n`` stages: from 0 to .8 in equal steps."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(i * 0.8 / F.greatest(n - 1, F.lit(1)), 2))


def clean_query(query: Column) -> Column:
    """The user's own words of a query with context lines around it, redacted; null where under five characters are left."""
    lines = F.transform(F.split(query, "\n"), strip)
    own = F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(r"^(/|Ran:|Edited |Wrote |- |\*\*)") & ~x.rlike(r"^[a-f0-9]{8,}"))
    text = F.array_join(own, " ")
    return F.when(F.length(text) >= 5, redact_people(text))


def memory_preview(content: Column, kind: Column) -> Column:
    """What is shown of a memory: of a session's summary the first line that reads as prose, of others the start."""
    lines = F.transform(F.split(content, "\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), "^#+|#+$", ""), "^-+|-+$", "")))
    code = lambda x: x.rlike(r"[{}=]|json\.load|\(f\)")
    prose = F.filter(lines, lambda x: (F.length(x) >= 10) & ~code(x))
    summary = F.when(F.size(prose) > 0, truncate(F.element_at(prose, 1), 150)).otherwise(truncate(F.split(content, "\n")[0], 100))
    other = truncate(F.when(content.startswith("Ran: "), F.substring(content, 6, 2**31 - 1)).otherwise(content), 200)
    return redact_people(F.when(kind.isin("session_summary", "session"), summary).otherwise(other))


def compact_observation(context: str = "context", tags: str = "tags") -> list[Column]:
    """The six columns of an observation that are kept with a reward."""
    return [F.col("id"), F.col("tool"), F.col("summary"), F.col("type"), F.col(f"{context}.file_path").alias("file_path"), F.coalesce(tags, F.expr("cast(array() as array<string>)")).alias("tags")]


def rating_weight(rating: Column) -> Column:
    """A rating of 0 to 10 as a weight, from a table of fixed values; 0 for any other."""
    return F.coalesce(F.get(F.array(*map(F.lit, RATING_WEIGHTS)), rating), F.lit(0.0))
