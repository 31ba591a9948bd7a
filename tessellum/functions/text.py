"""Column functions over text: chunks, terms, tokens, hints, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 800, 100
QUERY_STOP = "about and are does for from has have how implemented into that the this to was what when where which who why will with".split()
STATS_STOP = "about all and are but const export false for from function import into let not null return that the their there they this true var what when which will with would you".split()
SUMMARY_STOP = "about and are for from has have into its not that the this was were will with you your".split()
EVAL_STOP = "a an and are as at be by do does for from has have how in is it its of on or that the this to was what when where which who why will with".split()
#: A token of the word index.
TOKEN = r"[\p{L}\p{N}_$]+"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def chunk(df: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: chunk_index, chunk_start, chunk_end, body in place of text.

    Windows of ``size`` characters, ``size - overlap`` apart, until the end is
    reached; null and empty texts give none.  Offsets count code points.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap smaller than it")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    rest = [c for c in df.columns if c != text]
    rows = df.where(F.length(text) > 0).select(*rest, F.col(text), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select(*rest, "chunk_index", start.alias("chunk_start"), F.least(start + size, F.length(text)).alias("chunk_end"), F.substring(F.col(text), start + 1, F.lit(size)).alias("body"))


def fold(text: Column) -> Column:
    """Lower case without the diacritics of the Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def index_tokens(text: Column) -> Column:
    """The word index's tokens: runs of letters, digits, _ and $, folded."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def keyword_terms(text: Column, most: int = 8) -> Column:
    """Query terms: trimmed of edge punctuation (a final dot stays), 3 characters or more, no stop word, each once, the first ``most``."""
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[^A-Za-z0-9_]+", ""), r"[^A-Za-z0-9_.]+$", ""))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(literals(QUERY_STOP), F.lower(w)))
    unique = F.filter(kept, lambda w, i: F.array_position(F.transform(kept, F.lower), F.lower(w)) == i + 1)
    return F.slice(unique, 1, most)


def substring_terms(query: Column) -> Column:
    """Terms of the substring lane: three characters or more, lower case."""
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.length(w) >= 3)


def word_terms(query: Column) -> Column:
    """Terms of the word lane: edge punctuation but _ and $ stripped, none empty."""
    trimmed = F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[^\p{L}\p{N}_$]+", ""), r"[^\p{L}\p{N}_$]+$", ""))
    return F.filter(trimmed, lambda w: F.length(w) > 0)


def is_identifier(term: Column) -> Column:
    """Whether a term looks like a name from code: a digit, _, $, - or a lower-upper step."""
    return term.rlike(r"[0-9_$\-]|[a-z][A-Z]")


def is_refusal(answer: Column) -> Column:
    return F.coalesce(F.ltrim(answer).rlike(r"^(NO_ANSWER|$)"), F.lit(True))


def lead_sentence(text: Column, cap: int = 200) -> Column:
    """The first sentence, or the whole text; at most ``cap`` characters."""
    whole = F.trim(text)
    first = F.regexp_extract(whole, r"(?s)^(.*?[.!?])(\s|$)", 1)
    return F.trim(F.substring(F.when(first != "", first).otherwise(whole), 1, cap))


def snippet(body: Column, term: Column, width: int = 160) -> Column:
    """A window of the body around the first hit, the hit in 「 」 and cut ends marked with …."""
    at = F.position(F.lower(term), F.lower(body))
    begin = F.greatest(at - width // 2, F.lit(1))
    window = F.substring(body, begin, F.lit(width))
    hit = F.substring(body, at, F.length(term))
    marked = F.when(at > 0, F.replace(window, hit, F.concat(F.lit("「"), hit, F.lit("」")))).otherwise(window)
    return F.concat(F.when(begin > 1, "…").otherwise(""), marked, F.when(begin + width <= F.length(body), "…").otherwise(""))


def parse_hint(query: Column) -> Column:
    """struct(hint, query): a ``space:``, ``repo:`` or ``shard:`` token as a shard key, and the query without it."""
    pattern = r"(?:^|\s)((space|repo|shard):(\S+))"
    kind, value, token = (F.regexp_extract(query, pattern, i) for i in (2, 3, 1))
    key = F.when(kind == "space", F.concat(F.lit("cf:"), value)).when(kind == "repo", F.concat(F.lit("gh:"), value)).when(kind == "shard", value)
    stripped = F.trim(F.regexp_replace(F.when(token != "", F.replace(query, token, F.lit(""))).otherwise(query), r"\s+", " "))
    return F.struct(key.alias("hint"), stripped.alias("query"))


def decode_entities(text: Column) -> Column:
    """The six entities of storage markup, the ampersand last."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def eval_tokens(text: Column) -> Column:
    """Tokens of the evaluation metrics: camelCase split, lower, alphanumeric runs over one character, no stop words."""
    split = F.split(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    return F.filter(split, lambda w: (F.length(w) > 1) & ~F.array_contains(literals(EVAL_STOP), w))


def statements(text: Column) -> Column:
    """Sentences and lines with two evaluation tokens or more."""
    parts = F.transform(F.split(text, r"(?<=[.!?;])\s+|\n+"), F.trim)
    return F.filter(parts, lambda s: F.size(eval_tokens(s)) >= 2)


def critique(text: Column) -> Column:
    """Penalised self-containment and clarity of a question, between 0 and 1."""
    n = F.size(eval_tokens(text))
    contained = 1.0 - F.when(text.rlike(r"(?i)^\s*(it|this|that|they|these|those|he|she)\b"), 0.5).otherwise(0.0) - F.when(n < 2, 0.3).otherwise(0.0)
    clear = 1.0 - F.when(~F.trim(text).endswith("?"), 0.3).otherwise(0.0) - F.when((n < 3) | (n > 40), 0.4).otherwise(0.0)
    return F.struct(F.greatest(contained, F.lit(0.0)).alias("self_containment"), F.greatest(clear, F.lit(0.0)).alias("clarity"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as BIGINT."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def shard_file(key: str) -> str:
    """A file-safe name of a shard key."""
    h = 2166136261
    for c in key:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return f"{re.sub(r'[^a-z0-9]+', '-', key.lower()).strip('-')[:80]}-{h:08x}"


def count_overlapping(text: Column, term: Column) -> Column:
    """Occurrences of term in text, overlapping ones too."""
    quoted = F.concat(F.lit(r"(?=\Q"), term, F.lit(r"\E)"))
    return F.regexp_count(text, quoted)
