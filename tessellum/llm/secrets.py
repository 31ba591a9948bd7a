"""Secret scan with corpus-wide ownership frequency.

Candidates are found by one regular expression, reduced to their value and
hashed; no secret leaves the scan.  Per hash the distinct owners and
repositories are counted over the whole corpus.  A value that ``common`` owners
or more share is a copied example; one owner's value that looks live (long,
mixed, no placeholder) is a credential to revoke; the rest is unclear.  A private
key is its base64 body, however that is broken into lines; a header without a
body is found but never live.

Everything is built-in expressions; only findings are shuffled, first by (hash,
owner, repository), so a value that is everywhere is no hot key.

Defined results: null and empty texts have no findings; a null owner or
repository counts as one unknown owner or repository; the same value several
times in a document is one finding with its ``times``; repeated rows of a document
count as one document but add to ``times``; a text of any length is scanned whole;
there are no ties to break; an empty table gives an empty result; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

COMMON = 3
_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_PATTERN = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|%s"
    r"|(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy])[ \t]*[:=][ \t]*[\"'][^\"'\s]{8,}[\"']"
)
SQL_PATTERN = _PATTERN % _HEADER
#: A private key whole, or one whose end is cut off, or a header alone; possessive groups don't recurse.
PATTERN = _PATTERN % (_HEADER + r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\[nrt])*+[A-Za-z0-9+/=]{16,}+)++)?")
#: What of a private key isn't its base64 body: the lines around it, headers such as DEK-Info, white space, written-out escapes.
NO_BODY = r"-----[A-Z ]+-----|[A-Za-z][A-Za-z-]*:[^\n\\]*|\\[nrt]|[^A-Za-z0-9+/=]"
#: Base64 of this length has short words such as test by chance.
KEY_PLACEHOLDER = r"example|sample|dummy|changeme|placeholder|1234567890|abcdef0123"
QUOTED = r"^[A-Za-z_]+[ \t]*[:=][ \t]*[\"'](.*)[\"']$"
PLACEHOLDER = r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test|1234567890|abcdef0123"
KINDS = (("AKIA", "aws_key"), ("gh", "github_token"), ("xox", "chat_token"), ("AIza", "cloud_key"), ("sk_live_", "payment_key"), ("rk_live_", "payment_key"), ("eyJ", "jwt"), ("-----BEGIN", "private_key"))


def findings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: str = "lang") -> DataFrame:
    """(doc_id, owner, repository, hash, kind, live, times), a row per document and value."""
    matched = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"), F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("m"))
    kind = F.lit("assigned")
    for prefix, name in reversed(KINDS):
        kind = F.when((F.col("value") == F.col("m")) & F.col("value").startswith(prefix), name).otherwise(kind)
    value = F.when(F.col("m").rlike(QUOTED), F.regexp_extract("m", QUOTED, 1)).otherwise(F.col("m"))
    body = F.when(F.col("m").startswith("-----BEGIN"), F.regexp_replace("m", NO_BODY, ""))
    v = matched.withColumn("value", value).withColumn("kind", kind).withColumn("value", F.when(F.length(body) > 0, body).otherwise(F.col("value")))
    variety = F.size(F.array_distinct(F.filter(F.split("value", ""), lambda c: c != "")))
    live = (F.length("value") >= 16) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (variety >= 8) & ~F.lower("value").rlike(PLACEHOLDER)
    live_key = (F.length("value") >= 64) & (variety >= 16) & ~F.lower("value").rlike(KEY_PLACEHOLDER) & ~F.col("value").startswith("-")
    live = F.when(F.col("kind") == "private_key", live_key).otherwise(live)
    hashed = v.select("doc_id", "owner", "repo", F.sha2("value", 256).alias("hash"), "kind", live.alias("live"))
    return hashed.groupBy("doc_id", "owner", "repo", "hash", "kind", "live").agg(F.count("*").alias("times"))


def ownership(docs: DataFrame, common: int = COMMON, **columns) -> DataFrame:
    """Each finding with n_docs, n_owners, n_repositories of its value and the verdict."""
    found = written(findings(docs, **columns))  # used twice; the texts are scanned once
    places = found.groupBy("hash", "owner", "repo").agg(F.countDistinct("doc_id").alias("docs"))
    owners = places.groupBy("hash", "owner").agg(F.sum("docs").alias("docs"), F.count("*").alias("repos"))
    spread = owners.groupBy("hash").agg(F.sum("docs").alias("n_docs"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"))
    verdict = F.when(F.col("n_owners") >= common, "widely_copied").when((F.col("n_owners") == 1) & F.col("live"), "owner_specific_live").otherwise("unclear")
    return found.join(spread, "hash").select("doc_id", "owner", F.col("repo").alias("repository"), "hash", "kind", "live", "times", "n_docs", "n_owners", "n_repositories", verdict.alias("verdict"))


def oracle() -> str:
    """The same over ``documents`` in DuckDB's SQL, which knows a private key by its header alone."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = " ".join(f"WHEN value = m AND starts_with(value, '{p}') THEN '{n}'" for p, n in KINDS)
    return f"""
WITH matched AS (
  SELECT doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS repo, unnest(regexp_extract_all(text, {quote(SQL_PATTERN)})) AS m FROM documents),
valued AS (SELECT *, CASE WHEN regexp_matches(m, {quote(QUOTED)}) THEN regexp_extract(m, {quote(QUOTED)}, 1) ELSE m END AS value FROM matched),
found AS (
  SELECT doc_id, owner, repo, sha256(value) AS hash, CASE {kinds} ELSE 'assigned' END AS kind,
    length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8
      AND NOT regexp_matches(lower(value), {quote(PLACEHOLDER)}) AS live, count(*) AS times
  FROM valued GROUP BY ALL),
spread AS (
  SELECT hash, count(DISTINCT (owner, repo, doc_id)) AS n_docs, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repositories FROM found GROUP BY hash)
SELECT doc_id, owner, repo AS repository, hash, kind, live, times, n_docs, n_owners, n_repositories,
  CASE WHEN n_owners >= {COMMON} THEN 'widely_copied' WHEN n_owners = 1 AND live THEN 'owner_specific_live' ELSE 'unclear' END AS verdict
FROM found JOIN spread USING (hash)"""
