"""Topic routing of atoms, term statistics and routing of queries to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import counting
from .materialise import cut
from .search import B, BROADCAST_RUNS, K1, RRF_K, Index, _maybe_broadcast, hybrid, rrf

MIN_DENSITY = 1.0
#: Keywords of clusters up to this many are part of the expression that routes an atom.
INLINE = 256
#: A term of a shard's statistics.
STATS_TERM = "[a-z][a-z0-9_$]{2,31}"
#: So many times the terms that are asked for are sent by each part of a table.
SENT = 4


def keyword_density(body, keyword):
    """Non-overlapping literal hits, weighted by keyword length, per 1000 characters."""
    low = F.lower(body)
    hits = (F.length(low) - F.length(F.replace(low, F.lower(keyword), F.lit("")))) / F.length(keyword)
    return hits * F.greatest(F.lit(1.0), F.length(keyword) / 4) * 1000 / F.length(body)


def route_atoms(atoms: DataFrame, clusters: DataFrame, min_density: float = MIN_DENSITY) -> DataFrame:
    """atoms with cluster and density: the densest cluster, the first by name among equals, or general.

    clusters: name, keywords.  Up to INLINE keywords the clusters are a
    literal and every atom is judged in its own row, without a shuffle; more of
    them are joined.
    """
    words = clusters.select(F.col("name").alias("cluster_name"), F.explode("keywords").alias("keyword")).where(F.length("keyword") > 0)
    known = words.limit(INLINE + 1).collect()
    if len(known) > INLINE:
        each = atoms.select("id", "body").join(_maybe_broadcast(words), F.lower("body").contains(F.lower("keyword"))).groupBy("id", "cluster_name").agg(F.sum(keyword_density(F.col("body"), F.col("keyword"))).alias("density"))
        order = Window.partitionBy("id").orderBy(F.desc(F.round("density", 9)), "cluster_name")
        best = each.withColumn("r", F.row_number().over(order)).where("r = 1").where(F.col("density") >= min_density)
        joined = atoms.join(best.select("id", F.col("cluster_name"), "density"), "id", "left")
        return joined.withColumns({"cluster": F.coalesce("cluster_name", F.lit("general")), "density": F.coalesce("density", F.lit(0.0))}).drop("cluster_name")
    by: dict[str, list[str]] = {}
    for row in known:
        by.setdefault(row["cluster_name"], []).append(row["keyword"])
    if not by:
        return atoms.withColumns({"cluster": F.lit("general"), "density": F.lit(0.0)})
    offers = []
    for name in sorted(by, key=str.encode):
        density = sum((F.coalesce(keyword_density(F.col("body"), F.lit(k)), F.lit(0.0)) for k in by[name]), F.lit(0.0))
        offers.append(F.struct(F.round(density, 9).alias("r"), F.lit(-len(offers)).alias("turn"), F.lit(name).alias("name"), density.alias("density")))
    told = atoms.withColumn("_best", F.array_max(F.array(*offers)))
    some = F.col("_best.density") >= min_density
    return told.withColumns({"cluster": F.when(some, F.col("_best.name")).otherwise("general"), "density": F.when(some, F.col("_best.density")).otherwise(0.0)}).drop("_best")


def term_stats(docs: DataFrame, shard: str = "shard_key", text: str = "text") -> DataFrame:
    """(shard_key, term, tf) of ingest terms: identifiers of 3 to 32 characters, no stop words."""
    found = docs.select(F.col(shard).alias("shard_key"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(STATS_TERM), F.lit(0))).alias("term"))
    return found.where(~F.col("term").isin(T.STATS_STOP)).groupBy("shard_key", "term").agg(F.count("*").alias("tf"))


def top_terms(stats: DataFrame, most: int = 500) -> DataFrame:
    order = Window.partitionBy("shard_key").orderBy(F.desc("tf"), "term")
    return stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def best_terms(docs: DataFrame, most: int = 500, shard: str = "shard_key", text: str = "text") -> DataFrame:
    """top_terms(term_stats(docs)) without a row for each term of each shard.

    Each part of the table sends its most frequent terms and a bound of the others.
    A shard's terms that may be among its best by what was sent are then counted
    in a second pass.  Where an unsent term may be among them, as with few or flat
    counts, all terms of that shard are counted.
    """
    sent = cut(counting.frequent_terms(docs, STATS_TERM, T.STATS_STOP, SENT * most, shard, text).groupBy("shard_key", "term").agg(F.sum("n").alias("tf")))
    some = sent.where("term IS NOT NULL")
    bounds = {r["shard_key"]: r["tf"] for r in sent.where("term IS NULL").collect()}
    if not bounds:
        return cut(top_terms(some, most))
    least = {r["shard_key"]: r["tf"] for r in top_terms(some, most).where(F.col("rank") == most).select("shard_key", "tf").collect()}
    open_ = [key for key, bound in bounds.items() if bound >= least.get(key, 0)]
    # without a bound what was sent is a shard's whole count
    limits = docs.sparkSession.createDataFrame([(key, least.get(key, 0) - bound) for key, bound in bounds.items() if key not in set(open_)], sent.select("shard_key", F.col("tf").alias("limit")).schema)
    known = some.join(F.broadcast(limits), some["shard_key"].eqNullSafe(limits["shard_key"])).where(F.col("tf") >= F.col("limit")).select(some["shard_key"], "term")
    wanted: dict[object, set] = {}
    if known.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        for row in known.collect():
            wanted.setdefault(row["shard_key"], set()).add(row["term"])
    else:
        open_ = list(bounds)
    keys = docs.sparkSession.createDataFrame([(key,) for key in bounds], limits.select(F.col("shard_key").alias("_key")).schema)
    every = some.join(F.broadcast(keys), some["shard_key"].eqNullSafe(keys["_key"]), "left_anti")
    if wanted:
        every = every.unionByName(counting.count_known(docs, STATS_TERM, {key: frozenset(terms) for key, terms in wanted.items()}, shard, text).groupBy("shard_key", "term").agg(F.sum("n").alias("tf")))
    if open_:
        unsettled = docs.sparkSession.createDataFrame([(key,) for key in open_], keys.schema)
        rest = docs.select(F.col(shard).alias("shard_key"), F.col(text).alias("text"))
        every = every.unionByName(term_stats(rest.join(F.broadcast(unsettled), rest["shard_key"].eqNullSafe(unsettled["_key"]), "left_semi")))
    return cut(top_terms(every, most))


def term_df(best: DataFrame) -> DataFrame:
    """In how many shards' top terms each term is."""
    return best.groupBy("term").agg(F.count_distinct("shard_key").alias("df"))


def signatures(best: DataFrame, shards: DataFrame, most: int = 200) -> DataFrame:
    """(shard_key, term, score, rank): tf times ln((shards + 1) / (1 + df)), positive scores alone."""
    n = shards.agg(F.count("*").alias("shards"))
    joined = best.join(term_df(best), "term", "left").join(F.broadcast(n))
    score = F.col("tf") * F.log((F.col("shards") + 1) / (1 + F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))))
    scored = joined.select("shard_key", "term", score.alias("score")).where(F.round("score", 9) > 0)
    order = Window.partitionBy("shard_key").orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def shard_text_rank(shards: DataFrame, queries: DataFrame, limit: int = 64) -> DataFrame:
    """BM25 over shard key, display name and routing terms, query terms joined by OR; equal column weights."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = shards.select("shard_key", F.concat(split(F.col("shard_key")), split(F.col("display_name")), F.flatten(F.transform("routing_terms", split))).alias("words"))
    sized = words.withColumn("len", F.size("words"))
    stats = sized.agg(F.count("*").alias("total"), F.avg("len").alias("avg_len"))
    terms = queries.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(F.split("query", r"\s+"), split)))).alias("term"))
    tf = sized.select("shard_key", "len", F.explode("words").alias("term")).groupBy("shard_key", "len", "term").agg(F.count("*").alias("tf"))
    n = tf.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(n, "term").join(F.broadcast(stats)).withColumn("part", part).join(terms, "term").groupBy("query_id", "shard_key").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "shard_key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "shard_key", "rank")


def shard_density_rank(shards: DataFrame, queries: DataFrame, head: int = 32, distinctive: int = 8) -> DataFrame:
    """Keyword density of the query against a shard's first routing terms, the most distinctive counting three times."""
    terms = shards.select("shard_key", F.posexplode(F.slice("routing_terms", 1, head)).alias("pos", "keyword"))
    weight = F.when(F.col("pos") < distinctive, 3).otherwise(1)
    # a keyword in the query: found by its words first, so that no query meets every shard
    scored = queries.join(_maybe_broadcast(terms), F.lower("query").contains(F.lower("keyword"))).withColumn("d", keyword_density(F.col("query"), F.col("keyword")) * weight)
    total = scored.groupBy("query_id", "shard_key").agg(F.sum("d").alias("density")).where("density > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("density", 9)), "shard_key")
    return total.withColumn("rank", F.row_number().over(order)).select("query_id", "shard_key", "rank")


def candidate_shards(shards: DataFrame, queries: DataFrame, max_shards: int = 32) -> DataFrame:
    """(query_id, shard_key, score, rank): text and density ranks fused, with a little recency for shards with a signal."""
    lists = shard_text_rank(shards, queries, max(64, 2 * max_shards)).unionByName(shard_density_rank(shards.where("status <> 'EVICTED'"), queries))
    recency = shards.select("shard_key", F.row_number().over(Window.orderBy(F.desc("updated_at"), "shard_key")).alias("recent"))
    signal = lists.groupBy("query_id", "shard_key").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("base")).join(F.broadcast(recency), "shard_key")
    scored = signal.select("query_id", "shard_key", (F.col("base") + 0.05 / (RRF_K + F.col("recent"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "shard_key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_shards)


def interleave(ranked: DataFrame, max_shards: int = 32) -> DataFrame:
    """(query_id, term_pos, shard_key, rank) lists taken in turn, rank by rank; a shard's first place counts."""
    first = Window.partitionBy("query_id", "shard_key").orderBy("rank", "term_pos")
    once = ranked.withColumn("f", F.row_number().over(first)).where("f = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "term_pos")
    return once.select("query_id", "shard_key", F.row_number().over(order).alias("route_rank")).where(F.col("route_rank") <= max_shards)


def route(shards: DataFrame, queries: DataFrame, max_shards: int = 32, fallback: int = 4) -> DataFrame:
    """(query_id, shard_key, route_rank, pinned, query) of every query.

    A known hint pins its shard; otherwise each query term is scored and the
    lists are interleaved, or the whole text if there is one term at most; with
    no signal at all the most recent shards are taken.
    """
    hinted = queries.withColumn("h", T.parse_hint(F.col("query"))).select("query_id", F.col("h.hint").alias("hint"), F.col("h.query").alias("query"))
    pinned = hinted.join(shards.select("shard_key"), F.col("hint") == F.col("shard_key")).select("query_id", "shard_key", F.lit(1).alias("route_rank"), F.lit(True).alias("pinned"))
    free = hinted.join(pinned, "query_id", "left_anti")
    terms = free.select("query_id", "query", T.keyword_terms(F.col("query")).alias("terms"))
    parts = terms.select("query_id", F.posexplode(F.when(F.size("terms") > 1, F.col("terms")).otherwise(F.array("query"))).alias("term_pos", "part"))
    each = parts.select(F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("term_pos").cast("string")).alias("query_id"), F.col("part").alias("query"))
    key = F.split("query_id", "\u0001")
    kind = dict(queries.dtypes)["query_id"]
    ranked = candidate_shards(shards, each, max_shards).select(key[0].cast(kind).alias("query_id"), key[1].cast("int").alias("term_pos"), "shard_key", "rank")
    routed = interleave(ranked, max_shards).withColumn("pinned", F.lit(False))
    recent = shards.where("status <> 'EVICTED'").select("shard_key", F.row_number().over(Window.orderBy(F.desc("updated_at"), "shard_key")).alias("route_rank")).where(F.col("route_rank") <= fallback)
    none = free.join(routed, "query_id", "left_anti").select("query_id").join(F.broadcast(recent)).withColumn("pinned", F.lit(False))
    every = pinned.unionByName(routed).unionByName(none)
    return every.join(hinted.select("query_id", "query"), "query_id").select("query_id", "shard_key", "route_rank", "pinned", "query")


def waves(routed: DataFrame, shard_hits: DataFrame, probe_wave: int = 4, strict: bool = False) -> DataFrame:
    """Routed shards that are probed: all of them when strict, else up to the first wave with a hit.

    shard_hits: (query_id, shard_key) of shards where the query has hits.
    """
    placed = routed.withColumn("wave", F.ceil(F.col("route_rank") / probe_wave))
    if strict:
        return placed
    flagged = placed.join(shard_hits.select("query_id", "shard_key").distinct().withColumn("hit", F.lit(True)), ["query_id", "shard_key"], "left")
    stop = F.min(F.when(F.col("hit"), F.col("wave"))).over(Window.partitionBy("query_id"))
    return flagged.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("wave") <= F.col("stop"))).drop("stop", "hit")


def federated(atoms: DataFrame | Index, shards: DataFrame, queries: DataFrame, limit: int = 20, max_shards: int = 32, per_shard: int = 10, probe_wave: int = 4, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, diagnostics) of a batch of queries over many shards, fused by rank.

    Each shard ranks with its own statistics; only routed pairs of query and shard
    are scored.  Stragglers don't exist in a batch, so that list is empty.
    """
    routed = cut(route(shards, queries, max_shards))
    stripped = routed.select("query_id", "query").distinct()
    found = cut(hybrid(Index.of(atoms, ("shard_key",)), stripped, per_shard, per=("shard_key",), only=routed.select("query_id", "shard_key")))
    probed = waves(routed, found, probe_wave, strict)
    kept = found.join(_maybe_broadcast(probed.select("query_id", "shard_key")), ["query_id", "shard_key"], "left_semi")
    keyed = kept.select("query_id", "shard_key", "id", F.concat_ws(":", "shard_key", F.col("id").cast("string")).alias("key"), F.col("fused_rank").alias("rank"))
    fused = rrf(keyed, ["query_id"], "key", lane="shard_key").where(F.col("fused_rank") <= limit)
    hits = fused.join(keyed.select("query_id", "key", "shard_key", "id", F.col("rank").alias("shard_rank")), ["query_id", "key"])
    diagnostics = probed.groupBy("query_id").agg(F.count("*").alias("probed"), F.max("wave").alias("waves"), F.bool_or("pinned").alias("pinned")).withColumn("stragglers", F.array().cast("array<string>"))
    return hits.select("query_id", "shard_key", "id", "rrf_score", "shard_rank", "fused_rank"), diagnostics
