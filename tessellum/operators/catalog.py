"""The catalog: clusters, shards, checkpoints, index integrity and the queue's loop, as set operations over small tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import Index

GENERAL = "general"
CHECKPOINTS = "shard_key string, connector string, cursor string"


def ensure_clusters(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph, name, keywords): wanted clusters in place of existing ones of their name; every graph has ``general``, without keywords."""
    graphs = existing.select("graph").unionByName(wanted.select("graph")).distinct()
    general = graphs.select("graph", F.lit(GENERAL).alias("name"), F.array().cast("array<string>").alias("fresh"))
    fresh = wanted.where(F.col("name") != GENERAL).select("graph", "name", F.col("keywords").alias("fresh")).unionByName(general)
    return existing.join(fresh, ["graph", "name"], "full").select("graph", "name", F.coalesce("fresh", "keywords").alias("keywords"))


def ensure_shards(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard_key, kind, display_name, clusters, status): new shards are ACTIVE; clusters change only to a list that isn't empty."""
    fresh = wanted.select("shard_key", *[F.col(c).alias(f"new_{c}") for c in ("kind", "display_name", "clusters")])
    both = existing.join(fresh, "shard_key", "full")
    clusters = F.when(F.size("new_clusters") > 0, F.col("new_clusters")).otherwise(F.coalesce("clusters", "new_clusters"))
    return both.select("shard_key", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("new_display_name", "display_name").alias("display_name"), clusters.alias("clusters"), F.coalesce("status", F.lit("ACTIVE")).alias("status"))


def put_checkpoints(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """(shard_key, connector, cursor): the last of new for each shard and connector, else the old one."""
    last = new.groupBy("shard_key", "connector").agg(F.max(F.struct(order, "cursor"))["cursor"].alias("fresh"))
    return existing.join(last, ["shard_key", "connector"], "full").select("shard_key", "connector", F.coalesce("fresh", "cursor").alias("cursor"))


def checkpoints_of(checkpoints: DataFrame, shards: DataFrame) -> DataFrame:
    """Checkpoints of shards that are there."""
    return checkpoints.join(shards.select("shard_key", "status"), "shard_key")


def index_integrity(atoms: DataFrame, index: Index) -> DataFrame:
    """One row (atoms, indexed, missing, orphans, wrong, ok): whether the index holds each atom once and with its lengths."""
    true = Index(atoms).sizes.select("id", F.struct("chars", "words").alias("true"))
    held = index.sizes.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct("chars", "words")).alias("held"))
    both = true.join(held, "id", "full")
    counts = both.agg(F.count("true").alias("atoms"), F.count("held").alias("indexed"), F.count_if(F.col("held").isNull()).alias("missing"), F.count_if(F.col("true").isNull()).alias("orphans"), F.count_if((F.col("true") != F.col("held")) | (F.col("n") > 1)).alias("wrong"))
    return counts.withColumn("ok", F.expr("missing + orphans + wrong = 0"))


def org_sync(nodes: DataFrame, outbox: DataFrame, subscriptions: DataFrame | None = None, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes, outbox) after a sync round of every subscribed shard at once, ``limit`` events each; both have shard_key.

    Shards without waiting events aren't touched; without subscriptions every shard is synced.
    """
    waiting = outbox.where("status <> 'SYNCED' AND event_type <> 'remote.stale'")
    if subscriptions is not None:
        waiting = waiting.join(subscriptions.select("shard_key").distinct(), "shard_key", "left_semi")
    oldest = Window.partitionBy("shard_key").orderBy("id")
    batch = waiting.withColumn("n", F.row_number().over(oldest)).where(F.col("n") <= limit)
    touched = batch.select("shard_key", "node").distinct().withColumn("hit", F.lit(True))
    after = nodes.join(touched, ["shard_key", "node"], "left").withColumns({"version": F.col("version") + F.when(F.col("hit"), 1).otherwise(0), "status": F.when(F.col("hit"), "SYNCED").otherwise(F.col("status"))}).drop("hit")
    done = batch.select("shard_key", "id").withColumn("hit", F.lit(True))
    return after, outbox.join(done, ["shard_key", "id"], "left").withColumn("status", F.when(F.col("hit"), "SYNCED").otherwise(F.col("status"))).drop("hit")


def drain(tasks: list[dict], run: Callable[[dict], None]) -> list[dict]:
    """Runs the pending tasks, priority first, then age, one at a time for each shard; a failed one is marked and the rest go on.

    The queue is the driver's; what a task does is a Spark job of its own.
    """
    for task in sorted((t for t in tasks if t["status"] == "PENDING"), key=lambda t: (-t["priority"], t["id"])):
        try:
            run(task)
            task["status"] = "DONE"
        except Exception as error:  # any failure of a task is the task's
            task["status"], task["error"] = "FAILED", str(error)
    return tasks
