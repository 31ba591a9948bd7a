"""The edit log: a last-writer-wins register per field, epochs, the outbox and its stream.

An operation is (node, field, value, lamport, client, epoch).  Merging is a
grouped maximum, so it is commutative, associative and idempotent; edits of
different fields both survive, a later edit beats an earlier one, and of
concurrent edits of one field that of the higher client wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPS = "node bigint, field string, value string, lamport bigint, client bigint, epoch bigint"


def merge(ops: DataFrame) -> DataFrame:
    """(node, field, value, lamport, client): the register of each field."""
    order = F.struct("lamport", "client", "value")
    return ops.groupBy("node", "field").agg(F.max(order).alias("w")).select("node", "field", F.col("w.value").alias("value"), F.col("w.lamport").alias("lamport"), F.col("w.client").alias("client"))


def fields(merged: DataFrame, names: list[str]) -> DataFrame:
    """One row per node with the fields as columns; '' where never set."""
    return merged.groupBy("node").agg(*[F.coalesce(F.max(F.when(F.col("field") == n, F.col("value"))), F.lit("")).alias(n) for n in names])


def diff(ops: DataFrame, known: DataFrame) -> DataFrame:
    """Operations beyond a state vector (client, clock)."""
    return ops.join(known, "client", "left").where(F.col("clock").isNull() | (F.col("lamport") > F.col("clock"))).drop("clock")


def save(ops: DataFrame, node: Column, changes: dict[str, Column], lamport: Column, client: Column) -> DataFrame:
    """The operations of one edit of each row of ops' nodes."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in changes.items()]))
    return ops.select(node.alias("node"), each.alias("c"), lamport.alias("lamport"), client.alias("client")).select("node", "c.field", "c.value", "lamport", "client")


def split_remote(updates: DataFrame, nodes: DataFrame) -> DataFrame:
    """updates (node, epoch) with what becomes of each: stale, adopted, queued, or unknown for a missing node.

    A stale update is for review and never merged; one of a later epoch replaces
    the baseline; one of the same epoch, or of none, waits for the next round.
    """
    local = nodes.select("node", F.col("epoch").alias("local_epoch"))
    action = F.when(F.col("local_epoch").isNull(), "unknown").when(F.col("epoch") < F.col("local_epoch"), "stale").when(F.col("epoch") > F.col("local_epoch"), "adopted").otherwise("queued")
    return updates.join(local, "node", "left").withColumn("action", action)


def apply_remote(nodes: DataFrame, split: DataFrame) -> DataFrame:
    """nodes (node, epoch, version, status) after a batch of remote updates."""
    per = split.groupBy("node").agg(F.max(F.when(F.col("action") == "adopted", F.col("epoch"))).alias("adopt"), F.bool_or(F.col("action").isin("stale", "queued")).alias("conflict"))
    j = nodes.join(per, "node", "left")
    adopted = F.col("adopt").isNotNull()
    return j.select("node", F.coalesce("adopt", "epoch").alias("epoch"), (F.col("version") + F.when(adopted, 1).otherwise(0)).alias("version"), F.when(adopted, "SYNCED").when(F.col("conflict"), "CONFLICT").otherwise(F.col("status")).alias("status"))


def adopt(ops: DataFrame, split: DataFrame) -> DataFrame:
    """ops after a batch of remote updates, which are operations with ``action``: a node that adopts has the operations of the latest epoch offered, alone."""
    offered = split.where("action = 'adopted'")
    latest = offered.groupBy("node").agg(F.max("epoch").alias("epoch"))
    taken = offered.join(latest, ["node", "epoch"], "left_semi").select(*ops.columns)
    return ops.join(latest.select("node"), "node", "left_anti").select(*ops.columns).unionByName(taken)


def save_atomic(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, events) after edits (node, id): each raises its node's version, marks it DIRTY and is a ``node.updated`` event."""
    known = edits.join(nodes.select("node"), "node", "left_semi")
    times = known.groupBy("node").agg(F.count("*").alias("times"))
    after = nodes.join(times, "node", "left").withColumns({"version": F.col("version") + F.coalesce("times", F.lit(0)), "status": F.when(F.col("times") > 0, "DIRTY").otherwise(F.col("status"))}).drop("times")
    return after, known.select("id", "node", F.lit("node.updated").alias("event_type"), F.lit("DIRTY").alias("status"))


def merge_payloads(ops: DataFrame, payloads: DataFrame, outbox: DataFrame, limit: int = 1000, in_flight: DataFrame | None = None) -> DataFrame:
    """Registers of the nodes of one round, after the payloads of its events (id, and an operation) are merged in; nodes in flight wait."""
    waiting = outbox if in_flight is None else outbox.join(in_flight.select("node"), "node", "left_anti")
    batch = dirty(waiting, limit)
    said = payloads.join(batch.select("id"), "id", "left_semi").select("node", "field", "value", "lamport", "client")
    own = ops.join(batch.select("node").distinct(), "node", "left_semi").select("node", "field", "value", "lamport", "client")
    return merge(own.unionByName(said))


def dirty(outbox: DataFrame, limit: int | None = None) -> DataFrame:
    """Outbox rows that wait for a round: not synced, not stale; oldest first."""
    found = outbox.where("status <> 'SYNCED' AND event_type <> 'remote.stale'")
    return found if limit is None else found.orderBy("id").limit(limit)


def sync_round(nodes: DataFrame, outbox: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes, outbox) after one round: touched nodes get a version and are SYNCED, their events too."""
    batch = dirty(outbox, limit)
    touched = batch.select("node").distinct().withColumn("hit", F.lit(True))
    j = nodes.join(touched, "node", "left")
    after = j.select("node", "epoch", (F.col("version") + F.when(F.col("hit"), 1).otherwise(0)).alias("version"), F.when(F.col("hit"), "SYNCED").otherwise(F.col("status")).alias("status"))
    done = batch.select("id").withColumn("hit", F.lit(True))
    return after, outbox.join(done, "id", "left").withColumn("status", F.when(F.col("hit"), "SYNCED").otherwise(F.col("status"))).drop("hit")


def stable_frontier(vectors: DataFrame) -> DataFrame:
    """(client, clock): per client the least clock over all replicas, 0 where a replica hasn't seen it; no replica, no rows."""
    replicas = vectors.agg(F.count_distinct("replica").alias("replicas"))
    seen = vectors.groupBy("client").agg(F.min("clock").alias("least"), F.count_distinct("replica").alias("seen"))
    return seen.join(F.broadcast(replicas)).select("client", F.when(F.col("seen") == F.col("replicas"), F.col("least")).otherwise(0).alias("clock"))


def stable_nodes(ops: DataFrame, frontier: DataFrame) -> DataFrame:
    """Nodes all of whose operations lie within the frontier."""
    j = ops.join(frontier, "client", "left")
    return j.groupBy("node").agg(F.bool_and(F.col("lamport") <= F.coalesce("clock", F.lit(0))).alias("stable")).where("stable").select("node")


def compact(ops: DataFrame, which: DataFrame) -> DataFrame:
    """Operations with the chosen nodes collapsed to their registers, one epoch later."""
    chosen = ops.join(which, "node", "left_semi")
    epochs = chosen.groupBy("node").agg((F.max("epoch") + 1).alias("epoch"))
    base = merge(chosen).join(epochs, "node").select("node", "field", "value", "lamport", "client", "epoch")
    return ops.join(which, "node", "left_anti").select(*base.columns).unionByName(base)


def compact_candidates(sizes: DataFrame, max_bytes: int = 65_536, older_than: Column | None = None, limit: int = 100) -> DataFrame:
    """Nodes whose log is larger than max_bytes; the first ``limit`` by id."""
    big = sizes.where(F.col("bytes") > max_bytes)
    return (big if older_than is None else big.where(F.col("modified") < older_than)).orderBy("node").limit(limit)


def migrate(nodes: DataFrame, migrations: list[tuple[int, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Apply each migration, in order of version, to the rows whose schema_version is lower."""
    versions = [v for v, _ in migrations]
    if len(set(versions)) != len(versions) or min(versions, default=1) < 1:
        raise ValueError("versions must be unique and at least 1")
    for version, change in sorted(migrations, key=lambda m: m[0]):
        old = change(nodes.where(F.col("schema_version") < version)).withColumn("schema_version", F.lit(version))
        nodes = nodes.where(F.col("schema_version") >= version).unionByName(old, allowMissingColumns=True)
    return nodes


def subscribed(updates: DataFrame, known: DataFrame, subscriptions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) by shard_key; no subscription set accepts every known shard."""
    marked = updates.join(known.select("shard_key", F.lit(True).alias("known")).distinct(), "shard_key", "left")
    if subscriptions is not None:
        marked = marked.join(subscriptions.select("shard_key", F.lit(True).alias("wanted")).distinct(), "shard_key", "left")
    else:
        marked = marked.withColumn("wanted", F.lit(True))
    reason = F.when(F.col("known").isNull(), "unknown shard").when(F.col("wanted").isNull(), "not subscribed")
    judged = marked.withColumn("reason", reason)
    return judged.where("reason IS NULL").select(*updates.columns), judged.where("reason IS NOT NULL").select(*updates.columns, "reason")


def outbox_stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_round: int = 64):
    """Follow a folder of operation files: each round's new operations go to sink(batch, number).

    A round replayed after a crash merges to the same registers, so the sink may
    simply merge and write.
    """
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_round).parquet(folder)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_node(ops: DataFrame) -> DataFrame:
    """The newest operation of each node, ties by client."""
    w = Window.partitionBy("node").orderBy(F.desc("lamport"), F.desc("client"), "field")
    return ops.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
