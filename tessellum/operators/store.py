"""Snapshots of a collection: change classification, cascades, catalog rollups and the ingest queue.

A snapshot is a directory per version with a pointer file that is swapped last,
so readers see the old version or the new one, and a crash before the swap is a
replay that classifies everything as unchanged or new again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_ATOMS, SPLIT_BYTES = 150_000, int(1.5 * (1 << 30))


class Snapshots:
    """Versioned tables under ``root``, one committer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def pointer(self) -> dict[str, str]:
        """Table name to directory of the current version."""
        best = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("")) if s.getPath().getName().startswith("pointer-"))
        if not best:
            return {}
        text = self.spark.read.text(f"{self.root}/{best[-1]}").collect()
        return json.loads("".join(r[0] for r in text))

    def read(self, name: str) -> DataFrame | None:
        found = self.pointer().get(name)
        return self.spark.read.parquet(f"{self.root}/{found}") if found else None

    def commit(self, tables: dict[str, DataFrame], partition_by: str | None = None) -> int:
        """Write new versions of the tables, then the pointer; returns the version."""
        now = self.pointer()
        version = 1 + max([int(s.getPath().getName().split("-")[1]) for s in self.fs.listStatus(self._path("")) if s.getPath().getName().startswith("pointer-")], default=0)
        for name, df in tables.items():
            place = f"{name}-{version:09d}-{uuid.uuid4().hex[:8]}"
            writer = df.write
            if partition_by and partition_by in df.columns:
                writer = writer.partitionBy(partition_by)
            writer.parquet(f"{self.root}/{place}")
            now[name] = place
        temporary = self._path(f"_pending-{uuid.uuid4().hex}")
        out = self.fs.create(temporary)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self.fs.rename(temporary, self._path(f"pointer-{version:09d}")):
            raise RuntimeError("another committer was first")
        return version


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming with content_hash and change: new, skip or changed against stored (shard_key, source_key, content_hash).

    Equal keys in one batch: the last by ``seq`` wins if that column is there.
    Only the text decides; another title alone is a skip.
    """
    given = incoming.withColumn("content_hash", F.sha2("text", 256))
    if "seq" in incoming.columns:
        w = Window.partitionBy("shard_key", "source_key").orderBy(F.desc("seq"))
        given = given.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    known = stored.select("shard_key", "source_key", F.col("content_hash").alias("old_hash"))
    change = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "skip").otherwise("changed")
    return given.join(known, ["shard_key", "source_key"], "left").withColumn("change", change).drop("old_hash")


def delete_cascade(gone: DataFrame, documents: DataFrame, atoms: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without the documents in gone (doc_id) and all that hangs on their atoms."""
    left = atoms.join(gone, "doc_id", "left_anti")
    live = left.select("id")
    out = {
        "documents": documents.join(gone, "doc_id", "left_anti"),
        "atoms": left,
        "edges": edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns),
    }
    if vectors is not None:
        out["vectors"] = vectors.join(live, "id", "left_semi")
    if events is not None:
        out["events"] = events.join(live, "id", "left_semi")
    return out


def manifest_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change): added, touched (size or time differ), same or deleted."""
    new, old = listing.select("path", F.struct("size", "mtime").alias("now")), manifest.select("path", F.struct("size", "mtime").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "same").otherwise("touched")
    return new.join(old, "path", "full").select("path", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of old rows of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def shard_rollup(shards: DataFrame) -> DataFrame:
    """(status, shards, atoms, docs, bytes)."""
    return shards.groupBy("status").agg(F.count("*").alias("shards"), F.sum("atom_count").alias("atoms"), F.sum("doc_count").alias("docs"), F.sum("bytes").alias("bytes"))


def split_signal(shards: DataFrame) -> DataFrame:
    """shards with the status SPLIT where they have outgrown one store."""
    big = (F.col("atom_count") > SPLIT_ATOMS) | (F.col("bytes") > SPLIT_BYTES)
    return shards.withColumn("status", F.when(big, "SPLIT").otherwise(F.col("status")))


def claimable(queue: DataFrame, limit: int = 1) -> DataFrame:
    """The next pending tasks: the shard has none running; priority first, then age."""
    running = queue.where("status = 'RUNNING'").select("shard_key").distinct()
    return queue.where("status = 'PENDING'").join(running, "shard_key", "left_anti").orderBy(F.desc("priority"), "id").limit(limit)


def enqueue(queue: DataFrame, tasks: DataFrame) -> DataFrame:
    """queue with the new tasks whose shard doesn't already wait for the same."""
    waiting = queue.where("status = 'PENDING'").select("shard_key", "task")
    fresh = tasks.dropDuplicates(["shard_key", "task"]).join(waiting, ["shard_key", "task"], "left_anti")
    return queue.unionByName(fresh.select(*queue.columns))


def recover(queue: DataFrame) -> DataFrame:
    """After a restart what was running is pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """queue with the status of the finished tasks (id, ok)."""
    return queue.join(done, "id", "left").withColumn("status", F.when(F.col("ok"), "DONE").when(~F.col("ok"), "FAILED").otherwise(F.col("status"))).drop("ok")


def store_stats(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, in one job."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
