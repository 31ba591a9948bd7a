"""What the operators share: tables, checkpoints, size-checked broadcasts, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..operators.materialise import cut, scratch, shared_folder, spread, written  # noqa: F401

#: Sets of at most this many 64-bit keys (8 MB) are sent to every worker; larger ones are joined.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of a column of the Spark type that ``DataFrame.dtypes`` names."""
    return to_arrow_type(_parse_datatype_string(kind))


def tasks(df: DataFrame) -> int:
    """Shuffle partitions for repartition(), which AQE doesn't coalesce or size by itself."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def small_keys(keys: DataFrame, limit: int = BROADCAST_KEYS) -> np.ndarray | None:
    """The distinct values of a one-column BIGINT frame, sorted; None if there are more than limit."""
    found = keys.limit(limit + 1).toArrow().column(0).to_numpy(zero_copy_only=False)
    return None if len(found) > limit else np.unique(found.astype(np.int64))


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (node, root), root the least node of its component.

    Alternating large-star and small-star steps; every round is two shuffles over
    what is left of the edges, and the rounds grow with the logarithm of the
    longest chain.  Each round is checkpointed.
    """
    e = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    mark = None
    w = Window.partitionBy("a")
    while True:
        both = e.unionByName(e.selectExpr("b AS a", "a AS b"))
        large = both.select("a", "b", F.least(F.min("b").over(w), F.col("a")).alias("m")).where("b > a").selectExpr("b AS a", "m AS b").distinct()
        small = large.select("a", "b", F.min("b").over(w).alias("m"))
        star = small.selectExpr("a", "m AS b").unionByName(small.where("b <> m").selectExpr("b AS a", "m AS b")).distinct()
        e = cut(star)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            break
        mark = now
    return e.selectExpr("a AS node", "b AS root").unionByName(e.selectExpr("b AS node", "b AS root").distinct())


SLICE_BYTES = 16 << 20


def release() -> None:
    """Give freed memory back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A function for mapInArrow that sees slices of at most SLICE_BYTES (or one row) and gives freed memory back."""

    def wrapped(batches):
        def slices():
            for batch in batches:
                step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
                for at in range(0, max(batch.num_rows, 1), step):
                    yield batch.slice(at, step)

        yield from run(slices())
        release()

    return wrapped


class KeyTable:
    """A (key BIGINT, value BIGINT) table that a Python pass over documents looks keys up in.

    Up to ``limit`` keys it is broadcast.  Beyond that, ``attach`` joins to each
    document the entries of the keys it has, so nothing on a worker grows with
    the table; a batch then reads the union of its documents' entries.
    """

    def __init__(self, entries: DataFrame, limit: int = BROADCAST_KEYS):
        self.entries = entries
        found = entries.limit(limit + 1).toArrow()
        self.small = None
        if found.num_rows <= limit:
            key, value = (found.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            order = np.argsort(key, kind="stable")
            self.small = entries.sparkSession.sparkContext.broadcast((key[order], value[order]))

    def attach(self, docs: DataFrame, columns: list[str], keys_of) -> DataFrame:
        """docs with a last column ``_keys``; keys_of(batch) yields (rows, keys) of a batch of ``columns``."""
        if self.small is not None:
            return docs.withColumn("_keys", F.lit(None).cast("array<bigint>"))
        identity = F.struct(F.xxhash64(*columns), F.xxhash64(*reversed(columns), F.lit(1)))
        marked = docs.withColumn("_doc", identity)

        def spread(batches):
            for batch in batches:
                for rows, keys in keys_of(batch.column(0)):
                    yield pa.RecordBatch.from_arrays([batch.column(1).field(0).take(pa.array(rows)), batch.column(1).field(1).take(pa.array(rows)), pa.array(keys)], names=["d1", "d2", "key"])

        each = marked.select(columns[-1], "_doc").mapInArrow(lean(spread), "d1 bigint, d2 bigint, key bigint").distinct()
        name = self.entries.columns
        hit = each.join(self.entries.toDF("key", "value") if name != ["key", "value"] else self.entries, "key")
        lists = hit.groupBy("d1", "d2").agg(F.flatten(F.collect_list(F.array("key", "value"))).alias("_keys"))
        return marked.withColumns({"d1_": F.col("_doc").getField("col1"), "d2_": F.col("_doc").getField("col2")}).join(lists, (F.col("d1_") == F.col("d1")) & (F.col("d2_") == F.col("d2")), "left").select(*[F.col(c) for c in docs.columns], "_keys")

    def of(self, batch_keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys and their values for a batch."""
        if self.small is not None:
            return self.small.value
        flat = pa.concat_arrays([batch_keys.drop_null()]).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        key, at = np.unique(flat[:, 0], return_index=True)
        return key, flat[at, 1]

    def __getstate__(self):
        return {"small": self.small}


def find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of values: whether it is among the sorted keys, and its position there."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at
