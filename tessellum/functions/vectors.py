"""Vector functions: products, cosines and a hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 384


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hash_embeddings(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """(texts, dims): signed character trigrams hashed into ``dims`` buckets, of unit length (zero stays zero)."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    h = np.full(len(whole), 2166136261, np.int64)
    for j in range(3):
        h = ((h ^ flat[whole + j]) * 16777619) & 0xFFFFFFFF
    v = np.bincount(row[whole] * dims + h % dims, np.where(h >> 31 & 1, -1.0, 1.0), len(texts) * dims).reshape(len(texts), dims)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(size > 0, size, 1.0)).astype(np.float32)


def hash_embedding(text: str, dims: int = DIMS) -> np.ndarray:
    return hash_embeddings([text], dims)[0]


def embed(df: DataFrame, text: str, dims: int = DIMS, output: str = "embedding") -> DataFrame:
    """df with an ARRAY<FLOAT> column: one numpy pass over each Arrow batch; a null text is an empty one."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(hash_embeddings(texts.fillna("").tolist(), dims)))

    return df.withColumn(output, run(F.col(text)))


#: Bytes of query vectors that are broadcast at once, and of the similarities that a worker holds at once.
QUERY_BYTES, SIMILARITY_BYTES = 128 << 20, 64 << 20


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id", batch_queries: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact cosine top k of every query, ties by id.

    Queries are sent to the vectors in rounds of QUERY_BYTES (of about
    ``batch_queries`` queries if that is fewer), so what is broadcast is bounded; each Arrow batch of vectors keeps its own top k per query before
    the shuffle, computed in slices of SIMILARITY_BYTES.  A null vector is neither
    found nor asked; vectors of another length than the queries' are an error.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(embedding).alias("e")).where("e IS NOT NULL AND size(e) > 0")
    n, width = asked.agg(F.count("*"), F.max(F.size("e"))).first()
    kinds = dict(asked.dtypes)["q"], dict(vectors.dtypes)[vec_id]
    rounds = max(1, -(-n * (width or 0) * 8 // QUERY_BYTES), -(-n // batch_queries) if batch_queries else 1)
    found = None
    for i in range(rounds):
        part = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == i)
        one = _similar(vectors.select(F.col(vec_id).alias("v"), F.col(embedding).alias("e")).where("e IS NOT NULL AND size(e) > 0"), part, k, kinds)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _similar(vectors: DataFrame, asked: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    got = asked.toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((got.column(0).combine_chunks(), _unit(_matrix(got.column(1).combine_chunks()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, m = shared.value
        for batch in batches:
            if not batch.num_rows or not len(qs):
                continue
            own, ids = _unit(_matrix(batch.column(1))), batch.column(0)
            # ties by id: columns in the order of their ids, and a stable choice
            ids = ids.take(order := pc.sort_indices(ids))
            own = own[order.to_numpy()]
            step = max(1, SIMILARITY_BYTES // (8 * len(own)))
            for a in range(0, len(qs), step):
                sim = m[a : a + step] @ own.T
                rounded = np.round(sim, 9)
                if k < len(own):  # all that reach the k-th value, then the first k of them in order
                    least = np.partition(rounded, len(own) - k, axis=1)[:, len(own) - k]
                    row, col = np.nonzero(rounded >= least[:, None])
                else:
                    row, col = (x.ravel() for x in np.indices(sim.shape))
                best = np.lexsort((col, -rounded[row, col], row))
                row, col = row[best], col[best]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(a + row)), ids.take(pa.array(col)), pa.array(sim[row, col])], names=["query_id", "vec_id", "similarity"])

    return vectors.mapInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
