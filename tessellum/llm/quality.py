"""Document quality by hierarchical empirical Bayes.

A logistic classifier on hashed words and surface statistics, fitted on a bounded
sample of labelled rows, gives each document evidence p.  Hosts and paths under
hosts get Beta posteriors of that evidence: a path is shrunk toward its host and a
host toward the global mean, with prior strengths estimated from the spread
between sites beyond what their sizes explain (method of moments).  A document's
final odds are its own, moved by how far its path's posterior, without the
document itself, lies from the global mean.  Host and path are columns, or come
from a column of URLs (``site_of``).

Defined results: a null or empty text has the statistics of an empty text and no
words, and is judged by them; a text of any length is read whole; there are no
ties to break, quality at the threshold is kept; a null host or path is a site of
its own; without both labels in the sample the evidence is 0.5 for all; repeated
rows count each; an empty table gives an empty result; clashing columns don't
matter, since only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import fit_sparse, sigmoid, sparse_dot
from .shared import lean, written
from .textvec import U64, WORD_BYTE, blocks, segment_sums, word_hashes

MAX_LABELLED = 20_000
HASHED = 1 << 16
RIDGE = 20.0
SITE_WEIGHT = 0.5
KEEP = 0.5
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 space, 4 sentence mark, 5 other mark
_CLASS[33:128] = 5
_CLASS[WORD_BYTE == 1] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[33, 44, 46, 63]] = 4
N_FEATURES = 9


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, N_FEATURES) surface statistics."""
    n = len(column)
    total = np.zeros((n, 8))
    for buf, offs, rows in blocks(column, lower=False):
        kind = _CLASS[buf]
        word = WORD_BYTE[buf].astype(bool)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        same = np.zeros(len(buf), bool)
        same[1:] = (buf[1:] == buf[:-1]) & (kind[1:] == 5)
        for i, flags in enumerate((kind == 1, kind == 2, kind == 3, kind == 4, kind == 5, begins, buf == 10, same)):
            np.add.at(total[:, i], rows, segment_sums(flags.astype(np.int32), offs))
    letters, digits, spaces, stops, marks, words, breaks, runs = total.T
    size = np.maximum(letters + digits + spaces + stops + marks, 1)
    w = np.maximum(words, 1)
    return np.column_stack([letters / size, digits / size, marks / w, runs / w, stops / w, np.log1p(letters / w), np.log1p(words), np.log1p(w / (breaks + 1)), spaces / size])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bucket, value): each row's hashed words, ln(1 + tf) / ln(1 + words)."""
    n = len(column)
    total, seen = np.zeros(n, np.int64), []
    for buf, offs, rows in blocks(column):
        h, at = word_hashes(buf, offs)
        np.add.at(total, rows, np.diff(at))
        seen.append(np.repeat(rows, np.diff(at)) * HASHED + (h >> U64(64 - HASHED.bit_length() + 1)).astype(np.int64))
    code, tf = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
    row = code // HASHED
    return np.searchsorted(row, np.arange(n + 1)), code % HASHED, np.log1p(tf) / np.log1p(np.maximum(total, 2))[row]


@dataclass
class Evidence:
    """weights: of the hashed words, then of the statistics, then the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def of(self, column: pa.Array) -> np.ndarray:
        logit = ((statistics(column) - self.mean) / self.scale) @ self.weights[HASHED:-1] + self.weights[-1] + sparse_dot(*words(column), self.weights)
        return np.clip(sigmoid(logit), 0.001, 0.999)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED, ridge: float = RIDGE) -> Evidence:
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    sample = marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id").select("t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            at, place, value = words(batch.column(0))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), a) for a in (pa.array(place, pa.int32()), pa.array(value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1), *lists], names=[*(f"x{i}" for i in range(N_FEATURES)), "y", "place", "value"])

    got = known.mapInArrow(lean(run), ", ".join(f"x{i} double" for i in range(N_FEATURES)) + ", y int, place array<int>, value array<float>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    nothing = Evidence(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(HASHED + N_FEATURES + 1))
    if not len(y) or y.min() == y.max():
        return nothing
    x = np.column_stack([got.column(i).to_numpy() for i in range(N_FEATURES)])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    place, value = (got.column(c).combine_chunks() for c in ("place", "value"))
    sizes = pa.compute.list_value_length(place).to_numpy(zero_copy_only=False).astype(np.int64)
    # one sparse row each: the words, then the statistics, which are dense
    at = np.append(0, np.cumsum(sizes + N_FEATURES))
    dense = (at[1:, None] - N_FEATURES + np.arange(N_FEATURES)).ravel()
    index, data = np.zeros(at[-1], np.int64), np.zeros(at[-1])
    index[dense], data[dense] = np.tile(HASHED + np.arange(N_FEATURES), len(y)), ((x - mean) / scale).ravel()
    rest = np.ones(at[-1], bool)
    rest[dense] = False
    index[rest], data[rest] = place.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
    w, b = fit_sparse((at, index, data), y, HASHED + N_FEATURES, ridge, steps=120)
    return Evidence(mean, scale, np.append(w, b))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first directory of a URL, without case and without a leading www; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", "")), F.when(host != "", F.concat(F.lit("/"), path))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Paths (host, path, n, total, prior, strength) and the global mean; scored has host, path, p."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    whole = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    mean = float(whole) if whole is not None else 0.5

    def strength(sites: DataFrame, centre: str) -> float:
        """m (1 - m) / tau^2 - 1, with tau^2 the spread of site means beyond sampling noise."""
        got = sites.where("n > 1").agg(
            F.count("*"), F.avg(F.expr(f"power(total / n - {centre}, 2)")), F.avg(F.expr("greatest(squares / n - power(total / n, 2), 0) / (n - 1)"))).first()
        if not got[0]:
            return 1e6
        tau = max(float(got[1]) - float(got[2]), 1e-7)
        return float(np.clip(mean * (1 - mean) / tau - 1, 1.0, 1e6))

    k_host = strength(hosts, f"{mean!r}D")
    host_mean = hosts.select(F.col("host").alias("h"), ((F.col("total") + k_host * mean) / (F.col("n") + k_host)).alias("prior"))
    placed = paths.join(host_mean, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return placed.withColumn("strength", F.lit(strength(placed, "prior"))), mean


def assess(docs: DataFrame, evidence: Evidence, text: str = "text", doc_id: str = "doc_id", host: str = "source", path: str = "lang", url: str | None = None, site_weight: float = SITE_WEIGHT, keep: float = KEEP) -> DataFrame:
    """(doc_id, evidence, site, quality, keep) of every row; no text is shuffled.  Host and path are the columns of these names, or from ``url``."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)
    where = site_of(F.col(url)) if url else (F.col(host), F.col(path))
    chosen = docs.select(F.col(text).alias("t"), F.col(doc_id).alias("doc_id"), where[0].alias("host"), where[1].alias("path"))
    kinds = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.of(batch.column(0)))], names=["doc_id", "host", "path", "p"])

    scored = written(chosen.mapInArrow(lean(run), f"doc_id {kinds['doc_id']}, host {kinds['host']}, path {kinds['path']}, p double"))
    sites, mean = posteriors(scored)
    s = written(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "total", "prior", "strength"))
    joined = scored.join(s, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    others = (F.col("total") - F.col("p") + F.col("strength") * F.col("prior")) / (F.col("n") - 1 + F.col("strength"))
    logit = lambda c: F.log(c / (1 - c))
    site = F.least(F.greatest(others, F.lit(0.001)), F.lit(0.999))
    moved = logit(F.col("p")) + site_weight * (logit(site) - logit(F.lit(min(max(mean, 0.001), 0.999))))
    final = 1 / (1 + F.exp(-moved))
    return joined.select("doc_id", F.round("p", 6).alias("evidence"), F.round(site, 6).alias("site"), F.round(final, 6).alias("quality"), (final >= keep).alias("keep"))
