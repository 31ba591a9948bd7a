"""Best-fit-decreasing packing of documents into training sequences.

Lengths are integers up to ``capacity``, so the whole corpus is a histogram.
The driver runs best-fit decreasing over it: a segment tree over remaining
capacities finds the tightest open bin that takes a length in logarithmic time,
and equal documents that go to equal bins are placed at once.  What the driver
holds is bounded by the capacity, never by the corpus.  Every document then
finds its bin from its rank among the documents of its length, which comes from
per-task counts and one grouped prefix sum; no sort of the corpus is needed.

A document longer than the capacity is cut into full sequences, each a bin of
its own, and a remainder that is packed like a document.

Defined results: null and empty texts have no tokens and give no row; rows of
equal length are told apart by the order in which they are read; repeated rows
are packed each; an empty table gives an empty result; columns but the id and the
text aren't read, whatever their names; a token is a word or a
single mark that is neither a word nor white space, unless ``tokenizer`` names a
vocabulary file (byte_bpe_*.json) whose tokens are counted instead.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, written
from .textvec import WORD_BYTE, blocks

CAPACITY = 4096
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


class TightestFit:
    """A segment tree over remaining capacities: the least r >= length that has an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.most = np.zeros(2 * self.size, np.int64)  # bins below each node

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.most[i] += bins
            i >>= 1

    def find(self, length: int) -> int:
        """-1 if no open bin takes the length."""
        i = length + self.size
        if self.most[i]:
            return length
        while i > 1:
            if not i & 1 and self.most[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.most[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, per bin, offset) of best-fit decreasing, and the number of bins.

    Documents of a run fill consecutive bins, ``per bin`` in each, from ``offset``
    on.  The tightest open bin takes documents until none fits, so bins of equal
    remaining capacity are served together.
    """
    tree, pools, runs, bins = TightestFit(capacity), defaultdict(list), [], 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            r = tree.find(length)
            if r < 0:
                per = capacity // length
                fresh = max(1, left // per)
                first, count, used = bins, fresh, 0
                bins += fresh
                remaining = capacity
            else:
                first, count = pools[r].pop()
                used, remaining = capacity - r, r
                per = r // length
                whole = max(1, left // per)
                if whole < count:
                    pools[r].append((first + whole, count - whole))
                    count = whole
                tree.add(r, -count)
            placed = min(left, per * count)
            runs.append((length, rank, first, per, used))
            for n, start, how_many in ((per, first, placed // per), (placed % per, first + placed // per, 1 if placed % per else 0)):
                rest = remaining - n * length
                if how_many and rest:
                    pools[rest].append((start, how_many))
                    tree.add(rest, how_many)
            rank, left = rank + placed, left - placed
    return runs, bins


def token_counts(column: pa.Array, tokenizer: str | None = None) -> np.ndarray:
    total = np.zeros(len(column), np.int64)
    if tokenizer:
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_file(tokenizer)
        bpe.encode_special_tokens = True
        texts = [x or "" for x in column.to_pylist()]
        return np.array([len(x.ids) for x in bpe.encode_batch(texts, add_special_tokens=False)], np.int64)
    for buf, offs, rows in blocks(column, lower=False):
        word = WORD_BYTE[buf].astype(bool)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edge = offs[1:-1]
        edge = edge[edge < len(buf)]
        begins[edge] = word[edge]
        ticks = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(begins | ~(word | _SPACES[buf]), out=ticks[1:])
        np.add.at(total, rows, np.diff(ticks[offs]))
    return total


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start (its first token), n_tokens, bin_id, offset (its place in the bin)."""
    kind = dict(docs.dtypes)[doc_id]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)  # documents of each length so far in this task
        full = 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            n = token_counts(batch.column(1), tokenizer)
            rest = n % capacity
            order = np.argsort(rest, kind="stable")
            group = rest[order]
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(group)))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(begin, size) + seen[group]
            seen[group[begin]] += size
            whole = n // capacity
            before = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.full(len(n), task)), pa.array(rank), pa.array(before)], names=["doc", "tokens", "task", "rank", "full"])

    measured = written(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).mapInArrow(lean(measure), f"doc {kind}, tokens bigint, task bigint, rank bigint, full bigint").where("tokens > 0"))
    rest = F.expr(f"tokens % {capacity}")
    sizes = measured.groupBy(rest.alias("length"), "task").agg((F.max("rank") + 1).alias("n"), F.lit(0).alias("z"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    # a task's own counts of full sequences, laid out after all packed bins
    fulls = measured.groupBy("task").agg(F.sum(F.expr(f"tokens div {capacity}")).alias("n"))
    laid = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    full_starts = fulls.select("task", F.coalesce(laid, F.lit(0)).alias("full_before"))

    histogram = {r["length"]: r["n"] for r in sizes.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, bins = plan(histogram, capacity)
    table = np.array(runs, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    held = docs.sparkSession.sparkContext.broadcast(table[order])
    span = (1 << 62) // (capacity + 1)  # (length, rank) as one number

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = held.value
        key = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, rank = batch.column(1).to_numpy() % capacity, batch.column(2).to_numpy()
            use = np.flatnonzero(length > 0)
            at = np.searchsorted(key, length[use] * span + rank[use], "right") - 1
            into = rank[use] - runs[at, 1]
            bin_id = runs[at, 2] + into // runs[at, 3]
            offset = runs[at, 4] + into % runs[at, 3] * length[use]
            tokens = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use)), pa.array(tokens[use] // capacity), pa.array(tokens[use] - length[use]), pa.array(length[use]), pa.array(bin_id), pa.array(offset)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "offset"])
            whole = tokens // capacity
            row = np.repeat(np.arange(len(whole)), whole)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
            full = batch.column(3).to_numpy()
            zero = np.zeros(len(row), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece * capacity), pa.array(zero + capacity), pa.array(bins + full[row] + piece), pa.array(zero)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "offset"])

    ranked = measured.withColumn("length", rest).join(starts, ["length", "task"]).join(full_starts, "task")
    ready = ranked.select("doc", "tokens", (F.col("rank") + F.col("before")).alias("rank"), (F.col("full") + F.col("full_before")).alias("full"))
    return ready.mapInArrow(lean(place), f"doc_id {kind}, piece bigint, start bigint, n_tokens bigint, bin_id bigint, offset bigint")
