"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``2 * STEP`` words, a step apart, as TF-IDF vectors over
``FEATURES`` hashed words.  One pass over all passages counts document
frequencies and builds a randomised sketch S A of the count matrix A, in which
every passage goes to one random sketch row with a random sign; its right
singular vectors, after the IDF weights, span the latent space, and dividing by
the singular values keeps the few dominant directions (the languages) from
drowning the rest.  A second pass projects every passage and every benchmark
item into that space, an item longer than a passage also by windows of a
passage's length, a step apart, and takes pairs above ``COSINE`` as candidates.  A
candidate is then checked on the words themselves: the longest common
subsequence of the whole item and the place where the item would lie, with half
the item's length, at least a step, of context either side, and the same for the
item's answer, its last sentence.  Verbatim passages and paraphrases that keep
most words in order both pass; shared vocabulary alone doesn't.  A text that is
read in parts is searched across their seams.

Defined results: null and empty texts are in no leak; an item with fewer than
``MIN_WORDS`` words is not looked for; texts and items of any length are searched
whole; repeated rows each have their own leaks; ties don't matter, since every
candidate is checked; empty tables give an empty result; only the named columns
are read, and ``decontaminate`` passes all columns through, whatever their names.
The benchmark is broadcast up to ``ITEMS`` windows of items, and beyond
that processed in as many rounds as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_type, find, lean, tasks
from .textvec import U64, blocks, mix, word_hashes, word_spans

FEATURES = 1 << 14
ROWS = 256
RANK = 128
STEP = 24
COSINE = 0.3
MIN_WORDS = 8
VERBATIM = 0.8
PARAPHRASE = 0.55
ANSWER = 0.8
ITEMS = 50_000
#: Cosines that a worker computes at once (32 MB), and cells of the table of items and words (20 MB), beyond which it is a sorted list.
SIMILARITIES, TABLE_CELLS = 1 << 23, 20_000_000
_SKETCH_ROWS_EACH = 2


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def _pieces(f: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, STEP) features, filled up with FEATURES; the piece of each word; the pieces before each part."""
    counts = np.diff(at)
    each = -(-counts // STEP)
    base = np.append(0, np.cumsum(each))
    place = np.arange(len(f)) - np.repeat(at[:-1], counts)
    piece = np.repeat(base[:-1], counts) + place // STEP
    words = np.full((base[-1], STEP), FEATURES, np.uint16)
    words[piece, place % STEP] = f
    return words, piece, base


def _count(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sketch of the passage counts (ROWS, FEATURES), passage frequencies, and number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(ROWS * FEATURES, np.float32)
        seen = np.zeros(FEATURES, np.int64)
        rng = np.random.default_rng(1000 + TaskContext.get().partitionId())
        passages = 0
        for batch in batches:
            for buf, offs, _ in blocks(batch.column(0)):
                h, at = word_hashes(buf, offs)
                if not len(h):
                    continue
                words, passage, _ = _pieces(feature(h), at)
                n = len(words)
                row, sign = rng.integers(0, ROWS, n), rng.integers(0, 2, n) * 2 - 1
                np.add.at(sketch, row[passage] * FEATURES + feature(h), sign[passage].astype(np.float32))
                words.sort(axis=1)
                first = np.ones(words.shape, bool)
                first[:, 1:] = words[:, 1:] != words[:, :-1]
                seen += np.bincount(words[first], minlength=FEATURES + 1)[:FEATURES]
                passages += n
        if not passages:
            return
        parts = sketch.reshape(-1, _SKETCH_ROWS_EACH * FEATURES).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts) + 1), pa.int64()), pa.array([p.tobytes() for p in parts] + [np.append(seen, passages).tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        last = ROWS // _SKETCH_ROWS_EACH
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(raw.as_buffer(), np.int64 if part == last else np.float16)
                total[part] = total.get(part, 0) + more.astype(np.int64 if part == last else np.float32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])

    rows = docs.select(text).mapInArrow(lean(run), "part bigint, sums binary")
    found = rows.repartition(min(tasks(docs), 128), "part").mapInArrow(lean(add), "part bigint, sums binary").toArrow()
    by = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    last = ROWS // _SKETCH_ROWS_EACH
    if last not in by:
        return np.zeros((ROWS, FEATURES), np.float32), np.zeros(FEATURES, np.int64), 0
    tail = np.frombuffer(by[last], np.int64)
    sketch = np.concatenate([np.frombuffer(by[p], np.float32) for p in range(last)]).reshape(ROWS, FEATURES)
    return sketch, tail[:-1], int(tail[-1])


def latent(docs: DataFrame, text: str = "text", rank: int = RANK) -> np.ndarray:
    """(FEATURES, rank) float32: maps word counts of a passage to whitened latent coordinates."""
    sketch, seen, passages = _count(docs, text)
    # TF-IDF, over the root of the frequency: otherwise the space is spanned by each language's few function words
    idf = np.log((1 + passages) / (1 + seen)) / np.sqrt(seen + 10)
    weighted = sketch * idf.astype(np.float32)
    fit, held = weighted[: ROWS * 2 // 3].astype(np.float64), weighted[ROWS * 2 // 3 :].astype(np.float64)
    values, left = np.linalg.eigh(fit @ fit.T)
    top = np.argsort(values)[::-1][:rank]
    right = (fit.T @ left[:, top]) / np.sqrt(np.maximum(values[top], 1e-12))
    # the sketch fits its own noise, so the variance along each direction comes from the passages of the other rows
    sigma = np.sqrt(((held @ right) ** 2).mean(axis=0))
    return np.ascontiguousarray((idf[:, None] * right / np.maximum(sigma, 1e-3 * sigma.max(initial=1e-9))).astype(np.float32))


class Items:
    """The benchmark's items: word hashes, answers, and the unit latent vectors of their windows."""

    def __init__(self, ids: list, texts: list[str | None], projection: np.ndarray, min_words: int):
        self.ids, self.words, self.answers, vectors = [], [], [], []
        owner, offset = [], []  # of each vector: its item, and the words of the item before its window
        for item, text in zip(ids, texts):
            raw = np.frombuffer((text or "").lower().encode(), np.uint8)
            offs = np.array([0, len(raw)])
            h = word_hashes(raw, offs)[0]
            if len(h) < min_words:
                continue
            start, _, _ = word_spans(raw, offs)
            # the answer: the words after the last sentence end that leaves at least three
            stops = np.flatnonzero(np.isin(raw, [33, 46, 63, 10]))
            after = [len(h) - int(np.searchsorted(start, s)) for s in stops]
            tail = next((k for k in reversed(after) if 3 <= k <= len(h) // 2), max(3, len(h) // 4))
            last = max(0, len(h) - 2 * STEP)
            spans = [(at, 2 * STEP) for at in [*range(0, last, STEP), last]] + [(last // 2, len(h))] * (last > 0)  # the whole of a long one too
            for at, n in spans:
                v = projection[feature(h[at : at + n] if n < len(h) else h)].sum(axis=0)
                vectors.append(v / max(np.linalg.norm(v), 1e-9))
                owner.append(len(self.ids)), offset.append(at)
            self.ids.append(item), self.words.append(h), self.answers.append(h[-tail:])
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.margins = np.maximum(STEP, self.lengths // 2)
        self.vectors = np.array(vectors, np.float32).reshape(-1, projection.shape[1])
        self.masks = [_masks(w) for w in self.words]
        self.answer_masks = [_masks(w) for w in self.answers]
        # for the bound: words of items as sorted keys with the items that have them
        self.known = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, U64)
        held = [np.unique(np.searchsorted(self.known, w)) for w in self.words]
        self.table = np.zeros((len(self.words), len(self.known) + 1), bool) if len(self.words) * len(self.known) < TABLE_CELLS else None
        if self.table is not None:
            for i, k in enumerate(held):
                self.table[i, k] = True
        self.pairs = np.concatenate([(i << 32) + k for i, k in enumerate(held)]) if held and self.table is None else np.zeros(0, np.int64)

    def has(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether each item has the known word; -1 is none."""
        if self.table is not None:
            return self.table[item, word]
        return find(self.pairs, (item << 32) + word)[0] & (word >= 0)


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _leaks(column: pa.Array, items: Items, projection: np.ndarray, cosine: float, verbatim: float, paraphrase: float, answer: float) -> dict[tuple[int, int], tuple[float, float]]:
    """{(row, item): (lcs share, answer share)} of a batch."""
    best: dict[tuple[int, int], tuple[float, float]] = {}
    if not items.ids:
        return best
    matrix = np.vstack([projection, np.zeros((1, projection.shape[1]), np.float32)])
    # a long text comes in parts: as many words as an item and its margins may take go along into the next one
    reach = max(4 * STEP, int((items.lengths + 2 * items.margins).max()) + 2 * STEP)
    reach += -reach % STEP
    row, held = -1, np.zeros(0, U64)  # the row of the part before and its last words
    for buf, offs, rows in blocks(column):
        h, at = word_hashes(buf, offs)
        if len(rows) == 1:
            if rows[0] != row:
                row, held = rows[0], held[:0]
            h = np.concatenate([held, h])
            at = np.array([0, len(h)])
            first = max(0, (len(h) - reach) // STEP * STEP)  # passages begin where they would in the whole text
            held = h[first:]
        if not len(h):
            continue
        words_of, _, base = _pieces(feature(h), at)
        n = len(words_of)
        part = np.repeat(np.arange(len(at) - 1), np.diff(base))
        begin = at[:-1][part] + STEP * (np.arange(n) - base[part])
        piece = np.empty((n, matrix.shape[1]), np.float32)
        for a in range(0, n, 2048):  # slices keep the sums in cache
            total = matrix[words_of[a : a + 2048, 0]]
            for j in range(1, STEP):
                total += matrix.take(words_of[a : a + 2048, j], axis=0)
            piece[a : a + 2048] = total
        joined = piece.copy()
        inside = np.flatnonzero(part[1:] == part[:-1])
        joined[inside] += piece[inside + 1]
        joined /= np.maximum(np.linalg.norm(joined, axis=1, keepdims=True), 1e-9)
        known = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
        known[items.known[known] != h] = -1
        ends = at[1:][part]
        slice_ = max(1, min(8192, SIMILARITIES // len(items.vectors)))
        for a in range(0, n, slice_):
            w, v = np.nonzero(joined[a : a + slice_] @ items.vectors.T >= cosine)
            w += a
            i = items.owner[v]
            # where the item would begin, and room for it and its margins
            start = begin[w] - items.offset[v]
            lo = np.clip(start - items.margins[i], at[:-1][part[w]], ends[w])
            hi = np.clip(start + np.maximum(items.lengths[i], 2 * STEP) + items.margins[i], lo, ends[w])
            # words of the item that the passage has bound its longest common subsequence from above
            if len(w):
                longest = np.argsort(lo - hi, kind="stable")
                w, i, lo, hi = w[longest], i[longest], lo[longest], hi[longest]
                bound = np.zeros(len(w), np.int64)
                open_ = np.searchsorted(lo - hi, -np.arange(int(hi[0] - lo[0])), "left")
                for step, m in enumerate(open_):
                    bound[:m] += items.has(i[:m], known[lo[:m] + step])
                use = bound >= np.ceil(paraphrase * items.lengths)[i]
                w, i, lo, hi = w[use], i[use], lo[use], hi[use]
            for j, a_, b_, p in zip(i.tolist(), lo.tolist(), hi.tolist(), part[w].tolist()):
                words = h[a_:b_].tolist()
                share = lcs(items.masks[j], len(items.words[j]), words) / len(items.words[j])
                if share < paraphrase:
                    continue
                reply = lcs(items.answer_masks[j], len(items.answers[j]), words) / len(items.answers[j])
                if share >= verbatim or reply >= answer:
                    key = (int(rows[p]), j)
                    best[key] = max(best.get(key, (0, 0)), (share, reply))
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", rank: int = RANK, cosine: float = COSINE, min_words: int = MIN_WORDS, verbatim: float = VERBATIM, paraphrase: float = PARAPHRASE, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap): every item found in every document row."""
    spark = docs.sparkSession
    out = None
    kinds = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    item_type = arrow_type(kinds[1])
    for shared, projection in _rounds(docs, benchmark, text, item_id, item_text, rank, min_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, projection=projection) -> Iterator[pa.RecordBatch]:
            items, matrix = shared.value, projection.value
            for batch in batches:
                found = _leaks(batch.column(1), items, matrix, cosine, verbatim, paraphrase, answer)
                rows, which = [r for r, _ in found], [items.ids[j] for _, j in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, type=item_type), pa.array([round(s, 6) for s, _ in found.values()], pa.float64()), pa.array([round(r, 6) for _, r in found.values()], pa.float64())], names=["doc_id", "item_id", "overlap", "answer_overlap"])

        part = docs.select(doc_id, text).mapInArrow(lean(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, overlap double, answer_overlap double")


def _rounds(docs, benchmark, text, item_id, item_text, rank, min_words):
    """Broadcast (items, projection) pairs: one for a benchmark of up to ITEMS windows, more beyond that."""
    context = docs.sparkSession.sparkContext
    # windows of items, about; an item has at least one
    words = F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"[^\p{L}\p{N}]+"))
    total = benchmark.agg(F.sum(F.greatest(F.lit(1), F.ceil(words / STEP)))).first()[0]
    if not total:
        return
    matrix = latent(docs, text, rank)
    projection = context.broadcast(matrix)
    rounds = -(-total // ITEMS)
    for k in range(rounds):
        part = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
        if rounds > 1:
            part = part.where(F.pmod(F.xxhash64("i"), F.lit(rounds)) == k)
        got = part.toArrow()
        yield context.broadcast(Items(got.column(0).to_pylist(), got.column(1).to_pylist(), matrix, min_words)), projection


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the rows that hold an item; columns unchanged, a single pass after the latent space is known."""
    limits = {k: how.get(k, v) for k, v in (("cosine", COSINE), ("verbatim", VERBATIM), ("paraphrase", PARAPHRASE), ("answer", ANSWER))}
    at, names = docs.columns.index(text), docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(inner, docs.dtypes))
    left = docs
    for shared, projection in _rounds(docs, benchmark, text, how.get("item_id", "item_id"), how.get("item_text", "text"), how.get("rank", RANK), how.get("min_words", MIN_WORDS)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, projection=projection) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _leaks(batch.column(at), shared.value, projection.value, **limits)
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in found]] = False
                yield batch.filter(pa.array(keep))

        left = left.toDF(*inner).mapInArrow(lean(run), schema).toDF(*names)
    return left
