"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary, the words of all documents, and one smoothing:
p(w | v) = (c(v, w) + mu / V) / (c(v) + mu).  The target's counts come from the
target documents, the background's from all documents; background counts are
scaled to the target's number of tokens, so that the two are matched.  A document
is left out of either model's counts where it was counted, with all that it says,
so that it is scored by what others say.  The score is the mean over tokens of
target loss minus background loss; low is target-like.

Counts grow with the corpus and are never gathered in one place.  Documents are
read in blocks; a block sends each bucket its distinct pairs and words with
their counts, as one compressed row, the bucket adds up and sends the totals
back in the same order.  Rows shuffled per word pair are a few bytes.  There are
as many buckets as hold ``BUCKET_BYTES`` each, whatever the corpus.

Defined results: a null or wordless text has no tokens and null losses; a text of
any length is scored whole; there are no ties to break; repeated rows count each,
and each has its score; a table without target documents gives target losses of
ln V; an empty table gives an empty result; ids may be of any type; columns but
the id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, arrow_type, lean, member, tasks, written
from .textvec import U64, blocks, mix, word_hashes

MU = 1.0
BLOCK_BYTES = 4 << 20
#: About what a bucket's requests come to in compressed form; they are some 1.2 times the text.
BUCKET_BYTES = 16 << 20
REQUESTS = 1.2
START = U64(1)
_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros(0, np.uint8)
    return np.uint32(len(values)).tobytes() + bytes(_ZSTD.compress(planes.tobytes()))


def expand(raw: bytes, dtype) -> np.ndarray:
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(_ZSTD.decompress(raw[4:], n * width), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(dtype).ravel()


def _pairs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its context, and the pair's key of 56 bits."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    before[first] = START
    with np.errstate(over="ignore"):
        return before, mix(before * U64(0xD6E8FEB86659FD93) + h) >> U64(8)


def _bucketed(keys: np.ndarray, weights: np.ndarray, target: np.ndarray, buckets: int, last: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ordered by (bucket, key), all and target counts, and each input's place among them.

    last: what the last key's target count has besides.
    """
    unique, place = np.unique(keys, return_inverse=True)
    bucket = (mix(unique) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[place]
    every = np.bincount(place, weights, len(unique)).astype(np.uint32)
    wanted = np.bincount(place, weights * target, len(unique))
    if last:
        wanted[place[-1]] += last
    wanted = wanted.astype(np.uint32)
    return unique[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), np.stack([every, wanted]), place


class _Block:
    """Documents of one block: word hashes, contexts and pair keys, one after the other."""

    def __init__(self):
        self.docs, self.target, self.words, self.contexts, self.pairs, self.rows, self.size = [], [], [], [], [], [], 0

    def add(self, docs: pa.Array, target: np.ndarray, texts: pa.Array) -> None:
        base = sum(map(len, self.docs))
        tail, last = None, -1
        for buf, offs, rows in blocks(texts):
            h, at = word_hashes(buf, offs)
            if len(h):
                before, pair = _pairs(h, at)
                if rows[0] == last and at[1] > 0:  # a long text goes on: its first word follows the last part's last
                    before[0] = tail
                    with np.errstate(over="ignore"):
                        pair[0] = mix(before[:1] * U64(0xD6E8FEB86659FD93) + h[:1])[0] >> U64(8)
                self.words.append(h), self.contexts.append(before), self.pairs.append(pair)
                self.rows.append(base + np.repeat(rows, np.diff(at)))
                tail, last = h[-1], rows[-1] if at[-1] > at[-2] else -1
            self.size += len(buf)
        self.docs.append(docs), self.target.append(target)

    def rows_of(self, block: int, buckets: int) -> pa.RecordBatch:
        docs, target = pa.concat_arrays(self.docs), np.concatenate(self.target)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        words, contexts, pairs, row = join(self.words, U64), join(self.contexts, U64), join(self.pairs, U64), join(self.rows, np.int64)
        flag = target[row].astype(np.float64)
        pair_keys, pair_at, pair_n, pair_place = _bucketed(pairs, np.ones(len(pairs)), flag, buckets)
        # a context's own count is how often it comes before a word; words that end a text count 0
        n_tokens = len(words)
        starts = contexts == START
        follow = np.zeros(n_tokens + 1)  # 1 for a word that another follows
        follow[:n_tokens][np.flatnonzero(~starts) - 1] = 1
        follow[n_tokens], wanted = starts.sum(), np.append(flag, 0.0)
        word_keys, word_at, word_n, word_place = _bucketed(np.append(words, START), follow, wanted, buckets, float((flag * starts).sum()))
        context_place = np.where(starts, word_place[n_tokens], np.append(0, word_place[:-2]) if n_tokens else word_place[:0])
        del words, contexts, pairs, starts, follow, wanted
        order = np.lexsort((pair_place, row))
        pair_place, context_place, row = pair_place[order], context_place[order], row[order]
        step = np.diff(pair_place, prepend=0)
        lens = np.bincount(row, minlength=len(docs))
        body = [squeeze(step.astype(np.int32)), squeeze(context_of(pair_place, context_place, len(pair_keys)).astype(np.int32))]
        out = [(block, -1, docs, pa.array(target), pa.array(lens), b"", body[0], body[1])]
        for kind, keys, at, n in ((0, pair_keys, pair_at, pair_n), (1, word_keys, word_at, word_n)):
            for b in range(buckets):
                part = slice(at[b], at[b + 1])
                if at[b] < at[b + 1]:
                    out.append((block, kind * buckets + b, None, None, None, squeeze(np.diff(keys[part], prepend=U64(0))), squeeze(n[0, part]), squeeze(n[1, part])))
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), _lists(docs, len(out)), _lists(pa.array(target), len(out)), _lists(pa.array(lens), len(out))]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.binary()) for c in columns[5:]], names=["block", "bucket", "docs", "target", "lens", "keys", "a", "b"])


def context_of(pair: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """The context's place of each distinct pair."""
    out = np.zeros(n, np.int64)
    out[pair] = context
    return out


def _lists(values: pa.Array, rows: int) -> pa.Array:
    """A list column with ``values`` in its first row and empty lists after."""
    return pa.ListArray.from_arrays(pa.array([0] + [len(values)] * rows, pa.int32()), values)


def _add_up(batches: Iterator[pa.RecordBatch], buckets: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Replies of the buckets, each block's keys with their totals over all blocks; the blocks' own rows pass through."""
    held: list[tuple] = []
    kinds: list[pa.DataType] = []

    def flush() -> pa.RecordBatch:
        keys = [np.cumsum(expand(k, U64), dtype=U64) for _, _, k, _, _ in held]
        sizes = np.cumsum([0] + [len(k) for k in keys])
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(place, np.concatenate([expand(x[i], np.uint32) for x in held]), len(unique)).astype(np.int64) for i in (3, 4)]
        words = len(unique) - int((unique == START).sum()) if held[0][1] >= buckets else 0
        every = int(totals[0].sum()) if held[0][1] < buckets else 0
        wanted = int(totals[1].sum()) if held[0][1] < buckets else 0
        replies = [tuple(squeeze(t[place[a:b]]) for t in totals) for a, b in zip(sizes, sizes[1:])]
        rows = [(x[0], x[1], None, None, None, r[0], r[1], 0, 0, 0) for x, r in zip(held, replies)] + [(-1, held[0][1], None, None, None, None, None, words, every, wanted)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        kinds = [*(batch.schema.field(n).type for n in names[:7]), pa.int64(), pa.int64(), pa.int64()]
        own = pa.compute.equal(batch.column(1), -1)
        heads, asked = batch.filter(own), batch.filter(pa.compute.invert(own))
        if heads.num_rows:
            nought = pa.array(np.zeros(heads.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*(heads.column(n) for n in names[:7]), nought, nought, nought], names=names)
        for row in zip(*(asked.column(n).to_pylist() for n in ("block", "bucket", "keys", "a", "b"))):
            if held and held[0][1] != row[1]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def score(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, difference) of every row of docs.

    target: one column, the ids of the target documents, of the same type as
    docs' ids.  Up to BROADCAST_KEYS of them are broadcast, more are joined.
    """
    kind = dict(docs.dtypes)[doc_id]
    id_type = arrow_type(kind)
    ids = target.toDF("id").select(F.col("id").cast(kind).alias("id")).where("id IS NOT NULL").distinct()
    given = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    few = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    shared = None
    if few and kind in ("bigint", "int", "smallint", "tinyint"):
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy().astype(np.int64)))
        given = given.withColumn("w", F.lit(False))
    else:
        marked = ids.withColumn("w", F.lit(True))
        given = given.join(F.broadcast(marked) if few else marked, F.col("d") == F.col("id"), "left").select("d", "t", F.coalesce("w", F.lit(False)).alias("w"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(2 * tasks(docs), int(REQUESTS * size) // BUCKET_BYTES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            if not batch.num_rows:
                continue
            if shared is not None:
                key = batch.column(0)
                flag = member(key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), shared.value) & ~key.is_null().to_numpy(zero_copy_only=False)
            else:
                flag = batch.column(2).to_numpy(zero_copy_only=False)
            step = max(1, batch.num_rows * (block_bytes // 8) // max(batch.nbytes, 1))
            for a in range(0, batch.num_rows, step):  # so that a block is hardly larger than it should be
                part = slice(a, a + step)
                block.add(batch.column(0)[part], flag[part], batch.column(1)[part])
                if block.size >= block_bytes:
                    yield block.rows_of(number, buckets)
                    number, block = number + 1, _Block()
        if block.docs:
            yield block.rows_of(number, buckets)

    head = f"block bigint, bucket bigint, docs array<{kind}>, target array<boolean>, lens array<bigint>"
    names = ["block", "bucket", "docs", "target", "lens", "a", "b", "words", "every", "wanted"]
    # one shuffle takes requests to their buckets, and the blocks' own rows along with them to anywhere
    asked = given.mapInArrow(lean(ask), f"{head}, keys binary, a binary, b binary").withColumn("to", F.expr("if(bucket < 0, block, bucket)"))
    sent = asked.repartition(buckets, "to").drop("to").sortWithinPartitions("bucket", "block")
    replies = written(sent.mapInArrow(lean(lambda batches: _add_up(batches, buckets, names)), f"{head}, a binary, b binary, words bigint, every bigint, wanted bigint"), "uncompressed")
    sums = replies.where("block = -1").agg(F.sum("words"), F.sum("every"), F.sum("wanted")).first()
    words, every, wanted = (int(x or 0) for x in sums)
    ratio = wanted / every if every else 1.0

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            head, rest = rows[0], rows[1:]
            docs_, flags, lens = head[2], np.array(head[3], bool), np.array(head[4], np.int64)
            place = np.cumsum(expand(head[5], np.int32), dtype=np.int64)
            context = expand(head[6], np.int32)[place] if len(place) else place
            n = {k: [np.concatenate([expand(r[c], np.int64) for r in rest if (r[1] >= buckets) == k] or [np.zeros(0, np.int64)]) for c in (5, 6)] for k in (False, True)}
            own = np.repeat(flags, lens)
            # what the document itself says: its tokens of this pair, and its tokens after this context
            row = np.repeat(np.arange(len(lens)), lens)
            says = [_times(row, x) for x in (place, context)]
            lost = []
            for c, counts_own, scale in ((1, own.astype(np.int64), 1.0), (0, np.ones(len(place), np.int64), ratio)):
                top, bottom = n[False][c][place] - counts_own * says[0], n[True][c][context] - counts_own * says[1]
                lost.append(np.log(scale * bottom + mu) - np.log(scale * top + mu / max(words, 1)))
            at = np.append(0, np.cumsum(lens))
            mean = [np.add.reduceat(np.append(x, 0), np.minimum(at[:-1], len(x)))[: len(lens)] / np.maximum(lens, 1) for x in lost]
            none = lens == 0
            cols = [pa.array(np.round(x, 9), mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]
            return pa.RecordBatch.from_arrays([pa.array(docs_, id_type), pa.array(lens), *cols], names=["doc_id", "n_tokens", "loss_target", "loss_background", "difference"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][0] != row[0]:
                    yield flush()
                    rows = []
                rows.append(row)
        if rows:
            yield flush()

    together = replies.where("block >= 0").select(*names[:7]).repartition(tasks(docs), "block").sortWithinPartitions("block", "bucket")
    return together.mapInArrow(lean(answer), f"doc_id {kind}, n_tokens bigint, loss_target double, loss_background double, difference double")


def _times(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place how often its (row, key) occurs."""
    _, at, n = np.unique((row << 32) + key, return_inverse=True, return_counts=True)
    return n[at]


def oracle() -> str:
    """The scores over ``documents`` with the targets of ``labels`` (quality 1), in DuckDB's SQL, rounded to 4 places."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS words, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS t FROM documents),
e AS (SELECT uid, t, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
q AS (SELECT uid, t, w, coalesce(lag(w) OVER (PARTITION BY uid ORDER BY i), '<s>') AS v FROM e),
p AS (SELECT *, count(*) OVER (PARTITION BY uid, v, w) AS ow, count(*) OVER (PARTITION BY uid, v) AS ov FROM q),
n AS (SELECT v, w, count(*) AS cb, count(*) FILTER (WHERE t) AS ct FROM p GROUP BY ALL),
c AS (SELECT v, sum(cb) AS nb, sum(ct) AS nt FROM n GROUP BY v),
g AS (SELECT (SELECT count(DISTINCT w) FROM e) AS size, (SELECT count(*) FILTER (WHERE t) / count(*)::DOUBLE FROM e) AS r),
s AS (SELECT uid, avg(ln(nt - t::INT * ov + {MU}) - ln(ct - t::INT * ow + {MU} / size)) AS lt, avg(ln(r * (nb - ov) + {MU}) - ln(r * (cb - ow) + {MU} / size)) AS lb
  FROM p JOIN n USING (v, w) JOIN c USING (v) CROSS JOIN g GROUP BY uid)
SELECT doc_id, len(words)::BIGINT AS n_tokens, round(lt, 4) AS loss_target, round(lb, 4) AS loss_background, round(lt - lb, 4) AS difference FROM d LEFT JOIN s USING (uid)"""
