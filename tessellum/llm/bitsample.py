"""Near-duplicate documents: 128-bit SimHash, grouped by random bit sampling.

A document's features are its word bigrams, the first word paired with the
start.  Tables each sample some coordinates of the signature; signatures that
agree on a table's coordinates share a bucket and are compared.  How many are
sampled follows from the number of signatures, so that a bucket of unrelated ones
holds about ``CROWD`` at any size of the corpus, and the number of tables from
that, so that a pair at distance ``MAX_DISTANCE`` meets in one of them with
probability 0.9 at least: 12 bits and 42 tables up to two million signatures, 18
bits and 201 tables at 130 million.  Work grows with about the 1.33th power.

A bucket is always compared whole, so no pair is dropped because its bucket is
large; one above ``share`` signatures is divided by hash, and each pair of its
divisions is a task's work of its own, so no task grows with the bucket (the
comparisons, with the square of its size, do).  Equal signatures are one node from
the start.  Pairs within ``max_distance`` are edges; a bucket sends out a spanning
forest of them, never all pairs, and connected components are the groups.

Defined results: a null text, or one without a word, belongs to no group and is
kept; a text of any length is read whole; repeated rows (same id or not) have equal signatures and form a group; of
a group the row with the least doc_id stays, nulls last, ties by text hash and
then arbitrarily among equal rows; an empty table gives an empty result; other
columns pass through, and working columns can't clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected, cut, find, lean, tasks, written
from .textvec import U64, binary_column, binary_rows, blocks, mix, segment_sums, word_hashes

BITS = 128
MAX_DISTANCE = 26
#: Planned for, a little above the 0.9 that is wanted: tables share coordinates.
RECALL = 0.91
SAMPLED = 12
CROWD = 512
CAP = 4096
#: A bucket above this many signatures is divided; into 512 divisions at most.
SHARE = 1 << 15
#: Keys of dropped rows up to this many (about 10 MB) are broadcast.
BROADCAST_ROWS = 200_000
_LANES = U64(0x0101010101010101)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2) uint64 signatures, and how many words each row has."""
    ones, words = np.zeros((len(column), BITS), np.int64), np.zeros(len(column), np.int64)
    for buf, offs, rows in blocks(column):
        h, at = word_hashes(buf, offs)
        if not len(h):
            continue
        before = np.empty_like(h)
        before[0] = 1
        before[1:] = h[:-1]
        first = at[:-1]
        before[first[at[1:] > first]] = 1
        with np.errstate(over="ignore"):
            pair = mix(before * U64(0xD6E8FEB86659FD93) + h)
        counts = np.diff(at)
        np.add.at(words, rows, counts)
        # runs of at most 255 words, so that a byte holds a count: eight bits of the signature per pass
        runs = -(-counts // 255)
        run_part = np.repeat(np.arange(len(counts)), runs)
        begin = np.cumsum(runs) - runs
        starts = at[:-1][run_part] + 255 * (np.arange(len(run_part)) - begin[run_part])
        for half, value in enumerate((pair, mix(pair ^ U64(0xA0761D6478BD642F)))):
            for shift in range(8):
                lanes = np.add.reduceat((value >> U64(shift)) & _LANES, starts)
                eight = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
                total = segment_sums(eight, np.append(begin, len(run_part)))
                np.add.at(ones[:, 64 * half + shift : 64 * half + 64 : 8], rows, total)
    bits = 2 * ones > words[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(U64), words


def with_signature(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """docs' carry columns as c0, c1, ..., and sig (16 bytes; null without a word)."""
    inner = [f"c{i}" for i in range(len(carry))]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, words = signatures(batch.column(0))
            packed = binary_column(sig, 16)
            packed = pa.compute.if_else(pa.array(words > 0), packed, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], packed], names=[*inner, "sig"])

    schema = ", ".join([f"{c} {kinds[name]}" for c, name in zip(inner, carry)] + ["sig binary"])
    chosen = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(i) for c, i in zip(carry, inner)])
    return chosen.mapInArrow(lean(run), schema)


def tables_for(bits: int, distance: int = MAX_DISTANCE, recall: float = RECALL) -> int:
    """How many tables of so many sampled bits a pair at the distance needs to meet with this probability."""
    meet = np.prod([(BITS - distance - i) / (BITS - i) for i in range(bits)])
    return int(np.ceil(np.log(1 - recall) / np.log1p(-meet)))


def bits_for(signatures: int) -> int:
    """Coordinates to sample so that a bucket of unrelated signatures holds about CROWD."""
    return min(24, max(SAMPLED, int(np.ceil(np.log2(max(signatures, 1) / CROWD)))))


def plan_tables(tables: int, bits: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(BITS, bits, replace=False) for _ in range(tables)])


def gather(sig: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The sampled coordinates of each signature as one integer."""
    key = np.zeros(len(sig), np.int64)
    for i, p in enumerate(positions):
        key |= ((sig[:, p // 64] >> U64(p % 64)) & U64(1)).astype(np.int64) << i
    return key


def _link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs (a, b) in root, an array of labels, by repeated minimum."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _near(sig: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(sig[i, 0] ^ sig[j, 0]).astype(np.int16) + np.bitwise_count(sig[i, 1] ^ sig[j, 1]) <= limit


def bucket_roots(key: np.ndarray, sig: np.ndarray, limit: int, cap: int = CAP, side: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by key: the least row that each is linked to by near pairs within buckets.

    side: in a bucket whose rows have both sides, only pairs across are compared.
    """
    root = np.arange(len(key))
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edge, len(key)))
    mixed = np.zeros(len(edge), bool) if side is None or not len(edge) else np.logical_or.reduceat(side, edge)
    big = (sizes > cap) | mixed
    small_rows = np.repeat(~big, sizes)
    left = np.flatnonzero(small_rows)
    last = np.repeat(edge + sizes, sizes)
    for step in range(1, int(sizes[~big].max(initial=0))):
        left = left[left + step < last[left]]
        ok = _near(sig, left, left + step, limit)
        _link(root, left[ok], left[ok] + step)
    for at, size, across in zip(edge[big], sizes[big], mixed[big]):
        rows = np.arange(at, at + size)
        if across:
            _crowded(root, rows[~side[rows]], rows[side[rows]], sig, limit)
        else:
            _crowded(root, rows, rows, sig, limit)
    return root


def _crowded(root: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray, limit: int) -> None:
    """Link the near pairs of left and right, all of them compared; slices bound the memory."""
    same = left is right
    step = max(1, 1_000_000 // max(1, len(right)))
    for a in range(0, len(left), step):
        one, other = left[a : a + step], right[a:] if same else right
        far = np.bitwise_count(sig[one, 0][:, None] ^ sig[other, 0][None, :])
        far += np.bitwise_count(sig[one, 1][:, None] ^ sig[other, 1][None, :])
        i, j = np.nonzero(far <= limit)
        _link(root, one[i], other[j])


def _division(sig: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of its bucket's n divisions each signature is in."""
    with np.errstate(over="ignore"):
        return (mix(sig[:, 0] ^ mix(sig[:, 1])) % n.astype(U64)).astype(np.int64)


def _divisions(sigs: DataFrame, plan: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the buckets above share, and into how many divisions each goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = binary_rows(batch.column(0), U64, 2)
            for t, positions in enumerate(plan):
                key, n = np.unique((np.int64(t) << 32) | gather(sig, positions), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    if sigs.limit(share + 1).count() <= share:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = sigs.select("sig").mapInArrow(lean(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > share).toArrow()
    key, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], np.minimum(-(-n[order] // share), 1 << 9)


def near_edges(sigs: DataFrame, max_distance: int = MAX_DISTANCE, tables: int | None = None, bits: int | None = None, cap: int = CAP, share: int = SHARE) -> DataFrame:
    """Edges (a, b) of a spanning forest of the near pairs found; sigs has distinct ``sig``."""
    bits = bits or bits_for(sigs.count())
    plan = plan_tables(tables or tables_for(bits, max_distance), bits)
    crowds, parts = _divisions(sigs, plan, share)
    meet = 44  # a key: bits of the bucket, of the table from 32, of two divisions (9 each) from 44

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = binary_rows(batch.column(0), U64, 2)
            packed = binary_column(sig, 16)
            for t, positions in enumerate(plan):
                key = (np.int64(t) << 32) | gather(sig, positions)
                if not len(crowds):
                    yield pa.RecordBatch.from_arrays([pa.array(key), packed], names=["key", "sig"])
                    continue
                hit, at = find(crowds, key)
                yield pa.RecordBatch.from_arrays([pa.array(key[~hit]), binary_column(sig[~hit], 16)], names=["key", "sig"])
                # a row of a large bucket meets each division of it once, its own too
                some, n = sig[hit], parts[at[hit]]
                mine = _division(some, n)
                for other in range(int(n.max(initial=0))):
                    use = n > other
                    low, high = np.minimum(mine[use], other), np.maximum(mine[use], other)
                    yield pa.RecordBatch.from_arrays([pa.array(key[hit][use] | (low << meet) | (high << meet + 9)), binary_column(some[use], 16)], names=["key", "sig"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(key: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            side = None
            if len(crowds):
                low, high = key >> meet & 511, key >> meet + 9
                side = low < high
                _, at = find(crowds, key[side] & (1 << meet) - 1)
                side[side] = _division(sig[side], parts[at]) == high[side]
            root = bucket_roots(key, sig, max_distance, cap, side)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([binary_column(sig[moved], 16), binary_column(sig[root[moved]], 16)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), binary_rows(batch.column(1), U64, 2)))
            if held[-1][0][-1] == held[0][0][0]:
                continue  # one bucket so far
            key, sig = (np.concatenate(x) for x in zip(*held))
            tail = int(np.searchsorted(key, key[-1]))
            yield flush(key[:tail], sig[:tail])
            held = [(key[tail:], sig[tail:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    spreaded = sigs.select("sig").mapInArrow(lean(spread), "key bigint, sig binary")
    sorted_ = spreaded.repartition(tasks(sigs), "key").sortWithinPartitions("key", "sig")
    return sorted_.mapInArrow(lean(compare), "a binary, b binary").distinct()


def groups(signed: DataFrame, **how) -> DataFrame:
    """(sig, root) of every signature whose group has two rows or more."""
    counted = cut(signed.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("n")))
    linked = connected(near_edges(counted, **how))
    alone = counted.where("n > 1").select("sig", F.col("sig").alias("root")).join(linked.select(F.col("node").alias("sig")), "sig", "left_anti")
    return cut(linked.selectExpr("node AS sig", "root").unionByName(alone))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """A row for each row of docs that is in a group: doc_id, group_id, group_size, kept.

    group_id is the least doc_id of the group (null if all are null).
    """
    signed = written(with_signature(docs, text, [doc_id]))
    members = signed.join(groups(signed, **how), "sig")
    # counts and the first row come from a partial aggregation, so one large group is no hot window
    first = members.groupBy("root").agg(F.min("c0").alias("group_id"), F.count("*").alias("group_size"))
    once = members.groupBy("root", "c0").agg(F.count("*").alias("times"))
    told = once.join(first, "root")
    kept = F.col("group_id").eqNullSafe(F.col("c0"))
    rows = told.select(F.col("c0").alias("doc_id"), "group_id", "group_size", F.explode(F.expr("sequence(1L, times)")).alias("k"), kept.alias("first"))
    return rows.select("doc_id", "group_id", "group_size", (F.col("first") & (F.col("k") == 1)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each group, columns unchanged.

    Rows go by two hashes, of id and text.  The rows to drop are broadcast up to
    BROADCAST_ROWS, beyond that joined; texts never pass through Python here.
    """
    keyed = docs.select(doc_id, text, F.xxhash64(doc_id).alias("_k1"), F.xxhash64(text).alias("_k2"))
    signed = written(with_signature(keyed, text, [doc_id, "_k1", "_k2"]).where("sig IS NOT NULL"))
    rows = signed.groupBy("sig", "c0", "c1", "c2").agg(F.count("*").alias("n")).join(groups(signed, **how), "sig")
    order = F.struct(F.col("c0").isNull().alias("last"), F.col("c0"), F.col("c2"))
    stay = rows.groupBy("root").agg(F.min(order).alias("stay"))
    judged = written(rows.join(stay, "root").select(F.col("c1").alias("_k1"), F.col("c2").alias("_k2"), "n", (order == F.col("stay")).alias("stays")))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    every = docs.toDF(*inner).withColumns({"_k1": F.xxhash64(inner[names.index(doc_id)]), "_k2": F.xxhash64(inner[names.index(text)])})
    gone, repeated = judged.where("NOT stays").select("_k1", "_k2"), judged.where("stays AND n > 1").select("_k1", "_k2")
    keep = every.join(_sized(gone), ["_k1", "_k2"], "left_anti")
    if repeated.limit(1).count():
        once = keep.join(_sized(repeated), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
        keep = keep.join(_sized(repeated), ["_k1", "_k2"], "left_anti").unionByName(once)
    return keep.select(*[F.col(i).alias(name) for i, name in zip(inner, names)])


def _sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
