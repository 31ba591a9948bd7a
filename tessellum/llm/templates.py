"""Line deduplication with a log-template tree.

A line's tokens are its runs of non-space characters; a token with a digit is a
variable.  The tree has a fixed depth: the token count, then the ``LEADING``
leading tokens (variables as one).  Within a leaf the most frequent line seeds a
template and lines that agree with it in at least ``similarity`` of their
positions join it, the positions that differ becoming variables; then the next
line, and so on.  A template that recurs in ``min_docs`` documents is
boilerplate, and its lines are dropped everywhere.

Copies of a document are a matter of document deduplication: their prose recurs
too and isn't boilerplate.  A document of which recurring lines are at most half
carries its templates by itself.  Of documents that are mostly recurring lines,
the groups of near duplicates (the SimHash groups of ``bitsample``) are counted,
one carrier each, so a footer counts on pages shorter than itself; and they count
only for a template whose such documents form at least ``KIN`` groups each, so
that a set of copies whose most edited members are in no group doesn't drop its
own prose.

Defined results: null and empty texts stay as they are; blank lines stay; a line
is held whole, however long, a text of any length is processed whole; of equally
frequent lines the one of the lesser hash is the first seed; a document that
would lose all its lines keeps its text; repeated rows count as documents each
but are one group; an empty table gives an empty result.  ``drop_lines`` replaces
a column of docs that is called like its count, ``n_dropped``, unless ``counted``
is None, which leaves it out; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitsample import near_edges, signatures
from .shared import KeyTable, connected, cut, find, lean, tasks, written
from .textvec import U64, binary_column, blocks, mix, segment_sums

LEADING = 4
MIN_DOCS = 10
SIMILARITY = 0.7
KIN = 0.2
#: Leaves of up to this many lines are grown as a matrix, larger ones line by line through an index of their seeds.
MATRIX_LINES = 2048
STAR = U64(0x2A2A2A2A2A2A2A2A)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1


class Lines:
    """The lines with at least one token of a block: part, byte range, tokens, leaf and line keys."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        w = ~_SPACE[buf]
        edge = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(buf == 10) + 1]))
        edge = edge[edge < len(buf)]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        self.token = token_hashes(buf, start, end)
        bounds = np.searchsorted(start, np.append(edge, len(buf)))
        full = np.diff(bounds) > 0
        self.first, self.count = bounds[:-1][full], np.diff(bounds)[full]
        self.begin, self.end = edge[full], np.append(edge[1:], len(buf))[full]
        self.part = np.searchsorted(offs, self.begin, "right") - 1
        with np.errstate(over="ignore"):
            leaf = mix(self.count.astype(U64) + U64(1))
            for j in range(LEADING):
                has = self.count > j
                leaf[has] = mix(leaf[has] * U64(0xD6E8FEB86659FD93) + self.token[self.first[has] + j])
            place = np.arange(len(self.token)) - np.repeat(self.first, self.count) if len(self.first) else np.zeros(0, np.int64)
            mixed = mix(self.token + place.astype(U64) * U64(0x9E3779B97F4A7C15))
            line = segment_sums(mixed, np.append(self.first, len(self.token)))
            self.line = mix(line + leaf).view(np.int64)
        self.leaf = leaf.view(np.int64)


def token_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each token of a block; STAR for one with a digit."""
    from .textvec import _powers

    if not len(start):
        return np.zeros(0, U64)
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * power, out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start])
    digits = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_DIGIT[buf], out=digits[1:])
    h[digits[end] > digits[start]] = STAR
    return h


def _keys(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for buf, offs, rows in blocks(column, lower=False, lines=True):
        lines = Lines(buf, offs)
        yield rows[lines.part], lines.line


def line_counts(docs: DataFrame, text: str) -> DataFrame:
    """(leaf, line, words, n): in how many documents each distinct line is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, line, words, row = [], [], [], []
            for buf, offs, rows in blocks(batch.column(0), lower=False, lines=True):
                x = Lines(buf, offs)
                leaf.append(x.leaf), line.append(x.line), words.append(x.count), row.append(rows[x.part])
            if not leaf:
                continue
            leaf, line, words, row = (np.concatenate(x) for x in (leaf, line, words, row))
            once = np.lexsort((line, row))
            same = (row[once][1:] == row[once][:-1]) & (line[once][1:] == line[once][:-1])
            once = once[np.append(True, ~same)] if len(once) else once
            key, at, n = np.unique(line[once], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[once][at]), pa.array(key), pa.array(n)], names=["leaf", "line", "n"])

    found = docs.select(text).mapInArrow(lean(run), "leaf bigint, line bigint, n bigint")
    return written(found.groupBy("leaf", "line").agg(F.sum("n").alias("n")))


def _vectors(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(leaf, line, tokens) of the lines whose leaf is wanted."""
    table = KeyTable(wanted.select(F.col("leaf").alias("key"), F.lit(0).cast("bigint").alias("value")))

    def leaves(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for buf, offs, rows in blocks(column, lower=False, lines=True):
            x = Lines(buf, offs)
            yield rows[x.part], x.leaf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = table.of(batch.column(1))
            for buf, offs, _ in blocks(batch.column(0), lower=False, lines=True):
                x = Lines(buf, offs)
                use = np.flatnonzero(find(keys, x.leaf)[0])
                use = use[np.unique(x.line[use], return_index=True)[1]]
                tokens = pa.array([x.token[a : a + n].tobytes() for a, n in zip(x.first[use], x.count[use])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x.leaf[use]), pa.array(x.line[use]), tokens], names=["leaf", "line", "tokens"])

    return table.attach(docs.select(text), [text], leaves).mapInArrow(lean(run), "leaf bigint, line bigint, tokens binary").dropDuplicates(["leaf", "line"])


def grow(tokens: np.ndarray, similarity: float) -> np.ndarray:
    """For lines of one leaf, most frequent first: the index of the line that seeds each one's template."""
    seed = np.full(len(tokens), -1)
    left = np.arange(len(tokens))
    while len(left):
        join = (tokens[left] == tokens[left[0]]).mean(axis=1) >= similarity
        join[0] = True
        seed[left[join]] = left[0]
        left = left[~join]
    return seed


class Leaf:
    """The seeds of a large leaf; lines come in order, and only the seeds are held.

    Lines of ``n`` tokens that agree in ``similarity`` of them differ in at most d
    places.  Cut into d + 1 pieces, they have a piece in common, so a line's first
    similar seed is among the seeds that share a piece with it.
    """

    def __init__(self, n: int, similarity: float):
        self.n, self.similarity = n, similarity
        most = max(d for d in range(n) if d == 0 or (n - d) / n >= similarity)
        self.cuts = np.unique(np.linspace(min(LEADING, n - 1), n, most + 2).astype(np.int64))
        self.loose = len(self.cuts) < most + 2  # fewer places than pieces: every line of the leaf is similar to its first
        self.seeds = np.zeros((64, n), U64)
        self.lines: list[int] = []
        self.pieces: list[dict[int, list[int]]] = [{} for _ in self.cuts[1:]]

    def assign(self, tokens: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The seeding line of each line's template."""
        out = np.empty_like(lines)
        place = np.arange(self.n, dtype=np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            hashed = mix(tokens + place)
            keys = np.stack([hashed[:, a:b].sum(axis=1, dtype=U64) for a, b in zip(self.cuts, self.cuts[1:])], axis=1).tolist()
        for i, (row, key) in enumerate(zip(tokens, keys)):
            near = range(len(self.lines)) if self.loose else sorted({s for held, k in zip(self.pieces, key) for s in held.get(k, ())})
            hit = np.flatnonzero((self.seeds[list(near)] == row).mean(axis=1) >= self.similarity) if len(near) else ()
            if len(hit):
                out[i] = self.lines[near[hit[0]]]
                continue
            if len(self.lines) == len(self.seeds):
                self.seeds = np.concatenate([self.seeds, np.zeros_like(self.seeds)])
            self.seeds[len(self.lines)] = row
            for held, k in zip(self.pieces, key):
                held.setdefault(k, []).append(len(self.lines))
            self.lines.append(int(lines[i]))
            out[i] = lines[i]
        return out


def generalised(docs: DataFrame, text: str, counts: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(line, template) for lines whose leaf has several lines and enough documents."""
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds")).where((F.col("docs") >= min_docs) & (F.col("kinds") > 1)).select("leaf")
    vectors = _vectors(docs, text, leaves).join(counts, ["leaf", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[pa.RecordBatch] = []  # the start of a leaf that may still be a small one
        name, large = None, None

        def matrix_of(rows: pa.RecordBatch) -> np.ndarray:
            return np.frombuffer(b"".join(rows.column(2).to_pylist()), U64).reshape(rows.num_rows, -1)

        def told(line: np.ndarray, template: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(line), pa.array(template)], names=["line", "template"])

        def end() -> Iterator[pa.RecordBatch]:
            for rows in pa.Table.from_batches(small).combine_chunks().to_batches() if small else ():
                line = rows.column(1).to_numpy()
                yield told(line, line[grow(matrix_of(rows), similarity)])
            small.clear()

        for batch in batches:
            leaf = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else ()
            for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
                if leaf[a] != name:
                    yield from end()
                    name, large = leaf[a], None
                part = batch.slice(a, b - a)
                if large is None and sum(x.num_rows for x in small) + part.num_rows <= MATRIX_LINES:
                    small.append(part)
                    continue
                for rows in [*small, part]:
                    matrix, line = matrix_of(rows), rows.column(1).to_numpy()
                    large = large or Leaf(matrix.shape[1], similarity)
                    yield told(line, large.assign(matrix, line))
                small.clear()
        yield from end()

    placed = vectors.repartition(tasks(docs), "leaf").sortWithinPartitions("leaf", F.desc("n"), "line").select("leaf", "line", "tokens")
    return written(placed.mapInArrow(lean(run), "line bigint, template bigint"))


def boilerplate(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """(line, template) of the lines to drop."""
    docs, text = docs.select(F.col(text).alias("t")), "t"
    counts = line_counts(docs, text)
    merged = generalised(docs, text, counts, min_docs, similarity)
    named = counts.join(merged, "line", "left").select("line", "n", F.coalesce("template", "line").alias("template"))
    often = named.groupBy("template").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    recurring = written(named.join(often, "template").select("line", "template"))
    table = KeyTable(recurring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = table.of(batch.column(1))
            n = batch.num_rows
            total, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
            who, what = [], []
            for buf, offs, rows in blocks(batch.column(0), lower=False, lines=True):
                x = Lines(buf, offs)
                hit, at = find(keys, x.line)
                np.add.at(total, rows[x.part], x.count)
                np.add.at(common, rows[x.part[hit]], x.count[hit])
                who.append(rows[x.part[hit]]), what.append(values[at[hit]])
            if not who:
                continue
            who, what = np.unique(np.stack([np.concatenate(who), np.concatenate(what)]), axis=1)
            own = (2 * common <= total)[who]
            template, times = np.unique(what[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(template), pa.nulls(len(template), pa.binary()), pa.array(times)], names=["template", "sig", "n"])
            few, place = np.unique(who[~own], return_inverse=True)
            if len(few):
                sig, _ = signatures(batch.column(0).take(pa.array(few)))
                yield pa.RecordBatch.from_arrays([pa.array(what[~own]), binary_column(sig[place], 16), pa.array(np.ones(len(place), np.int64))], names=["template", "sig", "n"])

    seen = table.attach(docs, [text], _keys).mapInArrow(lean(run), "template bigint, sig binary, n bigint")
    seen = written(seen.groupBy("template", "sig").agg(F.sum("n").alias("n")))
    carried = seen.where("sig IS NULL").select("template", "n")
    copies = seen.where("sig IS NOT NULL")
    if copies.limit(1).count():
        linked = connected(near_edges(cut(copies.select("sig").distinct())))
        rooted = copies.join(linked.toDF("sig", "root"), "sig", "left").groupBy("template", F.coalesce("root", "sig").alias("root")).agg(F.sum("n").alias("n"))
        groups = rooted.groupBy("template").agg(F.count("*").alias("groups"), F.sum("n").alias("docs"))
        carried = carried.unionByName(groups.where(F.col("groups") >= KIN * F.col("docs")).select("template", F.col("groups").alias("n")))
    enough = carried.groupBy("template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("template")
    return written(recurring.join(enough, "template").select("line", "template"))


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, counted: str | None = "n_dropped") -> DataFrame:
    """docs with the boilerplate lines cut out of the text column, and ``counted``, how many were."""
    table = KeyTable(boilerplate(docs, text, min_docs, similarity))
    rest = docs.drop(counted) if counted and counted != text else docs
    at = rest.columns.index(text)
    inner = [f"c{i}" for i in range(len(rest.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = table.of(batch.column(len(inner)))
            column, n = batch.column(at), batch.num_rows
            lost, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
            parts: dict[int, list] = {}
            for buf, offs, rows in blocks(column, lower=False, lines=True):
                x = Lines(buf, offs)
                hit, _ = find(keys, x.line)
                np.add.at(lost, rows[x.part[hit]], 1)
                np.add.at(left, rows[x.part[~hit]], 1)
                touched = np.isin(rows, rows[x.part[hit]]) | np.isin(rows, list(parts))
                if len(rows) == 1:
                    touched[:] = True  # a part of a long text: others may be touched
                raw = buf.tobytes()
                for part in np.flatnonzero(touched):
                    cuts = np.flatnonzero(hit & (x.part == part)) if len(rows) == 1 else np.arange(*np.searchsorted(x.part, [part, part + 1]))
                    cuts = cuts[hit[cuts]]
                    mark, pieces = offs[part], []
                    for line in cuts:
                        pieces.append(raw[mark : x.begin[line]])
                        mark = x.end[line]
                    pieces.append(raw[mark : offs[part + 1]])
                    parts.setdefault(int(rows[part]), []).append(b"".join(pieces))
            lost[left == 0] = 0
            new = column
            if lost.any():
                texts = column.to_pylist()
                for row in np.flatnonzero(lost):
                    cut = b"".join(parts[row]).decode()
                    texts[row] = cut[:-1] if cut.endswith("\n") and not texts[row].endswith("\n") else cut
                new = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 : len(inner)], pa.array(lost)], names=[*inner, "n_dropped"])

    schema = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(inner, rest.dtypes))
    given = table.attach(rest.toDF(*inner), [*inner[:at], *inner[at + 1 :], inner[at]], _keys)
    out = given.mapInArrow(lean(run), f"{schema}, n_dropped bigint")
    return out.toDF(*rest.columns, counted) if counted else out.drop("n_dropped").toDF(*rest.columns)
