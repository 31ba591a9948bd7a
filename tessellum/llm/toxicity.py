"""Toxicity classifier with a counterfactual penalty on identity terms.

Features are words and their prefixes of 4 to 8 bytes (so that inflected forms
share evidence), valued ln(1 + tf) / ln(1 + words).  The classifier keeps the
features that ``min_docs`` labelled documents have and that are associated with
either label (a log odds ratio of two standard errors), and the identity terms
always.  Every labelled sentence with an identity term is written again with the
term, wherever it stands in it, swapped for each other term of its group; both
are scored and the squared change of the score is part of the loss.  So is the
change from each term alone to no term, so that a bare mention scores nothing.

The labelled sample is bounded by ``max_labelled`` rows, those of least hash of
their id; scoring covers all documents in one pass without a shuffle.

Defined results: a null or wordless text has score 0 and isn't toxic; a text of
any length is scored whole; there are no ties to break, a score at the threshold
is toxic; labels that are null are ignored, several for one id count as toxic if
one is; without both labels in the sample every score is 0; repeated rows are
scored each; an empty table gives an empty result; columns but the id and the
text aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_sparse, sigmoid, sparse_dot
from .shared import find, lean
from .textvec import U64, _powers, blocks, hash_word, mix, word_spans

PREFIXES = (4, 5, 6, 7, 8)
MAX_LABELLED = 20_000
THRESHOLD = 0.5
TIE = 4.0
#: Groups of terms that may replace one another in a sentence.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
)
_WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")
_SENTENCE = re.compile(r"[.!?\n]+")


def swaps(text: str, identities: tuple = IDENTITIES) -> list[tuple[str, str]]:
    """(sentence, the same with an identity term swapped) for each sentence, term in it and other term of its group."""
    groups: dict[str, list[tuple[str, ...]]] = {}
    for group in identities:
        for term in group:
            groups.setdefault(term, []).append(group)
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        for term in sorted({w for w in _WORD.findall(sentence) if w in groups}):
            for other in sorted({o for group in groups[term] for o in group} - {term}):
                out.append((sentence, _WORD.sub(lambda m: other if m[0] == term else m[0], sentence)))
    return out


def differences(pairs: list[tuple[str, str]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, place, value): features of each sentence less those of its swapped form, where they differ."""
    parts = []
    for side, sign in ((0, 1.0), (1, -1.0)):
        row, place, tf, words = _table(pa.array([p[side] for p in pairs], pa.string()), keys)
        parts.append((row, place, sign * _value(tf, words[row])))
    row, place, value = (np.concatenate(x) for x in zip(*parts))
    code, at = np.unique(row * len(keys) + place, return_inverse=True)
    total = np.bincount(at, value, len(code))
    code, total = code[np.abs(total) > 1e-12], total[np.abs(total) > 1e-12]
    return np.searchsorted(code, np.arange(len(pairs) + 1) * len(keys)), code % max(len(keys), 1), total


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and prefixes, the word that each came from, and the word offsets of each part."""
    start, end, at = word_spans(buf, offs)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64), at
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    out, source = [], []
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * power, out=total[1:])
        out.append(mix((total[end] - total[start]) * inverse[start]))
        source.append(np.arange(len(start)))
        for n in PREFIXES:
            use = np.flatnonzero(end - start >= n)
            out.append(mix((total[start[use] + n] - total[start[use]]) * inverse[start[use]] + U64(n)))
            source.append(use)
    return np.concatenate(out), np.concatenate(source), at


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]))[0]


def _table(column: pa.Array, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature or its place in keys, tf) of each row's distinct features, and the words of each row."""
    words = np.zeros(len(column), np.int64)
    rows_, what = [], []
    for buf, offs, rows in blocks(column):
        h, source, at = features(buf, offs)
        np.add.at(words, rows, np.diff(at))
        row = np.repeat(rows, np.diff(at))[source] if len(h) else np.zeros(0, np.int64)
        value = h.view(np.int64)
        if keys is not None:
            hit, place = find(keys, value)
            row, value = row[hit], place[hit]
        rows_.append(row), what.append(value)
    row, value = np.concatenate(rows_ or [np.zeros(0, np.int64)]), np.concatenate(what or [np.zeros(0, np.int64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[first], value[first], np.diff(np.append(first, len(row))), words


def _value(tf: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(tf) / np.log1p(np.maximum(words, 2))


@dataclass
class ToxicityModel:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        row, place, tf, words = _table(column, self.keys)
        at = np.searchsorted(row, np.arange(len(column) + 1))
        logit = sparse_dot(at, place, _value(tf, words[row]), self.weights) + self.bias
        return np.where(words > 0, sigmoid(logit), 0.0) if len(self.keys) else np.zeros(len(column))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED, identities: tuple = IDENTITIES, tie: float = TIE, ridge: float = 0.05, min_docs: int = 3) -> ToxicityModel:
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    sample = marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id").select("t", "y")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            row, value, _, _ = _table(batch.column(0), None)
            key, place = np.unique(value, return_inverse=True)
            bad = np.bincount(place, y[row], len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(place, minlength=len(key)) - bad), pa.array(bad)], names=["f", "good", "bad"])

    n_good, n_bad = (int(x or 0) for x in known.agg(F.sum(1 - F.col("y")), F.sum("y")).first())
    nothing = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    if not n_good or not n_bad:
        return nothing
    counted = known.mapInArrow(lean(tally), "f bigint, good bigint, bad bigint").groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where(F.expr(f"good + bad >= {min_docs}"))
    odds = F.abs(F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = counted.where(odds >= 2.0).select("f").toArrow().column(0).to_numpy()
    terms = {t: term_features(t).view(np.int64) for group in identities for t in group}
    keys = np.unique(np.concatenate([best, *terms.values()]).astype(np.int64))
    if not len(best):
        return nothing

    spotted = np.unique(np.array([int(U64(hash_word(t)).view(np.int64)) for t in terms], np.int64))
    def pair(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32() if values.dtype.kind == "i" else pa.float32()))


    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows' features with their label, and rows without one: what changes by each swap."""
        for batch in batches:
            row, place, tf, words = _table(batch.column(0), keys)
            yield pa.RecordBatch.from_arrays([batch.column(1), pair(np.searchsorted(row, np.arange(batch.num_rows + 1)), place), pair(np.searchsorted(row, np.arange(batch.num_rows + 1)), _value(tf, words[row]))], names=["y", "place", "value"])
            said = np.unique(_table(batch.column(0), spotted)[0])
            found = [p for text in batch.column(0).take(pa.array(said)).to_pylist() for p in swaps(text, identities)]
            if found:
                at, place, value = differences(found, keys)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int32()), pair(at, place), pair(at, value)], names=["y", "place", "value"])

    got = known.mapInArrow(lean(describe), "y int, place array<int>, value array<float>").toArrow().combine_chunks()
    labelled = got.column("y").is_valid()
    sample, swapped = got.filter(labelled), got.filter(pa.compute.invert(labelled))
    y = sample.column("y").to_numpy().astype(float)
    # a bare mention: the term's features in a sentence of twenty words
    unit = np.log(2) / np.log1p(20)
    bare = [np.searchsorted(keys, np.unique(k)) for k in terms.values()]
    offsets, place, value = _lists(swapped)
    sizes = np.cumsum([len(x) for x in bare])
    pairs = np.concatenate([offsets, offsets[-1] + sizes]), np.concatenate([place, *bare]), np.concatenate([value, np.full(sizes[-1], unit)])
    # the mean over pairs times their number: each pair weighs tie, however many there are
    w, b = fit_sparse(_lists(sample), y, len(keys), ridge, pairs, tie * (len(pairs[0]) - 1))
    return ToxicityModel(keys, w, b)


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, place, value) of the list columns of rows."""
    place, value = (pa.chunked_array(rows.column(c).chunks, rows.column(c).type).combine_chunks() for c in ("place", "value"))
    lengths = pa.compute.list_value_length(place).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(lengths)), place.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value.flatten().to_numpy(zero_copy_only=False).astype(float)


def classify(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p, 6)), pa.array(p >= threshold)], names=["doc_id", "score", "toxic"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(lean(run), f"doc_id {kind}, score double, toxic boolean")
