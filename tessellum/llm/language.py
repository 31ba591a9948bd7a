"""Language identification with bit-sliced Bloom filters over byte n-grams.

Each of ``positions`` slots holds one bit for every language; an n-gram sets its
language's bit in ``hashes`` slots.  The AND of an n-gram's slots is the set of
all languages that contain it, so one lookup answers for all languages at once.
A document's hits are counted per language, freed of the expected share of
false positives, and the language with the largest share of the document's
n-grams is its language.

A slot is as many 64-bit words wide as the number of languages asks for.

Defined results: a null, empty or letterless text has no n-grams, its language
is null and it is rejected; a text of any length is judged whole; a tie goes to
the language first in order; every input row gives one output row, repeated rows
included.  ``identify`` replaces columns that have a verdict's name, ``accepted``
leaves every column as it is, whatever its name.  A table without labelled rows,
an empty one among them, gives a model without languages, which rejects
everything.  Repeated texts count once in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean
from .textvec import WORD_BYTE, blocks, segment_sums

GRAM = 4
_SPACED = np.where(WORD_BYTE == 1, np.arange(256), 32).astype(np.uint8)
_SPACED[48:58] = 32
_SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
VERDICT = "detected string, share double, runner_up double, n_grams bigint, keep boolean"


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of letters and single spaces, and their offsets per part.

    Each part is framed by spaces, so even a one-letter word has an n-gram or,
    below GRAM bytes with its frame, is filled up with a zero byte.
    """
    sizes = np.diff(offs)
    pad = GRAM - 1
    first = offs[:-1] + pad * np.arange(len(sizes))
    text = np.full(len(buf) + pad * len(sizes) + 1, 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(1 + pad * np.arange(len(sizes)), sizes)] = _SPACED[buf]
    # frame of a part: a space before, a space and a zero after; the zero ends what may follow a word
    text[first + sizes + 2] = 0
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    blank = text == 32
    wide = text.astype(np.uint32)
    key = wide[:n].copy()
    for j in range(1, GRAM):
        key |= wide[j : n + j] << np.uint32(8 * j)
    double = blank[:-1] & blank[1:]
    bad = np.zeros(n, bool)
    for j in range(GRAM - 1):
        bad |= double[j : n + j]
    for j in range(GRAM - 1):
        bad |= text[j : n + j] == 0  # a zero only as the last byte
    bad |= (text[pad : n + pad] == 0) & ~(blank[:n] & ~blank[1 : n + 1])  # and only of " x " after a frame
    good = np.flatnonzero(~bad)
    return key[good], np.searchsorted(good, np.append(first, len(text)))


@dataclass
class LanguageModel:
    """slots: (words, positions), one bit per language in each position; rates: each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    rates: np.ndarray

    @classmethod
    def build(cls, per_language: dict[str, np.ndarray], positions: int | None = None, hashes: int = 3) -> LanguageModel:
        """per_language holds packed n-grams; positions must be a power of two, and are at least ten per n-gram of the largest language if not given."""
        languages = sorted(per_language)
        if positions is None:
            most = max((len(x) for x in per_language.values()), default=0)
            positions = 1 << min(max(20, (10 * most - 1).bit_length() if most else 0), 28)
        width = next((w for w in (8, 16, 32) if len(languages) <= w), 64)
        slots = np.zeros((max(1, -(-len(languages) // width)), positions), f"u{width // 8}")
        model = cls(languages, slots, hashes, np.zeros(len(languages)))
        rates = []
        for i, language in enumerate(languages):
            row, bit = slots[i // width], slots.dtype.type(1 << i % width)
            own = np.zeros(positions, bool)
            for slot in model.probe(per_language[language].astype(np.uint32)):
                own[slot] = True
            row[own] |= bit
            rates.append((np.count_nonzero(own) / positions) ** hashes)
        model.rates = np.array(rates)
        return model

    def probe(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        shift = np.uint32(32 - (self.slots.shape[1].bit_length() - 1))
        for seed in _SEEDS[: self.hashes]:
            h = keys * np.uint32(seed)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            yield h >> shift

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """(words, n-grams): for each n-gram the bitmask of all languages that contain it."""
        with np.errstate(over="ignore"):
            found = None
            for slot in self.probe(keys):
                found = self.slots[:, slot] if found is None else found & self.slots[:, slot]
        return found

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per row: hits of each language, and the number of n-grams."""
        hit, total = np.zeros((len(column), len(self.languages)), np.int64), np.zeros(len(column), np.int64)
        width = self.slots.dtype.itemsize * 8
        for buf, offs, rows in blocks(column):
            keys, at = grams(buf, offs)
            np.add.at(total, rows, np.diff(at))
            mask = self.masks(keys)
            for i in range(len(self.languages)):
                ones = (mask[i // width] >> mask.dtype.type(i % width)) & mask.dtype.type(1)
                np.add.at(hit[:, i], rows, segment_sums(ones.astype(np.int32), at))
        return hit, total

    def judge(self, column: pa.Array, min_share: float, min_grams: int, languages: list[str] | None) -> dict[str, pa.Array]:
        hit, total = self.hits(column)
        share = hit / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.rates) / np.maximum(1 - self.rates, 1e-9), 0, 1)
        if not self.languages:
            share = np.zeros((len(total), 1))
        best = share.argmax(axis=1)
        top = share.max(axis=1)
        rest = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(total))
        names = np.array([*self.languages, None], dtype=object)[np.where((total > 0) & (top > 0), best, len(self.languages))]
        keep = (total >= min_grams) & (top >= min_share) & np.array([x is not None and (languages is None or x in languages) for x in names], bool)
        return {"detected": pa.array(names.tolist(), pa.string()), "share": pa.array(np.round(top, 6)), "runner_up": pa.array(np.round(rest, 6)), "n_grams": pa.array(total), "keep": pa.array(keep)}


def train(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = 1000, min_count: int = 2, positions: int | None = None, hashes: int = 3) -> LanguageModel:
    """Fit on a bounded sample: per language the per_language distinct labelled texts of least hash.

    An n-gram belongs to a language if it occurs min_count times in that sample.
    The sample bounds what reaches the driver; the corpus size doesn't.
    """
    known = docs.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).cast("string").alias("l"), F.xxhash64(text).bitwiseAND((1 << 62) - 1).alias("h"), F.col(text).alias("t"))
    sizes = known.groupBy("l").agg(F.approx_count_distinct("h").alias("size"))
    # about twice the sample by a bound on the hash, so what is shuffled doesn't grow with the corpus; copies meet before the shuffle
    few = known.join(F.broadcast(sizes), "l").where(F.col("h") < (2 * per_language + 64) / F.col("size") * float(1 << 62)).groupBy("l", "h").agg(F.min("t").alias("t"))
    picked = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= per_language).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                part = batch.column(1).filter(pa.array(names == name))
                keys = [grams(buf, offs)[0] for buf, offs, _ in blocks(part)]
                value, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n)], names=["l", "g", "n"])

    counted = picked.mapInArrow(lean(count), "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    best = counted.select("l", "g").toArrow()
    language, gram = best.column("l").combine_chunks().dictionary_encode(), best.column("g").to_numpy().astype(np.uint32)
    code = language.indices.to_numpy(zero_copy_only=False)
    return LanguageModel.build({x: gram[code == i] for i, x in enumerate(language.dictionary.to_pylist())}, positions, hashes)


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text", min_share: float = 0.5, min_grams: int = 1, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs whose language is recognised (``keep`` of ``identify``), with docs' own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(shared.value.judge(batch.column(at), min_share, min_grams, languages)["keep"])

    return docs.toDF(*inner).mapInArrow(lean(run), ", ".join(f"{c} {kind}" for c, (_, kind) in zip(inner, docs.dtypes))).toDF(*names)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", min_share: float = 0.5, min_grams: int = 1, languages: list[str] | None = None) -> DataFrame:
    """docs with detected, share, runner_up, n_grams and keep in columns of those names.

    A column of docs with one of these names is replaced.  keep: enough n-grams,
    a corrected share of at least min_share, and a wanted language (None: any).
    One pass, no shuffle; the model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [x.split()[0] for x in VERDICT.split(", ")]
    rest = docs.drop(*[c for c in docs.columns if c in extra and c != text])
    inner = [f"c{i}" for i in range(len(rest.columns))]
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = shared.value.judge(batch.column(at), min_share, min_grams, languages)
            yield pa.RecordBatch.from_arrays([*batch.columns, *said.values()], names=[*inner, *said])

    schema = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(inner, rest.dtypes))
    out = rest.toDF(*inner).mapInArrow(lean(run), f"{schema}, {VERDICT}")
    return out.select(*[F.col(c).alias(name) for c, name in zip(inner, rest.columns)], *extra)
