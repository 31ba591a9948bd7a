"""Vectorised text primitives over Arrow string columns.

Everything here works on the raw UTF-8 buffer of an Arrow batch with numpy, so a
Python worker never loops over words.  A document longer than ``PART_BYTES`` is
cut into parts at a separator; the cut depends on the document alone, so equal
texts always give equal parts wherever they lie in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 20
U64 = np.uint64

#: 1 for ASCII letters and digits and for every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = 1
_RADIX = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, U64)
_INVERSES = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd radix modulo 2**64, and of its inverse."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        inverse = pow(_RADIX, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, U64), np.full(n - 1, _RADIX, U64)]).cumprod(dtype=U64)
            _INVERSES = np.concatenate([np.ones(1, U64), np.full(n - 1, inverse, U64)]).cumprod(dtype=U64)
    return _POWERS[:n], _INVERSES[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def blocks(column: pa.Array, lower: bool = True, target: int = PART_BYTES, lines: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (bytes, part offsets, row of each part); a null counts as an empty text.

    lines: cut long texts after newlines alone, so that no line is ever split.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + target, "right")) - 1
        if end > row:
            yield data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], np.arange(row, end)
            row = end
            continue
        text = data[offsets[row] : offsets[row + 1]]
        cuts = [0]
        while len(text) - cuts[-1] > target:
            window = text[cuts[-1] : cuts[-1] + target]
            gaps = np.flatnonzero(window == 10 if lines else WORD_BYTE[window] == 0)
            if lines and not len(gaps):
                later = np.flatnonzero(text[cuts[-1] + target :] == 10)[:1]
                gaps = later + target if len(later) else np.array([len(text) - cuts[-1] - 1])
            cuts.append(cuts[-1] + (int(gaps[-1]) + 1 if len(gaps) else target))
        if cuts[-1] < len(text) or len(cuts) == 1:
            cuts.append(len(text))
        for a, b in zip(cuts, cuts[1:]):
            yield text[a:b], np.array([0, b - a]), np.array([row])
        row += 1


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word, and the word offsets of each part."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = WORD_BYTE[buf].astype(bool)
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    edge = offs[1:-1]
    before[edge[edge < len(buf)]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(w & ~before)
    return starts, np.flatnonzero(w & ~after) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the word offsets of each part."""
    starts, ends, per_part = word_spans(buf, offs)
    if not len(starts):
        return np.zeros(0, U64), per_part
    power, inverse = _powers(len(buf))
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * power, out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h), per_part


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives to one word."""
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], 0 where that is empty."""
    shape = (len(offsets) - 1, *values.shape[1:])
    out = np.zeros(shape, values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def binary_column(raw: np.ndarray, width: int) -> pa.Array:
    """Rows of ``width`` bytes as an Arrow binary column."""
    raw = np.ascontiguousarray(raw)
    n = raw.nbytes // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(raw)])


def binary_rows(column: pa.Array, dtype, count: int) -> np.ndarray:
    """The inverse of ``binary_column``: an array of shape (rows, count)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, count), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    first = offsets[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + n * count * np.dtype(dtype).itemsize].view(dtype).reshape(n, count)
