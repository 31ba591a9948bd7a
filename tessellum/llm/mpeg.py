"""MPEG audio columns: frame headers, tags, variable-bitrate tables, checksums, durations and seek offsets.

A stream is what lies between an ID3v2 tag at the start and APEv2 and ID3v1 tags
at the end.  A frame begins a run if the header it leads to fits it (version,
layer, sample rate) or if it ends the stream; within a run the next header alone
must be valid and fit.  A frame that leads nowhere while another run begins inside
it is none.  Where a run breaks, the parser searches for the next frame that
begins one.  A Xing, Info or VBRI frame holds the table and isn't
audio; a LAME extension's delay and padding are taken off the exact duration.

Defined results: a null value has status 'null' and no other field; bytes
without a frame (an empty value among them) have status 'no_frames'; a stream
with skipped bytes, a cut last frame or a wrong checksum is 'damaged', others
are 'ok'.  Checksums of layer III are verified; those of layers I and II, whose
protected length depends on the bit allocation, are counted as unchecked.
Repeated rows give repeated results; other columns pass through, one called
``audio_info`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

_V1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_V2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_V2[3] = _V2[2]
#: kbit/s by version bits (0: 2.5, 2: 2, 3: 1), layer and bitrate index; 0 where free or invalid.
BITRATES = np.zeros((4, 4, 16), np.int64)
for _layer in (1, 2, 3):
    BITRATES[3, _layer, :15] = _V1[_layer]
    BITRATES[2, _layer, :15] = BITRATES[0, _layer, :15] = _V2[_layer]
RATES = np.zeros((4, 4), np.int64)
RATES[3, :3], RATES[2, :3], RATES[0, :3] = (44100, 48000, 32000), (22050, 24000, 16000), (11025, 12000, 8000)
SAMPLES = np.zeros((4, 4), np.int64)
SAMPLES[3, 1:], SAMPLES[2, 1:], SAMPLES[0, 1:] = (384, 1152, 1152), (384, 1152, 576), (384, 1152, 576)
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
INFO = (
    "struct<status string, version string, layer int, sample_rate int, channels int, n_frames bigint, n_samples bigint, duration double, "
    "bitrate double, vbr boolean, table_kind string, table_frames bigint, table_bytes bigint, toc array<int>, encoder_delay int, encoder_padding int, "
    "crc_checked bigint, crc_failed bigint, crc_unchecked bigint, resyncs bigint, skipped_bytes bigint, truncated boolean, "
    "title string, artist string, album string, year string, seek_offsets array<bigint>>"
)


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out[i] = c
    return out


CRC = _crc_table()
_CRC_LIST = CRC.tolist()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes (MPEG: polynomial 0x8005, start 0xFFFF)."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, j]]
    return c


def side_info(version: int, channels: int) -> int:
    return (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)


def headers(d: np.ndarray, start: int, end: int) -> dict[str, np.ndarray]:
    """All valid frame headers that begin in d[start:end], vectorised."""
    at = start + np.flatnonzero((d[start : max(start, end - 3)] == 255) & (d[start + 1 : max(start + 1, end - 2)] >= 0xE0))
    b1, b2, b3 = d[at + 1].astype(np.int64), d[at + 2].astype(np.int64), d[at + 3].astype(np.int64)
    version, layer = (b1 >> 3) & 3, 4 - ((b1 >> 1) & 3)
    layer[layer == 4] = 0
    kbit, rate = BITRATES[version, layer, b2 >> 4], RATES[version, (b2 >> 2) & 3]
    ok = (kbit > 0) & (rate > 0) & (b3 & 3 != 2)
    at, b1, b2, b3, version, layer, kbit, rate = (x[ok] for x in (at, b1, b2, b3, version, layer, kbit, rate))
    pad, samples = (b2 >> 1) & 1, SAMPLES[version, layer]
    size = np.where(layer == 1, (12000 * kbit // np.maximum(rate, 1) + pad) * 4, samples * 125 * kbit // np.maximum(rate, 1) + pad)
    return {"at": at, "size": size, "samples": samples, "kbit": kbit, "rate": rate, "version": version, "layer": layer, "crc": (b1 & 1) == 0, "channels": np.where(b3 >> 6 == 3, 1, 2), "kin": version * 64 + layer * 16 + ((b2 >> 2) & 3)}


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(codec, "replace").split("\0")[0]


def _syncsafe(raw: bytes) -> int:
    return (raw[0] & 127) << 21 | (raw[1] & 127) << 14 | (raw[2] & 127) << 7 | raw[3] & 127


def id3v2(raw: bytes) -> tuple[int, dict[str, str]]:
    """Length of the tag at the start (0: none) and its text fields."""
    if len(raw) < 10 or raw[:3] != b"ID3" or raw[3] == 255 or raw[4] == 255 or max(raw[6:10]) > 127:
        return 0, {}
    major, flags, size = raw[3], raw[5], _syncsafe(raw[6:10])
    body = raw[10 : 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at, tags = 0, {}
    if flags & 0x40 and len(body) >= 4:
        at = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    names = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TYER": "year", "TDRC": "year", "TT2": "title", "TP1": "artist", "TAL": "album", "TYE": "year"}
    wide, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name = body[at : at + wide].decode("latin-1")
        n = int.from_bytes(body[at + 3 : at + 6], "big") if major == 2 else _syncsafe(body[at + 4 : at + 8]) if major == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        value = body[at + head : at + head + n]
        if name in names:
            tags.setdefault(names[name], _text(value))
        at += head + n
    return min(len(raw), 10 + size + (10 if flags & 0x10 else 0)), tags


def trailing(raw: bytes, end: int) -> tuple[int, dict[str, str]]:
    """End of the stream before the tags at its end, and the fields of an ID3v1 tag."""
    tags: dict[str, str] = {}
    if end >= 128 and raw[end - 128 : end - 125] == b"TAG":
        v1 = raw[end - 128 : end]
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            value = v1[a:b].split(b"\0")[0].decode("latin-1").strip()
            if value:
                tags[name] = value
        end -= 128
    if end >= 32 and raw[end - 32 : end - 24] == b"APETAGEX":
        size, flags = int.from_bytes(raw[end - 20 : end - 16], "little"), int.from_bytes(raw[end - 12 : end - 8], "little")
        end = max(0, end - size - (32 if flags >> 31 else 0))
    return end, tags


def walk(h: dict[str, np.ndarray], start: int, end: int) -> tuple[list[int], int, int, bool]:
    """Indexes of the frames, resynchronisations, skipped bytes, and whether the last frame is cut."""
    at, size, kin = h["at"], h["size"], h["kin"]
    then = at + size
    place = np.searchsorted(at, then)
    follows = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == then) & (kin[np.minimum(place, len(at) - 1)] == kin) if len(at) else np.zeros(0, bool)
    begins = follows | (then == end)
    link, starters = np.where(follows, place, -1).tolist(), np.flatnonzero(begins)
    frames, resyncs, skipped, cut, mark, i = [], 0, 0, False, start, -1
    stops, fits = then.tolist(), (then <= end).tolist()
    positions, begins_run, begin_at = at.tolist(), begins.tolist(), at[starters]
    while True:
        if i < 0:  # out of step: the next frame that begins a run
            k = int(np.searchsorted(begin_at, mark))
            if k >= len(starters):
                break
            i = int(starters[k])
            if positions[i] > mark:
                skipped += positions[i] - mark
                resyncs += bool(frames)
        if link[i] < 0 and stops[i] != end:  # leads nowhere: false if a run begins inside it
            k = int(np.searchsorted(begin_at, positions[i] + 1))
            if k < len(begin_at) and begin_at[k] < stops[i] and not begins_run[i]:
                i = int(starters[k])
                skipped += positions[i] - mark
                resyncs += 1
        if not fits[i]:
            cut = True
            break
        frames.append(i)
        mark = stops[i]
        i = link[i]
    if mark < end and (frames or start < end):
        # a header in step that runs past the end is a cut frame, other bytes are junk
        near = int(np.searchsorted(at, mark))
        if frames and not cut and near < len(at) and positions[near] == mark and kin[near] == kin[frames[-1]]:
            cut = True
        if not cut:
            skipped += end - mark
    return frames, resyncs, skipped, cut


def vbr_table(raw: bytes, at: int, version: int, channels: int, crc: bool) -> dict | None:
    xing = at + 4 + side_info(version, channels)
    for place in (xing, xing + 2 * crc):
        kind = raw[place : place + 4]
        if kind in (b"Xing", b"Info"):
            flags, p = int.from_bytes(raw[place + 4 : place + 8], "big"), place + 8
            out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(raw[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"], p = list(raw[p : p + 100]), p + 100
            p += 4 * bool(flags & 8)
            if raw[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and len(raw) >= p + 24:
                gap = int.from_bytes(raw[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = gap >> 12, gap & 4095
            return out
    p = at + 36
    if raw[p : p + 4] == b"VBRI":
        n, scale, width = (int.from_bytes(raw[p + o : p + o + 2], "big") for o in (18, 20, 22))
        toc = [int.from_bytes(raw[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(n)] if 1 <= width <= 4 else None
        return {"kind": "VBRI", "frames": int.from_bytes(raw[p + 14 : p + 18], "big"), "bytes": int.from_bytes(raw[p + 10 : p + 14], "big"), "toc": toc, "delay": 0, "padding": 0}
    return None


def parse(raw: bytes | None) -> dict:
    """Everything known about one value, as the fields of INFO."""
    if raw is None:
        return {"status": "null"}
    start, tags = id3v2(raw)
    end, old = trailing(raw, len(raw))
    tags = old | tags
    start = min(start, end)
    d = np.frombuffer(raw, np.uint8)
    h = headers(d, start, end)
    frames, resyncs, skipped, cut = walk(h, start, end)
    if not frames:
        return {"status": "no_frames", "skipped_bytes": end - start, **{k: tags.get(k) for k in ("title", "artist", "album", "year")}}
    first = frames[0]
    version, channels = int(h["version"][first]), int(h["channels"][first])
    table = vbr_table(raw, int(h["at"][first]), version, channels, bool(h["crc"][first]))
    f = np.array(frames[1:] if table else frames, np.int64)
    checked = failed = unchecked = 0
    guarded = f[h["crc"][f]]
    third = guarded[h["layer"][guarded] == 3]
    unchecked = len(guarded) - len(third)
    for ch in (1, 2):
        for v in (0, 2, 3):
            group = third[(h["channels"][third] == ch) & (h["version"][third] == v)]
            n = side_info(v, ch)
            group = group[h["size"][group] >= 6 + n]
            if len(group):
                p = h["at"][group]
                body = np.concatenate([d[p[:, None] + np.arange(2, 4)], d[p[:, None] + np.arange(6, 6 + n)]], axis=1)
                said = d[p + 4].astype(np.uint16) << np.uint16(8) | d[p + 5]
                checked += len(group)
                failed += int((crc16(body) != said).sum())
    samples, rate = int(h["samples"][f].sum()), int(h["rate"][first])
    played = max(0, samples - (table["delay"] + table["padding"] if table else 0))
    sizes, kbit = h["size"][f], h["kbit"][f]
    return {
        "status": "damaged" if skipped or cut or failed else "ok", "version": VERSIONS[version], "layer": int(h["layer"][first]), "sample_rate": rate, "channels": channels,
        "n_frames": len(f), "n_samples": samples, "duration": played / rate, "bitrate": round(8 * float(sizes.sum()) * rate / samples, 3) if samples else None, "vbr": bool(len(np.unique(kbit)) > 1),
        "table_kind": table and table["kind"], "table_frames": table and table["frames"], "table_bytes": table and table["bytes"], "toc": table and table["toc"],
        "encoder_delay": table["delay"] if table else 0, "encoder_padding": table["padding"] if table else 0,
        "crc_checked": checked, "crc_failed": failed, "crc_unchecked": unchecked, "resyncs": resyncs, "skipped_bytes": skipped, "truncated": cut,
        **{k: tags.get(k) for k in ("title", "artist", "album", "year")}, "seek_offsets": h["at"][f],
    }


def audio_info(df: DataFrame, column: str = "audio") -> DataFrame:
    """df with the struct ``audio_info`` in place of the bytes: one pass, no shuffle."""
    rest = [c for c in df.columns if c not in (column, "audio_info")]
    kinds = dict(df.dtypes)
    inner = [f"c{i}" for i in range(len(rest))]
    arrow = _arrow_struct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            info = pa.array([parse(x.as_py()) for x in batch.column(0)], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], info], names=[*inner, "info"])

    schema = ", ".join([f"{i} {kinds[c]}" for i, c in zip(inner, rest)] + [f"info {INFO}"])
    chosen = df.select(F.col(column), *[F.col(c).alias(i) for c, i in zip(rest, inner)])
    return chosen.mapInArrow(lean(run), schema).select(*[F.col(i).alias(c) for i, c in zip(inner, rest)], F.col("info").alias("audio_info"))


def _arrow_struct() -> pa.StructType:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.struct([(x.split()[0], kinds[x.split()[1]]) for x in INFO[len("struct<") : -1].split(", ")])


def frame(payload: bytes, version: int, kbit: int, rate: int, channels: int, crc: bool) -> tuple[bytes, int]:
    """A layer III frame around the start of payload, and how many payload bytes it took."""
    size = int(SAMPLES[version, 3]) * 125 * kbit // rate
    index = int(np.flatnonzero(BITRATES[version, 3] == kbit)[0])
    rates = RATES[version].tolist()
    head = bytes([255, 0xE0 | version << 3 | 1 << 1 | (0 if crc else 1), index << 4 | rates.index(rate) << 2, 0xC0 if channels == 1 else 0])
    room = size - 4 - 2 * crc
    body = payload[:room].ljust(room, b"\0")
    check = b""
    if crc:
        c = 0xFFFF
        for byte in head[2:] + body[: side_info(version, channels)]:
            c = (c << 8) & 0xFFFF ^ _CRC_LIST[c >> 8 ^ byte]
        check = c.to_bytes(2, "big")
    return head + check + body, min(len(payload), room)


def encode(payload: bytes, title: str = "", version: int = 3, rate: int = 44100, channels: int = 2, kbits: tuple[int, ...] = (128, 160), crc: bool = True, table: bool = True) -> tuple[bytes, list[int]]:
    """A stream that carries payload in its frames, bitrates taken in turn; and the frames' offsets."""
    name = b"\x03" + title.encode()
    tag = b"TIT2" + len(name).to_bytes(4, "big") + b"\0\0" + name
    n = len(tag)
    out = [b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag]
    pieces, left, i = [], payload, 0
    while left or not pieces:
        piece, used = frame(left, version, kbits[i % len(kbits)], rate, channels, crc)
        pieces.append(piece)
        left, i = left[used:], i + 1
    if table:
        mark = b"\0" * side_info(version, channels) + b"Xing" + (7).to_bytes(4, "big") + len(pieces).to_bytes(4, "big") + sum(map(len, pieces)).to_bytes(4, "big") + bytes(min(255, 256 * k // 100) for k in range(100))
        out.append(frame(mark, version, max(kbits), rate, channels, False)[0])
    at = sum(map(len, out))
    offsets = (at + np.cumsum([0] + [len(p) for p in pieces[:-1]])).tolist()
    return b"".join(out + pieces), offsets
