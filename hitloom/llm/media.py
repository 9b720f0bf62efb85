"""Media columns: AVI with motion JPEG, stored, read back and cut in shots.

A payload of bytes becomes grey frames of 64 x 32: every 64 bytes are one 8 x 8 block
and every byte one quantised DCT coefficient, the format's unit, which a reader keeps as
it is while samples after the inverse transform are rounded. Byte b is the coefficient
b - 128 below 128 and b - 127 from there on, so none is 0. The Huffman tables are declared
so that a code and its value bits always fill 16 bits: category c has a code of 16 - c.

A reader takes tables, sizes and frames from the file: the RIFF lists, the idx1 index,
the JPEG segments. Word-aligned tables are decoded as arrays, any other baseline grey
scan bit by bit; scans that end early are an error. Frames are dequantised and transformed
back to samples of 0 to 255, and shots are cut on the samples: one ends where the histogram
difference of two frames is above the mean of the differences around it by a multiple of
their deviation.

Texts: null is empty; payloads are filled with bytes 0 to a positive multiple of 64.
Null and repeated ids are rows like any other. A file has two bytes for each of the
payload, a third where one is stuffed, and headers (2.09 in all, as measured), and must
fit in a value of Spark (2^31 - 1 bytes): payloads above 1,000,000,000 bytes are an error,
and so is any file that is too large.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import pieces

WIDTH, HEIGHT, FRAME_US = 64, 32, 40_000
BLOCKS = WIDTH * HEIGHT // 64


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


# --- JPEG frames ---------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(codes.get(n, [])) for n in range(1, 17)) + bytes(x for n in sorted(codes) for x in codes[n])


#: code lengths by category, and codes: canonical, in the order in which the tables list them
DC_SIZES, AC_SIZES = range(9, -1, -1), range(8, 0, -1)
#: bytes of a Spark value, and of a payload, whose file takes two for each, some stuffed, and headers
CELL, MOST = 2**31 - 1, 1_000_000_000


def _canonical(sizes: range) -> dict[int, int]:
    out, code, length = {}, 0, 0
    for c in sizes:  # by length
        code <<= (16 - c - length) if out else 0
        out[c], code, length = code, code + 1, 16 - c
    return out


def _word(codes: dict[int, int], value: int) -> int:
    c = abs(value).bit_length()
    return codes[c] << c | (value if value > 0 else value + (1 << c) - 1 if c else 0)


OF_BYTE = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int32)
AC_WORDS = np.array([_word(_canonical(AC_SIZES), int(v)) for v in OF_BYTE], np.uint16)
DC_WORDS = np.array([_word(_canonical(DC_SIZES), v) for v in range(-256, 257)], np.uint16)
#: values by word; words that are none have NO_VALUE
NO_VALUE = 1 << 12
AC_VALUES, DC_VALUES = np.full(1 << 16, NO_VALUE, np.int32), np.full(1 << 16, NO_VALUE, np.int32)
AC_VALUES[AC_WORDS], DC_VALUES[DC_WORDS] = OF_BYTE, np.arange(-256, 257)


def _head(height: int) -> bytes:
    tables = _table(0x00, {16 - c: [c] for c in DC_SIZES}) + _table(0x10, {16 - c: [c] for c in AC_SIZES})
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, height, WIDTH, 1) + b"\1\x11\0") + _segment(0xC4, tables) + _segment(0xDA, b"\1\1\0\0\x3f\0")


HEADS = {h: _head(h) for h in range(8, HEIGHT + 1, 8)}


def encode_frame(units: np.ndarray, height: int) -> bytes:
    """units: (blocks, 64) of uint8; blocks fill whole rows of WIDTH."""
    words = AC_WORDS[units]
    words[:, 0] = DC_WORDS[np.diff(OF_BYTE[units[:, 0]], prepend=0) + 256]
    return HEADS[height] + words.astype(">u2").tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _codes(body: bytes) -> tuple[dict[tuple[int, int], int], int]:
    codes, code, at = {}, 0, 17
    for n in range(1, 17):
        for _ in range(body[n]):
            codes[n, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes, at


def _scan_bits(data: bytes, dc: dict, ac: dict, blocks: int) -> np.ndarray:
    """Any baseline scan of one component, in zigzag order."""
    value, left = int.from_bytes(data, "big"), len(data) * 8

    def take(n: int) -> int:
        nonlocal left
        left -= n
        if left < 0:
            raise ValueError("the scan ends early")
        return (value >> left) & ((1 << n) - 1)

    def symbol(codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code in the scan's table")

    def number(n: int) -> int:
        x = take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    out, before = np.zeros((blocks, 64), np.int32), 0
    for b in range(blocks):
        before += number(symbol(dc))
        out[b, 0], k = before, 1
        while k < 64:
            run, n = divmod(symbol(ac), 16)
            if not n and run < 15:
                break
            k += run
            if n:
                out[b, k] = number(n)
            k += 1
    return out


OWN_DC, OWN_AC = ({(16 - c, x): c for c, x in _canonical(sizes).items()} for sizes in (DC_SIZES, AC_SIZES))


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Quantised coefficients (blocks, 64) and their steps (64), both in zigzag order, width and height of a baseline grey frame."""
    at, dc, ac, width, height, steps = 2, {}, {}, 0, 0, np.ones(64, np.int32)
    while jpeg[at + 1] != 0xDA:
        (n,) = struct.unpack(">H", jpeg[at + 2 : at + 4])
        kind, body = jpeg[at + 1], jpeg[at + 4 : at + 2 + n]
        if kind == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            if body[5] != 1:
                raise ValueError("only grey frames are read")
        elif kind == 0xDB:
            steps = np.frombuffer(body, ">u2" if body[0] >> 4 else np.uint8, 64, 1).astype(np.int32)
        elif kind == 0xC4:
            while body:
                codes, used = _codes(body)
                dc, ac = (dc, codes) if body[0] >> 4 else (codes, ac)
                body = body[used:]
        at += 2 + n
    (n,) = struct.unpack(">H", jpeg[at + 2 : at + 4])
    data = jpeg[at + 2 + n : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff")
    blocks = -(-width // 8) * -(-height // 8)
    if dc == OWN_DC and ac == OWN_AC and len(data) == blocks * 128:
        words = np.frombuffer(data, ">u2").reshape(blocks, 64)
        out = AC_VALUES[words]
        d = DC_VALUES[words[:, 0]]
        out[:, 0] = d
        if out.max(initial=0) < NO_VALUE:
            out[:, 0] = np.cumsum(d)
            return out, steps, width, height
    return _scan_bits(data, dc, ac, blocks), steps, width, height


def units_of(coefficients: np.ndarray) -> np.ndarray:
    """The bytes that encode_frame() put in."""
    return np.where(coefficients < 0, coefficients + 128, coefficients + 127).astype(np.uint8)


def _zigzag() -> np.ndarray:
    """The place, row by row, of each coefficient."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(order)


def _inverse() -> np.ndarray:
    """Samples (64) of each coefficient in zigzag order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2 * np.where(k, 1, 0.5**0.5)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[_zigzag()].astype(np.float32)


INVERSE = _inverse()


def samples_of(coefficients: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Samples (blocks, 64) row by row, of 0 to 255."""
    x = (coefficients * steps).astype(np.float32) @ INVERSE
    return np.clip(np.rint(x + 128), 0, 255).astype(np.uint8)


# --- RIFF ------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """One motion-JPEG stream; payload: a positive multiple of 64 bytes."""
    if len(payload) > MOST:
        raise ValueError(f"a payload above {MOST} bytes has a file that may not fit in a value")
    units = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    n = len(units)
    across = WIDTH // 8
    if n % across:  # whole rows of blocks; avih keeps the payload's length
        units = np.vstack([units, np.zeros((across - n % across, 64), np.uint8)])
    frames = [encode_frame(units[i : i + BLOCKS], len(units[i : i + BLOCKS]) // across * 8) for i in range(0, len(units), BLOCKS)]
    main = struct.pack("<14I", FRAME_US, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, len(payload), 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<12I", 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), 0, 0, 0, 0, 0)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", 0, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    chunks, index, at = [], [], 4
    for f in frames:
        chunks.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    file = _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))
    if len(file) > CELL:
        raise ValueError(f"a file of {len(file)} bytes does not fit in a value")
    return file


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        (n,) = struct.unpack("<I", data[at + 4 : at + 8])
        yield data[at : at + 4], at + 8, n
        at += 8 + n + n % 2


def read_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """Frames by the index, microseconds a frame, and the length kept in avih's first reserved field."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, frame_us, length = 0, b"", 0, 0
    for name, at, n in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            a = next(a for x, a, _ in _chunks(data, at + 4, at + n) if x == b"avih")
            frame_us, *_rest = struct.unpack("<14I", data[a : a + 56])
            length = _rest[9]
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at
        elif name == b"idx1":
            index = data[at : at + n]
    frames = [data[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in struct.iter_unpack("<4sIII", index) if name[2:] == b"dc"]
    return frames, frame_us, length


# --- shots -----------------------------------------------------------------------


def shots(histograms: np.ndarray, around: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """First and last frame (end exclusive) of every shot; histograms: (frames, bins), each of sum 1."""
    n = len(histograms)
    d = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts = []
    for i in range(len(d)):
        near = np.delete(d[max(0, i - around) : i + around + 1], min(i, around))
        limit = max(least, near.mean() + factor * near.std()) if len(near) else least
        if d[i] > limit:
            cuts.append(i + 1)
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def frame_histograms(frames: list[np.ndarray], bins: int = 32) -> np.ndarray:
    """frames: samples of each."""
    n = np.array([f.size for f in frames])
    of = np.repeat(np.arange(len(frames)) * bins, n)
    every = np.concatenate([f.ravel() for f in frames])
    return np.bincount(of + (every.astype(np.int64) * bins >> 8), minlength=bins * len(frames)).reshape(-1, bins) / n[:, None]


class Film:
    """A file read back: coefficients and samples of its frames."""

    def __init__(self, media: bytes):
        jpegs, self.frame_us, self.length = read_avi(media)
        found = [decode_frame(f) for f in jpegs]
        self.coefficients = [f[0] for f in found]
        ends = np.cumsum([len(c) for c in self.coefficients])[:-1]
        steps = np.concatenate([np.broadcast_to(f[1], f[0].shape) for f in found])
        self.frames = np.split(samples_of(np.concatenate(self.coefficients), steps), ends)

    def payload(self) -> bytes:
        return units_of(np.concatenate(self.coefficients)).tobytes()[: self.length]

    def clips(self) -> list[tuple[int, int]]:
        return shots(frame_histograms(self.frames))


# --- columns ---------------------------------------------------------------------


def _text_id(id_col: str) -> Column:
    """Ids as text, which pandas keeps whole beside a null."""
    return F.col(id_col).cast("string").alias("id")


def _named(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col("id").cast("long").alias(id_col), *df.columns[1:])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media (binary): each text's payload as a motion-JPEG file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, "text", 2_000_000):
            raw = [(t or "").encode("utf-8", "replace") for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(x) for x in raw], "media": [encode_avi(padded(x)) for x in raw]})

    return _named(df.select(_text_id(id_col), F.col(text_col).alias("text")).mapInPandas(run, "id string, n_bytes long, media binary"), id_col)


def clips(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df: id, media. One row a clip: id, clip, start_us, end_us, n_frames, mean (of its samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, media in zip(pdf["id"], pdf["media"], strict=True):
                film = Film(media)
                us = film.frame_us
                out += [(i, k, a * us, b * us, b - a, float(np.mean(np.concatenate([f.ravel() for f in film.frames[a:b]])))) for k, (a, b) in enumerate(film.clips())]
            yield pd.DataFrame(out, columns=["id", "clip", "start_us", "end_us", "n_frames", "mean"])

    return _named(df.select(_text_id(id_col), "media").mapInPandas(run, "id string, clip int, start_us long, end_us long, n_frames int, mean double"), id_col)


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df: id, n_bytes, media as encode() gives them. What the stored bytes hold, read back, with the clips as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, n, media in zip(pdf["id"], pdf["n_bytes"], pdf["media"], strict=True):
                film = Film(media)
                payload = film.payload()
                feature = ";".join(f"{a * film.frame_us // 1000}-{b * film.frame_us // 1000}" for a, b in film.clips())
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(film.frames)} clips_ms={feature}"))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _named(df.select(_text_id(id_col), "n_bytes", "media").mapInPandas(run, schema), id_col)
