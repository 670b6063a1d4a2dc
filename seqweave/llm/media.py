"""Media columns: PNG images in binary columns, and perceptual hashes of what is read back from them.

Encoding and decoding follow the public PNG specification: a signature, then chunks of length, name, data and CRC-32; the
image data is one zlib stream of rows, each with a filter byte. Reading tests every chunk's checksum and zlib's own, and
undoes the row filters with numpy. Features are hashes of the low frequencies of a two-dimensional cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a row, and the unit to which a payload is filled up with zeros.
WIDTH = 64
#: Sizes of the grid that is transformed and of the block of frequencies that is kept.
GRID, KEPT = 32, 8
#: zlib level.
LEVEL = 3


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def _entropy(samples: np.ndarray) -> float:
    """Bits of a sample, by the frequencies of all."""
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum())


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit grey image of ``width`` columns whose samples are the payload, which is a multiple of ``width`` bytes.

    The filter (none or up) is that whose samples have the lower entropy over the image; a row is never lossy.
    """
    if not payload or len(payload) % width:
        raise ValueError(f"the payload has {len(payload)} bytes, not a positive multiple of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    _, kind, best = min(((_entropy(x), kind, x) for kind, x in ((0, rows), (2, up))), key=lambda x: x[:2])
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, best
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of one byte each from rows that begin with a filter byte (0 none, 1 left, 2 up, 3 mean, 4 Paeth)."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError(f"filter {kinds.max()} is unknown")
    runs = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for begin, end in zip(runs, np.r_[runs[1:], len(kinds)], strict=True):
        kind = int(kinds[begin])
        if kind == 1:
            rows[begin:end] = np.cumsum(rows[begin:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            rows[begin] += rows[begin - 1] if begin else 0
            rows[begin:end] = np.cumsum(rows[begin:end], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(begin, end):
                above = rows[y - 1].tolist() if y else [0] * rows.shape[1]
                line, left, corner = rows[y].tolist(), 0, 0
                for x, up in enumerate(above):
                    left = (line[x] + ((left + up) // 2 if kind == 3 else _paeth(left, up, corner))) & 255
                    line[x], corner = left, up
                rows[y] = line
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """The rows of an 8-bit grey image without interlacing; ValueError if a checksum, length or form is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        name, inner = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(name + inner):
            raise ValueError(f"checksum or length of chunk {name!r} is wrong")
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", inner)
        elif name == b"IDAT":
            body.append(inner)
        elif name == b"IEND":
            ended = True
        elif not name[0] & 32:
            raise ValueError(f"chunk {name!r} is not known")
        at += 12 + size
    if header is None or not ended:
        raise ValueError("chunks are missing")
    width, height, *form = header
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit grey images without interlacing are read")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != height * (width + 1):
        raise ValueError("the image data has a wrong length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _transform(n: int) -> np.ndarray:
    """The orthonormal cosine transform of length ``n`` (type II)."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


LOW = _transform(GRID)[:KEPT]


def _shrink(n: int) -> np.ndarray:
    """Edges of GRID nearly equal spans of ``n`` lines; short images repeat lines."""
    at = np.arange(GRID + 1) * n // GRID
    return np.maximum(at[1:], at[:-1] + 1), at[:-1]


def frequency_hash(rows: np.ndarray) -> bytes:
    """64 bits: which low frequencies of the image, shrunk to a square by means of areas, lie above their median."""
    sums = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1))
    np.cumsum(np.cumsum(rows, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    (y1, y0), (x1, x0) = _shrink(rows.shape[0]), _shrink(rows.shape[1])
    area = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    grid = area / np.outer(y1 - y0, x1 - x0)
    low = np.round(LOW @ grid @ LOW.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def as_payload(text: str | None, unit: int = WIDTH) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def media_column(text: Column) -> Column:
    """Each text's bytes, filled up with zeros to a positive multiple of 64, as a PNG image. Null and empty texts give the
    same image, repeated rows equal ones, an empty table no rows; texts of any length are one image."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_png(as_payload(x)) for x in texts], dtype=object)

    return of(text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features_column(media: Column) -> Column:
    """A struct of what is read back from each image: ``FEATURES``. Null gives null, repeated rows equal
    structs, an empty table no rows; a broken image raises."""

    @F.pandas_udf(FEATURES)
    def of(images: pd.Series) -> pd.DataFrame:
        out = []
        for image in images:
            if image is None:
                out.append((None,) * 6)
                continue
            rows = decode_png(image)
            payload = rows.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), frequency_hash(rows).hex()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in FEATURES.split(", ")]).astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    return of(media)


def payload_column(media: Column) -> Column:
    """The samples of each image as bytes."""

    @F.pandas_udf("binary")
    def of(images: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_png(x).tobytes() for x in images], dtype=object)

    return of(media)
