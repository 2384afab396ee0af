"""Image columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

``decode_image`` reads P1 to P6 (with comments, 8 and 16 bits) and uncompressed BMP of 1, 4, 8, 24 and
32 bits, bottom-up or top-down. ``encode_pnm`` and ``encode_bmp`` write 8-bit samples losslessly.
``area_resize`` gives each target pixel the mean of the source area it covers, fractions of pixels
included, from one integral image, a strip of rows at a time. ``difference_hash`` compares neighbours
in a row of the (9 x 8) reduction.

Bytes that aren't an image of these formats give null columns and an ``error``; null stays null.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, table

#: Payloads are padded to a multiple of this; it is also the width of the stored image. Side of the NPY tile.
UNIT, TILE = 576, 16
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n\r]*[\n\r])+(\d+)(?:\s|#[^\n\r]*[\n\r])+(\d+)(?:(?:\s|#[^\n\r]*[\n\r])+(\d+))?")


def encode_pnm(pixels: np.ndarray) -> bytes:
    """P5 for (h, w), P6 for (h, w, 3) arrays of bytes."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour BMP, bottom-up."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = pixels[::-1] if grey else pixels[::-1, :, ::-1]
    width = w * (1 if grey else 3)
    body = np.zeros((h, -(-width // 4) * 4), np.uint8)
    body[:, :width] = rows.reshape(h, width)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.empty((0, 4), np.uint8)
    palette[:, 3] = 0
    at = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette.tobytes() + body.tobytes()


def _decode_pnm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise ValueError("no Netpbm header")
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    if -(-w * h // 8) > len(data):  # a sample takes a bit at least: nothing is allocated for sizes that the bytes can't hold
        raise ValueError("too few samples")
    if kind in (1, 4):
        m = re.match(rb"P[14](?:\s|#[^\n\r]*[\n\r])+\d+(?:\s|#[^\n\r]*[\n\r])+\d+", data)
        if kind == 4:
            row = -(-w // 8)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, m.end() + 1).reshape(h, row), axis=1)[:, :w]
        else:
            bits = np.array([c - 48 for c in re.sub(rb"#[^\n\r]*", b"", data[m.end() :]) if c in b"01"][: w * h], np.uint8).reshape(h, w)
        return ((1 - bits) * 255).astype(np.uint8)
    if m[4] is None:
        raise ValueError("no maximum value")
    top, deep = int(m[4]), 3 if kind in (3, 6) else 1
    if not 0 < top < 65536:
        raise ValueError("bad maximum value")
    n = w * h * deep
    if kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[m.end() :]).split()[:n], dtype=np.int64)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, m.end() + 1)
    if len(flat) < n:
        raise ValueError("too few samples")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8, copy=False).reshape((h, w) if deep == 1 else (h, w, 3))


def _decode_bmp(data: bytes) -> np.ndarray:
    at, size, w, h = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if size < 40 or w <= 0 or h == 0 or bits not in (1, 4, 8, 24, 32) or packing not in (0, 3):
        raise ValueError("unsupported BMP")
    flip, h = h > 0, abs(h)
    row = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
    rows = rows[::-1] if flip else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], axis=2).reshape(h, -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode_image(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) array of bytes."""
    return _decode_bmp(data) if data[:2] == b"BM" else _decode_pnm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel (float64), by integral images of row strips."""
    if pixels.ndim == 3:
        return np.stack([area_resize(pixels[:, :, c], height, width) for c in range(pixels.shape[2])], axis=2)
    h, w = pixels.shape
    down, across = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    col, part = np.minimum(across.astype(np.int64), w - 1), None
    part = across - col
    integral = np.zeros((height + 1, width + 1))  # of the area above and left of each target corner
    total = np.zeros(width + 1)
    done = 0
    for k in range(1, height + 1):
        last = min(int(down[k]), h)
        while done < last:
            strip = pixels[done : min(last, done + 4096)]
            sums = strip.sum(axis=0, dtype=np.int64)
            above = np.concatenate([[0], np.cumsum(sums)])
            total = total + above[col] + part * sums[col]
            done += len(strip)
        cut = down[k] - last
        extra = 0.0
        if cut > 1e-12 and last < h:
            row = pixels[last].astype(np.int64)
            extra = cut * (np.concatenate([[0], np.cumsum(row)])[col] + part * row[col])
        integral[k] = total + extra
    area = (h / height) * (w / width)
    return (integral[1:, 1:] - integral[:-1, 1:] - integral[1:, :-1] + integral[:-1, :-1]) / area


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: is each of 8 x 8 cells darker than its right neighbour in a 9 x 8 reduction?"""
    small = np.round(grey(area_resize(pixels, 8, 9)), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The image reduced to side x side bytes, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_columns(images: DataFrame, data: str = "data", side: int = TILE) -> DataFrame:
    """Add height, width, channels, tile (an NPY file of side x side), dhash and error to rows with image bytes."""

    def make():
        def one(x):
            if x is None:
                return (None,) * 6
            try:
                p = decode_image(bytes(x))
                if not p.size:
                    raise ValueError("empty image")
                return p.shape[0], p.shape[1], 1 if p.ndim == 2 else p.shape[2], npy_tile(p, side), difference_hash(p), None
            except (ValueError, IndexError, OverflowError, struct.error) as e:
                return None, None, None, None, None, str(e)[:200]

        return lambda xs: tuple(map(list, zip(*map(one, xs), strict=True)))

    return add_columns(images, [data], {"height": "int", "width": "int", "channels": "int", "tile": "binary", "dhash": "string", "error": "string"}, make)


def pack_text(text: str | None) -> tuple[bytes, int]:
    """(payload of whole rows, bytes without padding)."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT), len(raw)


def text_to_media(docs: DataFrame, text: str = "text", media: str = "media", tall: int | None = None) -> DataFrame:
    """Add the whole text as an image of width UNIT (n_bytes: bytes without padding): P5, or, from ``tall`` rows on, BMP, whose longer header then weighs little."""

    def make():
        def one(t):
            payload, n = pack_text(t)
            pixels = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
            return (encode_pnm if tall is None or len(pixels) < tall else encode_bmp)(pixels), n

        return lambda xs: tuple(map(list, zip(*map(one, xs), strict=True)))

    return add_columns(docs, [text], {media: "binary", "n_bytes": "bigint"}, make, drop=(text,))


def media_digests(stored: DataFrame, media: str = "media") -> DataFrame:
    """Read the stored bytes back and add digests of the payload and of the file, the NPY tile, and the feature (difference hash and the tile's CRC)."""

    def make():
        def one(x):
            data = bytes(x)
            p = decode_image(data)
            payload = np.ascontiguousarray(p).tobytes()
            tile = npy_tile(p)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(p)}:{zlib.crc32(tile):08x}", tile

        return lambda xs: tuple(map(list, zip(*map(one, xs), strict=True)))

    fields = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "tile": "binary"}
    return add_columns(stored, [media], fields, make, drop=(media,))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image (P5 whatever its size), read back, with digests and features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = media_digests(text_to_media(docs))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
