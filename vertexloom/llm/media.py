"""Media columns: bytes held as Netpbm or BMP images, decoded to numpy arrays, area-resized and hashed.

An image is resized by its integral image: a cell's mean is four look-ups in the table of running sums, interpolated where a
cell's edge falls inside a pixel. The table is built strip by strip, so that memory doesn't grow with the image's height.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import map_texts

WIDTH = 64
#: Rows of an image that the integral table holds at once.
STRIP = 8192
HASH_SHAPE = (8, 9)
TILE_SHAPE = (16, 16)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as binary PGM."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as BMP with 8 bits a pixel and a grey palette, rows from the bottom."""
    height, width = pixels.shape
    stride = -(-width // 4) * 4
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = pixels[::-1]
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); bitmaps become 0 and 255, black being 0."""
    if not re.match(rb"P[1-6]\s", data):
        raise ValueError("not Netpbm")
    kind, numbers, at = data[1] - 48, [], 2
    token = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")
    while len(numbers) < (2 if kind in (1, 4) else 3):
        found = token.match(data, at)
        if not found:
            raise ValueError("broken Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    (width, height), most = numbers[:2], numbers[2] if len(numbers) > 2 else 1
    depth = 3 if kind in (3, 6) else 1
    count = width * height * depth
    if kind == 1:
        values = np.array([c - 48 for c in re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:count]], np.uint8)
    elif kind < 4:
        values = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:count], dtype=np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        values = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if values.size < count:
        raise ValueError("Netpbm data ends early")
    if kind in (1, 4):
        values = np.where(values == 1, 0, 255).astype(np.uint8)
    elif values.dtype != np.uint8:
        values = values.astype(np.uint8 if most < 256 else np.uint16)
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel; two-dimensional if its palette is grey, else red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {bits} bits, compression {packing}")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    body = body[::-1] if height > 0 else body
    if bits >= 24:
        return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = body[:, :width]
    else:
        unpacked = np.unpackbits(body, axis=1).reshape(rows, -1, bits)
        index = (unpacked @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :width]
    (used,) = struct.unpack_from("<I", data, 14 + 32)
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][index] if grey else palette[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Means over the cells of an even grid of ``shape``, as float64; pixels on an edge count by the part inside."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    (height, width), (rows, cols) = grey.shape, shape
    xs, ys = np.arange(cols + 1) * (width / cols), np.arange(rows + 1) * (height / rows)
    left = np.minimum(xs.astype(int), width - 1)
    corners, carry = np.zeros((rows + 1, cols + 1)), np.zeros(width + 1)
    for top in range(0, height, STRIP):
        strip = grey[top : top + STRIP]
        table = np.zeros((len(strip) + 1, width + 1))
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
        table += carry
        carry = table[-1].copy()
        here = (ys >= top) & ((ys < top + len(strip)) | ((top + len(strip) == height) & (ys <= height)))
        if here.any():
            y = ys[here] - top
            upper = np.minimum(y.astype(int), len(strip) - 1)
            part = (y - upper)[:, None]
            lines = table[upper] * (1 - part) + table[upper + 1] * part
            corners[here] = lines[:, left] * (1 - (xs - left)) + lines[:, left + 1] * (xs - left)
    return np.diff(np.diff(corners, axis=0), axis=1) / ((height / rows) * (width / cols))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each cell of 8 by 9 is darker than the one to its right."""
    cells = np.round(area_resize(pixels, HASH_SHAPE), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    """The array as an NPY file."""
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


def tile(pixels: np.ndarray) -> bytes:
    return npy(np.clip(np.rint(area_resize(pixels, TILE_SHAPE)), 0, 255).astype(np.uint8))


def to_payload(text: str | None) -> tuple[int, bytes]:
    """The text's length in UTF-8, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


FORMATS = {"pgm": encode_pgm, "bmp": encode_bmp}


def media_columns(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", with_media: bool = True) -> DataFrame:
    """Each text as an image 64 pixels wide, one byte a pixel, stored in ``form``, and what is computed from the stored bytes read back.

    Gives ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, dhash, height, tile_sha256`` and, with
    ``with_media``, the stored ``media`` and the resized ``tile_npy``. A null text counts as empty: 64 zeros. Equal texts give equal
    values; repeated rows stay repeated; an empty table gives no rows; other columns of ``df`` are left out.
    """
    encode = FORMATS[form]

    def made(rows: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "height", "tile_sha256", "media", "tile_npy")}
        for text in rows.column("text").to_pylist():
            n, payload = to_payload(text)
            media = encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
            pixels = decode(media)
            back, small = pixels.tobytes(), tile(pixels)
            for k, v in (("n_bytes", n), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-64:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("dhash", difference_hash(pixels)), ("height", len(pixels)), ("tile_sha256", hashlib.sha256(small).hexdigest()), ("media", media if with_media else None), ("tile_npy", small if with_media else None)):
                out[k].append(v)
        return out | {"doc_id": rows.column("doc_id")}

    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, dhash string, height bigint, tile_sha256 string" + ", media binary, tile_npy binary" * with_media
    return map_texts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), made, schema, "text")
