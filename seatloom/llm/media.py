"""Operator 4, media columns: Netpbm and BMP images as binary columns.

Images are decoded to numpy arrays, resized by area with integral images, written as NPY tiles,
and given a difference hash. Corrupt, truncated or null images give null features instead of an error.
Brightness and integral images are computed a band of rows at a time, so an image needs little more
memory than its samples.
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

from .common import column, map_arrow

ROW_BYTES = 192
#: Luma weights in thousandths for red, green and blue.
LUMA = np.array([299, 587, 114], np.int64)
#: Pixels of a band of rows, about.
BAND_PIXELS = 1 << 18

_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+")
_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """An 8-bit array of (height, width) or (height, width, 3) as binary PGM (P5) or PPM (P6)."""
    height, width = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit array of (height, width, 3) in RGB as a 24-bit bottom-up BMP."""
    height, width = pixels.shape[:2]
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = int(_HEADER.match(data)[1])
    at, sizes = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        number = _NUMBER.match(data, at)
        sizes.append(int(number[1]))
        at = number.end()
    width, height, most = (*sizes, 1)[:3]
    if not 1 <= most <= 65535:
        raise ValueError("maximum sample value out of range")
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if count > 8 * len(data):
        raise ValueError("too few samples")
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:count], np.uint8) - 48
    elif kind in (2, 3):
        words = re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count]
        if any(len(x) > 9 for x in words):
            raise ValueError("sample out of range")
        flat = np.array(words, np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        flat = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
    if flat.size != count:
        raise ValueError("too few samples")
    if count and (int(flat.max()) > most or int(flat.min()) < 0):
        raise ValueError("sample out of range")
    if kind in (1, 4):
        flat = (1 - flat) * np.uint8(255)  # in bitmaps 1 is black
    elif most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    return flat.astype(np.uint8, copy=False).reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), -(-width * depth // 32) * 4
    if rows * stride > len(data):
        raise ValueError("too few samples")
    flat = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    flat = flat if height < 0 else flat[::-1]
    if depth == 8:
        table = np.frombuffer(data, np.uint8, max(0, start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return table[flat[:, :width]][:, :, 2::-1]
    return flat[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 or an uncompressed 8, 24 or 32-bit BMP as uint8 (height, width[, 3]), RGB.

    ValueError if it isn't one: for an unknown or broken header, sizes that the data don't fill,
    whatever they are, and samples above the header's maximum.
    """
    try:
        pixels = _decode_bmp(data) if data[:2] == b"BM" else _decode_netpbm(data)
    except (struct.error, TypeError, IndexError, OverflowError) as e:
        raise ValueError("not a whole Netpbm or BMP image") from e
    if not pixels.size:
        raise ValueError("an image without pixels")
    return pixels


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.int64) if pixels.ndim == 2 else pixels @ LUMA // 1000


def _cuts(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where size units are cut in parts equal ones: the unit that each edge falls in, and how far in it."""
    edges = np.arange(parts + 1) * size
    low = np.minimum(edges // parts, size - 1)
    return low, (edges - low * parts) / parts


def area_resize(pixels: np.ndarray, height: int, width: int, band: int = BAND_PIXELS) -> np.ndarray:
    """Mean brightness over each target cell's area.

    The integral image is read between its grid points, so cells may cut pixels. It is built a band of
    rows at a time, and only its rows next to a cell's edge are held.
    """
    rows, columns = pixels.shape[:2]
    low, part = _cuts(rows, height)
    left, right = np.zeros((height + 1, columns + 1), np.int64), np.zeros((height + 1, columns + 1), np.int64)
    above, step = np.zeros(columns + 1, np.int64), max(1, band // columns)
    for at in range(0, rows, step):
        total = np.zeros((min(step, rows - at) + 1, columns + 1), np.int64)
        total[0] = above
        total[1:, 1:] = np.cumsum(grey(pixels[at : at + step]), axis=1)
        np.cumsum(total, axis=0, out=total)
        inside = np.nonzero((low >= at) & (low < at + step))[0]
        left[inside], right[inside] = total[low[inside] - at], total[low[inside] - at + 1]
        above = total[-1].copy()
    table = left * (1 - part)[:, None] + right * part[:, None]
    low, part = _cuts(columns, width)
    table = table[:, low] * (1 - part) + table[:, low + 1] * part
    return np.diff(np.diff(table, axis=0), axis=1) * (height * width / (rows * columns))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: in an 8 by 9 reduction, is each cell darker than its right neighbour?"""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def text_images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str | None = None) -> DataFrame:
    """Store texts as images: (doc_id, n_bytes, media).

    The payload is the text in UTF-8 (null: empty), followed by spaces up to a positive multiple of
    192 bytes, taken as rows of 64 RGB pixels. form: ppm or bmp; None makes an odd number of rows a
    ppm and an even one a bmp, so that equal texts are stored alike.
    """
    encoders = {"ppm": encode_netpbm, "bmp": encode_bmp}

    def make():
        def run(part: pa.RecordBatch) -> dict:
            sizes, media = [], []
            for text in part.column(1).to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                data += b" " * ((-len(data)) % ROW_BYTES if data else ROW_BYTES)
                rows = len(data) // ROW_BYTES
                encode = encoders[form or ("ppm" if rows % 2 else "bmp")]
                media.append(encode(np.frombuffer(data, np.uint8).reshape(rows, ROW_BYTES // 3, 3)))
            return {"doc_id": part.column(0), "n_bytes": sizes, "media": media}

        return run

    return map_arrow(df.select(column(df, id_col, "doc_id", "long"), column(df, text_col, "text", "string")), make, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", tile: tuple[int, int] = (16, 16), digests: bool = False, size_col: str | None = None) -> DataFrame:
    """Read images back: (doc_id, height, width, channels, tile_npy, dhash[, payload and media digests][, n_bytes]).

    tile_npy is a greyscale uint8 NPY array of the given height and width. With digests, the columns
    payload_bytes, payload_sha256, tail_crc32, media_bytes and media_sha256 follow, the payload being
    the decoded samples. A null or undecodable image gives nulls. size_col, the stored text's own
    length, is passed through as n_bytes. One row per input row.
    """
    schema = "doc_id long, height int, width int, channels int, tile_npy binary, dhash string" + digests * ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    inputs = [column(df, id_col, "doc_id", "long"), column(df, media_col, "media", "binary")]
    if size_col:
        inputs.append(column(df, size_col, "n_bytes", "long"))

    def features(data: bytes | None) -> tuple:
        try:
            pixels = decode_image(data or b"")
        except ValueError:
            return (None,) * (10 if digests else 5)
        small = np.clip(np.round(area_resize(pixels, *tile)), 0, 255).astype(np.uint8)
        row = (*pixels.shape[:2], pixels.shape[2] if pixels.ndim == 3 else 1, npy_bytes(small), difference_hash(pixels))
        if digests:
            payload = np.ascontiguousarray(pixels).reshape(-1)
            row += (payload.size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest())
        return row

    def make():
        names = [x.split()[0] for x in schema.split(", ")][1:]

        def run(part: pa.RecordBatch) -> dict:
            rows = [features(x.as_py()) for x in part.column(1)]
            return {"doc_id": part.column(0), **({"n_bytes": part.column(2)} if size_col else {})} | dict(zip(names, map(list, zip(*rows)), strict=True))

        return run

    return map_arrow(df.select(inputs), make, schema + (", n_bytes long" if size_col else ""))
