"""Media columns: Netpbm and BMP images decoded to arrays, area-resized by integral images, written as NPY tiles.

:func:`decode` reads P1 to P6 and uncompressed BMP of 1, 4, 8, 24 and 32 bits; :func:`area_resize` integrates the
image once and reads every target cell, whole or fractional, from four interpolated corners; :func:`dhash` compares
neighbours of a 9 by 8 grey tile. :func:`media_columns` adds these to a table with a column of image bytes.

``op4_media`` stores each text as an 8-bit PGM image 64 samples wide, reads the stored bytes back through the same
decoder and hashes what it read. Defined results: a null or empty text is one row of 64 zero samples; equal texts give
equal values; bytes that are no image give nulls and a reason in ``error``; further columns are ignored by the query and
kept by :func:`media_columns`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, documents, utf8

WIDTH = 64
TILE = (32, 32)
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """Binary 8-bit PGM of ``payload``, whose length is a multiple of ``width``."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(image: np.ndarray) -> bytes:
    """BMP of a (height, width) grey image, 8 bits with a grey palette, or of a (height, width, 3) RGB image, 24 bits."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    rows = image[::-1] if grey else image[::-1, :, ::-1].reshape(height, width * 3)
    stride = (rows.shape[1] + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : rows.shape[1]] = rows
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + body.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at = data[1:2], 2
    fields = []
    for _ in range(2 if kind in b"14" else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("header ends early")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = (*fields, 1)[:3]
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise ValueError("bad dimensions")
    channels = 3 if kind in b"36" else 1
    n = width * height * channels
    if kind in b"123":
        rest = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]", rest) if kind == b"1" else rest.split()
        values = np.array(found[:n], dtype="S5").astype(np.int64)
    elif kind == b"4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        values = bits[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(values) < n:
        raise ValueError("pixels end early")
    if kind in b"14":  # 1 is black
        values = 1 - values
    out = values.astype(np.uint8 if most < 256 else np.uint16)
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    flip, height = height > 0, abs(height)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width < 1 or height < 1:
        raise ValueError(f"BMP of {depth} bits, packing {packing} is not supported")
    stride = (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if flip:
        raw = raw[::-1]
    if depth >= 24:
        pixels = raw[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1]
        return np.ascontiguousarray(pixels[:, :, :3])
    index = raw if depth == 8 else np.unpackbits(raw, axis=1) if depth == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(height, -1)
    palette = np.zeros((256, 4), np.uint8)
    given = np.frombuffer(data, np.uint8, 4 * (colours or 1 << depth), 14 + size).reshape(-1, 4)[:256]
    palette[: len(given)] = given
    pixels = palette[index[:, :width]][:, :, 2::-1]
    return pixels[:, :, 0].copy() if (pixels == pixels[:, :, :1]).all() else np.ascontiguousarray(pixels)


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm or BMP image: (height, width) if grey, (height, width, 3) if RGB."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, in float64, from one integral image with interpolated fractional edges."""
    h, w = image.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=integral[1:, 1:])

    def at(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        edges = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edges.astype(np.int64), n - 1)
        share = (edges - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    corners = at(at(integral, h, height).T, w, width).T
    return np.diff(np.diff(corners, axis=0), axis=1) / ((h / height) * (w / width))


def dhash(image: np.ndarray) -> str:
    """64-bit difference hash in hex: whether each cell of a 9 by 8 tile is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, tile: tuple[int, int] = TILE) -> bytes:
    """The area-resized grey tile as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.round(np.clip(area_resize(grey(image), *tile), 0, 65535)).astype(image.dtype))
    return out.getvalue()


def media_columns(df: DataFrame, column: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """``df`` with height, width, channels, tile (NPY bytes), dhash and error of the image bytes in ``column``."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column("_fw_media").to_pylist():
                try:
                    image = decode(data)
                    rows.append((image.shape[0], image.shape[1], 3 if image.ndim == 3 else 1, npy_tile(image, tile), dhash(image), None))
                except (ValueError, struct.error, TypeError) as e:
                    rows.append((None, None, None, None, None, str(e) if data is not None else "null"))
            added = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("_fw_row"), *added], names=["_fw_row", "height", "width", "channels", "tile", "dhash", "error"])

    packed = df.select(F.struct("*").alias("_fw_row"), F.col(column).cast("binary").alias("_fw_media"))
    kind = packed.schema["_fw_row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"_fw_row {kind}, height int, width int, channels int, tile binary, dhash string, error string")
    new = ("height", "width", "channels", "tile", "dhash", "error")
    return out.select(*[f"_fw_row.{c}" for c in df.columns if c not in new], *new)


_COLUMNS = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile_sha256": pa.string(),
}


def stored_text(text: bytes) -> dict:
    """The digest columns of one text: stored as an image, decoded again, hashed."""
    media = encode_pgm(text + bytes(-len(text) % WIDTH if text else WIDTH))
    image = decode(media)
    payload = image.tobytes()
    return {
        "n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": dhash(image), "tile_sha256": hashlib.sha256(npy_tile(image)).hexdigest(),
    }


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)

    def run(batches):
        for b in batches:
            rows = [stored_text(x) for x in b.column(1).to_pylist()]
            yield arrow_rows(_COLUMNS, {"doc_id": b.column(0)} | {k: [r[k] for r in rows] for k in _COLUMNS if k != "doc_id"})

    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), utf8("text").alias("data"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
