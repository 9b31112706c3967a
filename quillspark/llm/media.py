"""Operator 1, media columns.

Netpbm (P1 to P6) and BMP images are decoded to numpy arrays, resized to a tile by area
through integral images, and the tile is written in NPY form with a difference hash.

Tables of media are written in one pass and read back in the next: store() writes the media
column, write_tiles() the NPY tiles and hashes of what was read back.  The registered query
stores a text's payload as a PPM if it has an odd number of blocks, else as a BMP.

Defined cases: null or empty media give a row with error 'empty'; bytes that can't be
decoded give error and null results; a null text counts as empty and still gives one
block of padding; a very long text is one tall image, never cut; equal inputs give equal
outputs, repeated rows a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.common import arrow_map, documents, id_text, scratch, staged

#: Unit of the payload: eight rows of 24 RGB pixels.
BLOCK = 576
WIDTH = 24
#: Rows and columns of a tile; the hash compares neighbours, so one column more than bits a row.
TILE = (8, 9)

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


class MediaError(ValueError):
    """Bytes that are no image of a known form."""


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    at, out = 2, []
    for _ in range(n):
        m = _TOKEN.match(data, at)
        if not m:
            raise MediaError("bad header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """uint8 array (height, width, channels), scaled to 255 where maxval differs."""
    kind = data[1] - 48
    bitmap = kind in (1, 4)
    head, at = _header(data, 2 if bitmap else 3)
    w, h, top = head[0], head[1], 1 if bitmap else head[2]
    channels = 3 if kind in (3, 6) else 1
    if not w or not h or not 0 < top < 65536:
        raise MediaError("bad size")
    n = w * h * channels
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b" ", data[at:])
        if bitmap:
            values = np.frombuffer(re.sub(rb"\s+", b"", body), dtype=np.uint8)[:n].astype(np.int64) - 48
        else:
            found = body.split()[:n]
            if any(len(x) > 9 and len(x.lstrip(b"0")) > 5 for x in found):
                raise MediaError("sample")
            values = np.array(found, dtype=np.int64)
    elif bitmap:
        row = -(-w // 8)
        raw = np.frombuffer(data, dtype=np.uint8, offset=at + 1)
        if len(raw) < row * h:
            raise MediaError("short")
        values = np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w].reshape(-1).astype(np.int64)
    else:
        raw = data[at + 1 : at + 1 + n * (2 if top > 255 else 1)]
        values = np.frombuffer(raw, dtype=">u2" if top > 255 else np.uint8)
    if len(values) < n:
        raise MediaError("short")
    if (values > top).any() or (kind <= 3 and (values < 0).any()):
        raise MediaError("sample")
    if bitmap:
        values = 1 - values
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    return np.ascontiguousarray(values[:n].astype(np.uint8).reshape(h, w, channels))


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary PGM or PPM of a uint8 array (height, width, 1 or 3)."""
    h, w, c = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + image.tobytes()


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The field of each pixel under mask, scaled to 255; zero where the mask is empty."""
    if not mask:
        return np.zeros(pixels.shape, dtype=np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((((pixels.astype(np.int64) & mask) >> low) * 255 + top // 2) // top).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """uint8 RGB array of an uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits a pixel, bit fields and 12-byte headers included."""
    if len(data) < 26:
        raise MediaError("short")
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    packed = used = 0
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
    elif size >= 40 and len(data) >= 54:
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        used = struct.unpack_from("<I", data, 46)[0]
    else:
        raise MediaError("header")
    fields = packed == 3
    if packed not in (0, 3) or w <= 0 or not h or bits not in (1, 4, 8, 16, 24, 32) or (fields and bits not in (16, 32)):
        raise MediaError("unsupported")
    up, h = h > 0, abs(h)
    row = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, dtype=np.uint8, offset=min(start, len(data)))
    if len(raw) < row * h:
        raise MediaError("short")
    lines = raw[: row * h].reshape(h, row)
    if bits <= 8:
        each, entries = (3, 1 << bits) if size == 12 else (4, min(used or 1 << bits, 1 << bits))
        palette = np.frombuffer(data[14 + size : 14 + size + each * entries], dtype=np.uint8)
        palette = palette[: len(palette) // each * each].reshape(-1, each)[:, 2::-1]
        index = lines if bits == 8 else np.unpackbits(lines, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
        if (index[:, :w] >= len(palette)).any():
            raise MediaError("palette")
        out = palette[index[:, :w]]
    elif bits == 16 or fields:
        if fields and len(data) < 66:
            raise MediaError("short")
        masks = struct.unpack_from("<III", data, 54) if fields else (0x7C00, 0x3E0, 0x1F)
        pixels = lines[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4")
        out = np.stack([_masked(pixels, m) for m in masks], axis=2)
    else:
        out = lines[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if up else out)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, rows upwards, of a uint8 RGB array."""
    h, w, _ = image.shape
    row = (w * 3 + 3) // 4 * 4
    lines = np.zeros((h, row), dtype=np.uint8)
    lines[:, : w * 3] = image[::-1, :, ::-1].reshape(h, -1)
    body = lines.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and 49 <= data[1] <= 54:
        return decode_netpbm(data)
    raise MediaError("unknown form")


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """float64 (rows, cols): mean luminance of each cell's exact area, by differences of the integral image."""
    h, w, channels = image.shape
    # Whole numbers: three times the image's bytes, and exact however tall it is.
    table = np.zeros((h + 1, w + 1), dtype=np.int64)
    np.cumsum(image.sum(axis=2, dtype=np.uint16), axis=0, out=table[1:, 1:])
    np.cumsum(table, axis=1, out=table)

    def at(t: np.ndarray, n: int, cells: int) -> np.ndarray:
        """The table at the edges of the cells, times cells: whole numbers still."""
        x = np.arange(cells + 1) * n
        lo, part = x // cells, (x % cells)[:, None]
        return t[lo] * (cells - part) + t[np.minimum(lo + 1, n)] * part

    corner = at(at(table, h, rows).T, w, cols).T
    return np.diff(np.diff(corner, axis=0), axis=1) / (channels * h * w)


def tile_bytes(image: np.ndarray, shape: tuple[int, int] = TILE) -> bytes:
    """The resized tile as uint8 in NPY form (version 1.0)."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.rint(area_resize(image, *shape)).clip(0, 255).astype(np.uint8, order="C"), version=(1, 0))
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """A bit for each pair of neighbours in a row, set where the left one is brighter; hexadecimal."""
    return np.packbits(tile[:, :-1] > tile[:, 1:]).tobytes().hex()


def decode_column(df: DataFrame, key: str, media: str, shape: tuple[int, int] = TILE) -> DataFrame:
    """key, width, height, channels, tile (NPY bytes), dhash, error for each row of df."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("width", "height", "channels", "tile", "dhash", "error")}
        for data in batch.column(1).to_pylist():
            try:
                if not data:
                    raise MediaError("empty")
                image = decode(bytes(data))
                tile = tile_bytes(image, shape)
                row = (image.shape[1], image.shape[0], image.shape[2], tile, difference_hash(np.load(io.BytesIO(tile))), None)
            except (MediaError, ValueError, OverflowError, struct.error) as e:
                row = (None, None, None, None, None, str(e) or "bad")
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"key": batch.column(0)} | out

    picked = df.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media"))
    return arrow_map(picked, run, "key long, width int, height int, channels int, tile binary, dhash string, error string").withColumnRenamed("key", key)


def write_tiles(df: DataFrame, path: str) -> DataFrame:
    """df (with tile and dhash) as a Parquet table whose tiles any reader can load with numpy.load; rows without a tile are left out.  Read back."""
    df.where(F.col("tile").isNotNull()).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def payload(text: str) -> tuple[int, bytes]:
    """(length in bytes, UTF-8 padded with 255 to a positive multiple of BLOCK)."""
    return padded(text.encode())


def padded(raw: bytes) -> tuple[int, bytes]:
    n = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), raw + b"\xff" * (n - len(raw))


def encode_payload(body: bytes) -> bytes:
    """The payload as 24 RGB pixels a row, without loss: a PPM for an odd number of blocks, a BMP for an even one."""
    image = np.frombuffer(body, dtype=np.uint8).reshape(-1, WIDTH, 3)
    return encode_netpbm(image) if len(body) // BLOCK % 2 else encode_bmp(image)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each text, written to the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1), 8 * tk.SLICE_BYTES):
                found = [padded(s.raw(i)) for i in range(s.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array([n for n, _ in found], pa.int64()), pa.array([encode_payload(b) for _, b in found], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return staged(id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def text_media(docs: DataFrame) -> DataFrame:
    """The features of each text's stored media: all of them come from bytes read back from files."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, tile binary, dhash string"

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k.split()[0]: [] for k in kinds.split(", ")[2:]}
        for value in batch.column(2):
            media = value.as_buffer().to_pybytes()
            image = decode(media)
            back = image.tobytes()
            tile = tile_bytes(image)
            row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), image.shape[0], tile, difference_hash(np.load(io.BytesIO(tile))))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out

    tiles = write_tiles(arrow_map(store(docs), run, kinds), scratch(docs.sparkSession, "tiles"))
    feature = F.concat("dhash", F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16))
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "height")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
