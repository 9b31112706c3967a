"""Type and size of uploaded images from their headers, without decoding a pixel."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx

#: Most pixels of an image that is looked at.
PIXELS = 20_000_000
# JPEG markers that hold a frame's size, and those that stand without a length.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_ALONE = frozenset({0x01, *range(0xD0, 0xD9)})


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in _ALONE:
            at += 2
        elif kind in _FRAMES:
            if at + 9 > len(b):
                return None
            height, width = struct.unpack_from(">HH", b, at + 5)
            return width, height
        elif kind in (0xD9, 0xDA):
            # The image ends, or its data begin, before any frame.
            return None
        else:
            at += 2 + max(2, struct.unpack_from(">H", b, at + 2)[0])
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack_from("<HH", b, 26)
        return width & 0x3FFF, height & 0x3FFF
    return None


def header(b: bytes | None) -> tuple[str, int, int] | None:
    """(MIME type, width, height) by content; none for what has no whole header of a known type."""
    if not b:
        return None
    kind, size = None, None
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        kind = "image/png"
        size = struct.unpack_from(">II", b, 16) if len(b) >= 24 and b[12:16] == b"IHDR" else None
    elif b[:6] in (b"GIF87a", b"GIF89a"):
        kind = "image/gif"
        size = struct.unpack_from("<HH", b, 6) if len(b) >= 10 else None
    elif b[:2] == b"\xff\xd8":
        kind, size = "image/jpeg", _jpeg(b)
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind, size = "image/webp", _webp(b)
    return (kind, *size) if size else None


def info(content: Column) -> Column:
    """struct<kind, width, height> of header(); null fields where there is none."""

    @F.pandas_udf("struct<kind:string,width:int,height:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        # A width beyond 31 bits is no image's.
        found = [h if h and max(h[1:]) < 1 << 31 else (None, None, None) for h in (header(bytes(x) if x is not None else None) for x in s)]
        return pd.DataFrame({"kind": [h[0] for h in found], "width": pd.array([h[1] for h in found], dtype="Int32"), "height": pd.array([h[2] for h in found], dtype="Int32")})

    return run(content)


def upload_gate(mime: Column, content: Column) -> Column:
    """struct<status, reason, kind, width, height> of an upload: 200 or why it is refused.

    The declared type is tested first (415), then emptiness (400) and size (413); only what
    passes is looked into: content that is no image of the four types, has no pixels, or more
    than PIXELS of them is a bad request (400).  A declared type that the content contradicts is no reason to refuse.
    """
    size = F.octet_length(content)
    first = F.when(F.lower(mime).isin(*lx.IMAGE_TYPES), F.lit(200)).otherwise(F.lit(415))
    first = F.when(first == 415, first).when(content.isNull() | (size == 0), 400).when(size > lx.IMAGE_BYTES, 413).otherwise(200)
    seen = info(F.when(first == 200, content))
    pixels = seen["width"].cast("long") * seen["height"].cast("long")
    reason = (
        F.when(first == 415, "unsupported type")
        .when(first == 400, "empty image")
        .when(first == 413, "image too large")
        .when(seen["kind"].isNull(), "not an image")
        .when(pixels == 0, "image without pixels")
        .when(pixels > PIXELS, "too many pixels")
    )
    status = F.when(first != 200, first).when(reason.isNotNull(), 400).otherwise(200)
    return F.struct(status.alias("status"), reason.alias("reason"), seen["kind"].alias("kind"), seen["width"].alias("width"), seen["height"].alias("height"))
