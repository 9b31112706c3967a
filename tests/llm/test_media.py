from __future__ import annotations

import hashlib
import io
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import media as m
from quillspark.llm import registry
from quillspark.llm.common import scratch
from tests.llm.conftest import edge_rows


def test_query_against_brute_force(spark, data, rows):
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_media"](spark, data).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        raw = text.encode()
        body = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
        lines = [body[k : k + 72] for k in range(0, len(body), 72)]
        if len(body) // 576 % 2:
            media = b"P6\n24 %d\n255\n" % len(lines) + body
        else:
            turned = b"".join(line[k : k + 3][::-1] for line in reversed(lines) for k in range(0, 72, 3))
            media = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 24, len(lines), 1, 24, 0, len(body), 2835, 2835, 0, 0) + turned
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == brute_feature(lines)


def brute_feature(lines):
    """Means of exact areas, cell by cell and pixel by pixel."""
    gray = [[sum(line[k : k + 3]) for k in range(0, 72, 3)] for line in lines]
    h, out = len(lines), np.zeros((8, 9), np.uint8)
    overlap = lambda a, n, cell, k: max(0, min((a + 1) * k, (cell + 1) * n) - max(a * k, cell * n))  # noqa: E731  in k-ths of a pixel
    columns = [[(x, v) for x in range(24) if (v := overlap(x, 24, c, 9))] for c in range(9)]
    for i in range(8):
        own = [(y, u) for y in range(h * i // 8, min(h, h * (i + 1) // 8 + 1)) if (u := overlap(y, h, i, 8))]
        for j in range(9):
            total = sum(u * v * gray[y][x] for y, u in own for x, v in columns[j])
            out[i, j] = round(Fraction(total, 3 * h * 24))
    bits = "".join("1" if out[i, j] > out[i, j + 1] else "0" for i in range(8) for j in range(8))
    npy = b"\x93NUMPY\x01\x00" + struct.pack("<H", 118) + b"{'descr': '|u1', 'fortran_order': False, 'shape': (8, 9), }".ljust(117) + b"\n" + out.tobytes()
    return f"{int(bits, 2):016x}:{hashlib.sha256(npy).hexdigest()[:16]}"


def test_media_and_tiles_are_stored(spark, edge):
    media = m.store(edge)
    got = {r["doc_id"]: r for r in media.collect()}
    assert media.inputFiles() and media.columns == ["doc_id", "n_bytes", "media"]
    assert m.decode(got[10]["media"]).tobytes().rstrip(b"\xff").decode() == next(t for i, t, _ in edge_rows() if i == 10)
    tiles = m.write_tiles(m.decode_column(media, "doc_id", "media"), scratch(spark, "tiles"))
    for r in tiles.collect():
        tile = np.load(io.BytesIO(r["tile"]))
        assert tile.shape == m.TILE and m.difference_hash(tile) == r["dhash"]
    bad = m.decode_column(spark.createDataFrame([(1, b"P6")], "doc_id long, media binary"), "doc_id", "media")
    assert m.write_tiles(bad, scratch(spark, "tiles")).count() == 0


def test_edges(edge, nothing):
    got = m.text_media(edge).collect()
    assert len(got) == edge.count() and m.text_media(nothing).count() == 0
    blank = [r for r in got if r["doc_id"] in (1, 2)]
    assert all((r["n_bytes"], r["payload_bytes"]) == (0, 576) for r in blank)
    assert len({r["feature"] for r in got if r["doc_id"] in (4, 6, None)}) == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([1, 3]), st.integers(0, 2**32))
def test_round_trips(h, w, c, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)
    assert (m.decode(m.encode_netpbm(image)) == image).all()
    if c == 3:
        assert (m.decode(m.encode_bmp(image)) == image).all()


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"P1\n# c\n2 2\n1 0\n0 1\n", [[0, 255], [255, 0]]),
        (b"P1 2 2 1001", [[0, 255], [255, 0]]),
        (b"P2\n2 1\n15\n0 15\n", [[0, 255]]),
        (b"P3\n1 1\n255\n1 2 3\n", [[[1, 2, 3]]]),
        (b"P4\n3 1\n\xa0", [[0, 255, 0]]),
        (b"P5\n2 1\n65535\n\x00\x00\xff\xff", [[0, 255]]),
    ],
)
def test_netpbm_kinds(data, want):
    assert np.squeeze(m.decode(data), axis=2 if np.ndim(want) == 2 else ()).tolist() == want


@pytest.mark.parametrize("data", [b"P2\n1 1\n255\n" + b"9" * 25, b"P3\n1 1\n255\n1 2 300\n", b"P2 1 1 15 16", b"P5\n1 1\n15\n\x10", b"P2 1 1 255 x", b"P2 1 1 255 -1", b"P1 1 1 7", b"BM" + b"\0" * 60, b"P5\n99999999999999999999 1\n255\n"])
def test_bad_images_are_rows_with_an_error(spark, data):
    (r,) = m.decode_column(spark.createDataFrame([(1, data)], "k long, media binary"), "k", "media").collect()
    assert r["error"] and r["tile"] is None and r["width"] is None


def test_leading_zeros_are_no_error():
    assert m.decode(b"P2 1 1 255 " + b"0" * 30 + b"7").tolist() == [[[7]]]


def bmp(header, body, start):
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, start) + header + body


def test_bit_fields_and_short_headers():
    info = lambda bits, packed: struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, bits, packed, 0, 0, 0, 0, 0)
    swapped = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + struct.pack("<II", 0x030201, 0x060504)
    assert m.decode(bmp(info(32, 3), swapped, 66)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    rgb565 = struct.pack("<III", 0xF800, 0x7E0, 0x1F) + struct.pack("<HH", 0xF800, 0x7E0)
    assert m.decode(bmp(info(16, 3), rgb565, 66)).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    assert m.decode(bmp(info(16, 0), struct.pack("<HH", 0x7C00, 0x1F), 54)).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    core = struct.pack("<IHHHH", 12, 2, 1, 1, 24)
    assert m.decode(bmp(core, bytes([3, 2, 1, 6, 5, 4, 0, 0]), 26)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    palette = struct.pack("<IHHHH", 12, 2, 1, 1, 1) + bytes([0, 0, 9, 0, 8, 0])
    assert m.decode(bmp(palette, b"\x40\0\0\0", 32)).tolist() == [[[9, 0, 0], [0, 8, 0]]]


def test_palette_bmp():
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 1, 0, 0, 0, 0, 2, 0)
    data = head + bytes([0, 0, 255, 0, 255, 0, 0, 0]) + b"\x40\0\0\0"
    assert m.decode(data).tolist() == [[[255, 0, 0], [0, 0, 255]]]


def test_area_resize_is_exact():
    image = np.random.default_rng(0).integers(0, 256, (12, 10, 3), dtype=np.uint8)
    gray = image.mean(axis=2)
    fine = np.kron(gray, np.ones((4, 3)))
    want = fine.reshape(8, 6, 6, 5).mean(axis=(1, 3))
    assert np.allclose(m.area_resize(image, 8, 6), want)
    assert np.allclose(m.area_resize(image[:1, :1], 8, 9), gray[0, 0])


def test_decode_column(spark):
    good = m.encode_netpbm(np.zeros((2, 2, 1), np.uint8))
    d = spark.createDataFrame([(1, good), (2, b"junk"), (3, None), (4, good[:-1])], "k long, media binary")
    got = {r["k"]: r for r in m.decode_column(d, "k", "media").collect()}
    assert got[1]["error"] is None and got[1]["width"] == 2 and np.load(__import__("io").BytesIO(got[1]["tile"])).shape == m.TILE
    assert [got[i]["error"] for i in (2, 3, 4)] == ["unknown form", "empty", "short"]
