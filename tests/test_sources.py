"""Images by their headers, archives and folders with bad files, generated tasks and texts."""

from __future__ import annotations

import io
import random
import struct
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.operators import generation as gn
from quillspark.sources import files
from quillspark.sources import images as im


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\0" + b"\xff\xda"


def app(n):
    return b"\xff\xe1" + struct.pack(">H", n + 2) + b"\xff\xc0" * (n // 2) + b"x" * (n % 2)


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


CASES = [
    (png(640, 480), ("image/png", 640, 480)),
    (png(640, 480)[:23], None),
    (b"GIF89a" + struct.pack("<HH", 3, 4), ("image/gif", 3, 4)),
    (b"GIF87a\x01", None),
    (jpeg(1000, 700), ("image/jpeg", 1000, 700)),
    (jpeg(1000, 700, app(65_000) * 3 + b"\xff\xff\xff\xd0"), ("image/jpeg", 1000, 700)),
    (jpeg(9, 8, b"\xff\xc4\x00\x04ab"), ("image/jpeg", 9, 8)),
    (b"\xff\xd8\xff\xda\x00\x02", None),
    (b"\xff\xd8\xff\xd9", None),
    (b"\xff\xd8\x00\x00\x00", None),
    (b"\xff\xd8\xff\xe1\x00\x00" + b"\xff" * 50, None),
    (webp(b"VP8X", b"\0" * 4 + (4095).to_bytes(3, "little") + (2999).to_bytes(3, "little")), ("image/webp", 4096, 3000)),
    (webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")), ("image/webp", 100, 50)),
    (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 200)), ("image/webp", 320, 200)),
    (webp(b"VP8 ", b"\0" * 20), None),
    (b"", None),
    (None, None),
    (b"<svg xmlns='http://www.w3.org/2000/svg'/>", None),
]


def test_headers():
    assert [im.header(b) for b, _ in CASES] == [want for _, want in CASES]


def test_no_bytes_fail(spark):
    r = random.Random(5)
    seeds = [b for b, _ in CASES if b]
    for _ in range(20_000):
        x = bytearray(r.choice(seeds)[:200])
        for _ in range(r.randint(1, 4)):
            x[r.randrange(len(x)) :] = bytes(r.randrange(256) for _ in range(r.randint(0, 12))) + bytes(x[r.randrange(len(x)) :]) if x else b"\xff"
            x = x or bytearray(b"\xff")
        got = im.header(bytes(x))
        assert got is None or (got[0] in lx.IMAGE_TYPES and got[1] >= 0 and got[2] >= 0)
    huge = spark.createDataFrame([(png(0xFFFFFFFF, 1),), (png(5, 6),)], "b binary").select(im.info(F.col("b")).alias("i")).collect()
    assert [tuple(x["i"]) for x in huge] == [(None, None, None), ("image/png", 5, 6)]


def test_upload_gate(spark):
    big = png(1, 1) + b"\0" * lx.IMAGE_BYTES
    rows = [
        ("image/png", png(10, 10), 200, None),
        ("IMAGE/JPEG", png(10, 10), 200, None),
        ("image/svg+xml", png(10, 10), 415, "unsupported type"),
        (None, png(10, 10), 415, "unsupported type"),
        ("text/html", b"", 415, "unsupported type"),
        ("image/gif", b"", 400, "empty image"),
        ("image/gif", None, 400, "empty image"),
        ("image/png", big, 413, "image too large"),
        ("image/png", big[: lx.IMAGE_BYTES], 200, None),
        ("image/png", png(5000, 4000), 200, None),
        ("image/png", png(5000, 4001), 400, "too many pixels"),
        ("image/png", png(0, 4001), 400, "image without pixels"),
        ("image/png", png(2_000_000_000, 2_000_000_000), 400, "too many pixels"),
        ("image/webp", b"not an image", 400, "not an image"),
    ]
    d = spark.createDataFrame([(i, m, b) for i, (m, b, _, _) in enumerate(rows)], "i int, m string, b binary")
    got = sorted((r["i"], r["g"]["status"], r["g"]["reason"]) for r in d.select("i", im.upload_gate(F.col("m"), F.col("b")).alias("g")).collect())
    assert got == [(i, s, why) for i, (_, _, s, why) in enumerate(rows)]


def tar(path, members, mode="w:bz2"):
    with tarfile.open(path, mode) as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))


def test_bad_archives_are_rows(spark, tmp_path):
    tar(tmp_path / "good.tar.bz2", [("x/1", b"one"), ("x/2", b"two" * 200_000), ("y\udcff/3", b"three")])
    tar(tmp_path / "cut.tar", [("a/1", b"x" * 600), ("a/2", b"y" * 6000)], "w")
    whole = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:3000])
    (tmp_path / "garbage.tar").write_bytes(b"no archive at all" * 50)
    (tmp_path / "half.tar.bz2").write_bytes((tmp_path / "good.tar.bz2").read_bytes()[:60])
    (tmp_path / "large.tar").write_bytes(b"\0" * 70_000)
    got = files.archive_members(spark, str(tmp_path), most_archive=60_000).collect()
    by = {}
    for r in got:
        by.setdefault(r["archive"].rsplit("/", 1)[1], []).append((r["member"], bytes(r["raw"]) if r["raw"] is not None else None, r["error"]))
    assert set(by) == {"good.tar.bz2", "cut.tar", "garbage.tar", "half.tar.bz2", "large.tar"}
    assert [m[1:] for m in by["good.tar.bz2"]] == [(b"one", None), (b"three", None)]
    assert by["cut.tar"][0] == ("a/1", b"x" * 600, None) and by["cut.tar"][1][2].startswith("archive failed")
    assert all(by[k][-1][0] is None and by[k][-1][2].startswith("archive failed") for k in ("garbage.tar", "half.tar.bz2"))
    assert by["large.tar"] == [(None, None, "archive too large")]
    # Spark's reader leaves out empty files; as a row, such an archive is a bad one.
    empty = files.members_of(spark.createDataFrame([("e", b""), ("n", None)], "path string, content binary")).collect()
    assert [(r["archive"], r["raw"]) for r in empty] == [("e", None), ("n", None)] and all(r["error"] for r in empty)


def test_folders_of_spam_and_ham(spark, tmp_path):
    mails = {
        "spam_2/a": b"Subject: A\r\n\r\nbuy now",
        "easy_ham/b": b"Subject: B\r\nContent-Type: text/html\r\n\r\n<p>Hello <b>you</b></p><script>x()</script>",
        "HAM-spam/c": b"Subject: C\r\n\r\nboth words",
        "other/d": b"Subject: D\r\n\r\nno label",
        "ham/e": b"Subject: E\r\n\r\n \r\n",
        "ham/f": b"From: group: a@b;\r\nContent-Type: multipart/mixed; boundary=\"x\0\"\r\n\r\n\xff\xfe",
    }
    for name, body in mails.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body)
    d = files.spam_folder(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 2)[-1]: r["label"] for r in d.collect()} == {"a": 1, "b": 0, "c": 1, "e": 0, "f": 0}
    got = {r["path"][-1]: r for r in files.labelled_mail(d).collect()}
    assert (got["a"]["subject"], got["a"]["text"].strip(), got["a"]["error"]) == ("A", "buy now", None)
    assert "Hello" in got["b"]["text"] and "x()" not in got["b"]["text"] and got["c"]["label"] == 1
    assert (got["e"]["text"], got["e"]["error"]) == (None, "no text") and set(got) == set("abcef")
    texts = files.whole_texts(spark, str(tmp_path / "easy_ham")).collect()
    assert len(texts) == 1 and texts[0]["text"].startswith("Subject: B")


def test_mail_folder_in_order(spark, tmp_path):
    for k in ("human", "ai"):
        (tmp_path / k).mkdir()
        for i in range(6):
            (tmp_path / k / f"{(i * 7) % 6}.eml").write_bytes(b"Subject: x\r\n\r\ny")
    got = [r["path"] for r in files.mail_folder(spark, str(tmp_path), ordered=True).collect()]
    assert len(got) == 12 and got == sorted(got)


def test_rounds_use_up_their_list(spark):
    options = ["a", "b", "c", "d", "e"]
    got = {r["id"]: r["o"] for r in spark.range(53).select("id", gn.in_rounds(options, F.col("id"), "s").alias("o")).collect()}
    for k in range(10):
        assert sorted(got[i] for i in range(5 * k, 5 * k + 5)) == options
    assert len({tuple(got[i] for i in range(5 * k, 5 * k + 5)) for k in range(10)}) > 3


def test_slots(spark):
    templates = {"x": ["one {n} and {n}", "two {m}"], "y": ["plain"]}
    got = {r["id"]: (r["kind"], r["text"]) for r in gn.expanded(spark.range(24), "id", templates, {"n": ["1", "2", "3"], "m": ["q"]}).collect()}
    assert all(got[i] == ("y", "plain") for i in range(1, 24, 2)) and "{" not in "".join(t for _, t in got.values())
    assert Counter(got[i][1][:3] for i in range(0, 24, 2)) == {"one": 6, "two": 6}
    assert all(t.split()[1] == t.split()[3] for _, t in got.values() if t.startswith("one"))


def test_drawn_lengths_follow_the_corpus(spark):
    r = random.Random(1)
    sizes = [r.choice([0, 3, 50, 60, 60, 61, 240, 9000]) for _ in range(500)]
    texts = spark.createDataFrame([("w " * n,) for n in sizes] + [(None,)], "t string")
    cdf = gn.length_cdf(texts, "t")
    n = 20_000
    got = Counter(x["words"] for x in gn.with_length(spark.range(n), "id", cdf).collect())
    want = Counter(min(250, max(45, s)) for s in sizes if s)
    total = sum(want.values())
    assert set(got) == set(want)
    # Within four standard deviations of the draw.
    assert all(abs(got[k] / n - want[k] / total) < 4 * (0.25 / n) ** 0.5 for k in want)
    none = gn.length_cdf(texts.where("false"), "t")
    assert {x["words"] for x in gn.with_length(spark.range(300), "id", none).collect()} == set(gn.DEFAULT_WORDS)


def test_tasks_draw_from_all_lists(spark):
    cdf = gn.length_cdf(spark.createDataFrame([("w " * 60,)], "t string"), "t")
    rows = gn.tasks(spark.range(2000), "id", cdf).collect()
    assert [len(lx.TASK_LISTS[k]) for k in ("topic", "style", "role", "recipient", "detail", "format")] == [28, 12, 13, 10, 20, 6]
    for k, options in lx.TASK_LISTS.items():
        assert {r[k] for r in rows} == set(options)


@pytest.mark.parametrize("name", ["archived_mail", "image_uploads"])
def test_queries_show_every_case(spark, data, name):
    from quillspark.plans import registry

    rows = registry.QUERIES[name](spark, data).collect()
    if name == "archived_mail":
        assert {r["error"] for r in rows} >= {None, "archive failed"} and {r["label"] for r in rows} == {0, 1, None}
    else:
        assert {r["status"] for r in rows} == {200, 400, 415} and {r["kind"] for r in rows} == {*lx.IMAGE_TYPES, None}
