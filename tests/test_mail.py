"""Mail and HTML parsing on built messages, and zones."""

from __future__ import annotations

import hashlib
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from quillspark.operators import zones as zn
from quillspark.sources import html as ht
from quillspark.sources import mail as ml

PNG = b"\x89PNG fake"


def alternative() -> EmailMessage:
    m = EmailMessage()
    m["From"], m["Subject"] = "Anna <Anna@X.Example>", "Grüße"
    m.set_content("plain body\n")
    m.add_alternative('<p>html <img src="cid:Logo@x" alt="logo"></p>', subtype="html")
    return m


def test_plain():
    p = ml.parse(b"From: a@b.c\r\nSubject: s\r\n\r\nHello body\r\n")
    assert p["plain_parts"] == ["Hello body\r\n"] and not p["html_parts"]


def test_alternative_and_headers():
    p = ml.parse(alternative().as_bytes())
    assert p["plain_parts"] == ["plain body\n"] and "<p>html" in p["html_parts"][0]
    assert p["headers"]["from_domain"] == "x.example" and p["headers"]["subject"] == "Grüße"


def test_attachment():
    m = alternative()
    m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="a.pdf")
    a = ml.parse(m.as_bytes())["attachments"]
    assert a == [{"filename": "a.pdf", "mime_type": "application/pdf", "size": 4, "sha256": hashlib.sha256(b"%PDF").hexdigest(), "inline": False}]


def test_truncated_has_warnings():
    assert ml.parse(alternative().as_bytes()[:-20])["warnings"]


def test_empty_body_has_warnings():
    p = ml.parse(b"Subject: s\r\n\r\n")
    assert not p["plain_parts"] and p["warnings"]


def test_nested_depth_is_bounded():
    m = EmailMessage()
    m.set_content("deep")
    for _ in range(8):
        outer = EmailMessage()
        outer.make_mixed()
        outer.attach(m) if False else outer.add_attachment(m)
        m = outer
    p = ml.parse(m.as_bytes())
    assert any("depth" in w for w in p["warnings"]) or p["attachments"]


def test_related_resolves_cid(spark):
    m = alternative()
    m.get_payload()[1].add_related(PNG, maintype="image", subtype="png", cid="<logo@x>")
    e = ml.emails(spark.createDataFrame([(1, m.as_bytes())], "msg_id long, raw binary"))
    html = e.select("msg_id", F.posexplode("html_images").alias("pos", "i")).select("msg_id", "pos", "i.*")
    mime = e.select("msg_id", F.posexplode("mime_images").alias("pos", "i")).select("msg_id", "pos", "i.*")
    r = ml.resolve_images(html, mime).collect()
    assert [(x["source"], x["sha256"], x["warning"]) for x in r] == [("html+mime", hashlib.sha256(PNG).hexdigest(), None)]
    assert e.first()["metadata"]["text_source"] == "mime_plain"


@pytest.mark.parametrize(
    ("data", "declared", "want"),
    [("Привет".encode("cp1251"), "1251", "Привет"), ("é".encode(), None, "é"), (b"\xef\xbb\xbfx", "utf8", "x"), ("Привет мир".encode().decode("cp1251", "replace").encode("utf-8", "replace"), None, None), (b"caf\xe9", "no-such", None)],
)
def test_decoding(data, declared, want):
    text, used, notes = ml.decoded(data, declared)
    assert isinstance(text, str) and used
    if want is not None:
        assert text == want


def test_mojibake():
    assert ml.repaired("Привет".encode().decode("cp1251"), "cp1251") == "Привет"


@pytest.mark.parametrize(("raw", "want"), [("aGVs bG8", b"hello"), ("aGVsbG8===", b"hello"), ("aGVs*bG8=", b"hello"), ("a", b"")])
def test_loose_base64(raw, want):
    assert ml.loose_base64(raw) == want


def test_gate(spark):
    d = spark.createDataFrame([("aGVs\nbG8=",), ("***",), ("IA==",), (None,)], "b string")
    assert [r["s"] for r in d.select(ml.gate(F.col("b"))[1].alias("s")).collect()] == ["ok", "bad_base64", "empty", "bad_base64"]


def test_auth_last_wins(spark):
    d = spark.createDataFrame([("spf=fail; dkim=pass; SPF=Pass",), ("none here",), (None,)], "a string")
    got = [r["x"] for r in d.select(ml.auth_results(F.col("a")).alias("x")).collect()]
    assert got[0].asDict()["spf"] == "pass" and got[0]["dkim"] == "pass" and got[1] is None and got[2] is None


def test_simple_html():
    p = ht.simple('<p>Hello <a href="https://x.org/a">there</a></p><script>var bad = "https://no.org";</script><img src="a.png"><img src="data:image/png;base64,AA">see https://y.org/b')
    assert p["text"] == "Hello theresee https://y.org/b" or "Hello there" in p["text"]
    assert "bad" not in p["text"] and p["images"] == ["a.png", "data:image/png;base64,AA"]
    assert p["links"][0] == "https://x.org/a" and "https://y.org/b" in p["links"]


def test_artifacts():
    a = ht.artifacts('<base href="https://x.org/d/"><a href="p">rel <b>link</b></a><a href="javascript:x()">js</a><a href=" ">no</a><img src="i.png"><img src="javascript:1"><img src="cid:a%20b"><style>p{background:url(\'bg.png\')}</style><td background="old.gif">')
    assert [(x["url"], x["context"], x["position"]) for x in a["links"]] == [("https://x.org/d/p", "rel link", 0), ("javascript:x()", "js", 1), ("https://x.org/d/bg.png", "css_background", 2), ("https://x.org/d/old.gif", "bg_attr", 3)]
    assert [(i["url"], i["cid"]) for i in a["images"]] == [("https://x.org/d/i.png", None), (None, "a b")]


@pytest.mark.parametrize("flavour", ["rich_text", "zone_text", "corpus_text"])
def test_script_never_leaks(flavour):
    text = getattr(ht, flavour)("<style>p{}</style><script>secret()</script><p>shown<div>too</div><script>more secret</script>")
    assert "secret" not in text and "p{}" not in text and "shown" in text and "too" in text


def test_zones_in_cyrillic(spark):
    d = spark.createDataFrame([("Отчёт — май", "Добрый день, коллеги!\n\nТекст письма.\nЕщё строка.\n\nС уважением,\nАнна"), (None, ""), ("s", "just one line")], "subject string, body string")
    z = zn.split(d).collect()
    assert (z[0]["zone_greeting"], z[0]["zone_body"], z[0]["zone_signature"]) == ("Добрый день, коллеги!", "Текст письма.\nЕщё строка.", "С уважением,\nАнна")
    assert (z[1]["zone_subject"], z[1]["zone_body"]) == ("", "") and z[2]["zone_body"] == "just one line"


def test_contact_block_is_a_signature(spark):
    z = zn.split(spark.createDataFrame([("s", "Line one\nline two\n\nAnna\nanna@x.org")], "subject string, body string")).first()
    assert z["zone_signature"] == "Anna\nanna@x.org" and z["zone_body"] == "Line one\nline two"


def test_zone_scores_skip_nulls(spark):
    d = spark.createDataFrame([(1, "body", 0.8, None, None)], "msg_id int, kind string, tfidf double, embedding double, semantic double")
    m = zn.means(d)
    f = zn.features(m, "msg_id").first()
    assert m.first()["no_llm"] == 0.8 and f["score_body"] == 0.8 and f["mean_score"] == 0.8 and f["has_subject"] == 0
    trees = spark.createDataFrame([(1, None)], "msg_id int, tree double")
    r = zn.final_scores(m, trees, "msg_id").first()
    assert (r["covered"], r["mode"], r["final"]) == (False, "no_llm", 0.8)


def test_disagreeing_zones_are_uncertain(spark):
    d = zn.means(spark.createDataFrame([(1, "body", 0.9, 0.9, None), (1, "subject", 0.1, 0.1, None)], "msg_id int, kind string, tfidf double, embedding double, semantic double"))
    trees = spark.createDataFrame([(1, 0.99)], "msg_id int, tree double")
    cuts = spark.createDataFrame([("body", 0.5), ("subject", 0.5)], "kind string, threshold double")
    v = zn.verdicts(zn.final_scores(d, trees, "msg_id"), d, cuts, "msg_id", F.lit(0.2), F.lit(0.4)).first()
    assert v["verdict"] == "UNCERTAIN" and v["flagged"] == ["body"]


def mutated(seeds: list[bytes], n: int, seed: int = 1):
    """n light mutations: bytes changed, cut, doubled, moved, and odd pieces put in."""
    import random

    r = random.Random(seed)
    odd = [b"\0", b"\xff", b"=?", b"?=", b"=?utf-8?b?", b";", b'"', b"<", b">", b"@", b":", b",", b"(", b"\r\n", b"\r\n\r\n", b"--", b"boundary=", b"charset=", b"\xed\xa0\x80", b"group: a@b, c;", b"=?x\0y?q?a?=", b"filename*=utf-8''%ff%", b"utf-7", b"unicode_escape"]
    for _ in range(n):
        x = bytearray(r.choice(seeds))
        for _ in range(r.randint(1, 4)):
            i = r.randrange(len(x) + 1)
            k = r.randrange(5)
            if k == 0 and i < len(x):
                x[i] = r.randrange(256)
            elif k == 1:
                del x[i : i + r.randint(1, 12)]
            elif k == 2:
                x[i:i] = r.choice(odd)
            elif k == 3:
                j = r.randrange(len(x) + 1)
                x[i:i] = x[j : j + r.randint(1, 30)]
            else:
                x[i : i + 1] = r.choice(odd)
        yield bytes(x)


def full_mail() -> bytes:
    m = alternative()
    m["To"], m["Reply-To"], m["Date"], m["Message-ID"] = "team: b@c.d, e@f.g;", '"A, B" <r@x.y>', "Mon, 02 Jan 2023 10:00:00 +0100", "<1@x>"
    m["Authentication-Results"] = "mx; spf=pass; dkim=fail"
    m.add_attachment("Ünïcode".encode("utf-16"), maintype="text", subtype="csv", filename="ä.csv")
    inner = alternative()
    m.add_attachment(inner)
    return m.as_bytes() + b"\r\nX: =?utf-8?q?=C3=A4?=\r\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_no_mutated_mail_fails(seed):
    """20,000 broken mails: each gives a row that Arrow can hold."""
    import pyarrow as pa

    seeds = [full_mail(), alternative().as_bytes(), b"From: g: a@b;\r\nContent-Type: text/plain; charset=\"utf-8\"\r\n\r\nHi"]
    keys = set(ml.READ.names)
    rows = []
    for x in mutated(seeds, 10_000, seed):
        got = ml.read(x)
        assert set(got) == keys
        rows.append(got)
        assert all(isinstance(v, str) for v in (*ml.subject_and_body(x), *ml.preferred_body(x)))
    table = pa.Table.from_pylist(rows)
    assert table.num_rows == 10_000
    assert any("header failed" in w for r in rows for w in r["warnings"])


def test_unreadable_mails_are_rows(spark):
    deep = b"".join(b'Content-Type: multipart/mixed; boundary="%d"\r\n\r\n--%d\r\n' % (i, i) for i in range(3000))
    surrogate = b"Subject: \xed\xa0\x80\xff\r\nContent-Type: text/plain; charset=utf-7\r\n\r\n+2AA-"
    escape = b"Content-Type: text/plain; charset=unicode_escape\r\n\r\n\\ud800 x"
    nul = b'From: a@b.c\r\nContent-Type: text/plain; charset="a\0b"\r\n\r\nbody'
    rows = [(i, x) for i, x in enumerate([deep, surrogate, escape, nul, None, b"", b"From: group: a@b;\r\n\r\nx"])]
    d = spark.createDataFrame(rows, "msg_id long, raw binary")
    got = {r["msg_id"]: r for r in ml.emails(d).collect()}
    assert set(got) == {0, 1, 2, 3, 5, 6} and got[0]["metadata"]["warnings"] and got[3]["text"] == "body"
    assert len(d.select(ml.subject_body(F.col("raw")).alias("m")).collect()) == len(rows)


def test_headers_are_parsed_once():
    raw = full_mail()
    ml._header_object.cache_clear()
    ml.parse(raw)
    missed = ml._header_object.cache_info().misses
    ml.parse(raw)
    assert ml._header_object.cache_info().misses == missed
