"""Queries over all rows and whole texts against brute force, where SQL can't express the rule or follows only a part."""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter
from itertools import pairwise

import pytest
import regex

from quillspark.plans import registry

SMALL = "/root/testdata/sf0.001"
ASCII_SPACE = " \t\n\r\x0b\x0c"
TEXTS = ["Caf\u00e9 \ufb01ne \u2167 &amp; &lt;b&gt;tag&lt;/b&gt; \uff21\uff22", "Write to Ann.Lee+x@example.org, call +49 (0)30 1234-5678 or 12345; see HTTPS://x.example/a?b=1 now", "AT&T &copy; 2024\n> quoted\n\n\n\nrest \u00e9", "x" * 500 + " 0123456789 \u00fc", "", "www.example.org\r\nOn 12 of May 2024 Bob wrote:\nlost", "1234567890 12", "plain words only", "\u6f22\u5b57 123 456 789 01 end"]


def canonical(t: str) -> str:
    t = unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(t)))
    t = re.sub(r"<[^>]+>", " ", t)
    t = re.sub(r"(?i)(?:https?://|www\.)[^ \t\n\r\x0b\x0c]+", " url ", t)
    t = re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", " email ", t)
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)
    return re.sub(r"[ \t\n\r\x0b\x0c]+", " ", t).strip(" ").lower()


def mail_like(t: str) -> str:
    return f"See https://example.org/x?a=1 or write to someone@example.org now.\n> quoted {t[:40]}\nCall +49 30 1234 56789 today\n--------------------\n{t}\n\n\n\nUnsubscribe here\nOn Monday the person at work wrote:\nlost {t}"


def corpus_clean(t: str) -> str:
    t = re.sub(r"(?i)https?://[^ \t\n\r\x0b\x0c]+|www\.[^ \t\n\r\x0b\x0c]+", "", t)
    t = re.sub(r"(?ia)\b[\w.+%-]+@[\w.-]+\.[a-z]{2,}\b", "", t)
    t = re.sub(r"(?<!\w)(?:\+?[0-9][0-9 .()-]{9,}[0-9])(?!\w)", "", t)
    kept = []
    for line in t.replace("\r", "").split("\n"):
        s = line.strip(ASCII_SPACE)
        if re.search(r"(?ia)^on .{10,} wrote:\s*$", s):
            break
        if not re.search(r"(?i)^(-{2,}[ \t]*original message|unsubscribe|list-unsubscribe:|x-spam-|message-id:)|^[-_=*~]{8,}$|^[>|]", s):
            kept.append(s)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip(ASCII_SPACE)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Documents with what the SQL of canonical_text, corpus_clean and attachment_digest leaves out, and those of sf0.001."""
    path = str(tmp_path_factory.mktemp("whole"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    more = spark.createDataFrame([(10**6 + i, t, "built") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    return path, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}


def gram_tables(spark, grams):
    """(key to Counter of terms, the vocabulary as brute force has it) of the turns of sf0.001."""
    from quillspark.plans.corpus_queries import turns

    tf = {r["msg_id"]: Counter(grams(r["text"])) for r in turns(spark, SMALL).collect()}
    df, total = Counter(), Counter()
    for c in tf.values():
        df.update(c.keys())
        total.update(c)
    order = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t.encode()))
    return tf, df, total, order[:35_000]


def words_of(text):
    t = regex.findall(r"[\p{L}\p{N}]+(?:['\u2019\-][\p{L}\p{N}]+)*", text.lower())
    return t + [f"{a} {b}" for a, b in pairwise(t)]


def chars_of(text):
    return [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]


@pytest.mark.parametrize(("name", "grams"), [("tfidf_vocab", words_of), ("char_gram_counts", chars_of)])
def test_vocabularies(spark, name, grams):
    _, df, total, order = gram_tables(spark, grams)
    got = {r["term"]: (r["df"], r["total"]) for r in registry.QUERIES[name](spark, SMALL).collect()}
    assert got == {t: (df[t], total[t]) for t in order} and len(got) > 500


def test_weights(spark):
    tf, df, _, order = gram_tables(spark, words_of)
    known = set(order)
    got = {r["msg_id"]: r for r in registry.QUERIES["tfidf_weights"](spark, SMALL).collect()}
    for key, c in tf.items():
        w = [(1 + math.log(n)) * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, n in c.items() if t in known]
        assert (key in got) == bool(w)
        if w:
            norm = math.sqrt(sum(x * x for x in w))
            assert got[key]["terms"] == len(w) and got[key]["total"] == pytest.approx(sum(w) / norm, abs=2e-5) and got[key]["top"] == pytest.approx(max(w) / norm, abs=2e-5)


def test_text_model_has_the_surveyed_sizes(spark, monkeypatch):
    from quillspark.operators import models as md

    seen = []
    whole = md.text_pipeline
    monkeypatch.setattr(md, "text_pipeline", lambda **o: seen.append(o) or whole(**o))
    rows = registry.QUERIES["logreg_scores"](spark, SMALL).collect()
    assert rows and all(0 <= r["score"] <= 1 for r in rows)
    assert seen and all(o["iterations"] == 1000 and len(o["branches"]) == 1 for o in seen)
    branch = seen[0]["branches"][0]
    assert (branch.kind, branch.lo, branch.hi, branch.limit, branch.least, branch.sublinear) == ("word", 1, 3, 20_000, 2, False) and "the" in branch.stopwords


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def test_canonical_text(spark, built):
    path, texts = built
    got = {r["doc_id"]: r["clean_sha256"] for r in registry.QUERIES["canonical_text"](spark, path).collect()}
    assert got == {i: sha(canonical(t)) for i, t in texts.items()}


def test_corpus_clean(spark, built):
    path, texts = built
    got = {r["doc_id"]: (r["clean_sha256"], r["clean_chars"]) for r in registry.QUERIES["corpus_clean"](spark, path).collect()}
    want = {i: corpus_clean(mail_like(t)) for i, t in texts.items()}
    assert got == {i: (sha(c), len(c)) for i, c in want.items()}


def test_attachment_digest(spark, built):
    path, texts = built
    got = {r["doc_id"]: (r["size"], r["sha256"]) for r in registry.QUERIES["attachment_digest"](spark, path).collect()}
    assert got == {i: (len(t.encode()), sha(t) if t else None) for i, t in texts.items()}


def test_mails_give_back_blank_and_absent_texts(spark, tmp_path):
    """The parser takes a part of white space for none, so a mail must hold more than a blank text."""
    import duckdb

    from tests.compare import rows_of, rows_of_sql

    path = f"{tmp_path}/documents.parquet"
    rows = [(0, "Whole text.", "src0"), (1, "", "src1"), (2, " \n", "src2"), (3, " ", "src3"), (4, None, "src4"), (5, "No text", None), (6, "Text:\n", "src6"), (6, "Text:\n", "src6")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for name in ("mime_roundtrip", "auth_results"):
        assert rows_of(registry.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(duck, registry.ORACLES[name]), name
