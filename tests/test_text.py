"""Text functions, segment rules and fusion on worked examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scores as sc
from quillspark.functions import text as tx
from quillspark.operators import profile as pr


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize(("text", "want"), [("Don't re-do it_now", ["don't", "re-do", "it", "now"]), ("", []), ("Ünï 12", ["ünï", "12"])])
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("One. Two! Three", ["One.", "Two!", "Three"]), (". lone start. End", [". lone start.", "End"]), ("  ", []), ("a.b c", ["a.b c"])])
def test_sentences(spark, text, want):
    assert one(spark, tx.sentences(F.col("t")), t=text) == want


def test_list_sizes():
    assert [len(x) for x in (lx.FORMULAIC, lx.TRANSITIONS, lx.GENERIC, lx.INDICATORS, lx.SUBJECT_STOPWORDS)] == [35, 12, 19, 15, 38]


@pytest.mark.parametrize(("text", "want"), [("urgent: immediately verify your password and account", 1.0), ("verify", 0.25), ("nothing", 0.0)])
def test_fallback(spark, text, want):
    assert one(spark, tx.fallback_score(F.col("t")), t=text) == want


@pytest.mark.parametrize(("n", "want"), [(1, 0.26), (2, 0.38), (3, 0.50), (5, 0.50)])
def test_formulaic_rule(spark, n, want):
    body = " and ".join(lx.FORMULAIC[:n]) + " one two three four five six seven eight"
    assert pr.rules(pr.exploded(texts(spark, body))).first()["score"] == pytest.approx(want)


@pytest.mark.parametrize(("n", "want"), [(2, 0.15), (3, 0.19), (4, 0.23), (5, 0.23)])
def test_repeated_rule(spark, n, want):
    body = "\n".join(["we saw five small red boats."] * n) + "\n\nEnd of it."
    assert pr.rules(pr.exploded(texts(spark, body))).where("idx = 0").first()["score"] == pytest.approx(want)


def test_near_repeated(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa. Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.\n\nx"
    r = pr.rules(pr.exploded(texts(spark, body))).where("idx = 0").first()
    assert r["near"] and r["score"] == pytest.approx(0.12)


def test_profile_weights(spark):
    s = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc_id long, idx int, content string")
    rows = pr.rules(s.withColumn("kind", F.lit("paragraph")))
    assert rows.count() == 2
    # Scores 0.5 (16 words) and 0 (9 words): weights 4 and 3.
    mean = 0.5 * 4 / 7
    assert round(0.75 * mean + 0.25 * 0.5, 4) == 0.3393


def test_short_text_is_insufficient(spark):
    r = pr.document_verdicts(texts(spark, "Hi there", "", None)).collect()
    assert {x["label"] for x in r} == {"insufficient_context"} and all(x["score"] == 0 for x in r)


def test_spans_slice_to_content(spark):
    body = "  First part here.\nmore \n\n  Second, with\x01 mark. \r\n\r\nBest regards,\nAnna\n"
    for r in pr.spans(texts(spark, body, "One. Two. One. Two.")).collect():
        text = {0: body.replace("\x01", " "), 1: "One. Two. One. Two."}[r["doc_id"]]
        assert text[r["start"] : r["end"]] == r["content"]
    assert pr.exploded(texts(spark, body)).where("kind = 'signature'").count() == 1


def test_segment_caps(spark):
    body = " ".join(f"Sentence number {i} is here." for i in range(80))
    assert pr.exploded(texts(spark, body)).count() == lx.SEGMENTS


@pytest.mark.parametrize(("base", "semantic", "model", "want"), [(0.8, 0.5, True, 0.82), (0.25, 0.4, False, 0.4), (0.8, 0.0, True, 0.8), (0.9, 0.1, False, 0.9)])
def test_fuse_never_lowers(spark, base, semantic, model, want):
    got = one(spark, sc.fuse(F.col("b"), F.col("s"), F.lit(model)), b=base, s=semantic)
    assert got == pytest.approx(want) and got >= base


@pytest.mark.parametrize(("x", "want"), [(0.1, "DEFINITELY_HUMAN"), (0.2, "PROBABLY_HUMAN"), (0.4, "MIXED"), (0.6, "PROBABLY_AI"), (0.8, "DEFINITELY_AI"), (1.0, "DEFINITELY_AI")])
def test_verdict_bounds(spark, x, want):
    assert one(spark, sc.verdict(F.col("x")), x=x) == want


def test_subject_overlap(spark):
    subject, body = "Product update and login fix", "The product has an update: a fix for login."
    assert one(spark, tx.subject_overlap(F.col("s"), F.col("b")), s=subject, b=body) == 1.0
    assert one(spark, tx.subject_overlap(F.col("s"), F.col("b")), s="and", b=body) is None


def test_fake_headers(spark):
    full = "Return-Path: <a>\nSubject: s\n\nbody\n\nmore"
    assert one(spark, tx.strip_fake_headers(F.col("t")), t=full) == "body\n\nmore"
    assert one(spark, tx.strip_fake_headers(F.col("t")), t="Return-Path: <a>\n\nbody") == "Return-Path: <a>\n\nbody"


def test_numbers(spark):
    assert one(spark, tx.number_count(F.col("t")), t="in 2024, on 1/5 and 12/05, x9 7") == 4


@pytest.mark.parametrize(("v", "want"), [([3.0, 4.0], [0.6, 0.8]), ([0.0, 0.0], None), ([], None), ([float("nan"), 1.0], None)])
def test_normalised(spark, v, want):
    got = spark.createDataFrame([(v,)], "v array<double>").select(sc.normalised(F.col("v")).alias("x")).first()["x"]
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(("gap", "want"), [(0.1, 0.689974), (0.0, 0.5)])
def test_similarity(spark, gap, want):
    d = spark.createDataFrame([([1.0, 0.0], [gap, 0.0], [0.0, 1.0])], "v array<double>, a array<double>, h array<double>")
    assert d.select(sc.similarity_score(F.col("v"), F.col("a"), F.col("h")).alias("x")).first()["x"] == pytest.approx(want, abs=1e-6)


def test_mean_present(spark):
    d = spark.createDataFrame([(1, 0.8, None), (2, None, None)], "i int, a double, b double")
    assert [r["x"] for r in d.orderBy("i").select(sc.mean_present(F.col("a"), F.col("b")).alias("x")).collect()] == [0.8, None]


def test_valid_score(spark):
    d = spark.createDataFrame([("0.5",), ("nan",), ("1.1",), ("-0.1",), ("x",), (None,)], "x string")
    assert [r["y"] for r in d.select(sc.valid_score(F.col("x")).alias("y")).collect()] == [0.5, None, None, None, None, None]
