"""Rules that must hold, and stay fast, on large or awkward inputs."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import decision, dedupe, models, sampling, zones
from quillspark.sources import mail, sinks


def sentences(t: str) -> list[str]:
    return [s for s in (p.strip(" \t\n\r\x0b\x0c") for p in re.sub(r"(\S.*?[.!?…])([ \t\n\r\x0b\x0c])", "\\1\1\\2", t, flags=re.S).split("\1")) if s]


CASES = ["", " ", "one", "One. Two! Three? Four… five", "a. . . b ! c.d e. ", " . x. y", ". a", "... b. ", "a.\n\nb", "x" * 50 + " tail", "1.5 is. no end", "! ! !", "é… ü. 漢字. "]


def test_sentences_equal_the_plain_rule(spark):
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in CASES], "t string").select("t", tx.sentences(F.col("t")).alias("s")).collect()}
    assert got == {t: sentences(t) for t in CASES}


@pytest.mark.parametrize("text", ["word " * 200_000, "a. " + "word " * 200_000, "a.b" * 300_000, ". " * 300_000])
def test_a_megabyte_is_split_at_once(spark, text):
    d = spark.createDataFrame([(text,)], "t string").select(F.size(tx.sentences(F.col("t"))).alias("n"), F.size(tx.segments(F.col("t"))).alias("m"))
    d.collect()
    began = time.perf_counter()
    assert d.first()["n"] >= 1
    assert time.perf_counter() - began < 5


def test_numbers_past_9999(spark):
    d = spark.range(25_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("p"))
    got = {r["k"]: r["name"] for r in dedupe.numbered(d, F.col("p"), "k").collect()}
    place = {"a": 0, "b": 0}
    for k in range(25_000):
        p = "a" if k % 10 else "b"
        place[p] += 1
        assert got[k] == f"{p}_{place[p]:04d}"
    assert got[24_999] == "a_22500"


def test_large_lists_and_classes_are_not_cut(spark, monkeypatch):
    d = spark.createDataFrame([(1, "some words")], "k int, t string")
    monkeypatch.setattr(decision, "MOST_PHRASES", 3)
    words = spark.createDataFrame([("g", w) for w in "so me word s wor ds x y z".split()] + [("h", "me"), (None, "e w"), ("h", ""), ("h", None), ("g", "so")], "group string, phrase string")
    assert {(r["group"], r["hits"]) for r in decision.lexicon_matches(d, words, "k", "t").collect()} == {("g", 6), ("h", 2), (None, 1)}
    rows = spark.createDataFrame([(i, i % 1500) for i in range(15_000)], "k int, y int")
    assert sampling.split_labels(rows, "y", 1, "k").where("split = 'stack'").select("y").distinct().count() == 1500
    three = models.balanced(spark.createDataFrame([(0,), (1,), (1,), (2,)], "y int"), "y").collect()
    assert sorted((r["y"], r["weight"]) for r in three) == [(0, 2.0), (1, 1.0), (1, 1.0), (2, 2.0)]
    z = spark.createDataFrame([(1, "body", 0.5, 0.5)], "id int, kind string, no_llm double, embedding double")
    cuts = spark.createDataFrame([("body", 0.4), ("body", 0.6)], "kind string, threshold double")
    with pytest.raises(Exception, match="two thresholds"):
        zones.verdicts(z.select("id", F.lit(0.5).alias("final")), z, cuts, "id", F.lit(0.4), F.lit(0.6)).collect()


def test_keys_repeated_within_one_append(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(d, path, "k")
    sinks.append_new(d.unionByName(spark.createDataFrame([(3, "c"), (3, "c")], "k int, v string")), path, "k")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_missing_mail_is_an_empty_tree(spark):
    r = spark.createDataFrame([(None,), (b"Subject: x\r\n\r\nhi",)], "raw binary").select(mail.parsed(F.col("raw")).alias("m")).collect()
    assert sorted(str(x["m"]["headers"]["subject"]) for x in r) == ["None", "x"]


MEGABYTE = 1_000_000
LONG = {
    "blanks inside": "a" + " " * MEGABYTE + "b",
    "blanks": " " * MEGABYTE,
    "one word": "a" * MEGABYTE,
    "lines": "a\n" * (MEGABYTE // 2),
    "empty lines": "\n" * MEGABYTE,
    "blank lines": "x\n" + " \n" * (MEGABYTE // 2) + "y",
    "a gap that ends late": "x\n" + " " * MEGABYTE + "y",
    "tags left open": "<" * MEGABYTE,
    "tags and a close": "<a" * (MEGABYTE // 2) + ">" + "<" * 1000,
    "joined words": "a-" * (MEGABYTE // 2) + "a",
    "dots": "a." * (MEGABYTE // 2),
    "at signs": "a@" * (MEGABYTE // 2),
    "digits": "1 2-" * (MEGABYTE // 4) + "x",
}
ONE_TEXT = {
    "strip": tx.strip,
    "tokens": lambda c: F.size(tx.tokens(c)),
    "word_count": tx.word_count,
    "space_word_count": tx.space_word_count,
    "sentences": lambda c: F.size(tx.sentences(c)),
    "paragraphs": lambda c: F.size(tx.paragraphs(c)),
    "segments": lambda c: F.size(tx.segments(c)),
    "number_count": tx.number_count,
    "space_key": tx.space_key,
    "ascii_ratio": tx.ascii_ratio,
    "mask": tx.mask,
    "strip_tags": tx.strip_tags,
    "strip_fake_headers": tx.strip_fake_headers,
    "clean_corpus_text": tx.clean_corpus_text,
    "has_sign_off": tx.has_sign_off,
    "likely_human": lambda c: tx.likely_human(F.lit("subject"), c),
    "char_grams": lambda c: F.size(models.char_grams(c, 3, 5)),
    "word_grams": lambda c: F.size(models.word_grams(c, 1, 2)),
}


@pytest.mark.parametrize("name", sorted(ONE_TEXT))
def test_every_text_function_is_linear(spark, name):
    """A megabyte of any one kind, in about a second each; the first one pays for what is compiled."""
    for kind, text in [("", "warm"), *LONG.items()]:
        d = spark.createDataFrame([(text,)], "t string").select(ONE_TEXT[name](F.col("t")).alias("x"))
        began = time.perf_counter()
        d.collect()
        assert time.perf_counter() - began < (4 if kind else 30), kind


@pytest.mark.parametrize("kind", sorted(LONG))
def test_zones_are_linear(spark, kind):
    d = zones.split(spark.createDataFrame([("s", LONG[kind])], "subject string, body string"))
    began = time.perf_counter()
    d.collect()
    assert time.perf_counter() - began < 6


def test_java_patterns_find_what_the_plain_ones_find(spark):
    """On random texts over few characters, the same pieces as Python's plain patterns."""
    import random

    r = random.Random(11)
    texts = ["".join(r.choice("ab.@+-_ <>\n\t\r1é%") for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["a@b.c+d@e.f", "a@b.cc.d@e.ff", "<<a>b>", "é.a@b.cc", "éa.b@c.dd", "..a@b.cc", "\n \n\t\n x", " \r\n \n"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = d.select("i", tx.untagged(F.col("t")).alias("u"), F.regexp_replace("t", tx.JAVA_GAP, "#").alias("g"), F.regexp_replace("t", r"(?:(?<![\p{L}\p{N}_.+-])|\G)[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++\.[\p{L}\p{N}_.-]+", "#").alias("e"), F.regexp_replace("t", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "#").alias("f"), tx.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?i)\b[\w.+%-]+@[\w.-]+\.[a-z]{2,}\b", "").alias("c"), F.regexp_replace("t", r"(?i)((?:(?<![\w.+%-])|\G)(?:(?!\b)(?:\w++|[.+%-]++))?)\b[\w.+%-]++@[\w.-]+\.[a-z]{2,}\b", "$1").alias("k")).collect()
    for x in got:
        t = texts[x["i"]]
        assert x["u"] == re.sub(r"<[^>]+>", " ", t)
        assert x["g"] == re.sub(r"((?:[ \t]*\r?\n[ \t]*){2,})", "#", t)
        assert x["e"] == x["f"] and x["c"] == x["k"]
        assert x["s"] == t.strip(" \t\n\x0b\f\r")


def test_char_grams_of_wide_characters(spark):
    texts = ["", "a", "ab", "abc", "漢字😀é", "😀😀😀😀😀"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", models.char_grams(F.col("t"), 2, 3).alias("g")).collect()
    assert {r["t"]: sorted(r["g"]) for r in got} == {t: sorted(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)) for t in texts}


def test_lexicon_against_brute_force(spark, monkeypatch):
    import random

    r = random.Random(2)
    phrases = [("".join(r.choice("ab c") for _ in range(r.randint(0, 5)))) for _ in range(300)]
    lexicon = [(r.choice(["x", "y", None]), p) for p in phrases]
    texts = [(r.choice([1, 2, None, i]), "".join(r.choice("AabBc  ") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(900, None), (901, "")]
    want: dict = {}
    for k, t in texts:
        for g, p in lexicon:
            if t is not None and p in t.lower():
                want.setdefault((k, g), set()).add(p)
    d = spark.createDataFrame(texts, "k int, t string").repartition(3)
    for most in (100_000, 40):
        monkeypatch.setattr(decision, "MOST_PHRASES", most)
        got = decision.lexicon_matches(d, spark.createDataFrame(lexicon, "group string, phrase string"), "k", "t").collect()
        assert {(x["k"], x["group"]): x["hits"] for x in got} == {k: len(v) for k, v in want.items()}
    monkeypatch.setattr(decision, "MOST_PHRASES", 100_000)
    assert decision.lexicon_matches(d, spark.createDataFrame([], "group string, phrase string"), "k", "t").count() == 0


def test_a_long_lexicon_is_quick(spark):
    lexicon = spark.range(150_000).select((F.col("id") % 7).cast("string").alias("group"), F.concat(F.lit("p"), F.hex("id"), F.lit("q")).alias("phrase"))
    d = spark.range(2000).select("id", F.concat(F.lit("some text with P"), F.hex("id"), F.lit("Q in it")).alias("t"))
    began = time.perf_counter()
    # Phrases of capital digits are not in a lower-cased text; decimal ones are.
    assert decision.lexicon_matches(d, lexicon.withColumn("phrase", F.lower("phrase")), "id", "t").count() == 2000
    assert time.perf_counter() - began < 40


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_curves_in_any_number_of_partitions(spark, parts):
    """Thresholds, quantiles and AUC by group, null group too, against plain loops; no window without the partition."""
    import random
    import statistics

    from quillspark.operators import metrics

    r = random.Random(parts)
    rows = [(g, y, round(min(1.0, max(0.0, r.random() * 0.6 + 0.3 * y)), r.choice([1, 2, 6]))) for g in ("a", "b", None) for y in (r.choice([0, 1]) for _ in range(150))] + [("c", 1, 0.5)] * 4 + [("d", 0, None)]
    d = spark.createDataFrame(rows, "g string, y int, s double").repartition(4)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        cuts = {x["g"]: (x["cut"], x["j"]) for x in metrics.youden_cut(d, "y", "s", "g").collect()}
        engine = {x["g"]: x for x in metrics.engine_thresholds(d, "y", "s", "g").collect()}
        auc = {x["g"]: x["auc"] for x in metrics.roc_auc(d, "y", "s", "g").collect()}
        assert set(cuts) == set(engine) == {"a", "b", None} and set(auc) == {"a", "b", None, "c"} and auc["c"] is None
        for g in ("a", "b", None):
            own = [(s, y) for x, y, s in rows if x == g]
            pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
            assert auc[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg), abs=2e-6)
            u = sorted({s for s, _ in own})
            tries = [max(0.0, u[0] - 1e-6), *((x + y) / 2 for x, y in zip(u, u[1:], strict=False)), min(1.0, u[-1] + 1e-6)]
            js = [sum(p >= c for p in pos) / len(pos) - sum(n >= c for n in neg) / len(neg) for c in tries]
            best = statistics.median(c for c, j in zip(tries, js, strict=True) if abs(j - max(js)) < 1e-10)
            assert cuts[g] == (pytest.approx(best, abs=2e-5), pytest.approx(max(js), abs=2e-4))
            import numpy as np

            human, ai = np.quantile(neg, 0.9), np.quantile(pos, 0.1)
            gap = min(0.15, max(0.025, 0.15 * (ai - human)))
            lo, hi = max(human, cuts[g][0] - gap), min(ai, cuts[g][0] + gap)
            want = (lo, hi) if human < ai and lo < hi else (max(0.0, cuts[g][0] - 0.025), min(1.0, cuts[g][0] + 0.025))
            assert (engine[g]["human_cut"], engine[g]["ai_cut"]) == pytest.approx(want, abs=2e-5)
        whole = metrics.roc_auc(d, "y", "s").collect()
        assert len(whole) == 1 and len(metrics.engine_thresholds(d, "y", "s").collect()) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
