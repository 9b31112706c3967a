"""What must not depend on the order of rows, on batches, or on the size of a table."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx
from quillspark.operators import features as ft
from quillspark.operators import models as md
from quillspark.operators import profile as pr
from quillspark.operators import sampling
from quillspark.operators import zones as zn
from quillspark.plans import registry


def test_final_score_does_not_depend_on_the_order_of_zones(spark):
    rows = [(1, "subject", 0.39), (1, "greeting", 0.325), (1, "signature", 0.5449999999999999)]
    trees = spark.createDataFrame([], "k int, tree double")

    def final(order):
        z = spark.createDataFrame([(k, kind, x, None, x, x) for k, kind, x in order], "k int, kind string, tfidf double, semantic double, no_llm double, with_llm double").coalesce(1)
        return zn.final_scores(z, trees, "k").collect()[0]["final"], zn.features(z, "k").collect()[0]["mean_score"]

    assert (rows[2][2] + rows[1][2] + rows[0][2]) / 3 < 0.42
    assert final(rows) == final(rows[::-1]) == final([rows[2], rows[0], rows[1]]) == (0.42, 0.42)


@pytest.mark.parametrize("name", ["page_text", "page_links", "canonical_text", "attachment_digest", "image_references", "archived_mail", "text_as_mail"])
def test_parsers_get_rows_by_the_hundred(spark, data, name):
    """A worker that gets Arrow batches holds up to 10,000 pages or mails and all that is made of them."""
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_terms_are_not_shuffled_and_partitions_grow_with_the_text(spark, monkeypatch):
    """Counts by document and term stand where the document's text was dealt to, and a larger table has more such parts."""
    t = spark.createDataFrame([(i, f"word{i} common text") for i in range(40)], "k int, text string")
    few = session.parts_for(t, "text")
    monkeypatch.setattr(session, "PART_CHARS", 10)
    assert session.parts_for(t, "text") > few
    plan = md.term_counts(t, "k", md.word_grams(F.col("text")), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(k" in plan


def test_counters_of_terms_are_bounded(spark, monkeypatch):
    """A task hands terms on before it has counted a whole batch of texts, and the sums stay the same."""
    texts = spark.createDataFrame([(f"alpha beta{i % 7} gamma{i}",) for i in range(60)], "text string").coalesce(1)
    rows = lambda: sorted(map(tuple, ft.term_table(texts, "text", (ft.Branch(limit=1000),)).collect()))
    whole = rows()
    monkeypatch.setattr(ft, "HELD", 5)
    assert rows() == whole and (0, "alpha", 60, 60) in whole


def test_classes_are_not_sent_to_a_task_each(spark):
    """All rows of one class in one task would be as large as the table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        d = spark.createDataFrame([(i, i % 2, "text") for i in range(50)], "k int, y int, text string")
        for rows in (md.balanced(d, "y"), sampling.holdout(d, "y", "s", "k"), sampling.split_labels(d, "y", "s", "k")):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            top = plan[: plan.index("BroadcastHashJoin")] if "BroadcastHashJoin" in plan else plan
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in top
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_model_makes_its_vectors_once(spark, monkeypatch):
    """The regression reads its rows twice and then often; none of that may go through Python again."""
    rows = spark.createDataFrame([(f"alpha {'beta' if i % 2 else 'gamma'}", i % 2, 1.0) for i in range(40)], "text string, is_ai int, weight double")
    made = spark.sparkContext.accumulator(0)
    row = ft.Vectorizer.row

    class Counted(ft.Vectorizer):
        def row(self, text):
            made.add(1)
            return row(self, text)

    monkeypatch.setattr(ft.TextFeaturesModel, "vectorizer", lambda self: Counted(self.of(), self.terms, self.idf))
    model = md.fit_text(rows, rows=40)
    assert made.value == 40 and len(model.stages) == 2


ODD = (". Abc. Def", "... a. b", "A\x01b. c", "", " x ", "Hi!\tYou?\nNo…  end", "1.2.3. x", ". . a. . b", "a \r\n \r\nb. c", "WWW.x y@z.de <b> q://r\x00\x7f\n t", "solution и solutionsolution опыт", "комплексное решение, опыт", "x www. y", "ver<b>ify  hereby \n inform")


def test_what_passes_over_texts_finds_the_same(spark):
    """Sentences, phrases and the mask by plain rules: shortcuts for texts without ends, Cyrillic letters or addresses change nothing."""
    blank = "[ \t\n\x0b\f\r]"
    plain = lambda t: [x for s in re.sub(rf"(?s)([^ \t\n\x0b\f\r].*?[.!?…])({blank})", "\\1\x01\\2", t).split("\x01") if (x := s.strip(tx.BLANKS))]

    def masked(t):
        t = re.sub(r"(?i)(?:https?://|www\.)\S+", " url ", re.sub(r"<[^>]+>", " ", t), flags=re.ASCII)
        t = re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", " email ", t)
        return re.sub(rf"{blank}+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)).strip(" ").lower()

    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in ODD], "t string").select("t", tx.sentences(t).alias("s"), tx.distinct_hits(t, lx.FORMULAIC + lx.GENERIC).alias("d"), tx.occurrences(t, lx.GENERIC).alias("o"), tx.mask(t).alias("m")).collect()
    for r in got:
        assert r["s"] == plain(r["t"]), r
        assert (r["d"], r["o"]) == (sum(p in r["t"] for p in lx.FORMULAIC + lx.GENERIC), sum(r["t"].count(p) for p in lx.GENERIC)), r
        assert r["m"] == masked(r["t"]), r


def test_segments_of_one_sentence_are_not_taken_apart(spark):
    """Lengths and keys of sentences are made where there are enough sentences for the rules that read them."""
    d = spark.createDataFrame([(1, 0, "paragraph", "One sentence only.")], "doc_id int, idx int, kind string, content string")
    plan = pr.rules(d)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"CASE WHEN (size(sents#{i}" in plan for i in re.findall(r"AS sents#(\d+)", plan)) and "AS sents#" in plan


def test_mail_is_cleaned_once(spark, data):
    """Each line of a mail goes through the patterns once, however often the rules read it."""
    plan = registry.QUERIES["corpus_clean"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{9,}") == 1


def test_terms_for_the_driver_do_not_grow_with_partitions(spark, monkeypatch):
    """Of the most frequent terms each partition would hand on as many as are kept; ranges before the last term are kept whole, and one is cut."""
    texts = spark.createDataFrame([(" ".join(f"w{j}" for j in range(i, i + 9)),) for i in range(300)], "text string").repartition(8)
    branches = (ft.Branch(limit=150), ft.Branch(kind="char", lo=2, hi=3, limit=70), ft.Branch(limit=10_000))
    monkeypatch.setattr(session, "PART_CHARS", 100)
    parts = session.parts_for(texts, "text")
    found = ft.term_table(texts, "text", branches)
    got = [[tuple(r)[1:] for r in found.collect() if r["branch"] == k] for k in range(3)]
    rows = [r["text"] for r in texts.collect()]
    for own, b in zip(got, branches, strict=True):
        lists = [ft.grams(t, b) for t in rows]
        total, df = Counter(g for x in lists for g in x), Counter(g for x in lists for g in set(x))
        want = sorted(((t, df[t], n) for t, n in total.items() if df[t] >= b.least), key=lambda x: (-x[2], x[0]))
        assert sorted(own) == sorted(want[: b.limit])
    # What a top-n sorts is the one range that holds a branch's last term, written before, and not all partitions of counts.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert parts > 20 and plan.count("TakeOrderedAndProject") == 2 and "MapInArrow" not in plan
