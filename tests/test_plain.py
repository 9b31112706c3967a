"""Queries that SQL can't express, over whole tables, against the same rules in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from quillspark.functions import lexicon as lx
from quillspark.operators import models as md
from quillspark.operators import zones as zn
from quillspark.plans import registry
from quillspark.plans.mail_queries import zone_scores
from quillspark.sources import html as ht
from tests.test_scale import sentences

BLANK = " \t\n\r\x0b\x0c"


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def pages(spark, data):
    return {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}


def test_page_text(spark, data, pages):
    got = registry.QUERIES["page_text"](spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        h = pages[r["page_id"]] or ""
        assert (r["rich_sha256"], r["zones_sha256"], r["corpus_sha256"], r["simple_chars"]) == (sha(ht.rich_text(h)), sha(ht.zone_text(h)), sha(ht.corpus_text(h)), len(ht.simple(h)["text"]))


def test_link_scheme_counts(spark, data, pages):
    links, urls = defaultdict(int), defaultdict(set)
    for h in pages.values():
        for x in ht.artifacts(h or "")["links"]:
            links[x["scheme"]] += 1
            if x["url"] is not None:
                urls[x["scheme"]].add(x["url"])
    got = {r["scheme"]: (r["links"], r["urls"]) for r in registry.QUERIES["link_scheme_counts"](spark, data).collect()}
    assert got == {k: (n, len(urls[k])) for k, n in links.items()} and got


def plain_segments(text: str) -> list[str]:
    body = text[: lx.SEMANTIC_CHARS].replace("\1", " ").strip(BLANK)
    parts = [p for p in (x.strip(BLANK) for x in re.split(r"(?:[ \t]*\r?\n[ \t]*){2,}", body)) if p]
    if len(parts) == 1:
        lone = sentences(body)
        parts = lone if len(lone) > 1 else parts
    return parts[: lx.SEGMENTS]


def test_segment_spans(spark, data):
    from quillspark.plans import text_queries as tq

    texts = {r["doc_id"]: r["text"] for r in tq.table(spark, data, "documents").collect()}
    got = defaultdict(dict)
    for r in registry.QUERIES["segment_spans"](spark, data).collect():
        got[r["doc_id"]][r["idx"]] = r.asDict()
    for i, text in texts.items():
        want, at = [], 0
        view = text[: lx.SEMANTIC_CHARS].replace("\1", " ")
        for s in plain_segments(text):
            at = view.index(s, at)
            want.append((s, at, at + len(s)))
            at += len(s)
        assert len(got[i]) == len(want)
        for k, (s, a, b) in enumerate(want):
            r = got[i][k]
            assert (r["span_start"], r["span_end"]) == (a, b) and text[a:b] == s


def chance(node, x) -> float:
    """The share of class 1 in the leaf that a row comes to."""
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    stats = list(node.impurityStats().stats())
    return stats[1] / sum(stats)


def test_tree_scores(spark, data):
    from pyspark.sql import functions as F

    f = zn.features(zone_scores(spark, data), "msg_id").withColumn("is_ai", (F.col("mean_score") + (F.col("msg_id") % 10) / 50 > 0.55).cast("int"))
    root = md.fit_tree(f).stages[-1]._java_obj.rootNode()
    want = {r["msg_id"]: round(chance(root, [float(r[c]) for c in md.TREE_INPUTS]), 4) for r in f.collect()}
    got = {r["msg_id"]: r["score"] for r in registry.QUERIES["tree_scores"](spark, data).collect()}
    assert got == pytest.approx(want, abs=1e-4) and len(set(got.values())) > 1


@pytest.mark.parametrize("most", [10**6, 0])
def test_shared_passages_sent_or_shuffled(spark, data, monkeypatch, most):
    from quillspark.operators import dedupe

    monkeypatch.setattr(dedupe, "MOST_SENT", most)
    d, b = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    runs = defaultdict(set)
    for r in b.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        for i in range(len(w) - 7):
            runs[" ".join(w[i : i + 8])].add(r["item_id"])
    want = defaultdict(int)
    for r in d.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower())
        for g in {" ".join(w[i : i + 8]) for i in range(len(w) - 7)}:
            for item in runs.get(g, ()):
                want[r["doc_id"], item] += 1
    found = dedupe.shared_passages(d, b)
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) or not most
    assert {(r["doc_id"], r["item_id"]): r["shared"] for r in found.collect()} == dict(want) and want
