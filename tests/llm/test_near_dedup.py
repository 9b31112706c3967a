from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import exact_dedup, graph, registry
from quillspark.llm import near_dedup as nd
from quillspark.llm import textkit as tk
from tests.llm.conftest import edge_rows, prose


def sets_of(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def brute(texts, n, percent=80):
    """(sizes, root of each text)"""
    sets, parent = sets_of(texts, n), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in having[g])
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            having[g].append(i)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_query_against_brute_force(spark, data, rows):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_near_dedup"](spark, data).collect()}
    sizes, roots = brute([t for _, t, _ in rows], 4)
    assert len(got) == len(rows)
    for (i, _, _), n, root in zip(rows, sizes, roots, strict=True):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, rows[root][0], rows[root][0] == i)


def crowd():
    """A large group of near copies at many distances, and a passage that most texts share."""
    r = random.Random(5)
    base, shared = prose(7, 80).split(), prose(8, 25)
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = prose(r.randrange(10**6), 1)
        texts.append(" ".join(w))
    return texts + [shared + " " + prose(100 + i, r.randint(2, 30)) for i in range(80)]


@pytest.mark.parametrize(("refine", "heavy"), [(64, 2000), (0, 2000), (2, 2), (64, 100_000)])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, refine, heavy):
    monkeypatch.setattr(nd, "BLOCK", 16)  # many blocks for a bucket
    monkeypatch.setattr(nd, "REFINE", refine)
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    texts = crowd()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(d).collect()}
    _, roots = brute(texts, 5)
    assert [got[i] for i in range(len(texts))] == roots


def test_edges(edge, nothing):
    got = nd.near_dedup(edge)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()]
    assert len(rows) == len(edge_rows())
    by = {r[0]: r for r in rows}
    assert by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True)
    assert {by[i][2] for i in (4, 5, 6, None)} == {4} and by[9][2] == 8 and by[12][1:] == (1, 12, True)
    assert nd.near_dedup(nothing).count() == 0
    kept = nd.keep_one_of_near(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 10, 11, 12]
    assert nd.keep_one_of_near(nothing).count() == 0


def test_repeated_and_null_ids_with_different_texts(spark):
    a, b, c, d = (prose(200 + i, 40) for i in range(4))
    near = lambda t, i: t + " " + prose(300 + i, 1)
    rows = [(1, a), (2, b), (2, near(a, 0)), (3, near(b, 1)), (None, c), (None, near(a, 2)), (None, ""), (4, d), (4, near(d, 3)), (4, d), (None, ""), (5, None)]
    got = nd.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _, roots = brute([t for _, t in rows], 5)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(rows[i]) for i in set(roots))
    marks = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count()
    assert marks == len(set(roots))


def test_shingles_equal_plain_sets():
    texts = ["A b c", "a B  c\td e\nf g", "", "x", "a b c d a b c d a b c d", "É é \x01"]
    for n in (1, 3, 5):
        (s,) = tk.slices(pa.array(texts))
        _, of = nd.shingle_sets(s, n)
        assert np.diff(of).tolist() == [len(x) for x in sets_of(texts, n)]


@pytest.mark.parametrize("n", [4, 5])
@pytest.mark.parametrize("words", range(7))
def test_shingles_of_a_slice_with_few_words(n, words):
    text = " ".join("abcdefg"[:words])
    (s,) = tk.slices(pa.array([text]))
    x, of = nd.shingle_sets(s, n)
    assert np.diff(of).tolist() == [len(x)] == [len(sets_of([text], n)[0])]
    # The set is the same beside other documents.
    (s,) = tk.slices(pa.array([text, prose(1, 20)]))
    y, of = nd.shingle_sets(s, n)
    assert (y[: of[1]] == x).all()


def test_least_matches_is_the_posterior():
    # A fine sum over similarities with a uniform prior.
    grid = (np.arange(100_000) + 0.5) / 100_000
    for n, m in nd.least_matches(80, 1e-3):
        for k, kept in ((m - 1, False), (m, True)):
            mass = grid**k * (1 - grid) ** (n - k)
            assert (mass[grid >= 0.8].sum() / mass.sum() >= 1e-3) is np.bool_(kept) or comb(n, k) < 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
