from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from quillspark.llm import registry
from quillspark.llm import spotsigs as sp
from quillspark.llm import textkit as tk
from tests.llm.conftest import edge_rows, frame, prose


def plain_spots(text, chain=sp.CHAIN, anchors=sp.ANCHORS):
    """Signatures as tuples of words, by plain loops; (True, text) for a text without any."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", low)
    out = set()
    for i in range(-1, len(words)):
        if i >= 0 and words[i] not in anchors:
            continue
        following = [w for w in words[i + 1 :] if w not in anchors][:chain]
        if following:
            out.add((words[i] if i >= 0 else None, *following))
    return out or ({(True, text)} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_compare(rows):
    """The columns of compared() but for fingerprints, by the next document in order of doc_id; ids must differ."""
    rows = sorted(rows)
    out = {}
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(t) // 2
        other = t[: len(t) - k] + nxt[:k]
        a, b, c = plain_spots(t), plain_spots(other), plain_spots(nxt)
        out[i] = (len(t), hashlib.sha256(other.encode()).hexdigest(), len(a), len(b), jaccard(a, b), jaccard(a, c))
    return out


def shape(r):
    return (r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 8, len(r["edited_fingerprint"]) // 8, r["near_edited"], r["near_next"])


def test_query_against_brute_force(spark, data, rows):
    got = registry.QUERIES["op11_spotsigs"](spark, data).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"}
    want = plain_compare([(i, t or "") for i, t, _ in rows])
    assert len(got) == len(want) and {r["doc_id"]: shape(r) for r in got} == want
    prints = {i: plain_spots(t) for i, t, _ in rows}
    by_print = {}
    for r in got:
        by_print.setdefault(r["fingerprint"], prints[r["doc_id"]])
        assert by_print[r["fingerprint"]] == prints[r["doc_id"]] and sp.read_back(r["fingerprint"]).tolist() == sorted(set(sp.read_back(r["fingerprint"]).tolist()))
    # An edited text keeps about a third of its likeness; the next document shares nothing but copies.
    long = [r for r in got if r["n_spots"] >= 20]
    assert long and sum(r["near_edited"] > max(0.15, r["near_next"]) for r in long) >= 0.97 * len(long)


@pytest.mark.parametrize(("parts", "copies"), [(1, 1), (4, 1), (16, 1)])
def test_order_with_gaps_and_few_rows(spark, monkeypatch, parts, copies):
    monkeypatch.setattr(sp, "PARTS", parts)
    r = random.Random(parts)
    for n in (1, 2, 3, 40):
        rows = [(r.randrange(10**12) - 10**11, prose(i, r.randint(0, 30)), "s") for i in range(n)]
        got = sp.compared(frame(spark, rows).repartition(3)).collect()
        assert len(got) == n and {x["doc_id"]: shape(x) for x in got} == plain_compare([(i, t) for i, t, _ in rows])


def test_one_id_for_many_rows(spark):
    """An id that most rows share takes many parts, and rows stay in one circle."""
    rows = [(7, prose(i, 12), "s") for i in range(300)] + [(i, prose(1000 + i, 12), "s") for i in (1, 2, 9)] + [(None, prose(2000, 9), "s")]
    got = sp.compared(frame(spark, rows).repartition(5)).collect()
    assert sorted(len(t) for _, t, _ in rows) == sorted(r["n_chars"] for r in got)
    texts = [t for _, t, _ in rows]
    edits = {hashlib.sha256(sp.edited(a, b).encode()).hexdigest() for a in texts for b in texts}
    assert all(r["edited_sha256"] in edits for r in got) and len({r["edited_sha256"] for r in got}) == len(rows)
    dealt = sp.in_order(frame(spark, rows).repartition(5)).where("doc_id = 7 AND tail = 0").groupBy("part").count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 100


def test_defined_cases(spark, edge, nothing):
    got = sp.compared(edge).collect()
    assert len(got) == len(edge_rows()) and sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t, _ in edge_rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["fingerprint"] for r in by[1] + by[2]] == ["", ""] and by[1][0]["near_next"] == 1.0
    # Row 6 is there twice: one copy's next document is the other one.
    assert sorted(r["near_next"] == 1.0 for r in by[6]) == [False, True]
    assert by[4][0]["fingerprint"] == by[6][0]["fingerprint"] == by[None][0]["fingerprint"]
    assert by[3][0]["fingerprint"] and len(by[3][0]["fingerprint"]) == 8
    assert sp.compared(nothing).collect() == [] and sp.fingerprints(nothing).collect() == [] and sp.near_groups(nothing).collect() == []
    plain = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in sp.fingerprints(edge).collect()}
    assert all(plain[(r["doc_id"], r["n_chars"])] == r["fingerprint"] for r in got)


def test_anchors_and_chains(spark):
    spot = sp.Spotter()
    texts = ["The cat of mine, and THE dog", "cat mine dog", "the of and", "of", "...", "", "für Ärger über die Häuser", "the cat; of (mine) and\nthe dog!"]
    x, of = spot.of_texts(texts)
    sets = [set(x[of[i] : of[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(plain_spots(t)) for t in texts]
    assert sets[0] == sets[7] and not sets[0] & sets[2] and len(sets[1] & sets[0]) == 1 and sets[2] != sets[3]
    none = sp.Spotter(anchors=())
    assert [b - a for a, b in zip(none.of_texts(texts)[1], none.of_texts(texts)[1][1:], strict=False)] == [1, 1, 1, 1, 1, 0, 1, 1]


def test_size_partitions():
    for percent in (50, 80, 95):
        n = np.arange(1, 400)
        part = sp.size_part(n, percent)
        for a in n:
            for b in n[a - 1 :]:
                if 100 * a >= percent * b:
                    assert part[b - 1] - part[a - 1] in (0, 1)


def test_pruned_likeness():
    r = np.random.default_rng(0)
    sets = [[np.unique(r.integers(0, 30, int(r.integers(0, 25)))) for _ in range(300)] for _ in range(2)]
    flat = [v for s in sets for v in (np.concatenate(s).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in s])]))]
    for percent in (0, 30, 80):
        for got, a, b in zip(sp.likeness(*flat, percent), *(map(set, (x.tolist() for x in s)) for s in sets), strict=True):
            want = jaccard(a, b)
            assert got == (want if want * 100 >= percent - 1e-9 or not (a or b) else 0.0)


def plain_groups(texts, percent=80):
    sets, parent = [plain_spots(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def crowd(n=260):
    """Near copies at many distances, chains of edits, copies, a passage that many share, and sizes on both sides of partitions."""
    r = random.Random(6)
    words = [w for w in prose(9, 700).split() if len(w) > 2]
    common = ["the", "of", "and", "to"]

    def some(k):
        return [x for _ in range(k) for x in (r.choice(common), r.choice(words), r.choice(words), r.choice(words))]

    base, passage = some(40), some(30)
    texts = []
    for _ in range(n):
        t = base[:]
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t[: len(t) - r.randrange(0, 30)]))
    chain = some(30)
    for _ in range(40):
        chain = chain[:]
        chain[r.randrange(len(chain))] = r.choice(words)
        texts.append(" ".join(chain))
    texts += [" ".join(passage + some(r.randint(1, 12))) for _ in range(120)]
    texts += [prose(i, r.randint(0, 60)) for i in range(60)] + ["", "the of", "the of", "x"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [sp.BLOCK, 32])
def test_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sp, "BLOCK", block)
    texts = crowd()
    want = plain_groups(texts)
    got = {x["doc_id"]: x for x in sp.near_groups(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(4)).collect()}
    assert [got[i]["group_id"] for i in range(len(texts))] == want
    assert [got[i]["n_spots"] for i in range(len(texts))] == [len(plain_spots(t)) for t in texts]
    assert len(set(want)) < len(texts) - 100


def test_groups_of_odd_rows(spark, edge):
    got = sorted((repr(r["doc_id"]), r["group_id"]) for r in sp.near_groups(edge).collect())
    assert got == sorted([("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 4 if jaccard(plain_spots(edge_rows()[3][1]), plain_spots(edge_rows()[4][1])) >= 0.8 else 5), ("6", 4), ("6", 4), ("None", 4), ("7", 7), ("8", 8), ("9", 8), ("10", 10), ("11", 11), ("12", 12)])


def test_groups_of_documents(spark, docs, rows):
    got = {r["doc_id"]: r["group_id"] for r in sp.near_groups(docs).collect()}
    want = plain_groups([t for _, t, _ in rows])
    assert got == {i: rows[w][0] for (i, _, _), w in zip(rows, want, strict=True)}


def test_slices_do_not_matter(monkeypatch):
    texts = [prose(i, 50) for i in range(30)]
    x, of = sp.Spotter().of_texts(texts)
    monkeypatch.setattr(tk.slices, "__defaults__", (64,))
    y, yo = sp.Spotter().of_texts(texts)
    assert np.array_equal(x, y) and np.array_equal(of, yo)
