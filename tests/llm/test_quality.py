from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa

from quillspark.llm import quality as q
from quillspark.llm import registry
from quillspark.llm import textkit as tk


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = registry.QUERIES["op4_quality"](spark, data).collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([a for a, b in held if b == 1]) >= 0.98


def test_labels_of_held_out_rows_are_never_used(spark, docs):
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    flip = lambda bad: spark.createDataFrame([(i, (i % 2) if zlib.crc32(str(i).encode()) % 4 != 2 else bad) for i in ids], "doc_id long, quality int")
    a, b = q.fit(docs, flip(0)), q.fit(docs, flip(1))
    assert (a.weight == b.weight).all() and a.shift == b.shift


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(4, 1), (7, 0), (10, 1), (None, 1), (11, None), (4, 1)], "doc_id long, quality int")
    got = q.classify(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (4, 6, None)}) == 1
    assert q.classify(nothing, labels).count() == 0
    assert {r["score"] for r in q.classify(edge, labels.where("false")).collect()} == {0.5}
    kept = q.keep_good(edge, labels, 0.0)
    assert kept.columns == edge.columns and kept.count() == edge.count() and q.keep_good(nothing, labels).count() == 0


def test_score_equals_the_average_of_vectors(spark, docs):
    rng = np.random.default_rng(0)
    model = q.Model(rng.normal(size=q.BUCKETS), 0.25)
    got = {r["doc_id"]: r["score"] for r in q.score(docs, model).collect()}
    for r in q.bags(docs).collect():
        b, n = np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["counts"], "<u4")
        z = 0.25 + (model.weight[b] * n).sum() / max(n.sum(), 1)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-9


def test_features_against_plain_code(rows):
    """Equal words, pairs and grams share a bucket wherever they stand; counts are those of plain loops."""
    texts = [t for _, t, _ in rows[:40]] + ["", "a", "ab cé  ab", "é\n漢字 漢字"]
    seen: dict = {}
    for s in tk.slices(pa.array(texts), 1 << 12):
        found = [[] for _ in range(s.n)]
        for kind, (at, b) in enumerate(q._features(s)):
            for doc, x in zip((np.searchsorted(s.offsets, at, side="right") - 1).tolist(), b.tolist(), strict=True):
                found[doc].append((kind, x))
        for i in range(s.n):
            words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", texts[s.first + i]) if w]
            want = [(0, w) for w in words] + [(1, p) for p in zip(words, words[1:], strict=False)]
            want += [(2 + j, w[a : a + k]) for j, k in enumerate(q.GRAMS) for w in words for a in range(len(w) - k + 1)]
            assert sorted(k for k, _ in found[i]) == sorted(k for k, _ in want)
            for have, name in zip(sorted(found[i], key=lambda x: x[0]), sorted(want, key=lambda x: x[0]), strict=True):
                assert have[0] == name[0] and seen.setdefault(name, have[1]) == have[1]
    # As many buckets as that many names would meet by chance.
    assert abs(len(set(seen.values())) / (q.BUCKETS * (1 - math.exp(-len(seen) / q.BUCKETS))) - 1) < 0.02


def plain_training(rows, prior, epochs, seed):
    """The same descent in plain loops and double precision."""
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / q.DIM, 1 / q.DIM, (q.BUCKETS, q.DIM)).astype(np.float32).astype(float).tolist()
    layer = rng.normal(0, 0.1, (q.DIM, 2)).astype(np.float32).astype(float).tolist()
    bias, steps, step = [0.0, 0.0], epochs * -(-len(rows) // 32), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows)).tolist()
        for a in range(0, len(order), 32):
            rate, step = q.RATE * (1 - step / steps), step + 1
            batch = [rows[i] for i in order[a : a + 32] if len(rows[i][0])]
            change, d_layer, d_bias = {}, [[0.0, 0.0] for _ in range(q.DIM)], [0.0, 0.0]
            for buckets, counts, y in batch:
                total = sum(counts.tolist())
                x = [sum(c / total * v[b][d] for b, c in zip(buckets.tolist(), counts.tolist(), strict=True)) for d in range(q.DIM)]
                z = [sum(x[d] * layer[d][k] for d in range(q.DIM)) + bias[k] for k in (0, 1)]
                e = [math.exp(t - max(z)) for t in z]
                g = [t / sum(e) - (k == y) for k, t in enumerate(e)]
                for d in range(q.DIM):
                    for k in (0, 1):
                        d_layer[d][k] += x[d] * g[k] / len(batch)
                for k in (0, 1):
                    d_bias[k] += g[k] / len(batch)
                for b, c in zip(buckets.tolist(), counts.tolist(), strict=True):
                    own = change.setdefault(b, [0.0] * q.DIM)
                    for d in range(q.DIM):
                        own[d] += c / total * (layer[d][0] * g[0] + layer[d][1] * g[1])
            for b, own in change.items():
                for d in range(q.DIM):
                    v[b][d] -= rate * own[d]
            for d in range(q.DIM):
                for k in (0, 1):
                    layer[d][k] -= rate * d_layer[d][k]
            for k in (0, 1):
                bias[k] -= rate * d_bias[k]
    ones = sum(y for _, _, y in rows)
    weight = [sum(v[b][d] * (layer[d][1] - layer[d][0]) for d in range(q.DIM)) for b in range(q.BUCKETS)]
    return weight, bias[1] - bias[0] + prior - math.log(max(ones, 0.5) / max(len(rows) - ones, 0.5))


def test_training_against_plain_loops(monkeypatch):
    monkeypatch.setattr(q, "BUCKETS", 50)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        buckets = np.sort(rng.choice(50, size=rng.integers(0, 12) if i % 7 else 0, replace=False))
        rows.append((buckets.astype("<u4"), rng.integers(1, 5, len(buckets)).astype("<u4"), int(rng.random() < 0.3 + 0.5 * (3 in buckets))))
    got = q.train(rows, 0.4, epochs=5, seed=11)
    weight, shift = plain_training(rows, 0.4, 5, 11)
    assert np.abs(got.weight - weight).max() < 1e-3 and abs(got.shift - shift) < 1e-3
    assert np.abs(weight).max() > 0.5


def test_many_rows_of_one_labelled_id(spark):
    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    d = spark.createDataFrame([(one, "")] * 3000 + [(one, "good words here")] * 50 + [(two, "bad bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), (two, 0)], "doc_id long, quality int")
    seen = []
    train = q.train
    q.train = lambda rows, prior: seen.append(len(rows)) or train(rows, prior)
    try:
        q.fit(d, labels)
    finally:
        q.train = train
    assert seen == [2]


def test_grams_stay_within_words():
    (s,) = tk.slices(pa.array(["ab cé", ""]))
    kinds = [len(b) for _, b in q._features(s)]
    # Two words, a pair of words, two pairs of characters, no longer runs.
    assert kinds == [2, 1, 2, 0, 0]


def test_without_labels_all_documents_stay(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.keep_good(edge, none).count() == edge.count()
    unlabelled = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert q.keep_good(edge, unlabelled).count() == edge.count()
