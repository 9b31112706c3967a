from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from quillspark.llm import lattice as lt
from quillspark.llm import registry


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows):
    """(held out, tokens, known, all, base score) of each row."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows]
    c = Counter()
    for (_, t, _), h in zip(rows, held, strict=True):
        if not h:
            c.update([*words_of(t), "\n"])
    n, v = sum(c.values()), len(c)
    out = []
    for (_, t, _), h in zip(rows, held, strict=True):
        w = [*words_of(t), "\n"]
        out.append((h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


@pytest.mark.parametrize("most", [lt.FREQUENT, 50])
def test_query_against_brute_force(spark, data, rows, monkeypatch, most):
    monkeypatch.setattr(lt, "FREQUENT", most)
    monkeypatch.setattr(lt.frequent, "__defaults__", (most,))
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_lattice"](spark, data).collect()}
    assert len(got) == len(rows)
    for (i, _, _), want in zip(rows, base(rows), strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4]
        assert r["base_score"] == pytest.approx(want[4], abs=1e-6) and r["score"] < 0


def test_marginal_is_the_sum_over_all_cuts():
    lattice, p = lt._start(lt.default_vocabulary())
    pieces, _ = lt.read_pieces(lt.default_vocabulary())
    index = {x: i for i, x in enumerate(pieces)}

    def total(word: bytes) -> float:
        @lru_cache(None)
        def go(at: int) -> float:
            if at == len(word):
                return 1.0
            return sum(p[index[word[at:b]]] * go(b) for b in range(at + 1, len(word) + 1) if word[at:b] in index)

        return go(0)

    words = [b"the", b"tion", "élan".encode(), b"x", "漢字".encode(), b"wholeness"]
    for own, chars in lt.by_length(words):
        arcs = lattice.arcs(chars)
        logs = lattice.forward(arcs, np.log(p))[:, -1]
        for i, x in zip(own.tolist(), logs, strict=True):
            assert math.exp(x) == pytest.approx(total(lt.MARK + words[i]), rel=1e-9)
        # Expected counts: bytes covered by all pieces are the word's bytes.
        counts = np.zeros(len(p))
        lattice.expected(arcs, np.log(p), np.ones(len(own)), counts)
        assert (counts * [len(x) for x in pieces]).sum() == pytest.approx(chars.size)


def plain_model(rows):
    """Score of each row by plain loops: one round of expected counts over training words, then marginals."""
    pieces, scores = lt.read_pieces(lt.default_vocabulary())
    p = {x: 1 / (lt.OFFSET - s) for x, s in zip(pieces, scores.tolist(), strict=True)}
    whole = sum(p.values())
    p = {x: v / whole for x, v in p.items()}
    longest = max(map(len, pieces))

    def arcs(word):
        w = lt.MARK + word.encode()
        return w, [(a, b, w[a:b]) for b in range(1, len(w) + 1) for a in range(max(0, b - longest), b) if w[a:b] in p]

    def forward(w, found, weight):
        alpha = [1.0] + [0.0] * len(w)
        for a, b, x in found:
            alpha[b] += alpha[a] * weight[x]
        return alpha

    cut = {w: arcs(w) for w in {w for _, t, _ in rows for w in words_of(t)}}
    train = [words_of(t) for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    n = {x: lt.PRIOR * v for x, v in p.items()}
    for word, c in Counter(w for t in train for w in t).items():
        w, found = cut[word]
        alpha, beta = forward(w, found, p), [0.0] * len(w) + [1.0]
        for a, b, x in reversed(found):
            beta[a] += beta[b] * p[x]
        for a, b, x in found:
            n[x] += c * alpha[a] * p[x] * beta[b] / alpha[-1]
    end = len(train) + lt.PRIOR / len(p)
    whole = sum(n.values()) + end
    q = {x: v / whole for x, v in n.items()}
    logs = {word: math.log10(forward(w, found, q)[-1]) for word, (w, found) in cut.items()}
    return [math.log10(end / whole) + sum(logs[w] for w in words_of(t)) for _, t, _ in rows]


def test_scores_against_plain_loops(spark, docs):
    some = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.where("doc_id < 60").collect())
    got = {r["doc_id"]: r["score"] for r in lt.score(docs.where("doc_id < 60")).collect()}
    for (i, _, _), want in zip(some, plain_model(some), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 14])
def test_long_words_equal_short_ones(monkeypatch, chunk):
    monkeypatch.setattr(lt, "CHUNK", chunk)
    lattice, p = lt._start(lt.default_vocabulary())
    logp = np.log(p)
    for word in ("internationalization" * 9, "é漢" * 50, "x" * 65, "the" + "quick" * 40 + "😀"):
        chars = np.frombuffer(lt.MARK + word.encode(), dtype=np.uint8)
        arcs = lattice.arcs(chars[None, :])
        assert lattice.forward_long(chars, logp) == pytest.approx(lattice.forward(arcs, logp)[0, -1], rel=1e-12)
        short, long = np.zeros(len(p)), np.zeros(len(p))
        lattice.expected(arcs, logp, np.array([3.0]), short)
        lattice.expected_long(chars, logp, 3.0, long)
        assert np.abs(short - long).max() < 1e-8


def test_a_text_without_spaces(spark):
    import resource
    import time

    lattice, p = lt._start(lt.default_vocabulary())
    r = np.random.default_rng(1)
    word = r.choice(np.frombuffer(b"etaoinshrdlucmfwypvbgk", dtype=np.uint8), 1_000_000)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    whole = lattice.forward_long(word, np.log(p))
    assert np.isfinite(whole) and time.perf_counter() - began < 60
    # Kilobytes: chunks, and not the arcs of the whole word.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    text = "".join(map(chr, word[:60_000].tolist()))
    got = {x["doc_id"]: x for x in lt.score(spark.createDataFrame([(0, text), (1, text), (2, "a few words")], "doc_id long, text string")).collect()}
    assert got[0]["n_tokens"] == 2 and got[0]["score"] == got[1]["score"] < -60_000


def test_words_common_only_in_held_out_documents_are_frequent(spark):
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    d = spark.createDataFrame([(i, "unseen " * 9 + f"w{i}" if i in out else f"seen s{i}") for i in range(400)], "doc_id long, text string")
    vocab = lt.vocabulary(d)
    words = {r["word"].decode(): (r["c"], r["n"]) for r in vocab.collect()}
    assert words["unseen"] == (0, 9 * len(out)) and words["seen"] == (400 - len(out),) * 2
    top = {r["h"] for r in lt.frequent(vocab, 2).collect()}
    assert {r["word"] for r in vocab.collect() if r["h"] in top} == {b"unseen", b"seen"}


def test_learning_raises_the_likelihood(spark):
    d = spark.createDataFrame([(i, "walking talking walking stalking") for i in range(40)], "doc_id long, text string")
    vocab = lt.vocabulary(d).cache()
    before = np.log10(lt._start(lt.default_vocabulary())[1])
    after, _ = lt.learn(vocab, lt.default_vocabulary(), 40)
    total = lambda logp: sum(r["c"] * r["lp"] for r in lt.word_scores(vocab, lt.default_vocabulary(), logp).collect())
    assert total(after) > total(before)
    assert (10**after).sum() < 1


def test_edges(edge, nothing):
    from tests.llm.conftest import edge_rows

    got = lt.score(edge).collect()
    want = Counter((i, h, n, k, round(b, 4)) for (i, _, _), (h, n, k, _, b) in zip(edge_rows(), base(edge_rows()), strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(np.isfinite(r["score"]) for r in got) and lt.score(nothing).count() == 0
    end = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(end) == 1


def test_without_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lt.score(spark.createDataFrame([(held, "one word")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_known"], r["train_tokens"]) == (True, 0, 0) and r["base_score"] == pytest.approx(0)
