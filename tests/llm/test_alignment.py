from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import alignment as al
from quillspark.llm import registry, tokens
from quillspark.llm import textkit as tk
from tests.llm.conftest import edge_rows, frame, prose


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = al.default_tokenizers()
    one = Tokenizer.from_file(a)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=b), tokens.byte_entries(a), tokens.spaced_entries(b)


def brute(rows, tools):
    """doc_id and the seven columns for each row, by plain loops."""
    one, two, bytes_a, bytes_b = tools
    made, counts = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        if b"".join(bytes_a[x] for x in a) != raw or b"".join(bytes_b[x] for x in b) != raw:
            made.append((i, [], Counter()))
            continue
        ends = [list(itertools.accumulate(len(t[x]) for x in ids)) for ids, t in ((a, bytes_a), (b, bytes_b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            k = 0
            for x, e in zip(ids, ends[side], strict=True):
                groups[k][side].append(x)
                k += e == cuts[k]
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        made.append((i, groups, links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()))
        out.append((i, *n, sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items()), sha))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, data, rows, tools):
    got = [tuple(r) for r in registry.QUERIES["op12_alignment"](spark, data).collect()]
    assert sorted(got, key=repr) == brute([(i, t) for i, t, _ in rows], tools)


ODD = [" ", "  ", "a  b ", "\n\n x", "<|endoftext|> a<|endoftext|>", "<s> </s><unk>", "a▁b", "▁", "<0x41>", "\x00x\x00 y", "日本語 text 漢字", "😀 a😀a", "don't they're I'LL", "aaaa" * 700, "ab" * 300, "x y  z", "1234567890" * 40, "ﬁ①Å é", "\t\tif (x):\n\t\t\treturn", "=" * 500, "çéèàù" * 60]


@pytest.mark.parametrize("most", [al.FREQUENT, 40, 0])
def test_odd_texts_and_few_held_pairs(spark, tools, most):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(ODD) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 4))), "s") for i in range(120)] + [(1000 + i, t, "s") for i, t in enumerate(ODD)]
    got = [tuple(x) for x in al.align(frame(spark, rows), most=most).collect()]
    assert sorted(got, key=repr) == brute([(i, t) for i, t, _ in rows], tools)


def test_defined_cases(spark, edge, nothing, tools):
    got = al.align(edge)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute([(i, t) for i, t, _ in edge_rows()], tools)
    assert al.align(nothing).collect() == []


def test_union_find():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        u, v = r.integers(0, n, n // 2 + 1), r.integers(0, n, n // 2 + 1)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert al.union_find(n, u, v).tolist() == want
    chain = np.arange(5000)
    assert set(al.union_find(5001, chain, chain + 1).tolist()) == {0}
    assert al.union_find(3, chain[:0], chain[:0]).tolist() == [0, 1, 2]


def test_components_are_minimal_groups():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 60))
        ends = [np.unique(np.append(r.integers(1, n + 1, int(r.integers(0, n + 1))), n)) for _ in range(2)]
        cuts = np.intersect1d(*ends)
        for got, e in zip(al.groups_of(*ends), ends, strict=True):
            assert got.tolist() == np.searchsorted(cuts, e).tolist()


def test_long_groups_expand_in_parts(monkeypatch):
    r = np.random.default_rng(4)
    sizes = r.integers(1, 6, (2, 40))
    ga, gb = (np.repeat(np.arange(40), s) for s in sizes)
    ids = [r.integers(0, 5, len(g)) for g in (ga, gb)]
    doc = np.arange(40) // 7
    want = Counter((int(doc[g]), int(a) * 5 + int(b)) for g in range(40) for a in ids[0][ga == g] for b in ids[1][gb == g])
    for limit in (al.EXPAND, 3, 1):
        monkeypatch.setattr(al, "EXPAND", limit)
        got = al.links_of(ids[0], ids[1], ga, gb, doc, 5, 5)
        assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want


def test_pieces_equal_whole_texts(tools):
    """Cutting before spaces gives the library's ids of whole texts."""
    one, two, _, _ = tools
    texts = [prose(i, 40) + " " * (i % 4) + ODD[i % len(ODD)] for i in range(60) if "▁" not in ODD[i % len(ODD)]]
    a, b = tokens.aligned_encoders(*al.default_tokenizers())
    for enc, want in ((a, [one.encode(" " + t, add_special_tokens=False).ids for t in texts]), (b, two.encode(texts))):
        for s in tk.slices(pa.array([" " + t for t in texts], pa.large_string())):
            ids, of = enc.slice_ids(s)
            assert [ids[of[i] : of[i + 1]].tolist() for i in range(s.n)] == want[s.first : s.first + s.n]
