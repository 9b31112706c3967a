from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import fim, registry
from quillspark.llm import textkit as tk
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import edge_rows, frame


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_fim(doc_id, text):
    t = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t, re.DOTALL)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return (doc_id, len(w), "plain", None, None, t)
    if h4 % 100 < 20:
        return (doc_id, len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_query_against_sql_and_brute_force(spark, data, duck, rows):
    df = registry.QUERIES["op13_fim"](spark, data)
    assert rows_of(df) == rows_of_sql(duck, registry.ORACLES["op13_fim"])
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted((*plain_fim(i, t)[:5], sha(plain_fim(i, t)[5]), sha(t or "")) for i, t, _ in rows)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


ODD = ["<", "<<", "<P", "S>", "<P>", "a<S>b", "<M", "a<", ">b", "<S<M", "é", "日本語 text 漢字", "😀a😀", "a\nb\r\n\tc", "ab" * 3000, "1" * 3000, "\x00x\x00", "aéb日c😀d", "  ", "x"]


def test_odd_texts_and_restoring(spark):
    rows = [(i, ODD[i % len(ODD)], "s") for i in range(400)]
    made = fim.fill_in_middle(frame(spark, rows))
    got = made.withColumn("back", fim.restored(made["output"], made["form"])).collect()
    want = {i: (t, plain_fim(i, t)) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        text, expected = want[r["doc_id"]]
        assert tuple(r)[:6] == expected and r["back"] == text


def test_defined_cases(spark, edge, nothing):
    made = fim.fill_in_middle(edge)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted((plain_fim(i, t) for i, t, _ in edge_rows()), key=key)
    assert fim.fill_in_middle(nothing).collect() == []
    assert fim.run_table(nothing).collect() == []


def test_rates(spark, docs):
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=100, spm_rate=100).collect()} == {"spm"}
    assert fim.fill_in_middle(docs, seed=2).exceptAll(fim.fill_in_middle(docs)).count() > 0


def test_runs_are_maximal_and_find_every_cut(spark):
    texts = [*ODD, "", "Ab, c"]
    (s,) = tk.slices(pa.array(texts, pa.large_string()))
    r = fim.class_runs(s)
    for i, t in enumerate(texts):
        w = re.findall("[A-Za-z]+|[^A-Za-z]", t, re.DOTALL)
        assert r.units()[i] == len(w)
        kinds = r.kind[r.of[i] : r.of[i + 1]].tolist()
        assert all(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        for u in range(len(w) + 1 if t else 0):
            char, byte = r.place(np.array([i]), np.array([u]))
            head = "".join(w[:u])
            assert (char[0], byte[0]) == (len(head), len(head.encode()))
    table = {x["doc_id"]: x for x in fim.run_table(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    last = table[len(texts) - 1]
    assert (last["n_units"], last["n_chars"], last["kinds"], last["chars"], last["units"]) == (4, 5, [5, 1, 5], [0, 2, 4], [0, 1, 3])
    assert table[len(texts) - 2]["kinds"] == []


@pytest.mark.parametrize("text", ["<P" + "x" * 50, "<" * 60, "<S>" * 3])
def test_sentinels_across_cuts(spark, text):
    got = fim.fill_in_middle(frame(spark, [(i, text, "s") for i in range(60)]))
    assert {r["back"] for r in got.select(fim.restored(got["output"], got["form"]).alias("back")).collect()} == {text}
