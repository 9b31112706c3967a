from __future__ import annotations

from collections import defaultdict

import pytest

from quillspark.llm import mixing as m
from quillspark.llm import registry
from tests.compare import rows_of, rows_of_sql


def test_query_against_sql(spark, data, duck):
    assert rows_of(registry.QUERIES["op6_mix"](spark, data)) == rows_of_sql(duck, registry.ORACLES["op6_mix"])


def brute_targets(sizes: dict, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 5}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 7}, {"x": 3}, {"a": 10, "b": 20, "c": 5, "d": 1000, "e": 1, "f": 50, "g": 2}])
def test_targets(spark, sizes):
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in m.targets(d).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_taken_is_near_target_and_capped(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 60)), "abcd"[i % 4] if i % 3 else "a") for i in range(4000)]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 60


def test_longer_documents_are_likelier(spark):
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "a" if i < 2000 else "b") for i in range(4000)]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 3.0), share=1.0).where("source = 'a'").collect()
    rate = {s: sum(r["copies"] for r in got if r["size"] == s) / 1000 for s in (4, 64)}
    assert rate[64] > rate[4] > 0


def test_edges(edge, nothing):
    got = m.mix(edge).collect()
    assert len(got) == edge.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert len({r["copies"] for r in got if r["doc_id"] == 6}) == 1
    assert m.mix(nothing).count() == 0
    again = m.mix(edge).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_stage_repeats_rows(edge, nothing):
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in m.mix(edge).collect() if r["size"]}
    out = m.take(edge)
    assert out.columns == edge.columns
    have = defaultdict(int)
    for r in out.collect():
        have[(r["doc_id"], r["source"])] += 1
    want = {k: v * (2 if k[0] == 6 else 1) for k, v in copies.items() if v}
    assert dict(have) == want and m.take(nothing).count() == 0


def test_no_python_in_plan(docs):
    plan = m.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
