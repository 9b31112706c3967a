"""Each stage of the pipeline against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
import pytest

from quillspark.llm import mixing, quality
from quillspark.llm.common import staged
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in cp.STAGES:
        got = staged(stage(spark, docs, DATA), "t")
        out.append((name, docs, got))
        docs = got
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect())


def test_columns(stages, spark):
    want = spark.read.parquet(f"{DATA}/documents.parquet").columns
    for name, (_, after) in stages.items():
        assert name == "pack" or after.columns == want


def test_quality(stages, spark):
    before, after = stages["quality"]
    keep = {r["doc_id"] for r in quality.classify(before, quality.labels_of(spark, DATA)).where("predicted = 1").collect()}
    assert rows(after) == [r for r in rows(before) if r[0] in keep] and 0 < len(keep) < before.count()


def test_exact(stages):
    before, after = stages["exact_dedup"]
    last = {}
    for i, t, _ in rows(before):
        last[t] = i
    assert [r[0] for r in rows(after)] == sorted(last.values())


def test_near(stages):
    before, after = stages["near_dedup"]
    r = rows(before)
    _, roots = brute([t for _, t, _ in r], 5)
    assert rows(after) == [r[i] for i in sorted(set(roots))]


def test_mix(stages):
    before, after = stages["mix"]
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["size"]})
    assert Counter(r[0] for r in rows(after)) == +copies


def test_pack(stages):
    before, after = stages["pack"]
    check(after.collect(), rows(before))


def test_run_is_the_stages(stages, spark):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(cp.run(spark, DATA)) == key(stages["pack"][1])
    assert cp.ORACLE_SQL is None and 4 <= len(cp.STAGES) <= 5
