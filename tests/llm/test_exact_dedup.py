from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup as e
from quillspark.llm import registry
from quillspark.llm.common import scratch
from tests.compare import rows_of, rows_of_sql


def test_query_against_sql(spark, data, duck):
    assert rows_of(registry.QUERIES["op8_exact_dedup"](spark, data)) == rows_of_sql(duck, registry.ORACLES["op8_exact_dedup"])


def test_edges(spark, edge, nothing):
    got = e.dedup(edge, e.DigestIndex(spark, scratch(spark, "t"))).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["text_sha256"]].append(r)
    assert len(got) == edge.count()
    for g in groups.values():
        assert sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)}
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert {r["keep_id"] for r in g} == {max(ids)}
    assert {r["keep_id"] for r in groups[hashlib.sha256(b"").hexdigest()]} == {2}
    assert e.dedup(nothing, e.DigestIndex(spark, scratch(spark, "t"))).count() == 0


def test_stage_keeps_columns_and_one_of_each(edge, nothing):
    kept = e.keep_first_of_equals(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] in (1, 2, 4, 6, None)) == [(False, 2), (False, 6)]
    assert e.keep_first_of_equals(nothing).count() == 0


def frame(spark, *rows):
    return spark.createDataFrame([*rows], "doc_id long, text string")


def answer(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_index_persists_and_appends(spark):
    path = scratch(spark, "index")
    first = e.dedup(frame(spark, (1, "a"), (2, "a"), (3, "b")), e.DigestIndex(spark, path))
    assert answer(first) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    # Another session of the index: opened again from its files.
    index = e.DigestIndex(spark, path)
    assert answer(e.dedup(frame(spark, (9, "a"), (10, "c"), (3, "b")), index)) == [(3, 3, 1, False), (9, 2, 1, False), (10, 10, 1, True)]
    assert sorted(r["keep_id"] for r in index.read().collect()) == [2, 3, 10]
    e.dedup(frame(spark, (9, "a"), (10, "c")), index)
    assert index.read().count() == 3


def test_a_batch_sent_again_gets_its_first_answer(spark):
    path = scratch(spark, "index")
    one, two = frame(spark, (1, "a"), (2, "a"), (3, "b")), frame(spark, (4, "a"), (5, "c"))
    first = answer(e.dedup(one, e.DigestIndex(spark, path), batch="1"))
    # The answer was lost after the index had been written.
    assert answer(e.dedup(one, e.DigestIndex(spark, path), batch="1")) == first
    second = answer(e.dedup(two, e.DigestIndex(spark, path), batch="2", parts=2))
    assert second == [(4, 2, 1, False), (5, 5, 1, True)]
    assert answer(e.dedup(one, e.DigestIndex(spark, path), batch="1", parts=3)) == first
    assert answer(e.dedup(two, e.DigestIndex(spark, path), batch="2")) == second
    assert e.DigestIndex(spark, path).read().count() == 3


def test_a_batch_of_which_only_a_part_was_appended(spark):
    index = e.DigestIndex(spark, scratch(spark, "index"))
    rows = frame(spark, *[(i, str(i % 40)) for i in range(100)])
    index.create(100)
    index.append(e.groups_of(e.digests(rows.where("doc_id >= 80"))), "b")
    got = answer(e.dedup(rows, index, batch="b", parts=2))
    last = {str(i % 40): i for i in range(100)}
    assert got == sorted((i, last[str(i % 40)], 3 if i % 40 < 20 else 2, last[str(i % 40)] == i) for i in range(100))


def test_parts_equal_one_batch(spark, edge):
    key = lambda df: sorted((r["doc_id"] is None, r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    whole = key(e.dedup(edge, e.DigestIndex(spark, scratch(spark, "t"))))
    for parts in (2, 5):
        assert key(e.dedup(edge, e.DigestIndex(spark, scratch(spark, "t")), parts=parts)) == whole


def test_index_is_bucketed(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    path = scratch(spark, "index")
    index = e.DigestIndex(spark, path, buckets=4)
    e.dedup(rows, index)
    # Opened again with another number: the one that was written counts, so all texts are known.
    for other in (index, e.DigestIndex(spark, path, buckets=8)):
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {other.table}").collect()}
        assert described["Num Buckets"] == "4" and "digest" in described["Sort Columns"]
    assert not any(r["kept"] for r in e.dedup(rows, e.DigestIndex(spark, path, buckets=8)).collect())
    large = e.DigestIndex(spark, scratch(spark, "index"))
    large.create(100 * e.PER_BUCKET)
    assert large.buckets == 128


def test_the_query_goes_through_the_index(spark, docs, monkeypatch):
    plans = []
    append = e.DigestIndex.append

    def seen(self, groups, batch):
        before = self.read().count()
        plans.append((before, groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()))
        append(self, groups, batch)

    monkeypatch.setattr(e.DigestIndex, "append", seen)
    e.dedup(docs, e.DigestIndex(spark, scratch(spark, "t")), parts=e.PARTS)
    assert len(plans) == e.PARTS and plans[0][0] == 0 and plans[1][0] > 0
    assert all("SortMergeJoin" in p and "LeftAnti" in p for _, p in plans)


def test_stage_with_repeated_and_null_ids_of_other_texts(spark):
    rows = [(3, "a", "s"), (5, "b", "s"), (5, "a", "s"), (None, "c", "s"), (None, "d", "t"), (None, "d", "t"), (7, "d", "u"), (8, "e", "u"), (8, "e", "u")]
    got = e.keep_first_of_equals(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [(5, "b", "s"), (5, "a", "s"), (None, "c", "s"), (7, "d", "u"), (8, "e", "u")]))


@pytest.mark.parametrize(("bits", "maps"), [(16, 1 << 13), (1, 1)])
def test_rows_that_stay_by_bitmap(spark, monkeypatch, bits, maps):
    # One row of the bitmap for all keys: far more rows are marked than go.
    monkeypatch.setattr(e, "BITS_PER_KEY", bits)
    monkeypatch.setattr(e, "MOST_MAPS", maps)
    monkeypatch.setattr(e, "MAP_BITS", 1 << 15)
    rows = [(i if i % 11 else None, f"t{i % 30_000}") for i in range(40_000)]
    got = e.keep_first_of_equals(spark.createDataFrame(rows, "doc_id long, text string"))
    best: dict = {}
    for i, t in rows:
        best[t] = max(best.get(t, (False, 0)), (i is not None, i or 0))
    assert sorted((t, i) for i, t in map(tuple, got.collect()) if i is not None) == sorted((t, i) for t, (has, i) in best.items() if has)
    assert got.count() == 30_000


def test_bitmap_marks_exactly_the_places(spark):
    places = [0, 7, 8, 32_767, 32_768, 99_999, 131_071]
    got = e.bitmap(spark.createDataFrame([(p,) for p in places * 2], "p long"), F.col("p"), 4).collect()
    assert sorted(r["map"] * e.MAP_BITS + i for r in got for i in range(e.MAP_BITS) if r["bits"][i // 8] >> i % 8 & 1) == places


def test_heavy_digests(spark, monkeypatch):
    monkeypatch.setattr(e, "HEAVY", 3)
    d = spark.createDataFrame([(i, "same" if i % 3 else str(i)) for i in range(600)], "doc_id long, text string")
    got = e.dedup(d, e.DigestIndex(spark, scratch(spark, "t"))).where("text_sha256 = sha2('same', 256)").collect()
    assert len(got) == 400 and {r["keep_id"] for r in got} == {599} and {r["group_size"] for r in got} == {400}


def test_no_python_in_plan(docs, spark):
    plan = e.dedup(docs, e.DigestIndex(spark, scratch(spark, "t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_compaction_leaves_one_sorted_file_a_bucket(spark, docs):
    """After several batches; answers stay, other sessions open what is there, and old files go."""
    path = scratch(spark, "index")
    index = e.DigestIndex(spark, path, buckets=4)
    parts = [docs.where(f"doc_id % 5 = {i}") for i in range(5)]
    before = [sorted(map(tuple, e.dedup(d, index, batch=str(i)).drop("rid").collect())) for i, d in enumerate(parts)]
    held = sorted((bytes(r["digest"]), r["keep_id"], r["batch"]) for r in index.read().collect())
    assert index.files() > 4 and index.compact() and not index.compact()
    assert index.files() <= 4 and sorted((bytes(r["digest"]), r["keep_id"], r["batch"]) for r in index.read().collect()) == held
    plan = index.read().select("digest").hint("merge").join(index.read().select("digest"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    other = e.DigestIndex(spark, path)
    assert other.buckets == 4 and sorted(bytes(r["digest"]) for r in other.read().collect()) == [d for d, _, _ in held]
    # A batch that is sent again gets its first answer; a new one goes on.
    for i, d in enumerate(parts):
        assert sorted(map(tuple, e.dedup(d, other, batch=str(i)).drop("rid").collect())) == before[i]
    assert not any(r["kept"] for r in e.dedup(docs, other, batch="more").collect())
    fs, at = e.hadoop_fs(spark, path)
    assert sum(f.getPath().getName().startswith("rows") for f in fs.listStatus(at)) == 1
    name = other.table
    other.close()
    assert not spark.catalog.tableExists(name)


def test_a_crash_before_the_note_leaves_the_index(spark, docs, monkeypatch):
    path = scratch(spark, "index")
    index = e.DigestIndex(spark, path, buckets=2)
    for i in range(3):
        e.dedup(docs.where(f"doc_id % 3 = {i}"), index, batch=str(i))
    held = sorted(bytes(r["digest"]) for r in index.read().collect())

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(e.DigestIndex, "_note", crash)
    with pytest.raises(OSError, match="gone"):
        index.compact()
    monkeypatch.undo()
    again = e.DigestIndex(spark, path)
    assert sorted(bytes(r["digest"]) for r in again.read().collect()) == held and again.compact()
    assert sorted(bytes(r["digest"]) for r in e.DigestIndex(spark, path).read().collect()) == held
