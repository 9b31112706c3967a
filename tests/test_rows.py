"""Rows that share keys, have none, or are equal in all columns: against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedupe, models, profile, sampling, vectors, zones
from quillspark.session import dealt, opened
from tests.compare import rows_of

SCHEMA = "k int, y int, o int, v string"


def some_rows(seed: int, n: int = 400, keys: int = 40) -> list[tuple]:
    """Hot, repeated and null keys, ties in the order, and rows equal in all columns."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        k = r.choice([None, 0, 0, 0, r.randrange(keys)])
        rows.append((k, r.choice([0, 0, 0, 1]), r.randrange(12), r.choice("ab")))
    return rows + rows[:30]


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return some_rows(request.param)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_key(rows):
    out = defaultdict(list)
    for x in rows:
        out[x[0]].append(x)
    return out


def test_keep_first_keeps_one_row_of_each_key(spark, rows):
    got = [tuple(x) for x in dedupe.keep_first(frame(spark, rows), F.col("k"), "o").collect()]
    groups = by_key(rows)
    assert len(got) == len(groups) and {x[0] for x in got} == set(groups)
    assert all(x in groups[x[0]] and x[2] == min(y[2] for y in groups[x[0]]) for x in got)
    again = dedupe.keep_first(frame(spark, rows[::-1]).repartition(3), F.col("k"), "o").collect()
    assert sorted(map(repr, got)) == sorted(repr(tuple(x)) for x in again)
    whole = dedupe.keep_first(spark.createDataFrame([(1, 1, 1, "a")] * 5, SCHEMA), F.col("k"), "k", "y", "o", "v")
    assert whole.count() == 1 and whole.columns == ["k", "y", "o", "v"]


def test_drop_contradictions(spark, rows):
    rows = [*rows, (900, None, 1, "a"), (901, None, 1, "a"), (901, 1, 2, "a")]
    got = [tuple(x) for x in dedupe.drop_contradictions(frame(spark, rows), F.col("k"), "y", "o").collect()]
    clean = {k for k, g in by_key(rows).items() if len({x[1] for x in g} - {None}) == 1}
    assert Counter(x[0] for x in got) == Counter(clean) and 901 in clean and 900 not in clean


def plain_fold(labels: list) -> int | None:
    """Place of the row that is held at the end."""
    held = None
    for i, y in enumerate(labels):
        if held is None:
            held = i
        elif labels[held] != y:
            held = None
    return held


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_fold_of_contradictions(spark, parts):
    r = random.Random(parts)
    rows, want, at = [], set(), 0
    for k in [None, *range(60)]:
        labels = [r.choice([0, 0, 1, 2]) for _ in range(300 if k == 0 else r.randint(1, 9))]
        places = sorted(r.sample(range(100_000), len(labels)))
        rows += [(k, y, o, "a") for y, o in zip(labels, places, strict=True)]
        i = plain_fold(labels)
        if i is not None:
            want.add((k, labels[i], places[i], "a"))
        at += 1
    rows += [(5000, None, 1, "a"), (5001, 0, 1, "a"), (5001, None, 2, "a"), (5001, 1, 3, "a"), (5001, 0, 4, "a")]
    want.add((5001, 0, 4, "a"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        r.shuffle(rows)
        got = dedupe.fold_contradictions(frame(spark, rows), F.col("k"), "y", "o")
        assert got.columns == ["k", "y", "o", "v"] and {tuple(x) for x in got.collect()} == want and got.count() == len(want)
        assert [x["o"] for x in dedupe.fold_contradictions(frame(spark, [(1, 0, 1, "a"), (1, 1, 2, "a"), (1, 0, 3, "a")]), F.col("k"), "y", "o").collect()] == [3]
        assert dedupe.fold_contradictions(frame(spark, [(1, 0, 1, "a"), (1, 0, 1, "a")]), F.col("k"), "y", "o").count() == 1
        assert dedupe.fold_contradictions(frame(spark, rows).where("false"), F.col("k"), "y", "o").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def sizes(n: int, stack: int, calib: int, test: int) -> list[int]:
    half_up = lambda x: int(x + 0.5)
    return [min(cap, max(4, half_up(n * share))) for cap, share in ((stack, 0.2), (calib, 0.1), (test, 0.1))]


def test_splits_never_multiply_rows(spark, rows):
    got = sampling.split_labels(frame(spark, rows), "y", "s", "k", 30, 20, 10)
    assert got.columns == ["k", "y", "o", "v", "split"]
    found = [tuple(x) for x in got.collect()]
    assert Counter(x[:4] for x in found) == Counter(rows)
    # Equal rows stay together.
    assert len({x[:4] for x in found}) == len(set(found))
    copies = max(Counter(rows).values())
    for y in {x[1] for x in rows}:
        own = Counter(x[4] for x in found if x[1] == y)
        want = sizes(sum(x[1] == y for x in rows), 30, 20, 10)
        for name, n in zip(("stack", "calib", "test"), want, strict=True):
            assert abs(own[name] - n) < copies
    few = frame(spark, [(1, 0, 1, "a"), (1, 0, 1, "a"), (None, 0, 1, "a"), (None, 0, 1, "a"), (2, 0, 1, "a")])
    assert sampling.split_labels(few, "y", "s", "k").count() == 5


def test_holdout_never_multiplies_rows(spark, rows):
    got = sampling.holdout(frame(spark, rows), "y", "s", "k", 0.25)
    found = [tuple(x) for x in got.collect()]
    assert got.columns == ["k", "y", "o", "v", "held_out"] and Counter(x[:4] for x in found) == Counter(rows)
    assert len({x[:4] for x in found}) == len(set(found))
    copies = max(Counter(rows).values())
    for y in {x[1] for x in rows}:
        n = sum(x[1] == y for x in rows)
        assert abs(sum(x[4] for x in found if x[1] == y) - n * 0.25) <= copies
    assert sampling.holdout(frame(spark, [(None, 0, 1, "a")] * 4), "y", "s", "k").count() == 4


def test_exact_count(spark, rows):
    d = frame(spark, rows)
    one, two = (sorted(map(repr, sampling.exact_count(x, 50, "s", "k").collect())) for x in (d, d.repartition(2)))
    assert len(one) == 50 and one == two and sampling.exact_count(d, 50).columns == d.columns
    with pytest.raises(Exception, match="430 rows, 1000 wanted"):
        sampling.exact_count(d, 1000, "s", "k").collect()


TEXT = "In conclusion, it is important to note that this is a plain sentence of many words. Moreover, the results show the way. Furthermore, it works well for all of us here today, and it is important to note that it is robust."


def test_verdicts_of_rows_that_share_an_id(spark):
    texts = [TEXT, "Short.", "", None, "An ordinary letter about a garden, with three roses and 12 tulips in two beds, written on a Monday.", TEXT]
    ids = [7, 7, None, None, 7, None]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = Counter(repr((x["doc_id"], x["base_score"], x["semantic_score"], x["label"], x["score"], x["verdict"])) for x in profile.document_verdicts(d).collect())
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        (x,) = profile.document_verdicts(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
        want[repr((i, x["base_score"], x["semantic_score"], x["label"], x["score"], x["verdict"]))] += 1
    assert got == want and len(want) > 3
    scores = spark.createDataFrame([(7, 0.5, None), (7, 0.25, 0.5)], "doc_id long, transformer double, linear double")
    assert profile.document_verdicts(d, models=scores).count() == 6


#: Names that transforms of the library use for columns of their own.
TAKEN = "first_key first_row first_of_key clean_key clean_label fold_key fold_row fold_won split_place split_label last_stack last_calib last_test hold_place hold_cell hold_label hold_edge hold_need hold_last rank_of rows_there part_of before_of place_of prefix_of n_of part_at prefix_at class_of centre_ai centre_human zone_flat_of zone_n_of span_text __key __k __part __rn __p __t __h __c __low".split()


def test_columns_of_the_caller_survive(spark):
    rows = [(i, i % 2, i, f"text {i}", f"Dear team,\n\nbody {i}\n", [0.1 * i + 1, 1.0], *([f"x{i}"] * len(TAKEN))) for i in range(40)]
    d = spark.createDataFrame(rows, "k int, y int, o int, text string, body string, e array<double>, " + ", ".join(f"`{c.upper() if j % 2 else c}` string" for j, c in enumerate(TAKEN))).withColumn("subject", F.lit("s"))
    centres = vectors.centroids(d, "e", "y")
    for made in (
        dedupe.keep_first(d, F.col("k"), "o"),
        dedupe.drop_contradictions(d, F.col("k"), "y", "o"),
        dedupe.fold_contradictions(d, F.col("k"), "y", "o"),
        dedupe.numbered(d, F.lit("p"), "k"),
        sampling.split_labels(d, "y", "s", "k"),
        sampling.holdout(d, "y", "s", "k"),
        sampling.per_class(d, "y", 100, "s", "k"),
        sampling.exact_count(d, 40, "s", "k"),
        sampling.batches(d, 7, "k"),
        models.balanced(d, "y"),
        vectors.similarity(d, "e", centres, "y", 1, 0),
        zones.split(d),
    ):
        got = made.collect()
        assert len(got) == 40 and made.columns[: len(d.columns)] == d.columns
        assert all(x[c] == f"x{x['k']}" for x in got for c in d.columns[6:-1])
    assert profile.spans(d, "k").count() == 40


def test_opened_arrays(spark):
    """As explode: no row for an empty or absent array, one for each element, null ones too; columns of any name stay."""
    rows = spark.createDataFrame([(1, ["a", None, "a"], 7), (2, [], 8), (3, None, 9), (None, ["b"], None)], "id int, xs array<string>, place_of int")
    got = opened(rows, ["id", "place_of"], F.col("xs"), "x")
    assert got.columns == ["id", "place_of", "x"]
    assert rows_of(got) == rows_of(rows.select("id", "place_of", F.explode("xs").alias("x")))
    placed = opened(rows, "id", F.col("xs"), "x", "at").where("id = 1").collect()
    assert sorted((r["at"], r["x"] or "") for r in placed) == [(0, "a"), (1, ""), (2, "a")]


def test_dealt_tables(spark, data, tmp_path):
    """One row group is dealt out over the cores, a table of many splits is read as it is; rows are the same."""
    cores = spark.sparkContext.defaultParallelism
    d = dealt(spark, f"{data}/documents.parquet")
    assert d.rdd.getNumPartitions() == 2 * cores
    assert rows_of(d) == rows_of(spark.read.parquet(f"{data}/documents.parquet"))
    spark.range(100).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    with_splits = spark.read.parquet(str(tmp_path / "many"))
    if with_splits.rdd.getNumPartitions() >= cores:
        plan = dealt(spark, str(tmp_path / "many"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
