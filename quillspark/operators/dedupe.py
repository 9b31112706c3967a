"""Keep-first dedupe, contradictory labels, audits of corpora, leak and contamination checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.session import absent, opened, ranged, row_hash


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order, exactly one; a null key is a key like any other.

    Rows equal in order are told apart by a hash of all their columns; of rows equal in all columns
    one stays.  The winner is found by a min over narrow columns, which combines before the
    shuffle; only then are whole rows joined, so one hot key never gathers its rows in a task.
    """
    k, row, first = absent(df, "first_key", "first_row", "first_of_key")
    keyed = df.withColumn(k, key).withColumn(row, F.struct(*[df[c] for c in order], row_hash(df)))
    won = keyed.groupBy(k).agg(F.min(row).alias(first)).select(F.struct(k, first).alias(first))
    kept = keyed.withColumn(row, F.struct(k, row)).join(won, F.col(row) == F.col(first), "left_semi")
    return kept.dropDuplicates([row]).drop(k, row)


def drop_contradictions(df: DataFrame, key: Column, label: str, *order: str) -> DataFrame:
    """First row of each key whose rows all have one label; keys with several labels go.

    A null label is no label: it contradicts none, and keys without any other go.
    """
    k, kind = absent(df, "clean_key", "clean_label")
    keyed = df.withColumn(k, key)
    clean = keyed.groupBy(k).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi").select(F.struct(k).alias(kind))
    return keep_first(keyed.join(clean, F.struct(keyed[k]) == F.col(kind), "left_semi"), F.col(k), *order).drop(k)


_STATE = "struct<held:boolean,label:string,row:string>"


def fold_contradictions(df: DataFrame, key: Column, label: str, *order: str) -> DataFrame:
    """What is left of each key when its rows are taken in order: a row is held, equal labels are passed over, another label drops the held row and itself, and the next row is held again.

    So labels 0, 1, 0 keep the third row.  Rows without a label are left out.  Rows equal in order
    are taken in the order of a hash of all columns.  What a stretch of rows does depends on its
    first label and on whether a row is held before it and with that label: three outcomes.  Range
    partitions are summed up so, one narrow row for each key and partition, and the summaries of
    a key, as many as it has partitions, are put together in order; no task gathers a key.
    """
    k, row, won = absent(df, "fold_key", "fold_row", "fold_won")
    keyed = df.withColumn(k, F.to_json(F.struct(key.alias("k")), {"ignoreNullFields": "false"})).withColumn(row, F.to_json(F.struct(*[df[c] for c in order], row_hash(df).alias(won)), {"ignoreNullFields": "false"}))
    narrow = keyed.where(F.col(label).isNotNull()).select(F.col(k).alias("k"), F.col(label).cast("string").alias("y"), F.col(row).alias("row"), *[df[c].alias(f"o{i}") for i, c in enumerate(order)], row_hash(df).alias("h"))
    by = ["k", *[f"o{i}" for i in range(len(order))], "h"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = narrow.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("k", "y", "row").mapInArrow(_stretches, "k string, part int, first string, same boolean, empty " + _STATE + ", held " + _STATE + ", other " + _STATE)
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("held"), none.alias("label"), none.alias("row"))

    def merge(state: Column, x: Column) -> Column:
        equal = F.when(x["same"], state).otherwise(x["held"])
        return F.when(~state["held"], x["empty"]).otherwise(F.when(state["label"] == x["first"], equal).otherwise(x["other"]))

    per_key = sums.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("part", "first", "same", "empty", "held", "other"))).alias("all"))
    left = per_key.select("k", F.aggregate("all", start, merge).alias("s")).where("s.held").select(F.struct("k", "s.row").alias(won))
    same = F.struct(F.col(k), F.col(row))
    return keyed.join(left, same == F.col(won), "left_semi").dropDuplicates([k]).drop(k, row)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outcomes of each key's rows in this partition: from nothing held, from a row held with the first label (same: it stays), and with another one."""
    part = TaskContext.get().partitionId()
    key, first, done = None, None, []
    empty: tuple | None = None
    held: tuple | None = None
    other: tuple | None = None
    same = True

    def step(state: tuple | None, y: str, row: str) -> tuple | None:
        return (y, row) if state is None else state if state[0] == y else None

    def out(rows: list) -> pa.RecordBatch:
        states = [[x[4 + j] for x in rows] for j in range(3)]
        kind = pa.struct([("held", pa.bool_()), ("label", pa.string()), ("row", pa.string())])
        cols = [pa.array([{"held": s is not None, "label": s and s[0], "row": s and s[1]} for s in col], kind) for col in states]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array([x[2] for x in rows], pa.string()), pa.array([x[3] for x in rows], pa.bool_()), *cols], names=["k", "part", "first", "same", "empty", "held", "other"])

    for batch in batches:
        for k, y, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, part, first, same, empty, held, other))
                key, first, same, empty, held, other = k, y, True, None, None, (None, None)
            if same and y != first:
                same, held = False, None
            elif not same:
                held = step(held, y, row)
            empty, other = step(empty, y, row), step(other, y, row)
        if len(done) >= 10_000:
            yield out(done)
            done = []
    if key is not None:
        done.append((key, part, first, same, empty, held, other))
    if done:
        yield out(done)


def contradictions(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Keys that occur under more than one label, with how often."""
    g = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return g.where("lo <> hi").select("key", "n")


def class_profile(df: DataFrame, label: str, body: str) -> DataFrame:
    """Size, median, extremes, distinct texts and non-empty rows of each class."""
    n = tx.space_word_count(F.col(body))
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"),
        F.median(n).alias("median_words"),
        F.min(n).cast("long").alias("min_words"),
        F.max(n).cast("long").alias("max_words"),
        F.countDistinct(tx.fingerprint(F.col(body))).alias("distinct_texts"),
        F.count_if(tx.strip(F.col(body)) != "").alias("non_empty"),
    )


def confound_report(df: DataFrame, label: str, body: str, source: str) -> DataFrame:
    """One row: does length, a header mark or the source alone tell the classes apart?"""
    header = F.col(body).rlike(r"(?mi)^Return-Path\s*:").cast("int")
    y = F.col(label)
    per_source = df.groupBy(F.coalesce(F.col(source), F.lit("unspecified")).alias("s")).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    exclusive = per_source.agg(F.bool_and(F.col("lo") == F.col("hi")).alias("sources_exclusive"))
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(y == 0).alias("human_rows"),
        F.count_if(y == 1).alias("ai_rows"),
        F.median(F.when(y == 0, F.length(body))).alias("human_median_chars"),
        F.median(F.when(y == 1, F.length(body))).alias("ai_median_chars"),
        F.round(F.avg(F.when(y == 0, header)), 6).alias("human_header_rate"),
        F.round(F.avg(F.when(y == 1, header)), 6).alias("ai_header_rate"),
        F.round(F.avg((header == y).cast("int")), 6).alias("header_rule_accuracy"),
    )
    both = stats.crossJoin(exclusive)  # one row each
    strong = (F.col("header_rule_accuracy") >= 0.9) | (F.col("ai_median_chars") >= 2 * F.greatest("human_median_chars", F.lit(1.0))) | F.col("sources_exclusive")
    return both.withColumn("strong_confound", strong)


def overlap(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
    """Keys that both have: the leak check wants none."""
    return a.select(key_a.alias("key")).distinct().join(b.select(key_b.alias("key")), "key", "left_semi")


#: Runs of words that are sent to all tasks, 24 bytes each; more are joined by a shuffle.
MOST_SENT = 1_000_000


def shared_passages(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """doc_id, item_id, shared: distinct runs of `words` words that a document has in common with an item.

    The items' runs are counted first: where they are few, every document meets them in its own
    task and only what it shares is shuffled.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        t = df.select(F.col(key), F.regexp_extract_all(F.lower(tx.nonnull(F.col("text"))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
        g = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
        return opened(t, key, F.when(F.size("w") >= words, F.array_distinct(g)), "g")

    wanted = grams(items, "item_id")
    if wanted.limit(MOST_SENT + 1).count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    return grams(docs, "doc_id").join(wanted, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def numbered(df: DataFrame, prefix: Column, *order: str) -> DataFrame:
    """name: prefix and a number of at least four digits by order within the prefix.

    Rows are range-partitioned by prefix and order; a row's number is its place in its partition
    plus the rows of its prefix in earlier ones, so a prefix with very many rows is spread.
    """
    p, part, n, before, q, r = absent(df, "prefix_of", "part_of", "n_of", "before_of", "part_at", "prefix_at")
    rows = ranged(df.withColumn(p, prefix), part, p, *order)
    own = F.row_number().over(W.partitionBy(part, p).orderBy(*order))
    counts = rows.groupBy(part, p).agg(F.count(F.lit(1)).alias(n))
    # A row for each prefix and partition.
    earlier = counts.select(F.col(part).alias(q), F.col(p).alias(r), (F.sum(n).over(W.partitionBy(p).orderBy(part)) - F.col(n)).alias(before))
    placed = rows.withColumn(n, own).join(earlier, (F.col(part) == F.col(q)) & F.col(p).eqNullSafe(F.col(r)))
    return placed.withColumn("name", F.concat(p, F.lit("_"), F.format_string("%04d", F.col(before) + F.col(n)))).drop(p, part, n, q, r, before)


def readiness(df: DataFrame, label: str, key: Column, least: int) -> DataFrame:
    """One row: whether both classes have `least` rows, no text occurs twice and no text has two labels."""
    per = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    g = per.agg(F.sum("n0").alias("human"), F.sum("n1").alias("ai"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("n0") > 0) & (F.col("n1") > 0)).alias("contradictory"))
    return g.withColumn("ready", (F.col("human") >= least) & (F.col("ai") >= least) & (F.col("repeated") == 0) & (F.col("contradictory") == 0))
