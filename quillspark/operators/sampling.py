"""Deterministic order, samples, splits and task plans.

Order comes from SHA-256 of seed and key, so it is the same in any engine and on any
cluster; rand() is never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import absent, by_class, ranged, row_hash


def order_key(seed: int | str, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def shuffled_sample(df: DataFrame, n: int, seed: int | str, *keys: str) -> DataFrame:
    """n rows in hash order: a distributed top-n, never a full sort."""
    return df.orderBy(order_key(seed, *keys), *keys).limit(n)


def exact_count(df: DataFrame, n: int, seed: int | str = 0, *keys: str) -> DataFrame:
    """n rows in hash order of the keys (without any, of whole rows), an error at run time if there are fewer; reruns give the same rows."""
    at = absent(df, "rows_there")[0]
    have = df.groupBy().agg(F.count(F.lit(1)).alias(at)).select(F.assert_true(F.col(at) >= n, F.concat(F.col(at).cast("string"), F.lit(f" rows, {n} wanted"))).alias(at))
    order = order_key(seed, *keys) if keys else F.sha2(F.concat(F.lit(f"{seed}|"), row_hash(df).cast("string")), 256)
    # One row without content, so that the check runs with the query.
    return df.orderBy(order, *keys, row_hash(df)).limit(n).crossJoin(F.broadcast(have)).where(F.col(at).isNull()).drop(at)


def per_class(df: DataFrame, label: str, n: int, seed: int | str, *keys: str) -> DataFrame:
    """At most n rows of each class in hash order.  Spark keeps the first n of each class in
    every task before the shuffle (window group limit), so a large class costs no task more."""
    rn = absent(df, "rank_of")[0]
    w = W.partitionBy(label).orderBy(order_key(seed, *keys), *keys)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n).drop(rn)


def split_labels(df: DataFrame, label: str, seed: int | str, key: str, stack: int = 150, calib: int = 120, test: int = 80) -> DataFrame:
    """Adds split: per class stack 20 %, calib and test 10 % each (at least 4, at most the caps), the rest base.

    Only the bounded parts need an order: a per-class top-n, which combines before the shuffle,
    gives the last place of each part, and every row is told its part by those places.  Rows that
    share a key are told apart by a hash of all columns; rows equal in all columns go to one part.
    """
    place, one = absent(df, "split_place", "split_label")
    order = F.struct(order_key(seed, key).alias("o"), F.col(key).alias("k"), row_hash(df).alias("h"))
    rows = df.withColumn(place, order)
    # A row for each class, however many there are: the planner chooses how to join it.
    n = rows.groupBy(F.col(label).alias(one)).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(label).orderBy(place)
    top = rows.select(label, place).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= stack + calib + test)
    ranked = top.join(n, F.col(label).eqNullSafe(F.col(one)))
    size = lambda share, cap: F.least(F.lit(cap), F.greatest(F.lit(4), F.round(F.col("n") * share).cast("int")))
    s, c, t = size(0.2, stack), size(0.1, calib), size(0.1, test)
    edges = {"stack": s, "calib": s + c, "test": s + c + t}
    names = absent(rows, *(f"last_{e}" for e in edges))
    last = ranked.groupBy(F.col(label).alias(one)).agg(*[F.max(F.when(F.col("rn") <= e, F.col(place))).alias(x) for x, e in zip(names, edges.values(), strict=True)])
    out = rows.join(by_class(n, last), F.col(label).eqNullSafe(F.col(one)), "left")
    part = F.lit("base")
    for name, x in reversed(list(zip(edges, names, strict=True))):
        part = F.when(F.col(place) <= F.col(x), name).otherwise(part)
    return out.withColumn("split", part).drop(place, one, *names)


def holdout(df: DataFrame, label: str, seed: int | str, key: str, share: float = 0.2) -> DataFrame:
    """Adds held_out: the given share of each class by hash order; cells of the hash find the cut, so no class is sorted whole.

    Rows that share a key are told apart by a hash of all columns; rows equal in all columns stay together.
    """
    place, cell, one, edge, need, last = absent(df, "hold_place", "hold_cell", "hold_label", "hold_edge", "hold_need", "hold_last")
    h = F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("long")
    rows = df.withColumn(place, F.struct(h.alias("o"), F.col(key).alias("k"), row_hash(df).alias("h")))
    rows = rows.withColumn(cell, F.floor(F.col(f"{place}.o") / F.lit(1 << 20)))
    by_cell = rows.groupBy(label, cell).agg(F.count(F.lit(1)).alias("m"))
    run = by_cell.withColumn("upto", F.sum("m").over(W.partitionBy(label).orderBy(cell))).withColumn("all", F.sum("m").over(W.partitionBy(label)))
    want = F.round(F.col("all") * share)
    cut = run.where((F.col("upto") >= want) & (F.col("upto") - F.col("m") < want)).select(F.col(label).alias(one), F.col(cell).alias(edge), (want - F.col("upto") + F.col("m")).cast("int").alias(need))
    # Of the cell that holds the cut, the last place that is held out.
    inner = rows.select(label, cell, place).join(cut, F.col(label).eqNullSafe(F.col(one)) & (F.col(cell) == F.col(edge)))
    ranked = inner.withColumn("rn", F.row_number().over(W.partitionBy(label).orderBy(place))).where(F.col("rn") <= F.col(need))
    ends = ranked.groupBy(F.col(label).alias(one)).agg(F.max(edge).alias(edge), F.max(place).alias(last))
    out = rows.join(by_class(rows.select(label).distinct(), ends), F.col(label).eqNullSafe(F.col(one)), "left")
    inside = (F.col(cell) < F.col(edge)) | ((F.col(cell) == F.col(edge)) & (F.col(place) <= F.col(last)))
    return out.withColumn("held_out", F.coalesce(inside, F.lit(False))).drop(place, cell, one, edge, last)


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks that a resumed run still has to do."""
    return tasks.join(done.select(key), key, "left_anti")


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds batch: rows by order in groups of `size`.

    Positions come from range partitions and their sizes, not from one global window.
    """
    part, before, rn = absent(df, "part_of", "before_of", "place_of")
    rows = ranged(df, part, *order)
    counts = rows.groupBy(part).count()
    earlier = counts.withColumn(before, F.coalesce(F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(part, before)
    local = rows.withColumn(rn, F.row_number().over(W.partitionBy(part).orderBy(*order)))
    return local.join(F.broadcast(earlier), part).withColumn("batch", F.floor((F.col(before) + F.col(rn) - 1) / size).cast("long")).drop(part, rn, before)


def drawn(key: str, seed: str, options: list) -> Column:
    """One of the options by a hash of seed and key."""
    h = F.conv(F.substring(order_key(seed, key), 1, 12), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, options)), (h % len(options) + 1).cast("int"))
