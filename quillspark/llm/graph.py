"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step keeps the components and draws every node's neighbours to the smallest one; the
loop ends when the edges form stars.  Minima are pre-aggregated before the shuffle and
joined back by an equi join, which adaptive execution splits where a hub has very many
neighbours.  Every step's edges are written to the shared folder, so lineage stays short
and a lost executor costs no more than the step at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import staged


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node that has an edge; edges has u, v, without loops."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    was = _fingerprint(now)
    if not was[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        now = staged(_small_star(_large_star(now)), "components")
        is_ = _fingerprint(now)
        if is_ == was:
            break
        was = is_
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
