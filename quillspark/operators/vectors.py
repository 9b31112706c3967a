"""Centroids and similarity scores of embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as sc
from quillspark.session import absent, opened


def centroids(df: DataFrame, vector: str, *keys: str, least: int = 3) -> DataFrame:
    """keys, n, centroid: unit vector of the mean of unit vectors; null if zero, no row for fewer than `least`.

    Sums run by dimension, so the shuffle carries one number for each key and dimension.
    """
    dims = opened(df, list(keys), sc.normalised(F.col(vector)), "x", "i").groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    g = dims.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return g.where(F.col("n") >= least).select(*keys, "n", sc.normalised(F.col("mean")).alias("centroid"))


def similarity(df: DataFrame, vector: str, centres: DataFrame, label: str, ai: int, human: int) -> DataFrame:
    """Adds similarity to df; centres has one row for each label, of which two are used."""
    one, two = absent(df, "centre_ai", "centre_human")
    both = centres.where(F.col(label).isin(ai, human)).groupBy().agg(F.max_by("centroid", F.when(F.col(label) == ai, 1)).alias(one), F.max_by("centroid", F.when(F.col(label) == human, 1)).alias(two))
    d = df.crossJoin(F.broadcast(both))  # one row
    return d.withColumn("similarity", sc.similarity_score(sc.normalised(F.col(vector)), F.col(one), F.col(two))).drop(one, two)
