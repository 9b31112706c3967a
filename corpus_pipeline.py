"""The training-data pipeline: from raw documents to packed sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir), and its result is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  Counted as part of the subpackage quillspark.llm.

Each stage works on all rows its predecessor kept.  Null and empty texts: the classifier scores
them as the labelled rows' share of label 1 (without any labelled row it keeps all documents), exact dedup keeps one of them, near dedup leaves
them alone, the mix leaves them out, since they cost no words.  Very long texts go through every
stage whole; packing cuts them into sequences.  Rows that repeat a doc_id, or have none, are told
apart by their texts; repeated rows are equal texts, of which one stays.  Ties are broken by
doc_id.  An empty table gives no rows at any stage.  Extra columns, whatever their names, are
carried along up to packing, which ignores them.

A document may occur twice after mixing (a second copy); both copies are packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, mixing, near_dedup, packing, quality
from quillspark.llm.common import documents, settled


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    return quality.keep_good(docs, quality.labels_of(spark, sf_dir))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the largest doc_id, of each text."""
    return exact_dedup.keep_first_of_equals(docs)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return near_dedup.keep_one_of_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in a sequence of at most 2,048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_groups),
    ("mix", mixed),
    ("pack", packed),
]

#: The classifier is trained, so SQL can't express run(); a test holds the other stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way is deleted once its result stands."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
