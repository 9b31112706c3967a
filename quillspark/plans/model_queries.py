"""Queries that fit or apply models, and the streaming wrapper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import features as ft
from quillspark.operators import models as md
from quillspark.operators import zones as zn
from quillspark.plans.corpus_queries import TURNS, turns
from quillspark.plans.mail_queries import zone_scores
from quillspark.plans.sql import tokens_sql, verdict_sql
from quillspark.plans.text_queries import VERDICTS_OF_TEXT, texts
from quillspark.session import parts_for, shared_folder
from quillspark.streaming import verdicts as sv


#: Terms of each vocabulary of the model with the largest ones: words of 1 to 2, characters of 3 to 5.
TERMS = 35_000


def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    c = md.term_counts(t, "msg_id", md.word_grams(F.col("text")), parts_for(t, "text"))
    return md.vocabulary(c, 2, TERMS)


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    parts = parts_for(t, "text")
    # Written once: both the vocabulary and the weights read them.
    path = f"{shared_folder(spark)}/quillspark/terms-{uuid.uuid4().hex}"
    md.term_counts(t, "msg_id", md.word_grams(F.col("text")), parts).write.parquet(path)
    c = spark.read.parquet(path)
    w = md.tfidf(c, md.vocabulary(c, 2, TERMS), t.count(), "msg_id", parts)
    return w.groupBy("msg_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("top"))


def char_gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of whole turns."""
    t = turns(spark, sf_dir)
    c = md.term_counts(t, "msg_id", md.char_grams(F.col("text"), 3, 5), parts_for(t, "text"))
    return md.vocabulary(c, 2, TERMS)


def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.balanced(turns(spark, sf_dir), "is_ai").groupBy("is_ai").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores of the text model: words of 1 to 3 without stopwords, 20,000 features in all, 1,000 iterations at most."""
    held, _ = md.evaluate_then_refit(turns(spark, sf_dir), "msg_id", "is_ai", branches=ft.baseline(ft.english_stopwords()), iterations=1000)
    return held.select("msg_id", "is_ai", "score")


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of class 1 by a depth-3 tree over zone features; the label leans on the mean score."""
    f = zn.features(zone_scores(spark, sf_dir), "msg_id").withColumn("is_ai", (F.col("mean_score") + (F.col("msg_id") % 10) / 50 > 0.55).cast("int"))
    return md.probability(md.fit_tree(f), f).select("msg_id", "is_ai", "score")


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty mutations of each turn, counted by kind."""
    return md.augment(turns(spark, sf_dir, texts), "msg_id", "text", "is_ai").groupBy("is_ai", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document verdicts by way of a file stream that is drained once."""
    return sv.drain(spark, sf_dir, f"{shared_folder(spark)}/quillspark/stream-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (tfidf_vocab, tfidf_weights, char_gram_counts, balanced_weights, logreg_scores, tree_scores, augmented, stream_verdicts)}

_GRAMS = f"{TURNS}, t AS (SELECT msg_id, {tokens_sql('text')} AS t FROM turns), g AS (SELECT msg_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t), c AS (SELECT msg_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM c GROUP BY 1 HAVING df >= 2 ORDER BY total DESC, term LIMIT 35000)"

_U = "('0x' || substr(sha256('augment-u|' || msg_id || '|' || copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

ORACLES = {
    "tfidf_vocab": f"WITH {_GRAMS} SELECT * FROM v",
    "tfidf_weights": f"WITH {_GRAMS}, w AS (SELECT msg_id, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM turns)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)), u AS (SELECT msg_id, w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)) AS w FROM w) SELECT msg_id, count(*) AS terms, round(sum(w), 5) AS total, round(max(w), 5) AS top FROM u GROUP BY 1",
    "char_gram_counts": f"WITH {TURNS}, g AS (SELECT msg_id, unnest(list_concat(" + ", ".join(f"list_transform(range(1, greatest(length(text) - {n - 2}, 1)), lambda i: substring(text, i, {n}))" for n in (3, 4, 5)) + ")) AS term FROM turns), c AS (SELECT msg_id, term, count(*) AS tf FROM g GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM c GROUP BY 1 HAVING df >= 2 ORDER BY total DESC, term LIMIT 35000",
    "stream_verdicts": f"{VERDICTS_OF_TEXT} SELECT doc_id, base_score, semantic_score, score, label, {verdict_sql('score')} AS verdict FROM v",
    "balanced_weights": f"WITH {TURNS} SELECT is_ai, count(*) AS n, round((SELECT count(*) FROM turns) / (2 * count(*)), 6) AS weight FROM turns GROUP BY 1",
    "augmented": f"""WITH {TURNS}, c AS (SELECT msg_id, is_ai, text, copy FROM turns, range(1, 31) r(copy)), u AS (SELECT *, {_U} AS u FROM c),
      k AS (SELECT *, CASE WHEN is_ai = 0 THEN CASE WHEN u < 0.15 THEN 'typo' WHEN u < 0.30 THEN 'upper' WHEN u < 0.42 THEN 'lower' WHEN u < 0.52 THEN 'smile' WHEN u < 0.62 THEN 'prefix' WHEN u < 0.72 THEN 'suffix' ELSE 'same' END
        ELSE CASE WHEN u < 0.25 THEN 'prefix' WHEN u < 0.45 THEN 'suffix' WHEN u < 0.60 THEN 'formal' WHEN u < 0.72 THEN 'closing' WHEN u < 0.82 THEN 'upper' ELSE 'same' END END AS kind FROM u)
      SELECT is_ai, kind, count(*) AS n, sum(CASE kind WHEN 'upper' THEN length(replace(text, 'ß', 'SS')) WHEN 'smile' THEN length(text) + 3 WHEN 'prefix' THEN length(text) + 7 WHEN 'suffix' THEN length(text) + 8 WHEN 'formal' THEN length(text) + 19 WHEN 'closing' THEN length(text) + 34 ELSE length(text) END)::BIGINT AS chars FROM k GROUP BY 1, 2""",
}
