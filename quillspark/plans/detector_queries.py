"""Queries of the trained detector: its features, its training report, and raw mail to verdict in one chain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import detector as dt
from quillspark.operators import features as ft
from quillspark.plans.corpus_queries import TURNS, turns
from quillspark.session import shared_folder
from quillspark.sources import registry


def labelled_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, raw, is_ai: a mail of each turn, with greetings and signatures in some."""
    k = F.col("msg_id") % 4
    body = F.when(k == 0, F.concat(F.lit("Dear team,\n\n"), F.col("text"), F.lit("\n\nBest regards,\nAnna\n"))).when(k == 1, F.concat(F.lit("Hello,\n\n"), F.col("text"))).when(k == 2, F.concat(F.col("text"), F.lit("\n\nCheers,\nB. Smith"))).otherwise(F.col("text"))
    head = F.concat(F.lit("Subject: Re: "), F.col("source"), F.lit('\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset="utf-8"\r\nContent-Transfer-Encoding: base64\r\n\r\n'))
    return turns(spark, sf_dir).select("msg_id", F.encode(F.concat(head, F.base64(F.encode(body, "utf-8"))), "utf-8").alias("raw"), "is_ai")


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dt.Detector, DataFrame]:
    raw = labelled_mail(spark, sf_dir)
    mails = dt.read(raw)
    labels = raw.select(F.col("msg_id").alias("key"), "is_ai")
    detector, report = dt.train(mails.join(labels, "key"))
    return mails, detector, report


def detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures on the test part, for each mode."""
    return _trained(spark, sf_dir)[2].withColumnRenamed("precision", "precision_at_cut").withColumnRenamed("recall", "recall_at_cut")


def mail_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mails to verdicts: parsed, cut into zones, scored by a detector that was trained, published and loaded again."""
    mails, detector, _ = _trained(spark, sf_dir)
    place = f"{shared_folder(spark)}/quillspark/registry-{uuid.uuid4().hex}"
    registry.publish(spark, place, detector)
    found = dt.detect(mails, registry.predictor(spark, place))
    return found.select(F.col("key").alias("msg_id"), "subject", "mode", "tree", "final", "verdict", F.array_join("flagged", ",").alias("flagged"), F.array_join("warnings", ",").alias("warnings"), F.size("segments").cast("long").alias("zones"))


def tfidf_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn and vocabulary (words without accents, characters) the terms it has, the sum of their weights and the largest one."""
    t = turns(spark, sf_dir).select("msg_id", "text")
    model = ft.TextFeatures(branches=ft.UNION).fit(t)
    words = len(model.terms[0])
    w = model.rows(t, "r").select("msg_id", F.explode(F.arrays_zip("r.indices", "r.values")).alias("x"))
    return w.groupBy("msg_id", F.when(F.col("x.indices") < words, "word").otherwise("char").alias("branch")).agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("x.values"), 5).alias("total"), F.round(F.max("x.values"), 5).alias("top"))


def baseline_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the baseline: words of 1 to 3 under one limit of 20,000, without stopwords."""
    return ft.term_table(turns(spark, sf_dir), "text", ft.baseline(ft.english_stopwords())).select("term", "df", "total")


QUERIES = {f.__name__: f for f in (detector_report, mail_verdict, tfidf_union, baseline_vocab)}


def grams_sql(texts: str, stop: str = "") -> str:
    """g: msg_id, branch, term of both vocabularies, from a table with msg_id and text."""
    words = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}')"
    chars = "regexp_replace(lower(text), '[\\s]{2,}', ' ', 'g')"
    shifted = ", ".join(f"list_transform(range(1, greatest(length(c) - {n - 2}, 1)), lambda i: substring(c, i, {n}))" for n in (3, 4, 5))
    return f"""a AS (SELECT msg_id, {words} AS t, {chars} AS c FROM {texts}),
      g AS (SELECT msg_id, 'word' AS branch, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM a
            UNION ALL SELECT msg_id, 'char', unnest(list_concat({shifted})) FROM a)"""


ORACLES = {
    "tfidf_union": f"""WITH {TURNS}, {grams_sql('turns')}, c AS (SELECT msg_id, branch, term, count(*) AS tf FROM g GROUP BY 1, 2, 3),
      v AS (SELECT branch, term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1, 2 HAVING df >= 2 QUALIFY row_number() OVER (PARTITION BY branch ORDER BY total DESC, term) <= 35000),
      w AS (SELECT msg_id, branch, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM turns)) / (1 + df)) + 1) AS w FROM c JOIN v USING (branch, term)),
      u AS (SELECT msg_id, branch, w / sqrt(sum(w * w) OVER (PARTITION BY msg_id, branch)) AS w FROM w)
      SELECT msg_id, branch, count(*) AS terms, round(sum(w), 5) AS total, round(max(w), 5) AS top FROM u GROUP BY 1, 2""",
}
