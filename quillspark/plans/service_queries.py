"""Queries over the choices of the services: upload gates, accepted outputs, the backend of a text, thresholds by zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.operators import metrics as mt
from quillspark.operators import profile as pr
from quillspark.plans.mail_queries import _ZONES, zone_scores
from quillspark.plans.sql import verdict_sql
from quillspark.plans.text_queries import _PLANTED_SQL, _VERDICT, _seeded, table, texts
from quillspark.sources import files as fl
from quillspark.sources import mail as ml


def zone_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as uploads, some blank or missing, against a limit that some of them pass."""
    i = F.col("doc_id") % 5
    raw = F.when(i == 0, F.lit(" \n\t ")).when(i == 1, F.lit(None).cast("string")).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(raw, "utf-8").alias("raw"))
    return d.select("doc_id", ml.raw_gate(F.col("raw"), 2000).alias("status"), ml.raw_gate(F.col("raw")).alias("service_status"))


def accepted_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generated mails: three tries for an id, some without a subject."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("task"), "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("subject"), F.col("text").alias("body"))
    return fl.accepted(d, "task", "doc_id").select("task", "doc_id")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select(i, F.when(i % 4 == 1, (i * 37 % 101) / 100.0).when(i % 8 == 2, F.lit(1.5)).alias("transformer"), F.when(i % 4 != 3, (i * 53 % 101) / 100.0).alias("linear"))


def backend_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's verdict where some have a transformer's score, some a linear model's, and some none."""
    return pr.document_verdicts(texts(spark, sf_dir).select("doc_id", _seeded().alias("text")), models=_models(spark, sf_dir)).select("doc_id", "backend", "base_score", "score", "verdict")


def zone_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Youden cut of each kind of zone, with and without the semantic score."""
    z = zone_scores(spark, sf_dir).withColumn("is_ai", (F.col("msg_id") * 13 % 7 < 3).cast("int"))
    modes = z.select("kind", "is_ai", F.explode(F.array(F.struct(F.lit("no_llm").alias("mode"), F.round("no_llm", 9).alias("score")), F.struct(F.lit("with_llm").alias("mode"), F.round("with_llm", 9).alias("score")))).alias("m")).select("kind", "is_ai", "m.mode", "m.score")
    return mt.youden_cut(modes, "is_ai", "score", "kind", "mode").select("kind", "mode", F.round("cut", 4).alias("cut"), "j")


QUERIES = {f.__name__: f for f in (zone_gate, accepted_outputs, backend_choice, zone_thresholds)}

_CHOSEN = "greatest(least(CASE WHEN backend = 'keywords' THEN greatest(base, semantic_score) ELSE base + 0.2::DOUBLE * semantic_score * (1 - base) END, 1.0), 0.0)"
_GATE = "CASE WHEN doc_id % 5 < 2 OR text = '' THEN 'empty' WHEN octet_length(encode(text)) > {} THEN 'too_large' WHEN trim(regexp_replace(text, '\\s+', '', 'g')) = '' THEN 'empty' ELSE 'ok' END"

ORACLES = {
    "zone_gate": f"SELECT doc_id, {_GATE.format(2000)} AS status, {_GATE.format(lx.ZONE_MAIL_BYTES)} AS service_status FROM documents",
    "accepted_outputs": "SELECT doc_id // 3 AS task, min(doc_id) AS doc_id FROM documents WHERE doc_id % 7 <> 0 AND len(regexp_extract_all(text, '\\S+')) BETWEEN 25 AND 500 GROUP BY 1",
    "backend_choice": f"""{_VERDICT}, m AS (SELECT doc_id, semantic_score, CASE doc_id % 4 WHEN 1 THEN 'transformer' WHEN 2 THEN 'linear' ELSE 'keywords' END AS backend,
      CASE doc_id % 4 WHEN 1 THEN (doc_id * 37 % 101) / 100.0::DOUBLE WHEN 2 THEN (doc_id * 53 % 101) / 100.0::DOUBLE ELSE base_score END AS base FROM v),
      s AS (SELECT *, round({_CHOSEN}, 4) AS chosen FROM m)
      SELECT doc_id, backend, base AS base_score, chosen AS score, {verdict_sql('chosen')} AS verdict FROM s""",
    "zone_thresholds": f"""WITH {_ZONES}, r AS (SELECT kind, (msg_id * 13 % 7 < 3)::INT AS y, 'no_llm' AS mode, round(no_llm, 9) AS score FROM m UNION ALL SELECT kind, (msg_id * 13 % 7 < 3)::INT, 'with_llm', round(with_llm, 9) FROM m),
      d AS (SELECT kind, mode, score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r WHERE score IS NOT NULL GROUP BY ALL),
      cand AS (SELECT kind, mode, coalesce((score + lead(score) OVER w) / 2, least(1.0, score + 1e-6)) AS c FROM d WINDOW w AS (PARTITION BY kind, mode ORDER BY score) UNION ALL SELECT kind, mode, greatest(0.0, min(score) - 1e-6) FROM d GROUP BY 1, 2),
      j AS (SELECT cand.kind, cand.mode, c, sum(p) FILTER (score >= c) / sum(p) - sum(n) FILTER (score >= c) / sum(n) AS j0 FROM cand JOIN d ON d.kind = cand.kind AND d.mode = cand.mode GROUP BY ALL),
      k AS (SELECT kind, mode, c, coalesce(j0, 0) AS j FROM j), b AS (SELECT *, max(j) OVER (PARTITION BY kind, mode) AS best FROM k)
      SELECT kind, mode, round(round(median(c), 5), 4) AS cut, round(max(j), 4) AS j FROM b WHERE abs(j - best) < 1e-10 GROUP BY 1, 2""",
}
