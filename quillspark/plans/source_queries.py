"""Queries that go through readers, writers, the signal client and streaming windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import remote as rm
from quillspark.plans.corpus_queries import TURNS, turns
from quillspark.plans.sql import key_sql, strip_sql
from quillspark.plans.text_queries import table
from quillspark.session import shared_folder
from quillspark.sources import files, sinks
from quillspark.sources import images as im
from quillspark.sources import mail as ml
from quillspark.streaming import verdicts as sv


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes, written as quoted CSV and read back."""
    path = _place(spark, "csv")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('say "x", \n'), F.col("text")).alias("text"), F.col("lang").alias("label"))
    sinks.write_csv(d, path)
    back = files.require(files.csv(spark, path), "doc_id", "text", "label")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.sha2("text", 256).alias("text_sha256"))


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select(F.when(F.col("msg_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"), F.col("text").alias("body"), F.element_at(F.array(F.lit("human"), F.lit("AI"), F.lit("?")), (F.col("is_ai") + 1 + F.when(F.col("msg_id") % 11 == 0, 2 - F.col("is_ai")).otherwise(0)).cast("int")).alias("label"))
    d = files.labelled(t)
    return d.groupBy("is_ai").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping appends; the second adds only what is new, and a third nothing."""
    path = _place(spark, "append")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.append_new(d.where("doc_id % 2 = 0"), path, "doc_id")
    sinks.append_new(d, path, "doc_id")
    sinks.append_new(d, path, "doc_id")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))


def remote_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client that fails on batches: halving must still score every text.  Its score is the text's length by a rule."""

    def client(texts: list[str]) -> list[float | None]:
        if len(texts) > 1:
            raise ValueError("broken JSON")
        return [len(texts[0]) % 100 / 100]

    jobs = table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("key"), F.substring(F.trim(F.regexp_replace(F.lower(F.col("text")), r"\s+", " ")), 1, 1200).alias("text"))
    cache = spark.createDataFrame([], "key string, value double, stored_at timestamp")
    return rm.signals(jobs, cache, client).select("doc_id", F.round("value", 4).alias("value"))


def text_as_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", ml.subject_body(files.as_mail(F.col("text"))).alias("m"))
    return d.select("doc_id", F.col("m.subject").alias("subject"), F.sha2("m.body", 256).alias("body_sha256"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by hour, the batch form of the watermarked stream."""
    w = sv.windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def first_answer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("msg_id", "is_ai", F.array(F.substring("text", 1, 30), F.col("text")).alias("answers"))
    s = files.first_answers(t, "msg_id", "answers", 40, "is_ai", "hc", 40, 4000)
    return s.select("msg_id", "is_ai", F.sha2("text", 256).alias("text_sha256"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: tar archives of mails of about 20 documents each, below folders of spam and ham; every fifth one breaks off."""

    def run(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            # An archive at a time: a batch has up to 10,000.
            for group, docs in zip(*batch.columns, strict=True):
                g, held = group.as_py(), io.BytesIO()
                with tarfile.open(fileobj=held, mode="w") as t:
                    for d in sorted(docs.as_py(), key=lambda x: x["doc_id"]):
                        text = (d["text"] or "").encode()
                        body = b"Subject: " + str(d["doc_id"]).encode() + b'\r\nContent-Type: text/plain; charset="utf-8"\r\n\r\n' + text
                        info = tarfile.TarInfo(f"{'spam_x' if d['doc_id'] % 2 else 'easy_ham'}/{d['doc_id']}")
                        info.size = len(body)
                        t.addfile(info, io.BytesIO(body))
                content = held.getvalue()[: 512 + 7] if g % 5 == 0 else held.getvalue()
                yield pa.RecordBatch.from_arrays([pa.array([f"archives/{g}.tar"]), pa.array([content], pa.binary())], names=["path", "content"])

    d = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 20)).cast("long").alias("g"), F.struct("doc_id", "text").alias("d"))
    return d.groupBy("g").agg(F.collect_list("d").alias("docs")).mapInArrow(run, "path string, content binary")


def archived_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of tar archives with labels by folder; archives that break off, and mails without text, are rows with an error."""
    m = files.members_of(_archives(spark, sf_dir), 1 << 30).withColumn("path", F.concat_ws("/", "archive", "member"))
    t = files.labelled_mail(m.select("path", "raw", "error"))
    return t.select("path", "label", "subject", F.sha2(tx.strip(F.col("text")), 256).alias("text_sha256"), F.substring_index("error", ":", 1).alias("error"))


def image_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of four types, whose headers give sizes by doc_id, with the document's text behind them; some are refused."""
    i = F.col("doc_id")
    hexa = lambda c, n: F.lpad(F.hex(c), n, "0")
    swap = lambda c: F.concat(F.substring(hexa(c, 4), 3, 2), F.substring(hexa(c, 4), 1, 2))
    w, h = i % 7000, i % 5003 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexa(w, 8), hexa(h, 8))
    gif = F.concat(F.lit("474946383961"), swap(w), swap(h))
    jpeg = F.concat(F.lit("FFD8FFE000040102FFC0001108"), hexa(h, 4), hexa(w, 4))
    webp = F.concat(F.lit("524946460000000057454250565038200000000000000000"[:40]), F.lit("0000009D012A"), swap(w), swap(h))
    kind = i % 6
    head = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, jpeg).when(kind == 3, webp).when(kind == 4, F.lit("00"))
    mime = F.when(kind == 0, "image/PNG").when(kind == 1, "image/gif").when(kind == 5, F.when(i % 4 == 1, "text/plain").otherwise("image/png")).otherwise("image/jpeg")
    content = F.concat(F.unhex(head), F.encode("text", "utf-8"))
    d = table(spark, sf_dir, "documents").select("doc_id", im.upload_gate(mime, F.when(kind == 5, F.lit(b"")).otherwise(content)).alias("g"))
    return d.select("doc_id", F.col("g.status").cast("long").alias("status"), "g.reason", "g.kind", F.col("g.width").cast("long").alias("width"), F.col("g.height").cast("long").alias("height"))


QUERIES = {f.__name__: f for f in (archived_mail, image_uploads, csv_roundtrip, labelled_corpus, resumed_append, json_report, remote_signals, text_as_mail, event_windows, first_answer_sample)}

ORACLES = {
    "archived_mail": f"""WITH d AS (SELECT *, doc_id // 20 AS g, {strip_sql("regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10), 'g')")} AS t FROM documents)
      SELECT 'archives/' || g || '.tar/' || CASE WHEN doc_id % 2 = 1 THEN 'spam_x' ELSE 'easy_ham' END || '/' || doc_id AS path, (doc_id % 2)::INT AS label, doc_id::VARCHAR AS subject, CASE WHEN t <> '' THEN sha256(t) END AS text_sha256, CASE WHEN t = '' THEN 'no text' END AS error FROM d WHERE g % 5 <> 0
      UNION ALL SELECT DISTINCT 'archives/' || g || '.tar', NULL::INT, '', NULL, 'archive failed' FROM d WHERE g % 5 = 0""",
    "image_uploads": """WITH d AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 7000 AS w, doc_id % 5003 + 1 AS h FROM documents),
      s AS (SELECT *, CASE WHEN k = 5 AND doc_id % 4 = 1 THEN 'unsupported type' WHEN k = 5 THEN 'empty image' WHEN k = 4 THEN 'not an image' WHEN w = 0 THEN 'image without pixels' WHEN w * h > 20000000 THEN 'too many pixels' END AS reason FROM d)
      SELECT doc_id, (CASE WHEN reason IS NULL THEN 200 WHEN reason = 'unsupported type' THEN 415 ELSE 400 END)::BIGINT AS status, reason, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS kind,
        CASE WHEN k < 4 THEN w END AS width, CASE WHEN k < 4 THEN h END AS height FROM s""",
    "csv_roundtrip": "SELECT doc_id, lang AS label, sha256('say \"x\", ' || chr(10) || text) AS text_sha256 FROM documents",
    "labelled_corpus": f"WITH {TURNS} SELECT is_ai, count(*) AS n, sum(length(text))::BIGINT AS chars FROM turns WHERE msg_id % 11 <> 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1",
    "resumed_append": "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "json_report": "SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS line FROM documents",
    "remote_signals": f"SELECT doc_id, round((length(substring({key_sql('text')}, 1, 1200)) % 100) / 100.0::DOUBLE, 4) AS value FROM documents",
    "text_as_mail": f"SELECT doc_id, '' AS subject, sha256({strip_sql("regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS body_sha256 FROM documents",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "first_answer_sample": f"WITH {TURNS}, a AS (SELECT msg_id, is_ai, text FROM turns WHERE length(text) > 40), u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY text ORDER BY msg_id) = 1) SELECT msg_id, is_ai, sha256(substring(text, 1, 4000)) AS text_sha256 FROM u QUALIFY row_number() OVER (PARTITION BY is_ai ORDER BY sha256('hc|' || msg_id), msg_id) <= 40",
}
