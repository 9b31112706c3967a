"""Readers of corpora: CSV, folders of mail, mailbox archives, plain text, model artefacts."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header, quoted line breaks and an optional byte-order mark.  With a schema, a missing path gives no rows."""
    if schema:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    d = (reader.schema(schema) if schema else reader).csv(path)
    return d.toDF(*[c.lstrip("﻿") for c in d.columns])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df


def labelled(df: DataFrame) -> DataFrame:
    """text, subject, is_ai from any of the known layouts; rows without a label or text are dropped."""
    label = next((c for c in ("is_ai", "ai_assisted", "label") if c in df.columns), None)
    if label is None:
        raise ValueError("no label column")
    body = [F.nullif(F.col(c), F.lit("")) for c in ("text", "body") if c in df.columns]
    subject = F.col("subject") if "subject" in df.columns else F.lit("")
    d = df.select(F.coalesce(*body).alias("text"), tx.nonnull(subject).alias("subject"), tx.parse_label(F.col(label).cast("string")).alias("is_ai"))
    return d.where(F.col("is_ai").isNotNull() & (tx.strip(F.col("text")) != ""))


def validated(df: DataFrame, expected: int, least_words: int = 25) -> DataFrame:
    """df, failing when a row is used that has another label or too few words."""
    ok = (tx.parse_label(F.col("is_ai").cast("string")) == expected) & (tx.space_word_count(F.col("text")) >= least_words)
    return df.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("bad row: "), F.substring(tx.nonnull(F.col("text")), 1, 60))).isNull())


def accepted(df: DataFrame, key: str, *order: str, subject: str = "subject", body: str = "body", least: int = 25, most: int = 500) -> DataFrame:
    """Generated mails that are taken: a subject, `least` to `most` words, and of rows that share a key the first in the given order.

    Rows are judged before the first is chosen, so a refused one does not hide a later one.
    """
    from quillspark.operators import dedupe

    words = tx.space_word_count(tx.nonnull(F.col(body)))
    return dedupe.keep_first(df.where((tx.strip(tx.nonnull(F.col(subject))) != "") & words.between(least, most)), F.col(key), *order)


def numeric_label(c: Column) -> Column:
    """The label as a whole number, 0 where it is none."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def mail_folder(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """path, raw, is_ai of .eml files below human/ (0) and ai/ (1), by path if ordered; the size limit is checked before content is read on."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml").load(path)
    label = F.when(F.col("path").rlike(r"/human/"), 0).when(F.col("path").rlike(r"/ai/"), 1)
    out = d.where(F.col("length") <= lx.RAW_MAIL_BYTES).select("path", F.col("content").alias("raw"), label.alias("is_ai")).where("is_ai IS NOT NULL")
    return out.orderBy("path") if ordered else out


def folder_label(path: Column) -> Column:
    """1 below a folder whose name has spam, 0 below one with ham; spam is tested first; null elsewhere."""
    parent = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return F.when(F.contains(parent, F.lit("spam")), 1).when(F.contains(parent, F.lit("ham")), 0)


def spam_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, raw, label: all files below folders of spam and ham."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select("path", F.col("content").alias("raw"), folder_label(F.col("path")).alias("label"), F.lit(0).alias("ai_assisted")).where("label IS NOT NULL")


def labelled_mail(mails: DataFrame) -> DataFrame:
    """path, label, subject, text, error of mails (path, raw and maybe error) below folders of spam and ham.

    The text is the plain part, else that of the HTML part.  What can't be read is a row with an
    error and without text, and so is a mail without text; what lies in other folders is no row.
    """
    from quillspark.sources import mail as ml

    known = F.col("error") if "error" in mails.columns else F.lit(None).cast("string")
    d = mails.select("path", folder_label(F.col("path")).alias("label"), known.alias("known"), ml.preferred(F.col("raw")).alias("m"))
    blank = tx.strip(F.col("m.body")) == ""
    error = F.coalesce("known", F.when(blank, "no text"))
    d = d.where(F.col("label").isNotNull() | F.col("known").isNotNull())
    return d.select("path", "label", "m.subject", F.when(error.isNull(), F.col("m.body")).alias("text"), error.alias("error"))


def members_of(archives: DataFrame, most_member: int = 500_000) -> DataFrame:
    """archive, member, raw, error of the files in tar archives (path, content); oversized members are left out.

    Members are streamed out, a few at a time, so a task holds one archive and these.  An archive
    that can't be read, or breaks off, gives the members before that and a row with an error.
    """
    names = ["archive", "member", "raw", "error"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                for m in tar:
                    if m.isfile() and m.size <= most_member:
                        yield name, m.name.encode("utf-8", "replace").decode(), tar.extractfile(m).read(), None
        except Exception as e:  # noqa: BLE001  broken archives fail in many ways
            yield name, None, None, f"archive failed: {type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                for row in rows(name.as_py(), content.as_py() or b""):
                    held.append(row)
                    size += len(row[2] or b"")
                    if size >= 1 << 22 or len(held) >= 1000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, raw binary, error string")


def archive_members(spark: SparkSession, path: str, most_archive: int = 15 << 20, most_member: int = 500_000) -> DataFrame:
    """members_of() for tar files; an archive beyond the size limit is a row with an error and is not read."""
    d = spark.read.format("binaryFile").load(path)
    none = F.lit(None)
    large = d.where(F.col("length") > most_archive).select(F.col("path").alias("archive"), none.cast("string").alias("member"), none.cast("binary").alias("raw"), F.lit("archive too large").alias("error"))
    return members_of(d.where(F.col("length") <= most_archive), most_member).unionByName(large)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def as_mail(body: Column) -> Column:
    """A text as a mail without a subject."""
    return F.encode(F.concat(F.lit('MIME-Version: 1.0\r\nContent-Type: text/plain; charset="utf-8"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), F.base64(F.encode(body, "utf-8"))), "utf-8")


def first_answers(df: DataFrame, key: str, answers: str, per_class: int, label: str, seed: int | str, least: int = 40, most: int = 4000) -> DataFrame:
    """Of each row the first answer of over `least` characters, each text once, `per_class` of each label by hash order, cut at `most`."""
    from quillspark.operators import dedupe, sampling

    one = df.select(key, label, F.get(F.filter(F.col(answers), lambda a: F.length(a) > least), F.lit(0)).alias("text")).where("text IS NOT NULL")
    one = dedupe.keep_first(one, F.col("text"), key)
    return sampling.per_class(one, label, per_class, seed, key).withColumn("text", F.substring("text", 1, most))


@dataclass
class Settings:
    """Service settings; environment variables of the same upper-case names win, within bounds."""

    api_key: str = ""
    sem_batch: int = 8
    sem_conc: int = 8
    api_retries: int = 2
    api_timeout: float = 35.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        out = cls()
        for f in fields(cls):
            if (raw := env.get(f.name.upper())) is not None:
                setattr(out, f.name, type(getattr(out, f.name))(raw))
        out.api_key = "" if out.api_key.strip().lower() in lx.PLACEHOLDER_KEYS else out.api_key.strip()
        out.sem_batch, out.sem_conc = max(1, out.sem_batch), min(32, max(1, out.sem_conc))
        out.api_retries, out.api_timeout = min(5, max(0, out.api_retries)), max(5.0, out.api_timeout)
        return out
