"""Document verdicts over a stream of files.

All transforms of a document are stateless, so the stream needs no watermark: every micro
batch is scored as a batch and written under its batch id, and a batch that is tried
again overwrites its own folder, which makes the sink idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import profile as pr

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RESULT = "doc_id long, base_score double, semantic_score double, label string, score double, verdict string"


def read(spark: SparkSession, folder: str, pattern: str = "documents.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).parquet(folder)


def start(stream: DataFrame, out: str):
    """A query that scores micro batches into out/batches/<id>."""

    def write(batch: DataFrame, batch_id: int) -> None:
        pr.document_verdicts(batch).write.mode("overwrite").parquet(f"{out}/batches/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def drain(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """All files that are there now, scored by the stream, as one table.

    A table that is a folder of part files is read by its parts.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/documents.parquet")
    is_folder = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    stream = read(spark, f"{folder}/documents.parquet", "*.parquet") if is_folder else read(spark, folder)
    start(stream, out).awaitTermination()
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(f"{out}/batches")


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of kinds in tumbling windows, with a watermark when events is a stream."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark(ts, late)
    return t.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
