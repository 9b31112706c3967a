"""Writers: CSV, one file a row, resumable appends, artefacts, keyed caches, reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_numbered(df: DataFrame, path: str, kind: str, name: str) -> None:
    """A folder for each row, below its class; only sensible for samples."""
    df.write.mode("overwrite").partitionBy(kind, name).option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key is not there yet, one for each key, and returns them; running it again appends nothing."""
    spark, df = df.sparkSession, df.dropDuplicates([key])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)
    return df


def put_signals(df: DataFrame, path: str) -> None:
    """Adds key, value, stored_at to a cache table; null values are never stored, readers take the latest of a key."""
    df.where("value IS NOT NULL").select("key", "value", F.current_timestamp().alias("stored_at")).write.mode("append").parquet(path)


def save_artefacts(path: str, model: PipelineModel | None = None, **tables: DataFrame) -> None:
    """A fitted pipeline and its small tables (centroids, thresholds, metrics) below one path."""
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
    for name, t in tables.items():
        t.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def load_artefacts(spark: SparkSession, path: str, *names: str) -> dict:
    """The pipeline and the named tables; an error names what is missing."""
    out: dict = {}
    for name in ("model", *names):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise RuntimeError(f"artefact missing: {path}/{name}")
        out[name] = PipelineModel.load(f"{path}/model") if name == "model" else spark.read.json(f"{path}/{name}")
    return out


def report_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON line."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
