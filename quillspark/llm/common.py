"""Shared folder, staged tables and column helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster gets an error, since
    no folder of this machine would be there for the executors.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        found = context.getCheckpointDir()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_dir(spark).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


#: Paths staged inside each settled() that is under way.
_MADE: list[list[str]] = []


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, on storage that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    if _MADE:
        _MADE[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() staged; the tables that make() staged on its way are deleted, since nothing reads them any more.

    So are the shuffle files of what went out of scope: Spark drops them once the driver's
    garbage collector has found them free, which it is asked for here.
    """
    _MADE.append([])
    try:
        df = make()
        path, schema = scratch(spark, name), df.schema
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for old in _MADE.pop():
            remove(spark, old)
    del df
    gc.collect()
    spark._jvm.System.gc()
    if _MADE:
        _MADE[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def absent(docs: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of docs has, in upper or lower case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hadoop_fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return fs.exists(p)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read; whatever else docs holds can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, mod n (null stays null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns by name, in the order of schema."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[x.strip().split()[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (got := fn(batch)) is not None:
                arrays = [got[n] if isinstance(got[n], pa.Array) and got[n].type == t else pa.array(got[n], type=t) for n, t in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)
