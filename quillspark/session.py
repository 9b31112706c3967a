"""Session for tests, the benchmark and interactive use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "quillspark") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def absent(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, which tells apart rows that are equal in the columns at hand; rows equal in it are equal rows."""
    return F.xxhash64(*[df[c] if not kind.startswith(("map", "variant")) else F.to_json(df[c]) for c, kind in df.dtypes])


def dealt(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for heavy work on each row, dealt out over all cores where its splits are fewer than the cores.

    A file of one row group is one task's work, however many cores wait.  A large table has more splits than
    cores and is read as it is, without a shuffle; where it has fewer, a shuffle of the columns in use costs
    less than the cores that would idle.  Two partitions a core even out long rows.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def opened(df: DataFrame, keep: str | list[str], array: Column, item: str, place: str | None = None) -> DataFrame:
    """keep and item (and its place) for each element of array; a row whose array is empty or null has none.

    A plain explode lets the optimizer ask for the array's size before, which computes the array
    again; the outer one with a filter on the place computes it once.
    """
    keep = [keep] if isinstance(keep, str) else keep
    at = place or absent(df, "place_of")[0]
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())
    return rows if place else rows.drop(at)


def by_rows(of: Callable, kind: T.DataType | str):
    """Column function of a Python function of one value whose work and result are large beside the row.

    Rows go to Python a hundred at a time, as Spark's plain functions do, and not in Arrow batches of up to 10,000,
    of which a worker would hold the inputs and all results at once: so what it holds does not grow with the table.
    """
    return F.udf(of, kind, useArrow=False)


#: Characters of text that a task is given where what it holds grows with the terms of its texts.
PART_CHARS = 1_000_000


def parts_for(df: DataFrame, body: str) -> int:
    """Partitions of about PART_CHARS characters of a text column, and no fewer than there are cores: their number grows with the table, and not what a task holds."""
    chars = df.agg(F.sum(F.length(body).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, chars // PART_CHARS + 1)


#: Rows of a class table that is sent to all tasks.
FEW = 10_000


def by_class(classes: DataFrame, table: DataFrame) -> DataFrame:
    """table, a row for each class, to be joined with all rows: sent to all tasks if there are at most FEW classes.

    A join by class would send each class to one task.
    """
    return F.broadcast(table) if classes.limit(FEW + 1).count() <= FEW else table


def ranged(df: DataFrame, part: str, *order: str | Column) -> DataFrame:
    """df range-partitioned by order, with its partition in the column part; written to the shared folder once.

    Range bounds are drawn anew wherever a plan is run, so numbers that are put together from two
    readings of the partitions must both come from one written table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark/ranged-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that lineage ends on storage that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with this text unless it is there; it is renamed into place, so nobody reads half of it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    fs.mkdirs(at.getParent())
    aside = hadoop.Path(at.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(fs.makeQualified(at).toUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(at), plain)
    except Exception:
        fs.delete(aside, False)
        # Another writer was first; any other failure goes on.
        if not fs.exists(at):
            raise
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one for a local session and an error for a cluster."""
    import tempfile

    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")
