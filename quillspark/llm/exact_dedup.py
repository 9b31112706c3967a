"""Operator 8, exact dedup [native].

A persistent index of text digests, bucketed and sorted by digest.  New documents are
digested, reduced to one row for each digest, and sort-merge anti-joined with the index;
what is left is appended under the name of its batch.  Which document of a digest stays is
then read from the index.  Of equal texts within a batch the largest doc_id stays; a text
that the index knows from an earlier batch is a duplicate of the document named there.

A batch that is sent again, after a crash at any point or because its answer was lost, gets
its first answer: digests that the index holds under the batch's own name are its own, and
only those that are still missing are appended.  The number of buckets stands beside the
index, so that it is opened as it was written.  Each batch adds a file to every bucket it has
digests for; compact() merges them into one sorted file a bucket.  One writer at a time: two that
append at once may both find a digest missing.

Defined cases: null text counts as empty; null doc_id is smaller than any other; rows that
repeat both doc_id and text are equal texts like any others, and exactly one of them is
kept; an empty batch gives no rows; a very long text is one digest like any other; extra
columns are ignored, whatever their names.  A digest that a large share of rows has is
pre-aggregated, and rows are joined back with those heavy digests by a broadcast of at most
HEAVY entries.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import absent, documents, exists, hadoop_fs, id_text, remove, scratch, settled, staged

#: At most so many digests count as heavy, since each has over 1/HEAVY of all rows.
HEAVY = 2000
#: Digests of the first batch for each bucket of a new index, and the fewest and most buckets.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 16, 1 << 16
#: Bits of one row of the bitmap that finds rows which may go, bits for each of their keys, and the most rows of it:
#: 4 KB each, so what is broadcast stays below 32 MB.
MAP_BITS, BITS_PER_KEY, MOST_MAPS = 1 << 15, 16, 1 << 13
#: Parts in which the registered query and the pipeline hand their documents to a new index.
PARTS = 2


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame, normalise=None) -> DataFrame:
    """doc_id, digest (32 bytes) and rid, which tells repeated rows apart."""
    d = id_text(docs)
    text = normalise(F.col("text")) if normalise else F.col("text")
    return d.select("doc_id", text_digest(text).alias("digest"), F.monotonically_increasing_id().alias("rid"))


class DigestIndex:
    """digest, keep_id, batch as a Parquet table below path, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.rows, self.note = f"{self.path}/rows", f"{self.path}/index.json"
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.known = exists(spark, self.note)
        if self.known:
            note = json.loads(self._noted())
            self.buckets, self.rows = note["buckets"], f"{self.path}/{note.get('rows', 'rows')}"
            self._declare()

    def _noted(self) -> str:
        fs, at = hadoop_fs(self.spark, self.note)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _declare(self) -> None:
        fs, at = hadoop_fs(self.spark, self.rows)
        fs.mkdirs(at)
        self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.rows}'")

    def create(self, expected: int) -> None:
        """Fixes the number of buckets, before any row is written, and notes it beside the rows."""
        if self.buckets is None:
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, -(-expected // PER_BUCKET) - 1).bit_length()))
        self._note({"buckets": self.buckets}, False)
        self._declare()
        self.known = True

    def files(self) -> int:
        """How many files the index has."""
        fs, at = hadoop_fs(self.spark, self.rows)
        return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(at)) if fs.exists(at) else 0

    def compact(self) -> bool:
        """Writes every bucket as one sorted file; False if that is what there is.

        The new rows stand beside the old ones until the note names them, so a crash on the way leaves
        the index as it was; the old rows are deleted last.
        """
        if not self.known or self.files() <= self.buckets:
            return False
        old, new = self.rows, f"rows-{uuid.uuid4().hex}"
        # As plain files: the planner takes a bucketed table for dealt out already, and leaves the repartition out.
        rows, was = self.spark.read.schema("digest binary, keep_id long, batch string").parquet(old), self.table
        self.rows, self.table = f"{self.path}/{new}", f"digest_index_{uuid.uuid4().hex}"
        self._declare()
        rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)
        self._note({"buckets": self.buckets, "rows": new}, True)
        self.spark.sql(f"DROP TABLE {was}")
        remove(self.spark, old)
        self.spark.catalog.refreshTable(self.table)
        return True

    def close(self) -> None:
        """Takes the index out of the session's catalog; its files stay."""
        if self.known:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _note(self, note: dict, again: bool) -> None:
        fs, at = hadoop_fs(self.spark, self.note)
        stream = fs.create(at, again)
        stream.write(bytearray(json.dumps(note).encode()))
        stream.close()

    def read(self) -> DataFrame:
        return self.spark.table(self.table) if self.known else self.spark.createDataFrame([], "digest binary, keep_id long, batch string")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests that the index lacks; groups has one row for each digest."""
        new = groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).alias("batch"))
        new = new.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        # One task for each bucket, so that each bucket gains one sorted file.
        new.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each digest: keep_id, the row that stays and the number of rows; partial sums come before the shuffle."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", F.col("rid")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")


def join_back(rows: DataFrame, groups: DataFrame, n: int, key: str = "digest", size: str = "group_size") -> DataFrame:
    """Each of the n rows with its group, if it has one.  Keys with over n / HEAVY rows are at most HEAVY: they go by broadcast, the others by sort-merge, so no task gathers the rows of a hot key."""
    bound = max(64, n // HEAVY)
    heavy = groups.where(F.col(size) > bound)
    marked = rows.join(F.broadcast(heavy), key, "left")
    rest = marked.where(F.col(size).isNull()).select(*rows.columns)
    light = groups.where(F.col(size) <= bound)
    return marked.where(F.col(size).isNotNull()).unionByName(rest.join(light.hint("merge"), key))


def cuts(rows: DataFrame, parts: int) -> list[int]:
    """Ascending doc_ids, at most parts - 1, that split the rows into about equal parts."""
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 1000).alias("p")).first()["p"] if shares else None
    return sorted(set(found or []))


def dedup(docs: DataFrame, index: DigestIndex, normalise=None, batch: str | None = None, parts: int = 1) -> DataFrame:
    """doc_id, keep_id, group_size (within these docs), kept, text_sha256, rid for each row of docs; the index gains the new digests.

    batch names this call for a later retry; without it the call is a batch of its own.  With
    parts, documents are added part by part in descending order of doc_id, null last, so that
    the largest doc_id of a text still stays.  A text that the index knew from another batch has
    the keep_id stored there and no kept row.
    """
    rows = staged(digests(docs, normalise), "digests")
    n, batch = rows.count(), batch or uuid.uuid4().hex
    edges: list = cuts(rows, parts)
    spans = list(zip([None, *edges], [*edges, None], strict=True))[::-1]
    if not index.known:
        index.create(n)
    found = []
    for low, high in spans:
        own = rows
        if high is not None:
            own = own.where(F.col("doc_id").isNull() | (F.col("doc_id") < high)) if low is None else own.where(F.col("doc_id") < high)
        if low is not None:
            own = own.where(F.col("doc_id") >= low)
        part = staged(groups_of(own), "digest-groups")
        index.append(part, batch)
        found.append(part)
    groups = found[0]
    for g in found[1:]:
        groups = groups.unionByName(g)
    kept = index.read().select("digest", F.col("keep_id").alias("old_id"), (F.col("batch") == batch).alias("own"))
    best = F.max(F.when(F.col("own"), F.struct(F.col("keep_id").isNotNull().alias("has"), "keep_id", "keep_rid"))).alias("best")
    groups = groups.hint("merge").join(kept, "digest").groupBy("digest").agg(F.max("old_id").alias("keep_id"), best, F.sum("group_size").alias("group_size"))
    groups = staged(groups.select("digest", "keep_id", F.col("best.keep_rid").alias("keep_rid"), "group_size"), "digest-known")
    out = join_back(rows, groups, n)
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "rid")


def bitmap(keys: DataFrame, place: Column, maps: int) -> DataFrame:
    """map, bits: a bit for each place (0 .. maps * MAP_BITS - 1) that occurs, at most `maps` rows of MAP_BITS bits."""
    return keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg(F.col("p") % MAP_BITS).alias("bits"))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that were decided to stay, all columns as they were.

    decided has doc_id, digest (of the whole text) and kept, one row for each row of docs.
    Texts that stay are not shuffled: a bitmap of the hashed keys of rows that go, or of whose
    equals some go, is broadcast (its size is bounded), and only rows that it marks are joined
    with the table of those keys.  With very many such keys more rows are marked than need be;
    the join decides all the same.  Of rows equal in doc_id and text, of which some go, one stays
    if any was decided to.
    """
    keys = decided.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.min("kept").alias("all"))
    one, two, kept, place, at, bits = absent(docs, "key_id", "key_digest", "key_kept", "key_place", "key_map", "key_bits")
    odd = staged(keys.where(~F.col("all")).select(F.col("doc_id").alias(one), F.col("digest").alias(two), F.col("kept").alias(kept)), "keys-odd")
    n = odd.count()
    if not n:
        return docs
    maps = min(MOST_MAPS, 1 << max(0, -(-n * BITS_PER_KEY // MAP_BITS) - 1).bit_length())
    hashed = F.pmod(F.xxhash64(one, two), F.lit(maps * MAP_BITS))
    marks = staged(bitmap(odd, hashed, maps).withColumnsRenamed({"map": at, "bits": bits}), "keys-map")
    rows = docs.withColumns({one: docs["doc_id"].cast("long"), two: text_digest(docs["text"])}).withColumn(place, hashed)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(place) % MAP_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # As conditions of the join, so that no row carries its 4 KB of the bitmap along.
    marked = [F.floor(F.col(place) / MAP_BITS).cast("int") == F.col(at), byte.bitwiseAND(F.expr(f"shiftleft(1, CAST({place} % 8 AS INT))")) != 0]
    clear = rows.join(F.broadcast(marks), marked, "left_anti").select(*docs.columns)
    open_ = rows.join(F.broadcast(marks), marked, "left_semi").drop(place)
    named = odd.select(F.col(one).alias(at), F.col(two).alias(bits), kept)
    same = [F.col(one).eqNullSafe(F.col(at)), F.col(two) == F.col(bits)]
    out = clear.unionByName(open_.join(named.drop(kept), same, "left_anti").select(*docs.columns))
    again = named.where(F.col(kept)).drop(kept)
    if again.isEmpty():
        return out
    return out.unionByName(open_.join(again, same, "left_semi").dropDuplicates([one, two]).select(*docs.columns))


def keep_first_of_equals(docs: DataFrame) -> DataFrame:
    """Rows of docs with one document for each text, the one with the largest doc_id, all columns as they were.

    Null and empty texts are equal texts, and one of them stays; of rows equal in doc_id and
    text one stays; an empty table gives no rows.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, scratch(spark, "digest-index"))
    decided = settled(spark, "dedup", lambda: dedup(docs, index, parts=PARTS).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"))
    return keep_rows(docs, decided)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a new index in PARTS batches: the later ones are anti-joined with what the earlier ones left there."""
    return dedup(documents(spark, sf_dir), DigestIndex(spark, scratch(spark, "digest-index")), parts=PARTS).drop("rid")


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
