"""Operator 6, mixing sources to target weights [native].

Each source gets a target of words.  A target of r times the source's words first gives
every document floor(r) certain copies.  The rest is a Pareto order sample: a document's
rank is its random odds divided by its inclusion odds, and documents are taken in rank
order until the words left over are reached, so the sample's size is fixed, not only
expected.  Inclusion odds are the source's (from the left-over fraction) times the
document's tilt; by default longer documents have the higher odds, by the root of their size over
the source's mean, within [1/4, 4].

The cut of a source is found without sorting the source: ranks are mapped to (0, 1) and
summed in 1,024 cells, then the one cell that holds the cut in 1,024 finer ones, and only
the finest cell is ordered row by row.  So a source with a third of all rows costs no task
more than its share.

Defined cases: null text counts as empty (size 0; never changes a target, taken is 0);
a null source is a source of its own, last in order; a source without words has target 0;
rows that repeat a doc_id, or have none, are drawn each on its own while their texts differ;
rows equal in doc_id, source and text are taken together; a very long text counts with all its
words, and its source may miss its target by up to half of it; an empty table gives no rows;
extra columns are ignored, whatever their names.
Random numbers come from SHA-256 of seed, doc_id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import documents, staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
CELLS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def measures(docs: DataFrame, seed: str = SEED) -> dict[str, Column]:
    """doc_id, source, size (the number of words of the whole text) and draw of the rows of docs.

    draw holds the first 52 bits of a digest of the seed, doc_id and text, so rows that share a
    doc_id, or have none, are drawn each on its own; only rows equal in doc_id, source and text
    share a draw.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary")))
    return {
        "doc_id": docs["doc_id"].cast("long"),
        "source": docs["source"].cast("string"),
        "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "draw": F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 13), 16, 10).cast("long"),
    }


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, mean, target: one row for each source.

    Sources below their cap share what is left by weight.  With sources ordered by cap over
    weight, those that reach it come first; the level of the rest is that of the first
    source which stays below its cap, and the highest of all such levels.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).withColumn("top", cap * F.col("source_size"))
    rising = W.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    rows = rows.withColumn("below", F.sum("top").over(rising) - F.col("top")).withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(rising) + F.col("weight"))
    rows = rows.withColumn("all", F.lit(share) * F.sum("source_size").over(everything)).withColumn("level", (F.col("all") - F.col("below")) / F.col("left"))
    rows = rows.withColumn("stands", F.max(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.col("level"))).over(everything))
    target = F.when(F.col("stands").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("stands") * F.col("weight")))
    return rows.select("source", "source_size", (F.col("source_size") / F.col("n")).alias("mean"), target.alias("target"))


def ranked(rows: DataFrame, per_source: DataFrame, source: str, size: str, draw: str) -> DataFrame:
    """rows with source_size, target, sure (certain copies), want (words beyond them), at (the rank in (0, 1)) and its cells c1 and c2."""
    rows = rows.join(per_source, F.col(source).eqNullSafe(F.col("of")), "inner").drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("sure", F.floor(ratio + 1e-12).cast("long")).withColumn("part", F.greatest(ratio - F.col("sure"), F.lit(0.0)))
    rows = rows.withColumn("want", F.col("target") - F.col("sure") * F.col("source_size"))
    tilt = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.sqrt(F.col(size) / F.col("mean"))))
    u = (F.col(draw).cast("double") + 0.5) / float(1 << 52)
    odds = F.col("part") / (1 - F.col("part")) * F.when(F.col("mean") > 0, tilt).otherwise(F.lit(1.0))
    rank = (u / (1 - u)) / odds
    # rank / (1 + rank) has the order of rank and lies in (0, 1).
    rows = rows.withColumn("at", F.when((F.col("part") > 0) & (F.col(size) > 0), F.round(rank / (1 + rank), 14)))
    rows = rows.withColumn("c1", F.least(F.floor(F.col("at") * CELLS), F.lit(CELLS - 1)).cast("int"))
    return rows.withColumn("c2", F.least(F.floor((F.col("at") * CELLS - F.col("c1")) * CELLS), F.lit(CELLS - 1)).cast("int")).drop("mean", "part")


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row for each source: target and the cells of its cut; the rows of the last cell that are taken; sizes with their ranks), all staged."""
    per_source = staged(targets(sizes, weights, share, cap), "mix-targets").withColumnRenamed("source", "of")
    rows = staged(ranked(sizes, per_source, "source", "size", "draw"), "mix-ranks")
    open_ = rows.where(F.col("at").isNotNull())
    named = ["source", "want"]

    def cut(cells: DataFrame, cell: str, name: str) -> DataFrame:
        """The cell of each source in which the running sum reaches want, and the sum before it."""
        w = W.partitionBy("source").orderBy(cell)
        run = cells.withColumn("before", F.sum("words").over(w) - F.col("words") + F.col("base"))
        return run.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("words") >= F.col("want"))).groupBy("source").agg(F.min(F.struct(cell, "before")).alias("hit")).select(F.col("source").alias(f"of_{name}"), F.col(f"hit.{cell}").alias(f"cut_{name}"), F.col("hit.before").alias(f"base_{name}"))

    coarse = open_.groupBy(*named, "c1").agg(F.sum("size").alias("words")).withColumn("base", F.lit(0))
    first = staged(cut(coarse, "c1", "1"), "mix-cut1")
    inside = open_.join(first, F.col("source").eqNullSafe(F.col("of_1")) & (F.col("c1") == F.col("cut_1")))
    fine = inside.groupBy(*named, "c2", F.col("base_1").alias("base")).agg(F.sum("size").alias("words"))
    second = staged(cut(fine, "c2", "2"), "mix-cut2")
    last = inside.join(second, F.col("source").eqNullSafe(F.col("of_2")) & (F.col("c2") == F.col("cut_2")))
    w = W.partitionBy("source").orderBy("at", "doc_id", "size", "draw").rangeBetween(W.unboundedPreceding, W.currentRow)
    # The document over the end is taken if more than half of it fits.
    edge = last.withColumn("sum", F.sum("size").over(w) + F.col("base_2")).where(F.col("sum") - F.col("size") / 2 <= F.col("want"))
    edge = staged(edge.select(F.col("source").alias("e_source"), F.col("doc_id").alias("e_id"), F.col("size").alias("e_size"), F.col("draw").alias("e_draw")).distinct().withColumn("e", F.lit(True)), "mix-edge")
    cuts = per_source.join(first, F.col("of").eqNullSafe(F.col("of_1")), "left").join(second, F.col("of").eqNullSafe(F.col("of_2")), "left")
    return staged(cuts.select("of", "source_size", "mean", "target", "cut_1", "cut_2"), "mix-cuts"), edge, rows


def copies_of(edge: DataFrame, rows: DataFrame, doc_id: str, source: str, size: str, draw: str) -> DataFrame:
    """rows (with ranks and the cells of the cut) with copies."""
    same = F.col(source).eqNullSafe(F.col("e_source")) & F.col(doc_id).eqNullSafe(F.col("e_id")) & (F.col(size) == F.col("e_size")) & (F.col(draw) == F.col("e_draw"))
    below = F.col("cut_1").isNull() | (F.col("c1") < F.col("cut_1")) | ((F.col("c1") == F.col("cut_1")) & (F.col("cut_2").isNull() | (F.col("c2") < F.col("cut_2")))) | F.coalesce(F.col("e"), F.lit(False))
    sampled = F.when(F.col("at").isNotNull() & below, F.lit(1)).otherwise(F.lit(0))
    return rows.join(edge, same, "left").withColumn("copies", (F.col("sure") + sampled).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs."""
    sizes = staged(docs.select(*[c.alias(k) for k, c in measures(docs, seed).items()]), "mix-sizes")
    cuts, edge, rows = plan(sizes, weights, share, cap)
    out = copies_of(edge, rows.join(cuts.select("of", "cut_1", "cut_2"), F.col("source").eqNullSafe(F.col("of"))), "doc_id", "source", "size", "draw")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Rows of docs as often as the mix takes them, all columns as they were.

    A row is decided where it is read, from its own draw and its source's cut, so texts are not
    shuffled: what is joined is a row for each source and the few rows of the last cells.  A
    document without words (null and empty texts too) costs nothing and has no copies to take; it
    is left out.  An empty table gives no rows.
    """
    # Columns of docs stand aside in a struct, so no name of theirs can clash.
    found = measures(docs, seed)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in found.items()])
    sizes = staged(docs.select(*[c.alias(k) for k, c in found.items()]), "mix-sizes")
    cuts, edge, _ = plan(sizes, **options)
    placed = ranked(rows, cuts, "source", "size", "draw")
    out = copies_of(edge, placed, "doc_id", "source", "size", "draw").where("copies > 0 AND size > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", "copies")


OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS draw FROM documents
), g AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM s GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS top FROM g
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(top) OVER r - top)) / (sum(weight) OVER () - sum(weight) OVER r + weight) AS level
  FROM w WINDOW r AS (ORDER BY top / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, source_size / n AS mean,
         coalesce(least(top, weight * max(CASE WHEN level * weight <= top THEN level END) OVER ()), top) AS target FROM l
), p AS (
  SELECT s.doc_id, s.source, s.size, s.draw, source_size, mean, target,
         floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12)::BIGINT AS sure,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(ratio - sure, 0.0) AS part, target - sure * source_size AS want,
         (draw::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         CASE WHEN mean > 0 THEN greatest(0.25, least(4.0, sqrt(size / mean))) ELSE 1.0 END AS tilt
  FROM p
), o AS (
  SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part) * tilt) END AS rk FROM q
), c AS (
  SELECT *, CASE WHEN rk IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rk IS NULL ORDER BY round(rk / (1 + rk), 14), doc_id, size, draw) END AS run FROM o
)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (sure + CASE WHEN rk IS NOT NULL AND run - size / 2.0 <= want THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((sure + CASE WHEN rk IS NOT NULL AND run - size / 2.0 <= want THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""
