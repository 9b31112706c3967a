"""Thresholds, calibration and evaluation of scores against labels, grouped by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import absent, ranged


def _by_score(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """A row for each distinct score with the number of each class: what every curve needs, after a combining shuffle."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def _running(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """The rows of _by_score with cum_p and cum_n (up to the score), all_p and all_n, and the scores before and after.

    Distinct scores are as many as rows where scores are continuous, so no window holds all of
    a key's: they are range-partitioned by keys and score, summed within their partitions, and moved
    on by the sums of the key's earlier partitions, a row for each key and partition.
    """
    (part,) = absent(df, "part_of")
    rows = ranged(_by_score(df, label, score, keys), part, *keys, "s")
    own = W.partitionBy(part, *keys).orderBy("s")
    up = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumns({"cum_p": F.sum("p").over(up), "cum_n": F.sum("n").over(up), "next": F.lead("s").over(own), "prev": F.lag("s").over(own)})
    # As many rows as there are partitions, for each key.
    sums = rows.groupBy(part, *keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    along, whole = W.partitionBy(*keys).orderBy(part), W.partitionBy(*keys)
    at = {k: f"key_{i}" for i, k in enumerate(keys)}
    sums = sums.select(F.col(part).alias("at"), *[F.col(k).alias(x) for k, x in at.items()], (F.sum("p").over(along) - F.col("p")).alias("before_p"), (F.sum("n").over(along) - F.col("n")).alias("before_n"), F.lead("lo").over(along).alias("later"), F.lag("hi").over(along).alias("earlier"), F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"))
    same = F.col(part) == F.col("at")
    for k, x in at.items():
        same &= F.col(k).eqNullSafe(F.col(x))
    d = local.join(sums, same)
    return d.select(*keys, "s", "p", "n", (F.col("cum_p") + F.col("before_p")).alias("cum_p"), (F.col("cum_n") + F.col("before_n")).alias("cum_n"), "all_p", "all_n", F.coalesce("next", "later").alias("next"), F.coalesce("prev", "earlier").alias("prev"))


def _cuts(d: DataFrame, k: list[str]) -> DataFrame:
    """youden_cut of running sums."""
    d = d.where("all_p > 0 AND all_n > 0")
    # At the cut above score s, what is >= cut are the rows after s, unless clipping to 1 puts the cut on s itself.
    top = F.least(F.lit(1.0), F.col("s") + 1e-6)
    mid = F.when(F.col("next").isNotNull(), (F.col("s") + F.col("next")) / 2).otherwise(top)
    on_top = F.col("next").isNull() & (mid <= F.col("s"))
    after_p = F.col("all_p") - F.col("cum_p") + F.when(on_top, F.col("p")).otherwise(0)
    after_n = F.col("all_n") - F.col("cum_n") + F.when(on_top, F.col("n")).otherwise(0)
    upper = F.struct(mid.alias("c"), (after_p / F.col("all_p") - after_n / F.col("all_n")).alias("j"))
    lower = F.when(F.col("prev").isNull(), F.struct(F.greatest(F.lit(0.0), F.col("s") - 1e-6).alias("c"), F.lit(0.0).alias("j")))
    both = d.select(*k, F.inline(F.array_compact(F.array(upper, lower))))
    at = {x: f"key_{i}" for i, x in enumerate(k)}
    best = both.groupBy(*[F.col(x).alias(y) for x, y in at.items()]).agg(F.max("j").alias("best"))
    same = F.abs(F.col("j") - F.col("best")) < 1e-10
    for x, y in at.items():
        same &= F.col(x).eqNullSafe(F.col(y))
    # A row for each key: the planner sends it to all tasks where it is small.
    won = both.join(best, same) if k else both.crossJoin(best).where(same)
    return won.groupBy(*k).agg(F.round(F.median("c"), 5).alias("cut"), F.round(F.max("j"), 4).alias("j"))


def youden_cut(df: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """keys, cut, j: the median of the thresholds with the largest TPR - FPR.

    Candidates are the midpoints of neighbouring distinct scores and a little beyond both ends,
    kept within [0, 1].  Running sums over range partitions replace the quadratic scan.
    """
    return _cuts(_running(df, label, score, list(keys)), list(keys))


def _quantile(q: float, cum: str, n: str) -> Column:
    """The interpolated quantile of a class, from its running counts."""
    at = F.lit(q) * (F.max(n) - 1)
    place = F.lit(q) * (F.col(n) - 1)
    lo, hi = F.min(F.when(F.col(cum) > F.floor(place), F.col("s"))), F.min(F.when(F.col(cum) > F.ceil(place), F.col("s")))
    return lo + (at - F.floor(at)) * (hi - lo)


def engine_thresholds(df: DataFrame, label: str, score: str, *keys: str, least: int = 3) -> DataFrame:
    """keys, human_cut, ai_cut, youden_cut, youden_j, n: a narrow band of uncertainty around the Youden cut; no row for keys with too few labels."""
    k = list(keys)
    run = _running(df, label, score, k)
    q = run.groupBy(*k).agg(_quantile(0.9, "cum_n", "all_n").alias("human"), _quantile(0.1, "cum_p", "all_p").alias("ai"), F.max("all_n").alias("n0"), F.max("all_p").alias("n1")).where(f"n0 >= {least} AND n1 >= {least}")
    y = _cuts(run, k)
    at = {x: f"cut_key_{i}" for i, x in enumerate(k)}
    y = y.withColumnsRenamed(at)
    same = F.lit(True)
    for x, z in at.items():
        same &= F.col(x).eqNullSafe(F.col(z))
    d = q.join(y, same) if k else q.crossJoin(y)  # one row each
    gap = F.least(F.lit(0.15), F.greatest(F.lit(0.025), 0.15 * (F.col("ai") - F.col("human"))))
    lo, hi = F.greatest("human", F.col("cut") - gap), F.least("ai", F.col("cut") + gap)
    narrow = (F.col("human") < F.col("ai")) & (lo < hi)
    human = F.when(narrow, lo).otherwise(F.greatest(F.lit(0.0), F.col("cut") - 0.025))
    ai = F.when(narrow, hi).otherwise(F.least(F.lit(1.0), F.col("cut") + 0.025))
    return d.select(*k, F.round(human, 5).alias("human_cut"), F.round(ai, 5).alias("ai_cut"), F.col("cut").alias("youden_cut"), F.col("j").alias("youden_j"), (F.col("n0") + F.col("n1")).alias("n"))


def roc_auc(df: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """keys, auc by the rank sum, ties at their average rank; null where a class is missing."""
    d = _running(df, label, score, list(keys))
    rank = F.col("cum_p") + F.col("cum_n") - (F.col("p") + F.col("n")) + (F.col("p") + F.col("n") + 1) / 2
    g = d.groupBy(*keys).agg(F.sum(rank * F.col("p")).alias("r"), F.max("all_p").alias("p"), F.max("all_n").alias("n"))
    return g.select(*keys, F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 6).alias("auc"))


def confusion(df: DataFrame, label: str, predicted: Column, *keys: str) -> DataFrame:
    y = F.col(label)
    counts = {"tn": (y == 0) & (predicted == 0), "fp": (y == 0) & (predicted == 1), "fn": (y == 1) & (predicted == 0), "tp": (y == 1) & (predicted == 1)}
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def report(df: DataFrame, label: str, predicted: Column, *keys: str) -> DataFrame:
    """Confusion counts with accuracy, balanced accuracy, precision, recall and F1 (0 where undefined)."""
    c = confusion(df, label, predicted, *keys)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)

    recall, tnr = F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)), F.coalesce(tn / F.nullif(tn + fp, F.lit(0)), F.lit(0.0))
    return c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": F.round((recall + tnr) / 2, 6), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def class_report(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """A row for each class: precision, recall, F1, support."""
    both = df.select(F.col(label).cast("long").alias("y"), predicted.cast("long").alias("z"))
    rows = both.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit(1).alias("is_y"), (F.col("y") == F.col("z")).cast("int").alias("hit"), F.lit(0).alias("is_z")), F.struct(F.col("z").alias("class"), F.lit(0).alias("is_y"), F.lit(0).alias("hit"), F.lit(1).alias("is_z")))).alias("r"))
    g = rows.groupBy("r.class").agg(F.sum("r.hit").alias("hit"), F.sum("r.is_y").alias("support"), F.sum("r.is_z").alias("named"))
    zero = F.lit(0.0)
    return g.select("class", F.round(F.coalesce(F.col("hit") / F.nullif("named", F.lit(0)), zero), 6).alias("precision"), F.round(F.coalesce(F.col("hit") / F.nullif("support", F.lit(0)), zero), 6).alias("recall"), F.round(F.coalesce(2 * F.col("hit") / F.nullif(F.col("named") + F.col("support"), F.lit(0)), zero), 6).alias("f1"), "support")


def decision_flags(df: DataFrame, label: str, verdict: Column) -> DataFrame:
    """One row: share of uncertain verdicts, and how many of each class were told wrong."""
    return df.agg(F.round(F.avg((verdict == "UNCERTAIN").cast("int")), 6).alias("uncertain_fraction"), F.count_if((verdict == "AI") & (F.col(label) == 0)).alias("human_flagged_ai"), F.count_if((verdict == "HUMAN") & (F.col(label) == 1)).alias("ai_flagged_human"))
