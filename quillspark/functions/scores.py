"""Scores, fusion rules, verdicts and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx


def clamp(c: Column, lo: float, hi: float, digits: int = 4) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)), digits)


def valid_score(c: Column) -> Column:
    """The value if finite and within [0, 1], else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (d >= 0) & (d <= 1), d)


def mean_present(*cols: Column) -> Column:
    """Mean of what is not null; null if nothing is."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def verdict(c: Column) -> Column:
    """Five-way verdict of an unrounded mean; null counts as mixed."""
    out = F.when(c.isNull(), F.lit("MIXED"))
    for bound, label in lx.VERDICTS[:-1]:
        out = out.when(c < bound, F.lit(label))
    return out.otherwise(F.lit(lx.VERDICTS[-1][1]))


def semantic_label(score: Column, sufficient: Column) -> Column:
    return F.when(~sufficient, "insufficient_context").when(score >= 0.60, "ai_like").when(score >= 0.35, "mixed").otherwise("no_strong_ai_signals")


def reason(c: Column) -> Column:
    return F.when(c >= 0.8, "strong AI-generated writing patterns").when(c >= 0.6, "probable AI assistance in writing style").when(c >= 0.4, "mixed signals: style between human and AI").otherwise("no strong AI-writing patterns")


def fuse(base: Column, semantic: Column, has_model: Column, weight: float = 0.20) -> Column:
    """Semantic evidence raises a model's score by a share of what is left; a fallback takes the larger one."""
    return clamp(F.when(has_model, base + F.lit(weight) * semantic * (1 - base)).otherwise(F.greatest(base, semantic)), 0.0, 1.0)


def three_way(score: Column, human_cut: Column, ai_cut: Column) -> Column:
    """Uncertain where the score or a threshold is missing."""
    return F.when(score.isNull() | human_cut.isNull() | ai_cut.isNull(), "UNCERTAIN").when(score < human_cut, "HUMAN").when(score >= ai_cut, "AI").otherwise("UNCERTAIN")


def zone_label(score: Column, threshold: Column) -> Column:
    return F.when(threshold.isNull() | score.isNull(), "UNDETERMINED").when(score >= threshold, "AI").otherwise("HUMAN")


def final_score(zone_mean: Column, tree: Column) -> Column:
    return F.when(tree.isNull(), zone_mean).otherwise((zone_mean + tree) / 2)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalised(v: Column) -> Column:
    """Unit vector; null if empty, zero or not finite."""

    def of(d: Column, n: Column) -> Column:
        good = (F.size(d) > 0) & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (n > 0)
        return F.when(good, F.transform(d, lambda x: x / n))

    # Bound outside the loop, so the norm is summed once and not once for each dimension.
    return tx.once(F.transform(v, lambda x: x.cast("double")), lambda d: tx.once(norm(d), lambda n: of(d, n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity_score(v: Column, ai: Column, human: Column) -> Column:
    """Logistic of 8 times the similarity gap, clipped at 50; null on missing or unequal vectors."""

    def of(v: Column) -> Column:
        gap = F.lit(8.0) * (dot(v, ai) - dot(v, human))
        d = F.least(F.greatest(gap, F.lit(-50.0)), F.lit(50.0))
        ok = v.isNotNull() & ai.isNotNull() & human.isNotNull() & (F.size(v) == F.size(ai)) & (F.size(v) == F.size(human))
        return F.when(ok, 1 / (1 + F.exp(-d)))

    return tx.once(v, of)


def softmax(v: Column) -> Column:
    def of(e: Column) -> Column:
        return tx.once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))

    return tx.once(F.array_max(v), lambda top: tx.once(F.transform(v, lambda x: F.exp(x - top)), of))
