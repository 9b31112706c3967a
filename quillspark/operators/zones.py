"""Mail zones (subject, greeting, body, signature): split, scores in long form, features, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scores as sc
from quillspark.functions import text as tx
from quillspark.session import absent


def split(df: DataFrame, subject: str = "subject", body: str = "body") -> DataFrame:
    """Adds zone_subject, zone_greeting, zone_body, zone_signature, all native.

    Greeting: the first line, up to 120 characters, if it begins like one.  Signature: from the
    first sign-off within the last seven lines on, else the last of several blocks if it
    has at most four lines and a contact.
    """
    flat_, first_, rest_, lines_, n_, hit_, blocks_, last_ = made = absent(df, *(f"zone_{x}_of" for x in ("flat", "first", "rest", "lines", "n", "hit", "blocks", "last")))
    lines = F.transform(F.split(F.replace(tx.nonnull(F.col(body)), F.lit("\r\n"), F.lit("\n")), "\n"), lambda s: F.rtrim(s, F.lit(tx.BLANKS)))
    flat = F.btrim(F.array_join(lines, "\n"), F.lit("\n"))
    d = df.withColumn(flat_, flat).withColumn(first_, F.substring_index(flat_, "\n", 1))
    greets = (F.length(first_) <= 120) & tx.strip(F.col(first_)).rlike(lx.GREETING_START)
    d = d.withColumn("zone_greeting", F.when(greets, tx.strip(F.col(first_))).otherwise(""))
    rest = F.when(greets, F.ltrim(F.substring(F.col(flat_), F.length(first_) + 1, F.length(flat_)), F.lit("\n"))).otherwise(F.col(flat_))
    d = d.withColumn(rest_, rest).withColumn(lines_, F.when(F.col(rest_) == "", F.array().cast("array<string>")).otherwise(F.split(rest_, "\n"))).withColumn(n_, F.size(lines_))
    tail = F.slice(F.col(lines_), F.greatest(F.col(n_) - 6, F.lit(1)), F.lit(7))
    hit = F.array_position(F.transform(tail, lambda s: tx.strip(s).rlike(lx.SIGN_OFF_START)), F.lit(True)).cast("int")
    d = d.withColumn(hit_, F.when(hit > 0, F.greatest(F.col(n_) - 6, F.lit(1)) + hit - 1).otherwise(0))
    d = d.withColumn(blocks_, F.split(rest_, r"\n\s*\n")).withColumn(last_, tx.strip(F.element_at(blocks_, -1)))
    contact = (F.col(n_) >= 3) & (F.size(blocks_) > 1) & (F.size(F.split(last_, "\n")) <= 4) & F.col(last_).rlike(lx.CONTACT)
    signature = F.when(F.col(hit_) > 0, tx.strip(F.array_join(F.slice(F.col(lines_), F.greatest(hit_, F.lit(1)), F.greatest(n_, F.lit(1))), "\n"))).when(contact, F.col(last_)).otherwise("")
    kept = F.when(F.col(hit_) > 0, F.array_join(F.slice(F.col(lines_), F.lit(1), F.greatest(F.col(hit_) - 1, F.lit(0))), "\n"))
    kept = kept.when(contact, F.array_join(F.slice(F.col(blocks_), F.lit(1), F.greatest(F.size(blocks_) - 1, F.lit(0))), "\n\n")).otherwise(F.col(rest_))
    out = d.withColumns({"zone_subject": tx.strip(tx.nonnull(F.col(subject))), "zone_signature": signature, "zone_body": tx.strip(kept)})
    return out.drop(*made)


def long_form(df: DataFrame, key: str, *along: str) -> DataFrame:
    """key, the columns that go along, kind, text of each zone that isn't blank."""
    zones = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"zone_{k}").alias("text")) for k in lx.KINDS])
    return df.select(key, *along, F.inline(F.filter(zones, lambda z: tx.strip(z["text"]) != "")))


def means(zones: DataFrame) -> DataFrame:
    """Adds no_llm and with_llm, the means of what a zone has of tfidf, embedding (and semantic)."""
    t, e, s = F.col("tfidf"), F.col("embedding"), F.col("semantic")
    return zones.withColumns({"no_llm": sc.mean_present(t, e), "with_llm": sc.mean_present(t, e, s)})


def mean_over(name: str) -> Column:
    """An aggregate: the mean of a column over a mail's zones, summed in the order of KINDS however the rows stand, so that a mean on a cut falls on one side of it in every run."""
    known = F.col("kind").isin(*lx.KINDS)
    sums = [F.sum(F.when(F.col("kind") == k, F.col(name))) for k in lx.KINDS] + [F.sum(F.when(known, None).otherwise(F.col(name)))]
    total = F.coalesce(sums[0], F.lit(0.0))
    for x in sums[1:]:
        total = total + F.coalesce(x, F.lit(0.0))
    return total / F.nullif(F.count(name), F.lit(0))


def features(zones: DataFrame, key: str) -> DataFrame:
    """The ten inputs of the tree: a score and a flag for each zone, the mean of scores and of tfidf; absent scores are 0."""
    cols = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("no_llm"))), F.lit(0.0)).alias(f"score_{k}") for k in lx.KINDS]
    cols += [F.max((F.col("kind") == k).cast("double")).alias(f"has_{k}") for k in lx.KINDS]
    cols += [F.coalesce(mean_over("no_llm"), F.lit(0.0)).alias("mean_score"), F.coalesce(mean_over("tfidf"), F.lit(0.0)).alias("mean_tf")]
    return zones.groupBy(key).agg(*cols)


def final_scores(zones: DataFrame, trees: DataFrame, key: str) -> DataFrame:
    """key, covered (every zone has a semantic score), mode, final: the zones' mean in that mode, averaged with the tree's chance."""
    g = zones.groupBy(key).agg(F.bool_and(F.col("semantic").isNotNull()).alias("covered"), mean_over("no_llm").alias("n"), mean_over("with_llm").alias("w"))
    g = g.join(trees.select(key, "tree"), key, "left")
    mean = F.when(F.col("covered"), F.col("w")).otherwise(F.col("n"))
    return g.select(key, "covered", F.when(F.col("covered"), "with_llm").otherwise("no_llm").alias("mode"), sc.final_score(mean, F.col("tree")).alias("final"))


def verdicts(finals: DataFrame, zones: DataFrame, thresholds: DataFrame, key: str, human_cut: Column, ai_cut: Column, embeddings_expected: bool = True) -> DataFrame:
    """key, final, verdict, flagged.  A lost embedding or zones that disagree make it uncertain.

    thresholds: kind, threshold: one row for each kind at most; a kind with two is an error when the result is computed, as it would repeat the zones.
    """
    one = F.when(F.assert_true(F.count(F.lit(1)) == 1, F.lit("two thresholds for one kind")).isNull(), F.max("threshold"))
    z = zones.join(thresholds.groupBy("kind").agg(one.alias("threshold")), "kind", "left").withColumn("label", sc.zone_label(F.col("no_llm"), F.col("threshold")))
    g = z.groupBy(key).agg(F.bool_or(F.col("label") == "AI").alias("any_ai"), F.bool_or(F.col("label") == "HUMAN").alias("any_human"), F.bool_or(F.col("embedding").isNull()).alias("lost"), F.array_sort(F.collect_set(F.when(F.col("label") == "AI", F.col("kind")))).alias("flagged"))
    d = finals.join(g, key, "left")
    base = sc.three_way(F.col("final"), human_cut, ai_cut)
    unsure = F.col("any_ai").isNull() | (F.col("any_ai") & F.col("any_human")) | (F.lit(embeddings_expected) & F.col("lost"))
    return d.select(key, "final", F.when(unsure, "UNCERTAIN").otherwise(base).alias("verdict"), "flagged")
