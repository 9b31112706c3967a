"""Explainable style profile of texts: segment rules, their fusion, and the verdict of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scores as sc
from quillspark.functions import text as tx
from quillspark.session import absent, opened


def exploded(df: DataFrame, key: str = "doc_id", body: str = "text", subject: str | None = None, most: int = lx.SEGMENTS) -> DataFrame:
    """A row for each segment: key, idx, kind, content.  The subject, if any, is segment -1."""
    parts = tx.segments(tx.nonnull(F.col(body)), most)
    # The number of segments is taken before the explode, not once more for each segment.
    rows = opened(df.select(F.col(key), parts.alias("parts")).select(key, "parts", F.size("parts").alias("n")), [key, "n"], F.col("parts"), "content", "idx")
    rows = rows.select(key, "idx", _kind(F.col("idx"), F.col("n"), F.col("content")).alias("kind"), "content")
    if subject:
        own = df.select(F.col(key), F.lit(-1).alias("idx"), F.lit("subject").alias("kind"), tx.strip(tx.nonnull(F.col(subject))).alias("content")).where("content <> ''")
        rows = rows.unionByName(own)
    return rows


def _kind(idx: Column, n: Column, content: Column) -> Column:
    return F.when((idx == n - 1) & tx.has_sign_off(content), "signature").otherwise("paragraph")


def spans(df: DataFrame, key: str = "doc_id", body: str = "text", most: int = lx.SEGMENTS) -> DataFrame:
    """key, idx, content, start, end (code points) of each sentence-level or paragraph segment.

    A segment is found from the end of the one before it; both are in order of the text.
    """
    t = absent(df, "span_text")[0]
    text = F.translate(F.substring(tx.nonnull(F.col(body)), 1, lx.SEMANTIC_CHARS), tx.MARK, " ")
    parts = tx.segments(F.col(body), most)

    def at(acc: Column, s: Column) -> Column:
        return F.position(s, F.col(t), acc["at"])

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<content:string,start:int,end:int>>").alias("out"))
    found = F.aggregate(
        parts,
        start,
        lambda acc, s: F.struct((at(acc, s) + F.length(s)).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("content"), (at(acc, s) - 1).alias("start"), (at(acc, s) - 1 + F.length(s)).alias("end")))).alias("out")),
    )
    return opened(df.withColumn(t, text), key, found["out"], "s", "idx").select(key, "idx", "s.content", "s.start", "s.end")


def near_repeated(keys: Column) -> Column:
    """Whether two of at most 40 sentences, each of 5 or more distinct tokens, overlap by 0.82 or more."""
    sets = F.filter(F.transform(keys, lambda k: F.array_distinct(tx.tokens(k))), lambda t: F.size(t) >= 5)
    indexed = F.transform(sets, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    # Bound outside the loops, so the sentences are tokenised once and not once for each of them.
    return tx.once(indexed, lambda all_: F.exists(all_, lambda a: F.exists(all_, lambda b: (b["i"] > a["i"]) & (tx.jaccard(a["t"], b["t"]) >= lx.NEAR_JACCARD))))


def rules(segments: DataFrame) -> DataFrame:
    """Adds what the rules see in content, and score, sufficient, label, signals."""
    c, low = F.col("content"), F.col("low")
    rows = segments.withColumns({"low": F.lower(c), "words": tx.word_count(c)})
    rows = rows.withColumns({
        "formulaic": tx.distinct_hits(low, lx.FORMULAIC),
        "transitions": tx.distinct_hits(low, lx.TRANSITIONS),
        "generic": tx.occurrences(low, lx.GENERIC),
        "numbers": tx.number_count(c),
        "sents": tx.sentences(c),
    })
    # Lengths matter from four sentences on and keys from two; most segments are one sentence.
    many = F.size("sents")
    lengths = F.when(many >= 4, F.filter(F.transform("sents", tx.word_count), lambda n: n > 0)).otherwise(F.array().cast("array<int>"))
    keys = F.when(many >= 2, F.filter(F.transform("sents", lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " "))), lambda k: tx.word_count(k) >= 5)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"lengths": lengths, "keys": keys})
    n = F.size("lengths")
    mean = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    rows = rows.withColumns({"mean": mean})
    spread = F.sqrt(F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(n, F.lit(0)))
    rows = rows.withColumns({
        "uniform": F.coalesce((n >= 4) & (F.col("mean") >= 8) & (spread / F.col("mean") <= 0.22), F.lit(False)),
        "repeats": F.size("keys") - F.size(F.array_distinct("keys")),
    })
    # Two sentences are needed for a pair, so most segments never enter the nested loop.
    rows = rows.withColumn("near", F.when((F.col("repeats") == 0) & F.size("keys").between(2, lx.NEAR_SENTENCES), near_repeated(F.col("keys"))).otherwise(F.lit(False)))
    k, t, g, r = F.col("formulaic"), F.col("transitions"), F.col("generic"), F.col("repeats")
    zero = F.lit(0.0)
    parts = F.when(k > 0, F.least(0.26 + 0.12 * (k - 1), F.lit(0.50))).otherwise(zero)
    parts += F.when(t > 0, F.least(0.04 * t, F.lit(0.12))).otherwise(zero)
    parts += F.when((g >= 2) & (F.col("numbers") < 2), 0.08).otherwise(zero)
    parts += F.when(F.col("uniform"), 0.08).otherwise(zero)
    parts += F.when(r > 0, F.least(0.15 + 0.04 * (r - 1), F.lit(0.23))).when(F.col("near"), 0.12).otherwise(zero)
    # Columns of their own, since what follows reads them several times.
    rows = rows.withColumn("raw", parts).withColumn("raw", F.when((F.col("numbers") >= 3) & (k == 0), F.greatest(F.col("raw") - 0.04, zero)).otherwise(F.col("raw")))
    enough = F.col("words") >= lx.LEAST_WORDS
    rows = rows.withColumn("score", F.when(enough, sc.clamp(F.col("raw"), 0.0, 0.95)).otherwise(zero))
    signal = [
        F.when(k > 0, F.concat(F.lit("formulaic_language: "), F.array_join(tx.hit_list(low, lx.FORMULAIC), "; "))),
        F.when(t > 0, F.concat(F.lit("formal_transitions: "), F.array_join(tx.hit_list(low, lx.TRANSITIONS), "; "))),
        F.when((g >= 2) & (F.col("numbers") < 2), "generic_wording: several broad claims with few concrete details"),
        F.when(F.col("uniform"), "uniform_sentence_structure: sentence lengths are unusually consistent"),
        F.when(r > 0, "repeated_content: one or more sentences are duplicated").when(F.col("near"), "near_repeated_content: sentences use highly similar wording"),
    ]
    signals = F.when(enough, F.filter(F.array(*signal), lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"sufficient": enough, "label": sc.semantic_label(F.col("score"), enough), "signals": signals}).drop("low", "sents", "lengths", "keys", "mean", "raw")


def profile(segments: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys (doc_id if none is given): score, label, sufficient, segments, signals (distinct, in order, at most 12).

    Segments of a document stand in one partition after the explode, so the partial
    aggregation leaves one narrow row for each document before the shuffle.
    """
    return _profile(segments, list(keys) or ["doc_id"], [])


def _profile(segments: DataFrame, keys: list[str], along: list[str]) -> DataFrame:
    """profile() with columns that are equal for all segments of the keys; a key without segments has one row with null content."""
    s = rules(segments)
    weight = F.when(F.col("sufficient"), F.greatest(F.sqrt(F.least(F.col("words"), F.lit(80))), F.lit(1.0)))
    weighted = F.sum(F.col("score") * weight) / F.sum(weight)
    highest = F.max(F.when(F.col("sufficient"), F.col("score")))
    seen = F.collect_list(F.when(F.size("signals") > 0, F.struct("idx", "signals")))
    g = s.groupBy(*keys).agg(sc.clamp(F.coalesce(0.75 * weighted + 0.25 * highest, F.lit(0.0)), 0.0, 0.95).alias("score"), F.bool_or("sufficient").alias("sufficient"), F.count("content").alias("segments"), seen.alias("seen"), *[F.any_value(c).alias(c) for c in along])
    signals = F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort("seen"), lambda x: x["signals"]))), 1, 12)
    return g.select(*keys, *along, "score", sc.semantic_label(F.col("score"), F.coalesce("sufficient", F.lit(False))).alias("label"), "sufficient", "segments", signals.alias("signals"))


def document_verdicts(docs: DataFrame, key: str = "doc_id", body: str = "text", models: DataFrame | None = None) -> DataFrame:
    """key, base_score, semantic_score, score, label, verdict of each row: the whole text path; with models also backend.

    models (key, transformer, linear) has the scores of trained models, null where one has none; of
    several rows of one key the larger scores count.  A document's base score is the transformer's,
    else the linear model's, else that of the keywords; only a model's score is raised by
    semantic evidence.  Without models every document takes the keywords.  Rows that share a key,
    or have none, are documents of their own: the segments of a row are put together by a number
    of the row, and what is known of the row goes along with them.
    """
    text = tx.nonnull(F.col(body))
    base = docs.select(F.col(key).alias("key"), tx.fallback_score(tx.mask(text)).alias("base_score"), F.lit("keywords").alias("backend"), tx.segments(text).alias("parts"))
    if models is not None:
        scored = models.groupBy(F.col(key).alias("key")).agg(F.max(sc.valid_score(F.col("transformer"))).alias("t"), F.max(sc.valid_score(F.col("linear"))).alias("l"))
        backend = F.when(F.col("t").isNotNull(), "transformer").when(F.col("l").isNotNull(), "linear").otherwise(F.col("backend"))
        base = base.join(scored, "key", "left").select("key", F.coalesce("t", "l", "base_score").alias("base_score"), backend.alias("backend"), "parts")
    rows = base.withColumns({"rid": F.monotonically_increasing_id(), "n": F.size("parts")})
    rows = rows.select("rid", "key", "base_score", "backend", "n", F.posexplode_outer("parts").alias("idx", "content"))
    rows = rows.select("rid", "key", "base_score", "backend", "idx", _kind(F.col("idx"), F.col("n"), F.col("content")).alias("kind"), "content")
    out = _profile(rows, ["rid"], ["key", "base_score", "backend"])
    score = sc.fuse(F.col("base_score"), F.col("semantic_score"), F.col("backend") != "keywords")
    out = out.select(F.col("key").alias(key), "base_score", "backend", F.col("score").alias("semantic_score"), "label").withColumn("score", score)
    out = out.withColumn("verdict", sc.verdict(F.col("score")))
    return out if models is not None else out.drop("backend")
