"""Fusion of text and image evidence, image rollups, model output contracts, cached signals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scores as sc
from quillspark.session import opened


def decide(df: DataFrame) -> DataFrame:
    """Adds score, analyzer_count, verdict.

    df: text_score, text_available, image_status, image_count, image_score.  A missing status
    is ok only with images; invalid scores and absent modalities are skipped, never zero.
    """
    t = F.when(F.coalesce("text_available", F.lit(False)), sc.valid_score(F.col("text_score")))
    status = F.coalesce("image_status", F.when(F.coalesce("image_count", F.lit(0)) > 0, "ok").otherwise("unavailable"))
    i = F.when(status.isin("ok", "partial"), sc.valid_score(F.col("image_score")))
    n = t.isNotNull().cast("int") + i.isNotNull().cast("int")
    mean = sc.mean_present(t, i)
    return df.withColumns({"score": F.round(F.coalesce(mean, F.lit(0.5)), 3), "analyzer_count": n, "verdict": sc.verdict(mean)})


def image_rollup(images: DataFrame, key: str) -> DataFrame:
    """key, score, status, analyzed, requested from one row for each image (status, score)."""
    ok = F.col("status") == "ok"
    g = images.groupBy(key).agg(F.round(F.avg(F.when(ok, F.col("score"))), 3).alias("score"), F.count_if(ok).alias("analyzed"), F.count(F.lit(1)).alias("requested"))
    status = F.when(F.col("analyzed") == F.col("requested"), "ok").when(F.col("analyzed") > 0, "partial").otherwise("error")
    return g.select(key, F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"), "analyzed", "requested")


def image_ref_status(c: Column) -> Column:
    """ok_remote, ok_inline, or why a reference is refused.  Pixels are not looked at."""
    ref = F.trim(c)
    remote = F.startswith(ref, F.lit("http://")) | F.startswith(ref, F.lit("https://"))
    host = F.try_parse_url(ref, F.lit("HOST"))
    user = F.try_parse_url(ref, F.lit("USERINFO"))
    data = F.regexp_extract(ref, r"(?is)^data:(image/(?:png|jpeg|webp|gif));base64,(.*)$", 2)
    payload = F.when(F.startswith(ref, F.lit("data:")), data).otherwise(ref)
    raw = F.try_to_binary(F.regexp_replace(payload, r"\s+", ""), F.lit("base64"))
    return (
        F.when(c.isNull() | (ref == ""), "empty image reference")
        .when(remote & (host.isNull() | user.isNotNull()), "invalid remote image URL")
        .when(remote, "ok_remote")
        .when(F.startswith(ref, F.lit("data:")) & ~ref.rlike(r"(?is)^data:image/(?:png|jpeg|webp|gif);base64,"), "unsupported image data URI")
        .when(F.length(payload) > 4 * lx.IMAGE_BYTES // 3 + 8, "image payload too large")
        .when(raw.isNull(), "invalid base64 image")
        .when((F.octet_length(raw) == 0) | (F.octet_length(raw) > lx.IMAGE_BYTES), "empty or oversized image")
        .otherwise("ok_inline")
    )


def fenced_json(c: Column) -> Column:
    """Model output without code fences and blanks."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*|\s*```$", ""))


def scores_by_index(df: DataFrame, content: str = "content", n: str = "n") -> DataFrame:
    """Adds scores: the model's list of {i, score} in order of i, or null if it breaks the contract.

    The contract: exactly n items, whole indices 0 to n - 1, each once, finite scores in [0, 1].
    """
    body = fenced_json(F.col(content))
    items = "array<struct<i:int,score:double>>"
    first = F.from_json(body, items, {"mode": "PERMISSIVE"})
    second = F.from_json(F.nullif(F.regexp_extract(body, r"(?s)\[\s*\{.*\}\s*\]", 0), F.lit("")), items)
    got = F.coalesce(first, second)
    index = F.transform(got, lambda x: x["i"])
    good = (F.size(got) == F.col(n)) & (F.size(F.array_distinct(index)) == F.col(n)) & F.forall(got, lambda x: x["i"].isNotNull() & (x["i"] >= 0) & (x["i"] < F.col(n)) & sc.valid_score(x["score"]).isNotNull())
    return df.withColumn("scores", F.when(good, F.transform(F.array_sort(got), lambda x: x["score"])))


def object_score(c: Column) -> tuple[Column, Column]:
    """(score, reason) of a model's JSON object, found in fences or in other words; nulls if there is none."""
    body = fenced_json(c)
    kind = "struct<score:double,reason:string>"
    got = F.coalesce(F.from_json(F.when(F.startswith(body, F.lit("{")), body), kind), F.from_json(F.nullif(F.regexp_extract(body, r"\{[\s\S]*\}", 0), F.lit("")), kind))
    score = F.round(sc.valid_score(got["score"]), 3)
    return score, F.when(score.isNotNull(), F.substring(F.coalesce(F.nullif(got["reason"], F.lit("")), F.lit("vision model estimate")), 1, 400))


def with_cache(jobs: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(jobs with value, distinct keys still to compute).  Null values are never cached, the latest row of a key counts."""
    latest = cache.where("value IS NOT NULL").groupBy(key).agg(F.max_by("value", "stored_at").alias("value"))
    hit = jobs.join(latest, key, "left")
    return hit, hit.where("value IS NULL").select(key).distinct()


#: Phrases of one automaton; a longer list is cut into so many parts by hash.
MOST_PHRASES = 100_000


def lexicon_matches(df: DataFrame, lexicon: DataFrame, key: str, body: str) -> DataFrame:
    """key, group, hits: phrases of each group that occur in the lower-cased text; rows that share a key are one.

    An automaton of the distinct phrases finds all of them in one pass over a text.  A list of
    over MOST_PHRASES is cut into parts by hash, each an automaton of its own over the same texts,
    so what a task holds is bounded and no list is too long.  An empty phrase is in every text, a
    null one in none, and null texts have none at all.
    """
    phrases = lexicon.where(F.col("phrase").isNotNull()).select("group", "phrase").distinct()
    texts = df.where(F.col(body).isNotNull()).select(F.col(key), F.lower(body).alias("low"))
    parts = max(1, -(-phrases.select("phrase").distinct().count() // MOST_PHRASES))
    found = None
    for i in range(parts):
        # At most about MOST_PHRASES rows.
        own = sorted(r["phrase"] for r in phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i).select("phrase").distinct().collect())
        hits = opened(texts, key, _occurring(own)(F.col("low")), "phrase")
        found = hits if found is None else found.unionByName(hits)
    return found.join(phrases, "phrase").groupBy(key, "group").agg(F.count_distinct("phrase").alias("hits"))


def _occurring(phrases: list[str]):
    """Column function: the distinct phrases that occur in a text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # The automaton is built once for a task, not once for each batch.
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in phrases:
            if p:
                machine.add_word(p, p)
        machine.make_automaton()
        always = ["" for p in phrases if not p]
        search = machine.iter if len(machine) else lambda _: ()
        for s in batches:
            yield pd.Series([[*always, *{p for _, p in search(t)}] for t in s])

    return run
