"""Queries over single texts: tokens, sentences, lexicons, cleaning, segment profiles, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx
from quillspark.operators import profile as pr
from quillspark.plans.sql import (
    GENERIC_SQL,
    NUMBERS_SQL,
    SEGMENTS_SQL,
    hits,
    key_sql,
    mask_sql,
    sentences_sql,
    strip_sql,
    tokens_sql,
    verdict_sql,
)
from quillspark.session import dealt, opened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on: dealt out over all cores where it has few splits."""
    return dealt(spark, f"{sf_dir}/{name}.parquet")


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t"), "text")
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), tx.space_word_count(F.col("text")).cast("long").alias("space_words"), F.get("t", F.lit(0)).alias("first_token"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"), F.size(F.array_distinct("s")).cast("long").alias("distinct_sentences"))


def normalized_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))


def ascii_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.round(tx.ascii_ratio(F.col("text")), 6).alias("ascii_ratio"), F.length("text").cast("long").alias("chars"))


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word lists over the texts of documents, each with one of the list's phrases worked in by its id."""
    low = F.lower(_seeded())
    d = texts(spark, sf_dir).select("doc_id", low.alias("t"))
    return d.select("doc_id", tx.distinct_hits(F.col("t"), lx.FORMULAIC).cast("long").alias("formulaic"), tx.distinct_hits(F.col("t"), lx.TRANSITIONS).cast("long").alias("transitions"), tx.occurrences(F.col("t"), lx.GENERIC).cast("long").alias("generic"), tx.distinct_hits(F.col("t"), lx.INDICATORS).cast("long").alias("indicators"), F.array_join(tx.hit_list(F.col("t"), lx.FORMULAIC), "; ").alias("first_formulaic"))


#: Phrases of the lists by doc_id, so that the lists have something to find in invented prose.
_PLANTED = [lx.FORMULAIC[i % len(lx.FORMULAIC)] + ". " + lx.TRANSITIONS[i % len(lx.TRANSITIONS)] + ", a " + lx.GENERIC[i % len(lx.GENERIC)] + " and " + lx.GENERIC[(i * 7 + 3) % len(lx.GENERIC)] + " to " + lx.INDICATORS[i % len(lx.INDICATORS)] for i in range(40)]


def _seeded():
    planted = F.array(*map(F.lit, _PLANTED))
    return F.concat(F.col("text"), F.lit(" "), F.element_at(planted, (F.col("doc_id") % len(_PLANTED) + 1).cast("int")))


_PLANTED_SQL = "text || ' ' || (['" + "', '".join(p.replace("'", "''") for p in _PLANTED) + f"'])[doc_id % {len(_PLANTED)} + 1]"


def number_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", tx.number_count(F.col("text")).cast("long").alias("numbers"))


def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.sha2(tx.mask(F.col("text")), 256).alias("masked_sha256"), F.length(tx.mask(F.col("text"))).cast("long").alias("masked_chars"))


def fallback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", tx.fallback_score(F.lower(_seeded())).alias("score"))


def _mail_like():
    """A text as a mail body with quoted lines, addresses, a rule and a reply mark."""
    return F.concat(F.lit("See https://example.org/x?a=1 or write to someone@example.org now.\n> quoted "), F.substring("text", 1, 40), F.lit("\nCall +49 30 1234 56789 today\n--------------------\n"), F.col("text"), F.lit("\n\n\n\nUnsubscribe here\nOn Monday the person at work wrote:\nlost "), F.col("text"))


def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as mails, cleaned; the rule for numbers looks around, which DuckDB can't, so a test holds it against brute force."""
    d = texts(spark, sf_dir).select("doc_id", tx.clean_corpus_text(_mail_like()).alias("c"))
    return d.select("doc_id", F.sha2("c", 256).alias("clean_sha256"), F.length("c").cast("long").alias("clean_chars"))


def fake_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    full = F.concat(F.lit("Return-Path: <a@b.c>\nSubject: x "), F.col("lang"), F.lit("\n\n"), F.col("text"))
    broken = F.concat(F.lit("Return-Path: <a@b.c>\n\n"), F.col("text"))
    both = F.when(F.col("doc_id") % 3 == 0, full).when(F.col("doc_id") % 3 == 1, broken).otherwise(F.col("text"))
    return d.select("doc_id", F.sha2(tx.strip_fake_headers(both), 256).alias("body_sha256"))


def likely_human_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("Re: "), F.col("source"))
    return texts(spark, sf_dir).where(tx.likely_human(subject, F.col("text"))).select("doc_id", F.col("source").alias("subject_source"))


def label_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, (" AI ", "Human", "yes", "NO", "1", "0", "True", "false", "maybe"))), (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "documents").groupBy(raw.alias("raw"), tx.parse_label(raw).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pr.profile(pr.exploded(texts(spark, sf_dir).select("doc_id", _seeded().alias("text"))))
    return p.select("doc_id", "score", "label", "sufficient", "segments", F.size("signals").cast("long").alias("n_signals"))


def segment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pr.rules(pr.exploded(texts(spark, sf_dir).select("doc_id", _seeded().alias("text"))))
    return r.select("doc_id", F.col("idx").cast("long").alias("idx"), "kind", F.col("words").cast("long").alias("words"), F.col("formulaic").cast("long").alias("formulaic"), F.col("generic").cast("long").alias("generic"), F.col("numbers").cast("long").alias("numbers"), "score", "label")


def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pr.spans(texts(spark, sf_dir))
    return s.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


def sentence_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population variation of sentence lengths over each whole text."""
    d = opened(texts(spark, sf_dir), "doc_id", tx.sentences(F.col("text")), "s").select("doc_id", tx.word_count(F.col("s")).alias("n")).where("n > 0")
    g = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return g.select("doc_id", "sentences", F.round("mean", 6).alias("mean_words"), F.round(F.col("sd") / F.col("mean"), 6).alias("variation"), ((F.col("sentences") >= 4) & (F.col("mean") >= 8) & (F.col("sd") / F.col("mean") <= 0.22)).alias("uniform"))


def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.filter(F.transform(tx.sentences(F.col("text")), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " "))), lambda k: tx.word_count(k) >= 5)
    d = texts(spark, sf_dir).select("doc_id", keys.alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("long_sentences"), (F.size("k") - F.size(F.array_distinct("k"))).cast("long").alias("repeats"))


def near_duplicate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.filter(F.transform(tx.sentences(F.col("text")), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " "))), lambda k: tx.word_count(k) >= 5)
    d = texts(spark, sf_dir).select("doc_id", keys.alias("k"))
    # The rule looks at texts of at most NEAR_SENTENCES sentences; of longer ones it says no.
    return d.select("doc_id", F.when(F.size("k").between(2, lx.NEAR_SENTENCES), pr.near_repeated(F.col("k"))).otherwise(F.lit(False)).alias("near_repeated"))


def doc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every document's semantic profile, fused score and five-way verdict."""
    return pr.document_verdicts(texts(spark, sf_dir).select("doc_id", _seeded().alias("text")))


def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", "source", _seeded().alias("text"))
    v = pr.document_verdicts(d)
    return d.select("doc_id", "source").join(v, "doc_id").groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def subject_body_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first sentence as a subject against the rest of its text."""
    d = texts(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("subject"), "text")
    body = F.substring(F.col("text"), F.length("subject") + 1, F.length("text"))
    return d.select("doc_id", tx.subject_overlap(F.col("subject"), body).alias("relevance"))


def subject_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the subject as a segment of its own; the subject is the first line."""
    d = texts(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("subject"), _seeded().alias("text"))
    return pr.profile(pr.exploded(d, subject="subject")).select("doc_id", "score", "segments")


def signal_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", _seeded().alias("text"))
    r = opened(pr.rules(pr.exploded(d)), [], F.col("signals"), "s")
    return r.groupBy(tx.signal_category(F.col("s")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys of cached signals, over the JSON of task, version, url, model, kind and text."""
    payload = F.to_json(F.array(F.lit("semantic"), F.lit("v1"), F.lit("local"), F.lit("m"), F.col("role"), F.col("text")))
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(payload, 256).alias("key"))


QUERIES = {f.__name__: f for f in (token_stats, sentence_stats, normalized_key_hash, ascii_share, lexicon_hits, number_counts, masked_text, fallback_scores, corpus_clean, fake_headers, likely_human_filter, label_parsing, segment_profile, segment_rules, segment_spans, sentence_uniformity, repeated_sentences, near_duplicate_sentences, doc_verdict, verdict_histogram, subject_body_overlap, subject_profile, signal_categories, cache_keys)}

_RULES = f"""
d AS (SELECT doc_id, {_PLANTED_SQL} AS text FROM documents),
{SEGMENTS_SQL},
f AS (
  SELECT doc_id, idx, n, content, lower(content) AS low, len(regexp_extract_all(content, '{tx.TOKEN.replace("'", "''")}')) AS words, {sentences_sql("content")} AS sents FROM seg
), g AS (
  SELECT *, {hits("low", lx.FORMULAIC)} AS formulaic, {hits("low", lx.TRANSITIONS)} AS transitions, {GENERIC_SQL} AS generic, {NUMBERS_SQL} AS numbers,
    list_filter(list_transform(sents, lambda s: len(regexp_extract_all(s, '{tx.TOKEN.replace("'", "''")}'))), lambda x: x > 0) AS lengths,
    list_filter(list_transform(sents, lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), lambda k: len(regexp_extract_all(k, '{tx.TOKEN.replace("'", "''")}')) >= 5) AS keys
  FROM f
), h AS (
  SELECT *, len(keys) - len(list_distinct(keys)) AS repeats,
    coalesce(len(lengths) >= 4 AND list_avg(lengths) >= 8 AND sqrt(list_avg(list_transform(lengths, lambda x: (x - list_avg(lengths)) ** 2))) / list_avg(lengths) <= 0.22, false) AS uniform,
    list_filter(list_transform(keys, lambda k: list_distinct({tokens_sql("k")})), lambda t: len(t) >= 5) AS sets
  FROM g
), i AS (
  SELECT *, CASE WHEN repeats = 0 AND len(keys) BETWEEN 2 AND 40 THEN
    len(list_filter(range(1, len(sets) + 1), lambda a: len(list_filter(range(a + 1, len(sets) + 1), lambda b: len(list_intersect(sets[a], sets[b])) / len(list_distinct(list_concat(sets[a], sets[b]))) >= 0.82)) > 0)) > 0
    ELSE false END AS near FROM h
), j AS (
  SELECT *, CASE WHEN formulaic > 0 THEN least(0.26 + 0.12 * (formulaic - 1), 0.5) ELSE 0 END
    + CASE WHEN transitions > 0 THEN least(0.04 * transitions, 0.12) ELSE 0 END
    + CASE WHEN generic >= 2 AND numbers < 2 THEN 0.08 ELSE 0 END + CASE WHEN uniform THEN 0.08 ELSE 0 END
    + CASE WHEN repeats > 0 THEN least(0.15 + 0.04 * (repeats - 1), 0.23) WHEN near THEN 0.12 ELSE 0 END AS raw FROM i
), k AS (
  SELECT *, CASE WHEN words >= 8 THEN round(least(greatest(CASE WHEN numbers >= 3 AND formulaic = 0 THEN greatest(raw - 0.04, 0) ELSE raw END, 0), 0.95)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS score, words >= 8 AS sufficient FROM j
), sig AS (
  SELECT *, CASE WHEN sufficient THEN list_filter([
    CASE WHEN formulaic > 0 THEN 'formulaic language' END, CASE WHEN transitions > 0 THEN 'formal transitions' END,
    CASE WHEN generic >= 2 AND numbers < 2 THEN 'generic wording' END, CASE WHEN uniform THEN 'uniform sentence structure' END,
    CASE WHEN repeats > 0 THEN 'repeated content' WHEN near THEN 'near repeated content' END], lambda s: s IS NOT NULL) ELSE [] END AS cats FROM k
)"""

_LABEL = "CASE WHEN NOT sufficient THEN 'insufficient_context' WHEN score >= 0.60 THEN 'ai_like' WHEN score >= 0.35 THEN 'mixed' ELSE 'no_strong_ai_signals' END"

_PROFILE = f"""{_RULES}, pr AS (
  SELECT doc_id, round(least(greatest(coalesce(
    0.75 * sum(CASE WHEN sufficient THEN score * greatest(sqrt(least(words, 80)), 1.0) END) / sum(CASE WHEN sufficient THEN greatest(sqrt(least(words, 80)), 1.0) END)
    + 0.25 * max(CASE WHEN sufficient THEN score END), 0.0), 0.0), 0.95), 4) AS score, bool_or(sufficient) AS sufficient, count(*) AS segments,
    count(DISTINCT CASE WHEN sufficient AND formulaic > 0 THEN array_to_string(list_slice(list_filter({list(lx.FORMULAIC)!r}, lambda p: contains(low, p)), 1, 3), '; ') END)
    + count(DISTINCT CASE WHEN sufficient AND transitions > 0 THEN array_to_string(list_slice(list_filter({list(lx.TRANSITIONS)!r}, lambda p: contains(low, p)), 1, 3), '; ') END)
    + max((sufficient AND generic >= 2 AND numbers < 2)::INT) + max((sufficient AND uniform)::INT) + max((sufficient AND repeats > 0)::INT) + max((sufficient AND repeats = 0 AND near)::INT) AS n_signals
  FROM k GROUP BY doc_id
)""".replace('"in today\'s fast-paced world"', "'in today''s fast-paced world'")

_VERDICT = f"""WITH {_PROFILE}, b AS (
  SELECT doc_id, round(least(({hits("m", lx.INDICATORS)}) / 4.0::DOUBLE, 1.0), 4) AS base_score FROM (SELECT doc_id, {mask_sql("text")} AS m FROM d)
), v AS (
  SELECT b.doc_id, base_score, coalesce(pr.score, 0.0) AS semantic_score,
    coalesce({_LABEL.replace("score", "pr.score").replace("sufficient THEN", "pr.sufficient THEN")}, 'insufficient_context') AS label,
    round(least(greatest(greatest(base_score, coalesce(pr.score, 0.0)), 0.0), 1.0), 4) AS score
  FROM b LEFT JOIN pr ON b.doc_id = pr.doc_id
)"""

#: The same verdicts over texts as they are.
VERDICTS_OF_TEXT = _VERDICT.replace(_PLANTED_SQL, "text")

ORACLES = {
    "token_stats": f"SELECT doc_id, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS distinct_tokens, len(regexp_extract_all(text, '\\S+'))::BIGINT AS space_words, t[1] AS first_token FROM (SELECT doc_id, text, {tokens_sql('text')} AS t FROM documents)",
    "sentence_stats": f"SELECT doc_id, len(s)::BIGINT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest, len(list_distinct(s))::BIGINT AS distinct_sentences FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)",
    "normalized_key_hash": f"SELECT doc_id, sha256({key_sql('text')}) AS fingerprint FROM documents",
    "ascii_share": "SELECT doc_id, round(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS ascii_ratio, length(text)::BIGINT AS chars FROM documents",
    "lexicon_hits": f"SELECT doc_id, ({hits('low', lx.FORMULAIC)})::BIGINT AS formulaic, ({hits('low', lx.TRANSITIONS)})::BIGINT AS transitions, ({GENERIC_SQL})::BIGINT AS generic, ({hits('low', lx.INDICATORS)})::BIGINT AS indicators, array_to_string(list_slice(list_filter({list(lx.FORMULAIC)!r}, lambda p: contains(low, p)), 1, 3), '; ') AS first_formulaic FROM (SELECT doc_id, lower({_PLANTED_SQL}) AS low FROM documents)".replace('"in today\'s fast-paced world"', "'in today''s fast-paced world'"),
    "number_counts": f"SELECT doc_id, ({NUMBERS_SQL.replace('content', 'text')})::BIGINT AS numbers FROM documents",
    "masked_text": f"SELECT doc_id, sha256({mask_sql('text')}) AS masked_sha256, length({mask_sql('text')})::BIGINT AS masked_chars FROM documents",
    "fallback_scores": f"SELECT doc_id, round(least(({hits('low', lx.INDICATORS)}) / 4.0::DOUBLE, 1.0), 4) AS score FROM (SELECT doc_id, lower({_PLANTED_SQL}) AS low FROM documents)",
    "fake_headers": "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 1 THEN 'Return-Path: <a@b.c>' || chr(10) || chr(10) || text WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, '^[\\r\\n]+', '') END) AS body_sha256 FROM documents",
    "likely_human_filter": f"SELECT doc_id, source AS subject_source FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) BETWEEN 35 AND 650 AND length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1) >= 0.82 AND length('Re: ' || source) >= 4 AND ({hits('lower(substring(text, 1, 600))', lx.AUTOMATION)}) = 0",
    "label_parsing": "SELECT raw, (CASE WHEN lower(trim(raw)) IN ('1', 'true', 'ai', 'yes') THEN 1 WHEN lower(trim(raw)) IN ('0', 'false', 'human', 'no') THEN 0 END)::BIGINT AS label, count(*) AS n FROM (SELECT ([' AI ', 'Human', 'yes', 'NO', '1', '0', 'True', 'false', 'maybe'])[doc_id % 9 + 1] AS raw FROM documents) GROUP BY ALL",
    "segment_profile": f"WITH {_PROFILE} SELECT doc_id, score, {_LABEL} AS label, sufficient, segments, least(n_signals, 12)::BIGINT AS n_signals FROM pr",
    "segment_rules": f"WITH {_RULES} SELECT doc_id, (idx - 1)::BIGINT AS idx, 'paragraph' AS kind, words::BIGINT AS words, formulaic::BIGINT AS formulaic, generic::BIGINT AS generic, numbers::BIGINT AS numbers, score, {_LABEL} AS label FROM k",
    "sentence_uniformity": f"WITH s AS (SELECT doc_id, len(regexp_extract_all(s, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}')) AS n FROM (SELECT doc_id, unnest({sentences_sql('text')}) AS s FROM documents)), g AS (SELECT doc_id, count(*) AS sentences, avg(n) AS mean, stddev_pop(n) AS sd FROM s WHERE n > 0 GROUP BY 1) SELECT doc_id, sentences, round(mean, 6) AS mean_words, round(sd / mean, 6) AS variation, sentences >= 4 AND mean >= 8 AND sd / mean <= 0.22 AS uniform FROM g",
    "repeated_sentences": f"WITH {_RULES.replace(_PLANTED_SQL, 'text')} SELECT doc_id, len(keys)::BIGINT AS long_sentences, (len(keys) - len(list_distinct(keys)))::BIGINT AS repeats FROM (SELECT doc_id, list_filter(list_transform({sentences_sql('text')}, lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), lambda k: len(regexp_extract_all(k, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}')) >= 5) AS keys FROM documents)",
    "near_duplicate_sentences": f"WITH k AS (SELECT doc_id, list_filter(list_transform({sentences_sql('text')}, lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), lambda k: len(regexp_extract_all(k, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}')) >= 5) AS keys FROM documents), s AS (SELECT doc_id, list_filter(list_transform(keys, lambda k: list_distinct({tokens_sql('k')})), lambda t: len(t) >= 5) AS sets, len(keys) BETWEEN 2 AND 40 AS few FROM k) SELECT doc_id, few AND len(list_filter(range(1, len(sets) + 1), lambda a: len(list_filter(range(a + 1, len(sets) + 1), lambda b: len(list_intersect(sets[a], sets[b])) / len(list_distinct(list_concat(sets[a], sets[b]))) >= 0.82)) > 0)) > 0 AS near_repeated FROM s",
    "doc_verdict": f"{_VERDICT} SELECT doc_id, base_score, semantic_score, score, label, {verdict_sql('score')} AS verdict FROM v",
    "verdict_histogram": f"{_VERDICT} SELECT o.source, {verdict_sql('score')} AS verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM v JOIN documents o ON o.doc_id = v.doc_id GROUP BY ALL",
    "subject_body_overlap": f"WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS subject, text FROM documents), t AS (SELECT doc_id, list_distinct(list_filter({tokens_sql('subject')}, lambda x: length(x) >= 3 AND NOT list_contains({list(lx.SUBJECT_STOPWORDS)!r}, x))) AS s, {tokens_sql('substring(text, length(subject) + 1)')} AS b FROM d) SELECT doc_id, CASE WHEN len(s) > 0 THEN round(len(list_intersect(s, b)) / len(s), 4) END AS relevance FROM t",
    "signal_categories": f"WITH {_RULES} SELECT c AS category, count(*) AS n FROM (SELECT unnest(cats) AS c FROM sig) GROUP BY 1",
    "cache_keys": "SELECT conv_id, turn, sha256(to_json(['semantic', 'v1', 'local', 'm', role, text])::VARCHAR) AS key FROM conversations",
}
