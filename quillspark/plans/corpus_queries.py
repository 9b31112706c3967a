"""Queries over labelled corpora: dedupe, audits, samples, splits, plans, thresholds, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scores as sc
from quillspark.functions import text as tx
from quillspark.operators import dedupe as dd
from quillspark.operators import generation as gn
from quillspark.operators import metrics as mt
from quillspark.operators import sampling as sp
from quillspark.plans.sql import key_sql, quoted
from quillspark.plans.text_queries import table, texts


def turns(spark: SparkSession, sf_dir: str, read: Callable[..., DataFrame] = table) -> DataFrame:
    """The labelled corpus: turns of users (0) and assistants (1), with a key for each."""
    c = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text", (F.col("role") == "assistant").cast("int").alias("is_ai"), F.concat(F.lit("conv"), F.col("conv_id") % 7).alias("source"))


TURNS = "turns AS (SELECT conv_id * 1000 + turn AS msg_id, text, (role = 'assistant')::INT AS is_ai, 'conv' || (conv_id % 7) AS source FROM conversations WHERE role IN ('user', 'assistant'))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a score that leans to the label, from a hash of the key."""
    u = F.conv(F.substring(F.sha2(F.col("msg_id").cast("string"), 256), 1, 8), 16, 10).cast("long") / 4294967296.0
    t = turns(spark, sf_dir)
    return t.select("msg_id", "is_ai", "source", F.round(0.6 * u + 0.3 * F.col("is_ai"), 3).alias("score"))


SCORED = TURNS + ", scored AS (SELECT msg_id, is_ai, source, round(0.6::DOUBLE * (('0x' || substr(sha256(msg_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE) + 0.3::DOUBLE * is_ai, 3) AS score FROM turns)"


def order_sql(seed: str, key: str) -> str:
    return f"sha256('{seed}|' || {key}::VARCHAR)"


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", "text", "source")
    return dd.keep_first(d, tx.fingerprint(F.col("text")), "doc_id").select("doc_id", "source")


def contradictory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.contradictions(turns(spark, sf_dir), tx.fingerprint(F.col("text")), "is_ai")


def contradiction_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.drop_contradictions(turns(spark, sf_dir), tx.fingerprint(F.col("text")), "is_ai", "msg_id").select("msg_id", "is_ai")


def class_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.class_profile(turns(spark, sf_dir), "is_ai", "text")


def confound_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.confound_report(turns(spark, sf_dir), "is_ai", "text", "source")


def source_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turns(spark, sf_dir).groupBy("source").pivot("is_ai", [0, 1]).count()
    return p.select("source", F.coalesce("0", F.lit(0)).alias("human"), F.coalesce("1", F.lit(0)).alias("ai"))


def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sp.holdout(turns(spark, sf_dir), "is_ai", "leak", "msg_id")
    key = tx.fingerprint(F.col("text"))
    return dd.overlap(t.where("held_out"), t.where("NOT held_out"), key, key)


def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.shared_passages(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_labels(turns(spark, sf_dir), "is_ai", "split-1", "msg_id").select("msg_id", "is_ai", "split")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.holdout(turns(spark, sf_dir), "is_ai", "hold-1", "msg_id").select("msg_id", "held_out")


def per_class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 25, 631, "doc_id")


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("text").rlike(r"(?i)unsubscribe|newsletter|automatic|noreply|no-reply|do not reply|mailing list|notification|license").cast("long")
    s = sp.shuffled_sample(table(spark, sf_dir, "documents"), 50, 986, "doc_id")
    return s.select("doc_id", F.substring("text", 1, 450).alias("preview"), flag.alias("possible_automation"))


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return sp.pending(d, done, "doc_id")


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sp.batches(table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation task for each document id: one of each list by hash, and a length drawn from those of the human turns."""
    human = turns(spark, sf_dir).where("is_ai = 0")
    return gn.tasks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", gn.length_cdf(human, "text"))


TEMPLATES = {
    "service notice": ("Dear customer, your request {n} was registered.", "Please note that your plan ends in {d} days, {company}.", "We inform you that order {n} has left our store."),
    "service fraud": ("Your account closes in {d} hours, confirm it with {company}.", "A payment to {company} failed, case {n}: act within {d} hours.", "To claim prize {n} confirm who you are.", "We saw an unusual login, see case {n}."),
    "personal note": ("Hi! Can you check file {n} before lunch?", "Meet at {company} in {d} hours?", "Please bring the {d} keys.", "Parcel {n} came, thanks!", "Call me."),
    "personal fraud": ("Earn {n} a day from home, write to me!!!", "{company} gives {n} to everyone who answers in {d} hours"),
}
SLOTS = {"n": tuple(str(100 + 37 * i) for i in range(40)), "d": ("3", "7", "12", "14", "24", "48", "72"), "company": ("the bank", "the shop", "the service desk", "the market", "Online Ltd")}


def slot_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text from slotted templates for each document id."""
    return gn.expanded(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", TEMPLATES, SLOTS)


def contradiction_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each source and first word taken in order, whose labels contradict often: what is held at the end."""
    t = turns(spark, sf_dir).withColumn("first", F.regexp_extract(F.lower("text"), r"^(\S{0,2})", 1))
    return dd.fold_contradictions(t, F.concat_ws("|", "source", "first"), "is_ai", "msg_id").select("msg_id", "is_ai", "source")


def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents, or an error; the same ones in every run."""
    return sp.exact_count(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "exact", "doc_id")


def row_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang"), "doc_id").select("doc_id", "name")


def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.readiness(turns(spark, sf_dir), "is_ai", tx.fingerprint(F.col("text")), 20)


def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("is_ai = 1")
    return t.groupBy("source").agg(F.bool_or(~F.startswith("source", F.lit("conv3"))).alias("unexpected"), F.count(F.lit(1)).alias("n"))


def schema_tolerant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy(F.col("lang").isNull().alias("from_pages")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


def youden_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.youden_cut(scored(spark, sf_dir), "is_ai", "score", "source")


def engine_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.engine_thresholds(scored(spark, sf_dir), "is_ai", "score", "source")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.roc_auc(scored(spark, sf_dir), "is_ai", "score", "source")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(scored(spark, sf_dir), "is_ai", (F.col("score") >= 0.45).cast("int"), "source")


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.report(scored(spark, sf_dir), "is_ai", (F.col("score") > 0.5).cast("int"), "source")


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.class_report(scored(spark, sf_dir), "is_ai", (F.col("score") >= 0.5).cast("int"))


def decision_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sc.three_way(F.col("score"), F.lit(0.4), F.lit(0.55))
    return mt.decision_flags(scored(spark, sf_dir), "is_ai", v)


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("is_ai").agg(F.round(F.percentile("score", F.lit(0.9)), 6).alias("q90"), F.round(F.percentile("score", F.lit(0.1)), 6).alias("q10"), F.round(F.median("score"), 6).alias("q50"))


QUERIES = {f.__name__: f for f in (dedupe_keep_first, contradictory_labels, contradiction_dedupe, class_length_profile, confound_report, source_crosstab, split_leak_check, benchmark_contamination, stratified_split, holdout_split, per_class_sample, review_sample, resume_anti_join, batch_plan, task_plan, slot_templates, contradiction_fold, exact_sample, row_numbering, readiness_gate, provenance_check, schema_tolerant_union, missing_labels, youden_cut, engine_thresholds, roc_auc, confusion_matrix, evaluation_report, classification_report, decision_flags, score_quantiles)}

_KEYED = f"{TURNS}, k AS (SELECT *, sha256({key_sql('text')}) AS key FROM turns)"
_HELD = lambda seed: f"{_KEYED}, h AS (SELECT *, row_number() OVER (PARTITION BY is_ai ORDER BY ('0x' || substr({order_sql(seed, 'msg_id')}, 1, 8))::BIGINT, msg_id) <= round(count(*) OVER (PARTITION BY is_ai) * 0.2) AS held_out FROM k)"
_YOUDEN = f"""{SCORED}, c AS (SELECT source, score AS s, count(*) FILTER (is_ai = 1) AS p, count(*) FILTER (is_ai = 0) AS n FROM scored GROUP BY ALL),
t AS (SELECT source, sum(p) AS ap, sum(n) AS an FROM c GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0),
cand AS (
  SELECT source, (s + lead(s) OVER w) / 2 AS c FROM c WINDOW w AS (PARTITION BY source ORDER BY s)
  UNION ALL SELECT source, greatest(0.0, min(s) - 1e-6) FROM c GROUP BY 1
  UNION ALL SELECT source, least(1.0, max(s) + 1e-6) FROM c GROUP BY 1
), e AS (
  SELECT cand.source, cand.c, sum(CASE WHEN c.s >= cand.c THEN p ELSE 0 END) / any_value(ap) - sum(CASE WHEN c.s >= cand.c THEN n ELSE 0 END) / any_value(an) AS j
  FROM cand JOIN c ON c.source = cand.source JOIN t ON t.source = cand.source WHERE cand.c IS NOT NULL GROUP BY 1, 2
), b AS (SELECT *, max(j) OVER (PARTITION BY source) AS best FROM e),
y AS (SELECT source, round(median(c), 5) AS cut, round(max(j), 4) AS j FROM b WHERE abs(j - best) < 1e-10 GROUP BY 1)"""
_R = lambda a, b: f"round(coalesce(({a}) / nullif({b}, 0), 0.0), 6)"
_CONF = "count(*) FILTER (is_ai = 0 AND NOT z) AS tn, count(*) FILTER (is_ai = 0 AND z) AS fp, count(*) FILTER (is_ai = 1 AND NOT z) AS fn, count(*) FILTER (is_ai = 1 AND z) AS tp"



def _options(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _hash(seed: str) -> str:
    return f"('0x' || substr({order_sql(seed, 'doc_id')}, 1, 12))::BIGINT"


_TASKS_SQL = f"""WITH {TURNS}, w AS (SELECT greatest(45, least(250, len(regexp_extract_all(text, '\\S+')))) AS words FROM turns WHERE is_ai = 0 AND len(regexp_extract_all(text, '\\S+')) > 0),
  c AS (SELECT words, sum(count(*)) OVER (ORDER BY words)::BIGINT AS upto, sum(count(*)) OVER ()::BIGINT AS total FROM w GROUP BY 1)
  SELECT doc_id, """ + ", ".join(f"({_options(v)})[{_hash(k)} % {len(v)} + 1] AS {k}" for k, v in lx.TASK_LISTS.items()) + f""",
  (SELECT min(words) FROM c WHERE {_hash('words')} % total < upto)::BIGINT AS words FROM documents"""


def _rounds(values, place: str, seed: str) -> str:
    """generation.in_rounds in SQL."""
    return f"(list_sort(list_transform({_options(values)}, lambda o: {{'h': sha256('{seed}|' || ({place} // {len(values)}) || '|' || o), 'o': o}})))[{place} % {len(values)} + 1].o"


def _slotted() -> str:
    n = len(TEMPLATES)
    text = "CASE doc_id % " + str(n) + " " + " ".join(f"WHEN {i} THEN {_rounds(v, f'(doc_id // {n})', f'template-{k}')}" for i, (k, v) in enumerate(TEMPLATES.items())) + " END"
    for k, v in SLOTS.items():
        text = f"replace({text}, '{{{k}}}', {_rounds(v, 'doc_id', f'template-{k}')})"
    return f"SELECT doc_id, ({_options(TEMPLATES)})[doc_id % {n} + 1] AS kind, {text} AS text FROM documents"


_TEMPLATES_SQL = _slotted()

ORACLES = {
    "dedupe_keep_first": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {key_sql('text')} ORDER BY doc_id) = 1",
    "contradictory_labels": f"WITH {_KEYED} SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING min(is_ai) <> max(is_ai)",
    "contradiction_dedupe": f"WITH {_KEYED} SELECT min(msg_id) AS msg_id, min(is_ai) AS is_ai FROM k GROUP BY key HAVING min(is_ai) = max(is_ai)",
    "class_length_profile": f"WITH {_KEYED}, w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM k) SELECT is_ai, count(*) AS rows, median(n)::DOUBLE AS median_words, min(n)::BIGINT AS min_words, max(n)::BIGINT AS max_words, count(DISTINCT key) AS distinct_texts, count(*) FILTER (regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') AS non_empty FROM w GROUP BY 1",
    "confound_report": f"""WITH {TURNS}, h AS (SELECT *, regexp_matches(text, '(?mi)^Return-Path\\s*:')::INT AS header FROM turns),
      s AS (SELECT bool_and(lo = hi) AS sources_exclusive FROM (SELECT source, min(is_ai) AS lo, max(is_ai) AS hi FROM h GROUP BY 1)),
      g AS (SELECT count(*) AS rows, count(*) FILTER (is_ai = 0) AS human_rows, count(*) FILTER (is_ai = 1) AS ai_rows, median(length(text)) FILTER (is_ai = 0) AS human_median_chars, median(length(text)) FILTER (is_ai = 1) AS ai_median_chars,
        round(avg(header) FILTER (is_ai = 0), 6) AS human_header_rate, round(avg(header) FILTER (is_ai = 1), 6) AS ai_header_rate, round(avg((header = is_ai)::INT), 6) AS header_rule_accuracy FROM h)
      SELECT g.*, sources_exclusive, header_rule_accuracy >= 0.9 OR ai_median_chars >= 2 * greatest(human_median_chars, 1.0) OR sources_exclusive AS strong_confound FROM g, s""",
    "source_crosstab": f"WITH {TURNS} SELECT source, count(*) FILTER (is_ai = 0) AS human, count(*) FILTER (is_ai = 1) AS ai FROM turns GROUP BY 1",
    "split_leak_check": f"WITH {_HELD('leak')} SELECT DISTINCT key FROM h WHERE held_out AND key IN (SELECT key FROM h WHERE NOT held_out)",
    "benchmark_contamination": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS t FROM documents), v AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS t FROM benchmark),
      g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM w)), b AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM v))
      SELECT doc_id, item_id, count(*) AS shared FROM g JOIN b USING (g) GROUP BY 1, 2""",
    "stratified_split": f"""WITH {TURNS}, r AS (SELECT msg_id, is_ai, row_number() OVER (PARTITION BY is_ai ORDER BY {order_sql('split-1', 'msg_id')}, msg_id) AS rn, count(*) OVER (PARTITION BY is_ai) AS n FROM turns),
      z AS (SELECT *, least(150, greatest(4, round(n * 0.2)::INT)) AS s, least(120, greatest(4, round(n * 0.1)::INT)) AS c, least(80, greatest(4, round(n * 0.1)::INT)) AS t FROM r)
      SELECT msg_id, is_ai, CASE WHEN rn <= s THEN 'stack' WHEN rn <= s + c THEN 'calib' WHEN rn <= s + c + t THEN 'test' ELSE 'base' END AS split FROM z""",
    "holdout_split": f"WITH {_HELD('hold-1')} SELECT msg_id, held_out FROM h",
    "per_class_sample": f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {order_sql('631', 'doc_id')}, doc_id) <= 25",
    "review_sample": f"SELECT doc_id, substring(text, 1, 450) AS preview, regexp_matches(text, '(?i)unsubscribe|newsletter|automatic|noreply|no-reply|do not reply|mailing list|notification|license')::BIGINT AS possible_automation FROM documents ORDER BY {order_sql('986', 'doc_id')}, doc_id LIMIT 50",
    "resume_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "batch_plan": "SELECT batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch FROM documents) GROUP BY 1",
    "task_plan": _TASKS_SQL,
    "slot_templates": _TEMPLATES_SQL,
    "contradiction_fold": f"""WITH {TURNS}, t AS (SELECT *, source || '|' || regexp_extract(lower(text), '^(\\S{{0,2}})', 1) AS k FROM turns),
      s AS (SELECT k, list(is_ai ORDER BY msg_id) AS y, list(msg_id ORDER BY msg_id) AS id, any_value(source) AS source FROM t GROUP BY 1),
      f AS (SELECT *, list_reduce(list_prepend(0, list_transform(range(1, len(y) + 1), lambda i: i)), lambda held, i: CASE WHEN held = 0 THEN i WHEN y[held] <> y[i] THEN 0 ELSE held END) AS held FROM s)
      SELECT id[held] AS msg_id, y[held] AS is_ai, source FROM f WHERE held > 0""",
    "exact_sample": f"SELECT doc_id, lang FROM documents ORDER BY {order_sql('exact', 'doc_id')}, doc_id LIMIT 100",
    "row_numbering": "SELECT doc_id, lang || '_' || format('{:04d}', row_number() OVER (PARTITION BY lang ORDER BY doc_id)) AS name FROM documents",
    "readiness_gate": f"WITH {_KEYED}, p AS (SELECT key, count(*) AS n, count(*) FILTER (is_ai = 0) AS n0, count(*) FILTER (is_ai = 1) AS n1 FROM k GROUP BY 1), g AS (SELECT sum(n0)::BIGINT AS human, sum(n1)::BIGINT AS ai, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n0 > 0 AND n1 > 0) AS contradictory FROM p) SELECT *, human >= 20 AND ai >= 20 AND repeated = 0 AND contradictory = 0 AS ready FROM g",
    "provenance_check": f"WITH {TURNS} SELECT source, bool_or(NOT starts_with(source, 'conv3')) AS unexpected, count(*) AS n FROM turns WHERE is_ai = 1 GROUP BY 1",
    "schema_tolerant_union": "WITH u AS (SELECT doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages) SELECT lang IS NULL AS from_pages, count(*) AS n, count(DISTINCT url) AS urls FROM u GROUP BY 1",
    "missing_labels": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
    "youden_cut": f"WITH {_YOUDEN} SELECT source, cut, j FROM y",
    "engine_thresholds": f"""WITH {_YOUDEN}, q AS (SELECT source, quantile_cont(score, 0.9) FILTER (is_ai = 0) AS human, quantile_cont(score, 0.1) FILTER (is_ai = 1) AS ai, count(*) FILTER (is_ai = 0) AS n0, count(*) FILTER (is_ai = 1) AS n1 FROM scored GROUP BY 1 HAVING n0 >= 3 AND n1 >= 3),
      g AS (SELECT *, least(0.15, greatest(0.025, 0.15 * (ai - human))) AS gap FROM q JOIN y USING (source)),
      l AS (SELECT *, greatest(human, cut - gap) AS lo, least(ai, cut + gap) AS hi FROM g)
      SELECT source, round(CASE WHEN human < ai AND lo < hi THEN lo ELSE greatest(0.0, cut - 0.025) END, 5) AS human_cut, round(CASE WHEN human < ai AND lo < hi THEN hi ELSE least(1.0, cut + 0.025) END, 5) AS ai_cut, cut AS youden_cut, j AS youden_j, n0 + n1 AS n FROM l""",
    "roc_auc": f"WITH {SCORED}, r AS (SELECT source, is_ai, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS rk FROM scored) SELECT source, round((sum(rk) FILTER (is_ai = 1) - count(*) FILTER (is_ai = 1) * (count(*) FILTER (is_ai = 1) + 1) / 2.0)::DOUBLE / nullif(count(*) FILTER (is_ai = 1) * count(*) FILTER (is_ai = 0), 0), 6) AS auc FROM r GROUP BY 1",
    "confusion_matrix": f"WITH {SCORED} SELECT source, {_CONF} FROM (SELECT *, score >= 0.45 AS z FROM scored) GROUP BY 1",
    "evaluation_report": f"WITH {SCORED}, c AS (SELECT source, {_CONF} FROM (SELECT *, score > 0.5 AS z FROM scored) GROUP BY 1) SELECT *, {_R('tp + tn', 'tp + fp + fn + tn')} AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, {_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_R('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c",
    "classification_report": f"WITH {SCORED}, r AS (SELECT is_ai::BIGINT AS y, (score >= 0.5)::BIGINT AS z FROM scored), k AS (SELECT unnest([0, 1])::BIGINT AS class), g AS (SELECT class, count(*) FILTER (y = class AND z = class) AS hit, count(*) FILTER (y = class) AS support, count(*) FILTER (z = class) AS named FROM k, r GROUP BY 1) SELECT class, {_R('hit', 'named')} AS precision, {_R('hit', 'support')} AS recall, {_R('2 * hit', 'named + support')} AS f1, support FROM g",
    "decision_flags": f"WITH {SCORED}, v AS (SELECT *, CASE WHEN score < 0.4 THEN 'HUMAN' WHEN score >= 0.55 THEN 'AI' ELSE 'UNCERTAIN' END AS v FROM scored) SELECT round(avg((v = 'UNCERTAIN')::INT), 6) AS uncertain_fraction, count(*) FILTER (v = 'AI' AND is_ai = 0) AS human_flagged_ai, count(*) FILTER (v = 'HUMAN' AND is_ai = 1) AS ai_flagged_human FROM v",
    "score_quantiles": f"WITH {SCORED} SELECT is_ai, round(quantile_cont(score, 0.9), 6) AS q90, round(quantile_cont(score, 0.1), 6) AS q10, round(median(score), 6) AS q50 FROM scored GROUP BY 1",
}
