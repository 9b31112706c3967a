"""TF-IDF tables, logistic regression and decision trees for the authorship models.

TF-IDF is computed twice: as plain aggregates, and by the estimator in features, which serves
training.  Weights follow ln((1 + n) / (1 + df)) + 1 with unit length; SQL checks both.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators.features import UNION, Branch, TextFeatures
from quillspark.session import absent, by_class, opened, staged


def word_grams(c: Column, lo: int = 1, hi: int = 2) -> Column:
    """Word n-grams of lo to hi words, joined by a space."""

    def grams(t: Column, n: int) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # Tokens are bound outside the loops over places.
    return tx.once(tx.tokens(c), lambda t: F.concat(*[grams(t, n) for n in range(lo, hi + 1)]))


def char_grams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """Runs of lo to hi characters: those of each length that begin at the 1st, 1 + n-th, ... character, then at the 2nd, and so on."""
    runs = [F.regexp_extract_all(F.substring(c, F.lit(k), F.length(c)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for n in range(lo, hi + 1) for k in range(1, n + 1)]
    return F.concat(*runs)


def term_counts(df: DataFrame, key: str, grams: Column, parts: int) -> DataFrame:
    """key, term, tf.  Texts are dealt out by key to `parts` partitions before the explode, so the terms themselves are not shuffled; parts_for() gives a number that grows with the texts."""
    return opened(df.repartition(parts, key), key, grams, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, least: int = 2, most: int = 20_000) -> DataFrame:
    """term, df, total: terms of at least `least` documents, the `most` frequent (ties by term)."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return v.where(F.col("df") >= least).orderBy(F.desc("total"), "term").limit(most)


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int, key: str, parts: int, sublinear: bool = True) -> DataFrame:
    """key, term, weight with unit length for each key, in `parts` partitions by key; the vocabulary, whose limit bounds it, goes to all tasks."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.join(F.broadcast(vocab.select("term", "df")), "term").select(key, "term", (tf * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)).alias("w"))
    return raw.repartition(parts, key).withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).drop("w")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (2 n_c), n_c the rows of the same class.

    Up to FEW classes go to the tasks as a table, since a join by class would send each class to one task;
    a longer class table is joined as the planner likes.
    """
    one = absent(df, "class_of")[0]
    n = df.groupBy(label).count()
    total = n.agg(F.sum("count").alias("t"))
    w = n.crossJoin(total).select(F.col(label).alias(one), (F.col("t") / (2 * F.col("count"))).alias("weight"))
    return df.join(by_class(n, w), F.col(label).eqNullSafe(F.col(one))).drop(one)


def text_pipeline(body: str = "text", label: str = "is_ai", branches: tuple[Branch, ...] = UNION, rows: int = 1000, c: float = 1.0, iterations: int = 100) -> Pipeline:
    """TF-IDF features by branches, then logistic regression with weights; regParam 1 / (c * rows) equals an inverse strength of c."""
    features = TextFeatures(inputCol=body, outputCol="features", branches=branches)
    return Pipeline(stages=[features, LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1 / (c * max(rows, 1)), standardization=False, maxIter=iterations)])


def fit_text(df: DataFrame, body: str = "text", label: str = "is_ai", **options) -> PipelineModel:
    """text_pipeline() fitted on df with its weights.  Vectors are staged, since the regression reads its rows twice and would else have them made twice."""
    features, regression = text_pipeline(body=body, label=label, **options).getStages()
    model = features.fit(df)
    vectors = staged(model.transform(df).select("features", label, "weight"), "vectors")
    return PipelineModel([model, regression.fit(vectors)])


def chance() -> Column:
    """The chance of class 1 in what a classifier adds."""
    return vector_to_array("probability")[1]


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds score, the chance of class 1."""
    out = model.transform(df).withColumn("score", F.round(chance(), 4))
    return out.select(*df.columns, "score")


TREE_INPUTS = [f"score_{k}" for k in ("subject", "greeting", "body", "signature")] + [f"has_{k}" for k in ("subject", "greeting", "body", "signature")] + ["mean_score", "mean_tf"]


def fit_tree(df: DataFrame, label: str = "is_ai", depth: int = 3, seed: int = 42) -> PipelineModel:
    """Depth-3 tree over the ten zone features, classes balanced, leaves of at least max(3, n / 60) rows."""
    n = df.count()
    tree = DecisionTreeClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=depth, minInstancesPerNode=max(3, n // 60), seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=TREE_INPUTS, outputCol="features"), tree]).fit(balanced(df, label))


def evaluate_then_refit(df: DataFrame, key: str, label: str, **options) -> tuple[DataFrame, PipelineModel]:
    """(held-out rows with score, a model fitted on all rows); the split is by hash order within each class."""
    from quillspark.operators.sampling import holdout

    rows = balanced(holdout(df, label, "refit", key), label)
    n = rows.count()
    first = fit_text(rows.where("NOT held_out"), label=label, rows=n, **options)
    return probability(first, rows.where("held_out")), fit_text(rows, label=label, rows=n, **options)


# Chances of each mutation of a seed text, as upper bounds of a uniform draw.
MUTATIONS = {0: ((0.15, "typo"), (0.30, "upper"), (0.42, "lower"), (0.52, "smile"), (0.62, "prefix"), (0.72, "suffix")), 1: ((0.25, "prefix"), (0.45, "suffix"), (0.60, "formal"), (0.72, "closing"), (0.82, "upper"))}


def augment(df: DataFrame, key: str, body: str, label: str, copies: int = 30, seed: str = "augment") -> DataFrame:
    """key, copy, kind, text, label: `copies` mutations of each row, drawn by hash, so that reruns agree."""
    d = df.select(key, F.col(body).alias("text"), label, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    h = lambda s: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{seed}-{s}"), F.col(key).cast("string"), F.col("copy").cast("string")), 256), 1, 8), 16, 10).cast("long")
    u = h("u") / 4294967296.0
    kind = F.when(F.lit(False), F.lit(""))
    for y, bands in MUTATIONS.items():
        for top, name in bands:
            kind = kind.when((F.col(label) == y) & (u < top), F.lit(name))
    d = d.withColumn("kind", kind.otherwise("same"))
    at = (h("at") % F.greatest(F.length("text") - 1, F.lit(1)) + 1).cast("int")
    t = F.col("text")
    typo = F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + 1, F.lit(1)), F.substring(t, at, F.lit(1)), F.substring(t, at + 2, F.length(t)))
    text = F.when(F.col("kind") == "typo", typo).when(F.col("kind") == "upper", F.upper(t)).when(F.col("kind") == "lower", F.lower(t)).when(F.col("kind") == "smile", F.concat(t, F.lit(" :)"))).when(F.col("kind") == "prefix", F.concat(F.lit("Hello, "), t)).when(F.col("kind") == "suffix", F.concat(t, F.lit(" Thanks!"))).when(F.col("kind") == "formal", F.concat(F.lit("Please be advised. "), t)).when(F.col("kind") == "closing", F.concat(t, F.lit(" Thank you for your understanding."))).otherwise(t)
    return d.select(key, "copy", "kind", text.alias("text"), label)
