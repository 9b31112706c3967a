"""The detector of mail authorship: trained in one run, and applied from raw mail to verdict.

Training splits labelled mails by hash order into base, stack, calib and test.  The text model and
the centroids learn from the zones of base; the tree learns from what they say of stack; the
thresholds of zones and of the whole come from calib, in the modes with and without semantic
scores; test is what the report is about.  Nothing learns from a part that judges it.

A mail that has no zones is UNCERTAIN without a score.  So is one whose zones disagree, or that
lacks the embedding of a zone for which there are centroids.  Mails that share a key, or have
none, are mails of their own: they carry a number from the moment they are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import scores as sc
from quillspark.operators import metrics as mt
from quillspark.operators import models as md
from quillspark.operators import sampling as sp
from quillspark.operators import vectors as vc
from quillspark.operators import zones as zn
from quillspark.operators.features import ZONES, Branch, TextFeaturesModel
from quillspark.session import staged
from quillspark.sources import mail as ml

MODES = ("no_llm", "with_llm")
SPLITS = ("base", "stack", "calib", "test")


@dataclass
class TextModel:
    """Vocabulary and weights of the text model, as tasks hold them."""

    features: TextFeaturesModel
    weights: np.ndarray
    intercept: float

    @classmethod
    def of(cls, model: PipelineModel) -> TextModel:
        features, regression = model.stages
        return cls(features, regression.coefficients.toArray(), float(regression.intercept))

    def score(self, text: Column) -> Column:
        """The chance of class 1.  Vocabulary and weights go to a Python worker once, by a broadcast of bounded size."""
        made, weights, intercept = self.features.vectorizer(), self.weights, self.intercept

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            out = np.empty(len(s))
            for i, x in enumerate(s.fillna("")):
                at, values = made.row(x)
                out[i] = 1 / (1 + np.exp(-(values @ weights[at] + intercept)))
            return pd.Series(out)

        return run(text)


@dataclass
class Detector:
    """What training leaves: small tables and two models."""

    text: TextModel
    tree: PipelineModel
    #: (kind, label) to unit vector; empty where no embeddings were at hand.
    centroids: dict[tuple[str, int], list[float]] = field(default_factory=dict)
    #: (kind, mode) to threshold.
    zone_cuts: dict[tuple[str, str], float] = field(default_factory=dict)
    #: mode to human_cut, ai_cut, youden_cut, youden_j and n.
    engine: dict[str, dict] = field(default_factory=dict)

    @property
    def dimension(self) -> int | None:
        return len(next(iter(self.centroids.values()))) if self.centroids else None


def read(raw: DataFrame, key: str = "msg_id", content: str = "raw") -> DataFrame:
    """key, rid, subject, body of raw mails that pass the gate of the zone service; staged, so that a mail keeps its number."""
    ok = raw.where(ml.raw_gate(F.col(content)) == "ok")
    m = ok.select(F.col(key).alias("key"), ml.subject_body(F.col(content)).alias("m"))
    return staged(m.select("key", F.monotonically_increasing_id().alias("rid"), "m.subject", "m.body"), "mails")


def zones_of(mails: DataFrame, *along: str) -> DataFrame:
    """rid, kind, text of each zone that isn't blank, and the columns that go along."""
    return zn.long_form(zn.split(mails), "rid", *along)


def signals(zones: DataFrame, text: TextModel, centroids: dict, embeddings: DataFrame | None, semantic: DataFrame | None) -> DataFrame:
    """zones with tfidf, embedding, semantic, wants (there are centroids for the zone), no_llm and with_llm.

    embeddings: text_key, embedding, and semantic: text_key, score are by the digest of a zone's kind and text, as zone_key makes it.
    """
    out = zones.withColumn("tfidf", text.score(F.col("text")))
    none = F.lit(None).cast("double")
    kinds = [k for k in lx.KINDS if (k, 0) in centroids and (k, 1) in centroids]
    out = out.withColumn("wants", F.col("kind").isin(kinds) if kinds else F.lit(False))
    if embeddings is not None and kinds:
        e = embeddings.groupBy("text_key").agg(F.any_value("embedding").alias("vector"))
        unit = sc.normalised(F.col("vector"))

        def centre(label: int) -> Column:
            c = F.lit(None).cast("array<double>")
            for k in kinds:
                c = F.when(F.col("kind") == k, F.array(*map(F.lit, centroids[k, label]))).otherwise(c)
            return c

        out = out.withColumn("text_key", zone_key()).join(e, "text_key", "left").withColumn("embedding", F.when(F.col("wants"), sc.similarity_score(unit, centre(1), centre(0)))).drop("text_key", "vector")
    else:
        out = out.withColumn("embedding", none)
    if semantic is not None:
        s = semantic.groupBy("text_key").agg(F.max(sc.valid_score(F.col("score"))).alias("semantic"))
        out = out.withColumn("text_key", zone_key()).join(s, "text_key", "left").drop("text_key")
    else:
        out = out.withColumn("semantic", none)
    return zn.means(out)


def zone_key() -> Column:
    return F.sha2(F.concat_ws("\u0001", "kind", "text"), 256)


def finals(zones: DataFrame, tree: PipelineModel, modes: tuple[str, ...], *along: str) -> DataFrame:
    """rid, the columns that go along, covered, tree, and final in each mode."""
    f = zn.features(zones, "rid")
    scored = tree.transform(f).select("rid", md.chance().alias("tree"))
    g = zones.groupBy("rid").agg(F.bool_and(F.col("semantic").isNotNull()).alias("covered"), *[zn.mean_over(m).alias(f"mean_{m}") for m in modes], *[F.any_value(c).alias(c) for c in along])
    out = g.join(scored, "rid")
    return out.select("rid", *along, "covered", "tree", *[sc.final_score(F.col(f"mean_{m}"), F.col("tree")).alias(m) for m in modes])


def train(mails: DataFrame, label: str = "is_ai", embeddings: DataFrame | None = None, semantic: DataFrame | None = None, seed: int | str = 42, branches: tuple[Branch, ...] = ZONES, iterations: int = 350, stack: int = 150, calib: int = 120, test: int = 80, least: int = 3) -> tuple[Detector, DataFrame]:
    """(detector, report) from mails (rid, subject, body, label); the report has a row for each mode that could be calibrated."""
    rows = sp.split_labels(mails.select("rid", "subject", "body", F.col(label).alias("y")), "y", seed, "rid", stack, calib, test)
    zones = staged(zones_of(rows, "y", "split"), "zones")
    base = zones.where("split = 'base'")
    weighted = md.balanced(base, "y")
    model = md.fit_text(weighted, "text", "y", branches=branches, rows=base.count(), iterations=iterations)
    text = TextModel.of(model)
    centroids: dict[tuple[str, int], list[float]] = {}
    if embeddings is not None:
        known = base.withColumn("text_key", zone_key()).join(embeddings, "text_key")
        # Two centroids for each kind of zone.
        found = vc.centroids(known, "embedding", "kind", "y", least=least).where("centroid IS NOT NULL").collect()
        centroids = {(r["kind"], r["y"]): list(r["centroid"]) for r in found}
    scored = staged(signals(zones.where("split <> 'base'"), text, centroids, embeddings, semantic), "zone-scores")
    features = zn.features(scored.where("split = 'stack'").withColumn("semantic", F.lit(None).cast("double")), "rid")
    labels = rows.select("rid", F.col("y").alias("is_ai"))
    tree = md.fit_tree(features.join(labels, "rid"))
    modes = MODES if semantic is not None else MODES[:1]
    out = Detector(text, tree, centroids)
    judged = scored.where("split = 'calib'")
    for mode in modes:
        own = judged if mode == "no_llm" else judged.where("semantic IS NOT NULL")
        enough = own.groupBy("kind").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).where(f"n0 >= {least} AND n1 >= {least}").select("kind")
        for r in mt.youden_cut(own.join(enough, "kind", "left_semi"), "y", mode, "kind").collect():
            out.zone_cuts[r["kind"], mode] = r["cut"]
    whole = finals(scored, tree, modes, "y", "split")
    for mode in modes:
        able = whole.where("split = 'calib'" + ("" if mode == "no_llm" else " AND covered"))
        for r in mt.engine_thresholds(able, "y", mode, least=least).collect():
            out.engine[mode] = r.asDict()
    return out, _report(whole.where("split = 'test'"), out)


def _report(whole: DataFrame, detector: Detector) -> DataFrame:
    """mode, n_test, auc, and the figures at the Youden cut and of the three-way verdicts."""
    parts = []
    for mode, cuts in detector.engine.items():
        able = whole if mode == "no_llm" else whole.where("covered")
        mark = F.lit(mode).alias("mode")
        at_cut = mt.report(able, "y", (F.col(mode) >= cuts["youden_cut"]).cast("int"))
        flags = mt.decision_flags(able.withColumn("v", sc.three_way(F.col(mode), F.lit(cuts["human_cut"]), F.lit(cuts["ai_cut"]))), "y", F.col("v"))
        one = at_cut.crossJoin(mt.roc_auc(able, "y", mode)).crossJoin(flags).crossJoin(able.agg(F.count(F.lit(1)).alias("n_test")))  # one row each
        parts.append(one.select(mark, "*"))
    if not parts:
        raise ValueError("too few labelled mails to set any threshold")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SEGMENT = "kind, tfidf, embedding, semantic, score, threshold, label"


def detect(mails: DataFrame, detector: Detector, embeddings: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """key, subject, mode, tree, final, verdict, flagged, segments, warnings of each mail (key, rid, subject, body)."""
    if "no_llm" not in detector.engine:
        raise ValueError("the detector has no thresholds")
    modes = tuple(m for m in MODES if m in detector.engine)
    z = signals(zones_of(mails), detector.text, detector.centroids, embeddings, semantic)
    z = staged(z, "mail-zones")
    f = finals(z, detector.tree, modes)
    with_llm = F.col("covered") if "with_llm" in modes else F.lit(False)
    f = f.select("rid", "tree", F.when(with_llm, "with_llm").otherwise("no_llm").alias("mode"), (F.when(with_llm, F.col("with_llm")).otherwise(F.col("no_llm")) if "with_llm" in modes else F.col("no_llm")).alias("final"))

    def cut(name: str) -> Column:
        c = F.lit(detector.engine["no_llm"][name])
        return F.when(F.col("mode") == "with_llm", F.lit(detector.engine["with_llm"][name])).otherwise(c) if "with_llm" in modes else c

    def threshold(mode: str) -> Column:
        c = F.lit(None).cast("double")
        for (kind, m), value in detector.zone_cuts.items():
            if m == mode:
                c = F.when(F.col("kind") == kind, F.lit(value)).otherwise(c)
        return c

    s = z.join(f.select("rid", "mode"), "rid")
    llm = (F.col("mode") == "with_llm") & F.col("semantic").isNotNull()
    s = s.withColumns({"score": F.when(llm, F.col("with_llm")).otherwise(F.col("no_llm")), "threshold": F.when(llm, threshold("with_llm")).otherwise(threshold("no_llm"))})
    s = s.withColumn("label", sc.zone_label(F.col("score"), F.col("threshold")))
    item = F.struct(F.array_position(F.array(*map(F.lit, lx.KINDS)), F.col("kind")).alias("at"), *[F.col(c.strip()) for c in SEGMENT.split(",")])
    g = s.groupBy("rid").agg(F.sort_array(F.collect_list(item)).alias("segments"), F.bool_or(F.col("label") == "AI").alias("ai"), F.bool_or(F.col("label") == "HUMAN").alias("human"), F.bool_or(F.col("wants") & F.col("embedding").isNull()).alias("lost"))
    lost = F.coalesce("lost", F.lit(False))
    split = F.coalesce(F.col("ai") & F.col("human"), F.lit(False))
    d = mails.select("rid", "key", "subject").join(f, "rid", "left").join(g, "rid", "left")
    base = sc.three_way(F.col("final"), cut("human_cut"), cut("ai_cut"))
    notes = F.array_compact(F.array(F.when(F.col("final").isNull(), "empty_message"), F.when(lost, "embedding missing"), F.when(split & ~lost & (base != "UNCERTAIN"), "zones disagree")))
    segments = F.coalesce(F.transform("segments", lambda x: x.dropFields("at")), F.array().cast("array<struct<kind:string,tfidf:double,embedding:double,semantic:double,score:double,threshold:double,label:string>>"))
    flagged = F.transform(F.filter(segments, lambda x: x["label"] == "AI"), lambda x: x["kind"])
    verdict = F.when(lost | split, "UNCERTAIN").otherwise(base)
    return d.select("key", "subject", "mode", F.round("tree", 5).alias("tree"), F.round("final", 5).alias("final"), verdict.alias("verdict"), flagged.alias("flagged"), segments.alias("segments"), notes.alias("warnings"))


def tables(detector: Detector, spark: SparkSession) -> dict[str, DataFrame]:
    """Centroids and thresholds as small tables."""
    centres = spark.createDataFrame([(k, y, v) for (k, y), v in detector.centroids.items()], "kind string, label int, centroid array<double>")
    cuts = spark.createDataFrame([(k, m, v) for (k, m), v in detector.zone_cuts.items()], "kind string, mode string, threshold double")
    engine = spark.createDataFrame([(m, json.dumps(v)) for m, v in detector.engine.items()], "mode string, cuts string")
    return {"centroids": centres, "zone_cuts": cuts, "engine": engine}
