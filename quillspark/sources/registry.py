"""A registry of trained detectors: numbered versions that are whole, checked when they are loaded.

A version is a folder of models and small tables, and a manifest of what they must hold.  The
manifest is written last and only once, so a version exists when all of it does; the latest one
is that with the highest number.  load() refuses parts that don't fit together, and
predictor() keeps what it loaded for the session.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from quillspark.functions import lexicon as lx
from quillspark.operators import models as md
from quillspark.operators.detector import MODES, Detector, TextModel, tables
from quillspark.operators.features import TextFeaturesModel
from quillspark.session import create_once, read_text

#: Raised by one whenever what a version holds changes.
FORMAT = 1


class Mismatch(RuntimeError):
    """Parts of a version that don't fit together, or that this code can't use."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    fs, at = _fs(spark, f"{path}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def publish(spark: SparkSession, path: str, detector: Detector) -> int:
    """Saves a detector as the next version; returns its number."""
    path = path.rstrip("/")
    place = f"parts/{uuid.uuid4().hex}"
    detector.text.features.write().save(f"{path}/{place}/features")
    rows = [(i, float(w)) for i, w in enumerate(detector.text.weights)]
    spark.createDataFrame(rows, "i int, weight double").coalesce(1).write.parquet(f"{path}/{place}/weights")
    detector.tree.write().save(f"{path}/{place}/tree")
    for name, t in tables(detector, spark).items():
        t.coalesce(1).write.parquet(f"{path}/{place}/{name}")
    manifest = {"format": FORMAT, "place": place, "terms": detector.text.features.size, "intercept": detector.text.intercept, "dimension": detector.dimension, "kinds": list(lx.KINDS), "tree_inputs": md.TREE_INPUTS, "modes": sorted(detector.engine)}
    while True:
        n = max(versions(spark, path), default=0) + 1
        if create_once(spark, f"{path}/manifests/{n:08d}.json", json.dumps(manifest)):
            return n


def _fit(good: bool, what: str) -> None:
    if not good:
        raise Mismatch(what)


def load(spark: SparkSession, path: str, version: int | None = None, dimension: int | None = None) -> Detector:
    """A version, the latest without a number; dimension is that of the embeddings to be used, if any are."""
    path = path.rstrip("/")
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise RuntimeError(f"artefact missing: version {version or 'any'} below {path}")
    m = json.loads(read_text(spark, f"{path}/manifests/{version or there[-1]:08d}.json"))
    _fit(m["format"] == FORMAT, f"format {m['format']}, not {FORMAT}")
    _fit(m["kinds"] == list(lx.KINDS), "other kinds of zones")
    _fit(m["tree_inputs"] == md.TREE_INPUTS, "other inputs of the tree")
    at = f"{path}/{m['place']}"
    for name in ("features", "weights", "tree", "centroids", "zone_cuts", "engine"):
        fs, p = _fs(spark, f"{at}/{name}")
        if not fs.exists(p):
            raise RuntimeError(f"artefact missing: {at}/{name}")
    features = TextFeaturesModel.read().load(f"{at}/features")
    weights = spark.read.parquet(f"{at}/weights").toPandas().sort_values("i")["weight"].to_numpy()
    _fit(features.size == len(weights) == m["terms"], f"{features.size} terms, {len(weights)} weights, {m['terms']} expected")
    tree = PipelineModel.load(f"{at}/tree")
    _fit(tree.stages[-1].numFeatures == len(md.TREE_INPUTS), f"a tree of {tree.stages[-1].numFeatures} inputs")
    centroids = {(r["kind"], r["label"]): list(r["centroid"]) for r in spark.read.parquet(f"{at}/centroids").collect()}
    sizes = {len(c) for c in centroids.values()}
    _fit(sizes <= {m["dimension"]}, f"centroids of {sorted(sizes)} dimensions, {m['dimension']} expected")
    _fit(dimension is None or not sizes or sizes == {dimension}, f"embeddings of {dimension} dimensions, centroids of {sorted(sizes)}")
    cuts = {(r["kind"], r["mode"]): r["threshold"] for r in spark.read.parquet(f"{at}/zone_cuts").collect()}
    engine = {r["mode"]: json.loads(r["cuts"]) for r in spark.read.parquet(f"{at}/engine").collect()}
    _fit(sorted(engine) == m["modes"] and set(engine) <= set(MODES) and "no_llm" in engine, f"modes {sorted(engine)}")
    _fit(all(k in lx.KINDS and mode in MODES and 0 <= v <= 1 for (k, mode), v in cuts.items()), "thresholds of other zones or out of bounds")
    _fit(all(0 <= e["human_cut"] <= e["ai_cut"] <= 1 for e in engine.values()), "cuts out of order")
    return Detector(TextModel(features, weights, m["intercept"]), tree, centroids, cuts, engine)


@lru_cache(maxsize=8)
def _kept(session: str, path: str, version: int, dimension: int | None) -> Detector:
    spark = SparkSession.getActiveSession()
    return load(spark, path, version, dimension)


def predictor(spark: SparkSession, path: str, version: int | None = None, dimension: int | None = None) -> Detector:
    """The detector of a version, loaded once a session; the latest is looked up anew at each call."""
    there = versions(spark, path)
    if version is None and there:
        version = there[-1]
    if version is None:
        raise RuntimeError(f"artefact missing: no version below {path}")
    return _kept(spark.sparkContext.applicationId, path.rstrip("/"), version, dimension)
