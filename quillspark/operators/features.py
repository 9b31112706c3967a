"""TF-IDF features of texts as a Spark ML estimator that can be saved.

A branch is one vocabulary: word or character n-grams of several lengths under one common limit.
Terms are counted in the tasks, up to HELD at a time, and summed; the most frequent terms of a branch
(ties by term) that occur in enough texts are found by a distributed top-n, so the driver
gets at most the limits.  Weights are 1 + ln(tf) or tf, times ln((1 + n) / (1 + df)) + 1, with
unit length in each branch; the branches stand one after another in the vector.

Null texts count as empty, and an empty text has an empty vector.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import by_rows, parts_for, ranged


@dataclass(frozen=True)
class Branch:
    """One vocabulary: kind is word or char, lo to hi the lengths of its n-grams, limit the terms of all lengths together."""

    kind: str = "word"
    lo: int = 1
    hi: int = 2
    limit: int = 30_000
    least: int = 2
    sublinear: bool = True
    accents: bool = True
    pattern: str = r"\w\w+"
    stopwords: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in ("word", "char") or not 1 <= self.lo <= self.hi or self.limit < 1:
            raise ValueError(f"no such branch: {self}")


#: The survey's models: the baseline, the one of mail zones, and the union of words and characters.
ZONES = (Branch(limit=30_000, pattern=r"\w+"),)
UNION = (Branch(limit=35_000, accents=False), Branch(kind="char", lo=3, hi=5, limit=35_000))


def baseline(stopwords: tuple[str, ...] = ()) -> tuple[Branch, ...]:
    return (Branch(hi=3, limit=20_000, sublinear=False, stopwords=stopwords),)


def english_stopwords() -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


@lru_cache(maxsize=16)
def _tools(branch: Branch) -> tuple[re.Pattern, frozenset[str]]:
    return re.compile(branch.pattern), frozenset(branch.stopwords)


_GAP = re.compile(r"\s\s+")


def grams(text: str, branch: Branch) -> list[str]:
    """The n-grams of a text, with repeats."""
    t = text.lower()
    if not branch.accents and not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    if branch.kind == "char":
        t = _GAP.sub(" ", t)
        return [t[i : i + n] for n in range(branch.lo, branch.hi + 1) for i in range(len(t) - n + 1)]
    pattern, stop = _tools(branch)
    words = pattern.findall(t)
    if stop:
        words = [w for w in words if w not in stop]
    out = list(words) if branch.lo == 1 else []
    for n in range(max(branch.lo, 2), branch.hi + 1):
        out += map(" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return out


#: Terms that a task counts before it hands them on, besides those of one text.
HELD = 100_000


def term_table(texts: DataFrame, column: str, branches: tuple[Branch, ...]) -> DataFrame:
    """branch, term, df, total: the terms that each branch keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[Counter] = [Counter() for _ in branches]
        docs: list[Counter] = [Counter() for _ in branches]

        def counted(k: int) -> pa.RecordBatch:
            t, d = total[k], docs[k]
            total[k], docs[k] = Counter(), Counter()
            return pa.RecordBatch.from_arrays([pa.array([k] * len(t), pa.int32()), pa.array(list(t)), pa.array([d[x] for x in t], pa.int64()), pa.array(list(t.values()), pa.int64())], names=["branch", "term", "df", "total"])

        for batch in batches:
            for text in batch.column(0):
                for k, b in enumerate(branches):
                    # Counters take a list in one call, and another counter term by term.
                    found = grams(text.as_py(), b)
                    total[k].update(found)
                    docs[k].update(set(found))
                    if len(total[k]) >= HELD:
                        yield counted(k)
        for k, t in enumerate(total):
            if t:
                yield counted(k)

    rows = texts.select(F.coalesce(F.col(column), F.lit("")).alias("t")).mapInArrow(run, "branch int, term string, df long, total long")
    # Rows are counts already, so nothing is combined before they are dealt out by term.
    counts = rows.repartition(parts_for(texts, column), "branch", "term").groupBy("branch", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    enough = F.lit(False)
    for k, b in enumerate(branches):
        enough |= (F.col("branch") == k) & (F.col("df") >= b.least)
    return most_frequent(counts.where(enough), [b.limit for b in branches])


def most_frequent(counts: DataFrame, limits: list[int]) -> DataFrame:
    """branch, term, df, total: of the k-th branch its limits[k] most frequent terms, ties by term.

    A top-n would hand the driver n terms of every partition, whose number grows with the texts.  Here the terms
    are ranged by place and counted for each range, so that only the range that holds a branch's last term is cut.
    """
    part = "part_of"
    placed = ranged(counts, part, "branch", F.desc("total"), "term")
    sizes = placed.groupBy("branch", part).count().orderBy("branch", part).collect()
    whole, out = F.lit(False), placed.limit(0).drop(part)
    for k, left in enumerate(limits):
        here = F.col("branch") == k
        for _, at, n in (r for r in sizes if r["branch"] == k):
            if n > left:
                out = out.unionByName(placed.where(here & (F.col(part) == at)).drop(part).orderBy(F.desc("total"), "term").limit(left))
                here &= F.col(part) < at
                break
            left -= n
        whole |= here
    return out.unionByName(placed.where(whole).drop(part))


class Vectorizer:
    """Rows of indices and weights of texts, in a task."""

    def __init__(self, branches: tuple[Branch, ...], terms: list[list[str]], idf: list[np.ndarray]) -> None:
        self.branches, self.size = branches, sum(map(len, terms))
        begin = np.cumsum([0, *map(len, terms)])
        self.places = [{t: int(begin[k]) + i for i, t in enumerate(own)} for k, own in enumerate(terms)]
        self.idf = np.concatenate([*idf, np.zeros(0)])

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for b, places in zip(self.branches, self.places, strict=True):
            found = Counter(map(places.get, grams(text, b)))
            found.pop(None, None)
            i = np.array(sorted(found), dtype=np.int32)
            tf = np.array([found[x] for x in i.tolist()], dtype=float)
            w = (1 + np.log(tf) if b.sublinear else tf) * self.idf[i]
            norm = np.sqrt((w * w).sum())
            at.append(i)
            values.append(w / norm if norm else w)
        return np.concatenate(at), np.concatenate(values)


def _branches(text: str) -> tuple[Branch, ...]:
    return tuple(Branch(**(b | {"stopwords": tuple(b["stopwords"])})) for b in json.loads(text))


class _Shared(HasInputCol, HasOutputCol):
    branches = Param(Params._dummy(), "branches", "the vocabularies, as JSON", typeConverter=TypeConverters.toString)

    def of(self) -> tuple[Branch, ...]:
        return _branches(self.getOrDefault(self.branches))


class TextFeatures(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the vocabularies of its branches."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "features", branches: tuple[Branch, ...] = ZONES) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, branches=json.dumps([asdict(b) for b in branches]))

    def _fit(self, df: DataFrame) -> TextFeaturesModel:
        own = self.of()
        n = df.count()
        found: list[list[tuple[str, int]]] = [[] for _ in own]
        # At most the limits.
        for r in term_table(df, self.getInputCol(), own).collect():
            found[r["branch"]].append((r["term"], r["df"]))
        model = TextFeaturesModel([[t for t, _ in sorted(x)] for x in found], [np.log((1 + n) / (1 + np.array([d for _, d in sorted(x)], dtype=float))) + 1 for x in found])
        return self._copyValues(model)


class TextFeaturesModel(Model, _Shared, MLReadable, MLWritable):
    """Adds the vector of a text, and in plain columns its indices and weights."""

    def __init__(self, terms: list[list[str]] | None = None, idf: list[np.ndarray] | None = None) -> None:
        super().__init__()
        self.terms, self.idf = terms or [], idf or []

    @property
    def size(self) -> int:
        return sum(map(len, self.terms))

    def vectorizer(self) -> Vectorizer:
        return Vectorizer(self.of(), self.terms, self.idf)

    def rows(self, df: DataFrame, out: str) -> DataFrame:
        """df with the column out: struct<indices, values>."""
        made = self.vectorizer()

        def run(text: str | None) -> tuple[list[int], list[float]]:
            at, values = made.row(text or "")
            return at.tolist(), values.tolist()

        return df.withColumn(out, by_rows(run, "struct<indices:array<int>,values:array<double>>")(F.col(self.getInputCol())))

    def _transform(self, df: DataFrame) -> DataFrame:
        size, made = self.size, self.vectorizer()
        vector = by_rows(lambda text: SparseVector(size, *made.row(text or "")), VectorUDT())
        return df.withColumn(self.getOutputCol(), vector(F.col(self.getInputCol())))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TextFeaturesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(k, i, t, float(x)) for k, own in enumerate(self.model.terms) for i, (t, x) in enumerate(zip(own, self.model.idf[k], strict=True))]
        self.sparkSession.createDataFrame(rows, "branch int, i int, term string, idf double").coalesce(1).write.parquet(f"{path}/terms")


class _Reader(MLReader):
    def load(self, path: str) -> TextFeaturesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/terms").orderBy("branch", "i").collect()
        n = len(_branches(meta["paramMap"]["branches"]))
        own = [[r for r in rows if r["branch"] == k] for k in range(n)]
        model = TextFeaturesModel([[r["term"] for r in x] for x in own], [np.array([r["idf"] for r in x]) for x in own])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
