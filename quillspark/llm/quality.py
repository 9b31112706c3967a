"""Operator 4, quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its hashed words, pairs of words and character
n-grams; a softmax layer turns the average into class probabilities.  Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
Since the layer is linear in the average, scoring needs one number a bucket: the vector's
product with the difference of the two classes' weights.

The sample: at most ROWS labelled documents, half of each label as far as they go, chosen
by a hash of doc_id among rows whose crc32(doc_id as text) mod 4 is not 2, and at most
ENTRIES bucket counts in all (whole documents); of rows that share a labelled doc_id one is
learned from.  The true label odds are restored by a shift of the logit.

Defined cases: null text counts as empty; a text without characters scores as the labelled
rows' share of label 1; without any labelled row every score is 0.5; a null doc_id is not
held out; repeated rows score alike; a very long text is averaged whole; labels that contradict
each other count as the lower one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.common import crc_mod, documents, id_text, staged

ROWS = 4000
ENTRIES = 12_000_000
BITS = 17
BUCKETS = 1 << BITS
DIM = 8
GRAMS = (2, 3, 4)
#: Passes over the sample: at least EPOCHS, and as many as STEPS batches need.
EPOCHS = 12
STEPS = 1000
RATE = 4.0
CUT = 0.7
SEED = 7
#: Bytes of text whose features are held at a time.
SLICE = 1 << 19

_U = np.uint64
_SHIFT = _U(64 - BITS)


def _features(s: tk.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of bytes, buckets) of words, of pairs of words and of character n-grams within words, a pair for each kind."""
    data = s.data
    if not len(data):
        return
    w = tk.words(s)
    sums = tk.prefix(data)
    inv = tk._TABLE.inv

    def bucket(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        h = (sums[b] - sums[a]) * inv[a] + _U(kind)
        h ^= h >> _U(29)
        return ((h * _U(0xBF58476D1CE4E5B9)) >> _SHIFT).astype(np.int32)

    yield w.starts, bucket(w.starts, w.ends, 1)
    # Pairs of neighbouring words, at the place of the second.
    h = tk.range_hash(sums, w.starts, w.ends)
    second = np.ones(len(h), dtype=bool)
    second[w.of[:-1][w.counts > 0]] = False
    at = np.flatnonzero(second)
    yield w.starts[at], (tk.mix(h[at - 1] * _U(0x9E3779B97F4A7C15) + h[at]) >> _SHIFT).astype(np.int32)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    solid = ~tk.SPACE[data]
    # Index of the first character at or after the end of the word that holds each character.
    n = len(chars)
    word = np.searchsorted(w.starts, chars, side="right") - 1
    inside = solid[chars]
    limit = np.where(inside, np.searchsorted(chars, w.ends)[np.maximum(word, 0)], -1)
    edge = np.append(chars, len(data))
    place = np.arange(n)
    for k in GRAMS:
        at = np.flatnonzero(place + k <= limit)
        yield chars[at], bucket(chars[at], edge[at + k], k)


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, buckets, counts (both 32-bit) of each document, each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1), SLICE):
                doc, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at, b in _features(s):
                    doc.append(np.searchsorted(s.offsets, at, side="right") - 1)
                    bucket.append(b.astype(np.int64))
                key, n = np.unique(np.concatenate(doc) * BUCKETS + np.concatenate(bucket), return_counts=True)
                of = np.searchsorted(key, np.arange(s.n + 1) * BUCKETS)
                cut = list(zip(of[:-1].tolist(), of[1:].tolist(), strict=True))
                key = key % BUCKETS
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array([key[a:b].astype("<u4").tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in cut], pa.binary())], names=["doc_id", "buckets", "counts"])

    return id_text(docs).mapInArrow(run, "doc_id long, buckets binary, counts binary")


@dataclass
class Model:
    """score(x) = sigmoid(shift + average of weight[bucket])."""

    weight: np.ndarray
    shift: float


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, epochs: int | None = None, seed: int = SEED) -> Model:
    """Stochastic gradient descent on batches of 32; prior is the log odds of label 1 among all labelled rows."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    batches = -(-len(rows) // 32)
    epochs = epochs or max(EPOCHS, -(-STEPS // batches))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    label = np.array([y for _, _, y in rows])
    share = [(n / max(1, n.sum())).astype(np.float32) for _, n, _ in rows]
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 32):
            own = order[a : a + 32]
            own = own[[len(share[i]) > 0 for i in own]]
            rate, step = np.float32(RATE * (1 - step / steps)), step + 1
            if not len(own):
                continue
            at = np.concatenate([rows[i][0] for i in own]).astype(np.int64)
            part = np.concatenate([share[i] for i in own])
            size = np.array([len(share[i]) for i in own])
            mean = np.add.reduceat(vectors[at] * part[:, None], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            back = np.repeat(p @ layer.T, size, axis=0) * part[:, None]
            met, where = np.unique(at, return_inverse=True)
            for d in range(DIM):
                vectors[met, d] -= rate * np.bincount(where, weights=back[:, d]).astype(np.float32)
            layer -= rate * (mean.T @ p) / len(own)
            bias -= rate * p.sum(axis=0) / len(own)
    ones = int(label.sum())
    odds = np.log(max(ones, 0.5) / max(len(label) - ones, 0.5))
    diff = layer[:, 1] - layer[:, 0]
    return Model(vectors @ diff, float(bias[1] - bias[0]) + prior - float(odds))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, entries: int = ENTRIES) -> Model:
    """Learns from the labels of documents that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id").cast("long"), 4) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not totals:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    prior = float(np.log(max(totals.get(1, 0), 0.5) / max(totals.get(0, 0), 0.5)))
    order = F.xxhash64("doc_id", F.lit(SEED))
    # At most `rows` ids, so the broadcast is bounded.
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows // 2) for y in (0, 1)]
    picked = staged(chosen[0].unionByName(chosen[1]), "quality-sample")
    held = id_text(docs).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    # One row for each id, however many share it; minima are combined before the shuffle.
    held = held.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text")
    found = staged(bags(held).join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id"), "quality-bags")
    out, total = [], 0
    for r in found.orderBy(order, "doc_id").toLocalIterator():
        own = np.frombuffer(r["buckets"], "<u4")
        total += len(own)
        if out and total > entries:
            break
        out.append((own, np.frombuffer(r["counts"], "<u4"), r["y"]))
    return train(out, prior)


def _scores(s: tk.Slice, weight: np.ndarray, shift: float) -> np.ndarray:
    total, n = np.zeros(s.n), np.zeros(s.n)
    for at, b in _features(s):
        of = np.searchsorted(at, s.offsets)
        total += tk.segment_sum(weight[b], of)
        n += np.diff(of)
    return 1 / (1 + np.exp(-(shift + total / np.maximum(n, 1)).clip(-700, 700)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs."""
    weight, shift = model.weight.astype(np.float64), model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(_scores(s, weight, shift))], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows of docs whose score reaches cut, all columns as they were; filtered where they are read, without a join.

    Without any labelled row nothing is known against a document, and all stay.
    """
    model = fit(docs, labels)
    if model.shift == 0.0 and not model.weight.any():
        return docs
    weight, shift, at = model.weight.astype(np.float64), model.shift, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            for s in tk.slices(text, SLICE):
                yield batch.slice(s.first, s.n).filter(pa.array(_scores(s, weight, shift) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels_of(spark, sf_dir))
