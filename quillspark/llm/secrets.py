"""Operator 7, secret scans by a battery of randomness tests.

Base patterns (assignments, access keys, long hexadecimal) always count.  Besides, every
run of 20 or more key characters outside them is a candidate; '=' belongs to it only as
padding at its end, so name and value of an assignment are tested apart.  Its encoding is
inferred (the smallest of hexadecimal, base32, lower or upper case with digits, letters and
digits, and the two base64 alphabets that holds it), and chi-squared uniformity over that
alphabet, runs of character classes and serial correlation are tested and combined, calibrated
for each encoding and length by simulation: see randomness.  The letters of the simulated
ordinary strings follow the trigrams of all words of the table.  Candidates of the corpus are
then held to a false-discovery rate by the step-up rule, each weighted by its length (longer
strings carry more evidence) over the mean weight of all candidates, so that weights average 1.
Candidates that no encoding fits, numbers among them, count too, as never rejected.  The rule needs only
counts in bins of the logarithm.

Defined cases: null text counts as empty; an empty text has no spans and the digest of the
empty string; repeated rows are scanned alike and each counts as a candidate of its own; an empty
table gives no rows; a table without words has ordinary strings of any letters; a very long text
is scanned whole; extra columns are ignored.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import randomness as rn
from quillspark.llm import textkit as tk
from quillspark.llm.common import arrow_map, documents, id_text, staged

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

#: Shorter runs can't be tested, whatever their padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
LEAST_CANDIDATE = 20
#: False-discovery rate of the random spans.
ALPHA = 0.01
#: Bins of -log10 p for the step-up rule.
BIN, BINS = 0.05, 1200
#: Length by which weights are stated; beyond twice of it they rise no more.
USUAL_LENGTH = 32

#: Words of more letters than this teach no trigrams.
LONGEST_WORD = 19
_KEY = np.zeros(256, dtype=bool)
_KEY[48:58] = _KEY[65:91] = _KEY[97:123] = True
_KEY[[ord(c) for c in "+/_=-"]] = True
_KEY[128:] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def trigrams(docs: DataFrame) -> np.ndarray:
    """Trigrams of the words of all texts, runs of key characters that are ASCII letters only and no candidates; 27 ** 3 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                w = tk.bounds(_KEY[s.data], s.offsets)
                letters = np.concatenate([[0], np.cumsum(_LETTER[s.data])])
                size = w.ends - w.starts
                fit = (size <= LONGEST_WORD) & (letters[w.ends] - letters[w.starts] == size)
                total += rn.count_trigrams(s.data, w.starts[fit], w.ends[fit])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["i", "n"])

    found = id_text(docs).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3)
    out[found["i"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return out.reshape(27, 27, 27)


def simulated(spark: SparkSession, counts: np.ndarray) -> rn.Nulls:
    """The nulls of all encodings and lengths, a task for each encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for n, weights, scores in rn.simulate(i, rn.Letters(counts)):
                    null = rn.Null.of(weights, scores)
                    row = [[i], [n], [null.weights.tolist()], [null.scores.tolist()], [null.shares.tolist()], [null.scale]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["which", "n", "weights", "scores", "shares", "scale"])

    kinds = spark.range(len(rn.ENCODINGS), numPartitions=len(rn.ENCODINGS)).mapInArrow(run, "which long, n long, weights array<double>, scores array<double>, shares array<double>, scale double")
    return {(r["which"], r["n"]): rn.Null(np.array(r["weights"]), np.array(r["scores"]), np.array(r["shares"]), r["scale"]) for r in kinds.collect()}


def weight(n: int) -> float:
    """Before it is divided by the mean weight of all candidates."""
    return min(n, 2 * USUAL_LENGTH) / USUAL_LENGTH


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what is to be tested: runs of key characters without what base spans cover."""
    out = []
    # What base spans cover, as disjoint stretches in order; candidates are in order too, so one pass over both is enough.
    covered: list[list[int]] = []
    for x, _, y in base:
        if covered and x <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    j = 0
    for m in CANDIDATE.finditer(text):
        at, last = m.span()
        free = []
        while j < len(covered) and covered[j][1] <= at:
            j += 1
        i = j
        while i < len(covered) and covered[i][0] < last:
            free.append((at, covered[i][0]))
            at = max(at, covered[i][1])
            i += 1
        j = max(j, i - 1)
        for a, b in [*free, (at, last)]:
            if b - a < LEAST_CANDIDATE:
                continue
            # Padding that no encoding has is left out.
            if rn.encoding(text[a:b]) is None:
                b = a + len(text[a:b].rstrip("="))
            if b - a >= LEAST_CANDIDATE:
                out.append((a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, nulls: rn.Nulls) -> DataFrame:
    """doc_id, counts, base (joined), base_sha256, extra: start:end:bin of each candidate outside the base spans that an encoding fits, tested and weights: the number and the summed weight of all candidates."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "base_sha256", "extra", "tested", "weights")}
        for value in batch.column(1):
            text = value.as_py()
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            extra, found = [], candidates(text, base)
            for a, b in found:
                got = rn.battery(text[a:b], nulls)
                if got:
                    score = -math.log10(got[1]) + math.log10(weight(b - a))
                    extra.append(f"{a}:{b}:{min(max(int(score / BIN), 0), BINS)}")
            text = _joined(base)
            row = (kinds.count(0), kinds.count(1), kinds.count(2), text, hashlib.sha256(text.encode()).hexdigest(), ",".join(extra), len(found), sum(weight(b - a) for a, b in found))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": batch.column(0)} | out

    return arrow_map(id_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base string, base_sha256 string, extra string, tested long, weights double")


def threshold(counts: dict[int, int], tested: int, mean: float, alpha: float = ALPHA) -> int:
    """The lowest bin of -log10(p / weight) from which on the step-up rule rejects among all tested; BINS + 1 if none.  mean is that of the weights."""
    above, best = 0, BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        # Every p of the bin is at most that of its lower edge.
        if 10 ** (-b * BIN) * mean * tested / above <= alpha:
            best = b
    return best


def find_secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = staged(scan(docs, simulated(docs.sparkSession, trigrams(docs))), "secret-spans")
    bins = found.where(F.col("extra") != "").select(F.explode(F.split("extra", ",")).alias("x")).select(F.split("x", ":")[2].cast("int").alias("bin")).groupBy("bin").count()
    all_ = found.agg(F.sum("tested").alias("n"), F.sum("weights").alias("w")).first()
    tested, mean = all_["n"] or 0, (all_["w"] or 0.0) / max(all_["n"] or 0, 1)
    # At most BINS + 1 rows.
    least = threshold({r["bin"]: r["count"] for r in bins.collect()}, tested, mean, alpha)
    picked = F.filter(F.split("extra", ","), lambda x: F.get(F.split(x, ":"), F.lit(2)).cast("int") >= least)
    random = F.when(F.col("extra") == "", F.array().cast("array<string>")).otherwise(F.transform(picked, lambda x: F.concat_ws(":", F.lit("random"), F.get(F.split(x, ":"), F.lit(0)), F.get(F.split(x, ":"), F.lit(1)))))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    order = {k: i for i, k in enumerate(KINDS)}
    keyed = F.transform(F.concat(base, random), lambda s: F.struct(F.get(F.split(s, ":"), F.lit(1)).cast("long").alias("at"), F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.get(F.split(s, ":"), F.lit(0))).alias("kind"), s.alias("s")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ",").alias("spans"), F.size(random).cast("long").alias("n_random"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
