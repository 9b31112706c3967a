"""Operator 10, language-model scoring by subword lattices.

A word, with the mark of its beginning, is a lattice of all ways to cut it into pieces of
an existing vocabulary.  A forward recursion in log space sums over all of them, so the
score of a text is the log of its marginal probability, not that of one best cut.  The public
vocabulary at hand is one of merges, whose scores are ranks and no unigram log probabilities:
piece weights therefore begin as a Zipf law of those ranks and are re-estimated by one round of
expected counts (forward-backward) over all distinct words of the training documents.  Single
bytes are pieces, so every text has a probability.

A text's probability is the product of its words' and the end's, so the lattice is run
once for each distinct word of the corpus.  Words met often, in training documents or others,
are scored from a table of at most FREQUENT entries that all tasks hold; the others are joined
with the full table.  A word of over LONG bytes (a text without spaces is one) runs through the
lattice by itself, CHUNK bytes at a time: scoring holds the arcs of a chunk only, learning 16
bytes besides for each byte of the word.

Defined cases: null text counts as empty (only the end); a null doc_id is not held out and
learned from; without training documents every count is 0 and pieces keep their first
weights; rows that repeat a doc_id are scored each on its own; a very long text is scored whole;
an empty table gives no rows; extra columns are ignored.
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

#: The words that every task holds: bounded, whatever the corpus.
FREQUENT = 1 << 19
#: Zipf-Mandelbrot offset of the first piece weights, and how many counts they are worth afterwards.
OFFSET, PRIOR = 2.7, 1e4
#: Words longer than this many bytes run through the lattice on their own.
LONG = 64
CHUNK = 1 << 14
SLOTS = 1 << 20
MARK = b" "

_U = np.uint64


def default_vocabulary() -> str:
    """Path of the public vocabulary of 32,000 pieces with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, with a space for the mark of a word's beginning; scores).  A byte piece is its byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    low = min(sp.get_score(i) for i in range(len(sp)))
    for i in range(len(sp)):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        if sp.is_byte(i):
            piece, s = bytes([int(sp.id_to_piece(i)[1:-1], 16)]), low
        else:
            piece, s = sp.id_to_piece(i).replace("▁", " ").encode(), sp.get_score(i)
        score[piece] = max(score.get(piece, -np.inf), s)
    for b in range(256):
        score.setdefault(bytes([b]), low)
    names = sorted(score)
    return names, np.array([score[n] for n in names])


@dataclass
class Lattice:
    """Piece lookup and forward (and backward) recursions over groups of words of equal length."""

    hashes: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        self.first = np.full(SLOTS, -1, dtype=np.int32)
        self.second = np.full(SLOTS, -1, dtype=np.int32)
        a = (self.hashes & _U(SLOTS - 1)).astype(np.int64)
        b = ((self.hashes >> _U(40)) & _U(SLOTS - 1)).astype(np.int64)
        order = np.arange(len(self.hashes))
        self.first[a] = order
        lost = self.first[a] != order
        self.second[b[lost]] = order[lost]
        self.rest = {int(self.hashes[i]): int(i) for i in order[lost] if self.second[b[i]] != i}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        out = self.first[(h & _U(SLOTS - 1)).astype(np.int64)]
        out = np.where((out >= 0) & (self.hashes[out] == h), out, -1)
        miss = out < 0
        two = self.second[((h[miss] >> _U(40)) & _U(SLOTS - 1)).astype(np.int64)]
        out[miss] = np.where((two >= 0) & (self.hashes[two] == h[miss]), two, -1)
        if self.rest:
            for i in np.flatnonzero(out < 0):
                out.flat[i] = self.rest.get(int(h.flat[i]), -1)
        return out

    def arcs(self, words: np.ndarray) -> list[np.ndarray]:
        """words: uint8 (m, n).  For each end j = 1..n the pieces (m, k) that begin at j - k .. j - 1."""
        m, n = words.shape
        tk._TABLE.need(n + 1)
        sums = np.zeros((m, n + 1), dtype=_U)
        np.cumsum((words.astype(_U) + _U(1)) * tk._TABLE.fwd[:n], axis=1, out=sums[:, 1:])
        inv, out = tk._TABLE.inv, []
        for j in range(1, n + 1):
            lo = max(0, j - self.longest)
            h = tk.mix((sums[:, j : j + 1] - sums[:, lo:j]) * inv[lo:j] + np.arange(j - lo, 0, -1).astype(_U))
            out.append(self.find(h))
        return out

    def forward(self, arcs: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all cuts of each prefix: (m, n + 1)."""
        m, n = arcs[0].shape[0], len(arcs)
        alpha = np.full((m, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            ids = arcs[j - 1]
            alpha[:, j] = _logsum(np.where(ids >= 0, logp[ids], -np.inf) + alpha[:, j - ids.shape[1] : j])
        return alpha

    def backward(self, arcs: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
        m, n = arcs[0].shape[0], len(arcs)
        beta = np.full((m, n + 1), -np.inf)
        beta[:, n] = 0
        for j in range(n, 0, -1):
            ids = arcs[j - 1]
            k = ids.shape[1]
            with np.errstate(divide="ignore"):
                beta[:, j - k : j] = np.logaddexp(beta[:, j - k : j], np.where(ids >= 0, logp[ids], -np.inf) + beta[:, j : j + 1])
        return beta

    def expected(self, arcs: list[np.ndarray], logp: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds each piece's expected count, weighted by how often its word occurs."""
        alpha, beta = self.forward(arcs, logp), self.backward(arcs, logp)
        scale = np.log(weight) - alpha[:, -1]
        for j, ids in enumerate(arcs, 1):
            at = ids >= 0
            value = np.where(at, logp[ids], -np.inf) + alpha[:, j - ids.shape[1] : j] + beta[:, j : j + 1] + scale[:, None]
            total += np.bincount(ids[at], weights=np.exp(value[at]), minlength=len(total))

    def _spans(self, word: np.ndarray, lo: int, hi: int, by_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces) of the arcs of one word that end in lo + 1 .. hi, in order of their end; or that start in lo .. hi - 1, in order of their start."""
        a, b = (max(0, lo - self.longest), hi) if by_end else (lo, min(len(word), hi + self.longest))
        tk._TABLE.need(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum((word[a:b].astype(_U) + _U(1)) * tk._TABLE.fwd[: b - a], out=sums[1:])
        k = np.arange(1, self.longest + 1)
        if by_end:
            ends = np.arange(lo + 1, hi + 1)[:, None]
            starts = ends - k
        else:
            starts = np.arange(lo, hi)[:, None]
            ends = starts + k
        starts, ends = (x.reshape(-1) for x in np.broadcast_arrays(starts, ends))
        inside = (starts >= 0) & (ends <= len(word))
        starts, ends = starts[inside], ends[inside]
        ids = self.find(tk.mix((sums[ends - a] - sums[starts - a]) * tk._TABLE.inv[starts - a] + (ends - starts).astype(_U)))
        met = ids >= 0
        return starts[met], ends[met], ids[met]

    def _run(self, word: np.ndarray, p: np.ndarray, by_end: bool, kept: np.ndarray | None) -> float:
        """The recursion over one long word, forwards or backwards, in scaled numbers; kept takes the log of each place.  Returns the log of the last."""
        n, scale = len(word), 0.0
        value = [1.0]
        if kept is not None:
            kept[0 if by_end else n] = 0.0
        for at in range(0, n, CHUNK):
            if by_end:
                lo, hi = at, min(n, at + CHUNK)
            else:
                lo, hi = max(0, n - at - CHUNK), n - at
            starts, ends, ids = self._spans(word, lo, hi, by_end)
            # Steps from a place back to one whose value is known, place by place.
            here, step, weight = (ends - lo - 1 if by_end else starts - lo), (ends - starts).tolist(), p[ids].tolist()
            edge = np.searchsorted(here, np.arange(hi - lo + 1)).tolist()
            logs = np.empty(hi - lo)
            for j in range(hi - lo) if by_end else range(hi - lo - 1, -1, -1):
                size, v = len(value), 0.0
                for i in range(edge[j], edge[j + 1]):
                    v += weight[i] * value[size - step[i]]
                if v < 1e-200:
                    value = [x * 1e200 for x in value[-self.longest :]]
                    v, scale = v * 1e200, scale - 200 * np.log(10)
                value.append(v)
                logs[j] = np.log(v) + scale
            value = value[-self.longest :]
            if kept is not None:
                kept[lo + by_end : hi + by_end] = logs
        return float(np.log(value[-1]) + scale)

    def forward_long(self, word: np.ndarray, logp: np.ndarray) -> float:
        """Log of the summed probability of all cuts of one long word."""
        return self._run(word, np.exp(logp), True, None)

    def expected_long(self, word: np.ndarray, logp: np.ndarray, weight: float, total: np.ndarray) -> None:
        p = np.exp(logp)
        alpha, beta = np.empty(len(word) + 1), np.empty(len(word) + 1)
        whole = self._run(word, p, True, alpha)
        self._run(word, p, False, beta)
        for lo in range(0, len(word), CHUNK):
            starts, ends, ids = self._spans(word, lo, min(len(word), lo + CHUNK), True)
            total += np.bincount(ids, weights=weight * np.exp(alpha[starts] + logp[ids] + beta[ends] - whole), minlength=len(total))


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def by_length(words: list[bytes], most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, uint8 (m, n)) for groups of marked words of equal length; a long word is a group of its own."""
    n = np.array([len(w) for w in words]) + 1
    order = np.argsort(n, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        size = int(n[part[0]]) if len(part) else 0
        step = most if size <= LONG else 1
        for a in range(0, len(part), step):
            own = part[a : a + step]
            yield own, np.frombuffer(b"".join(MARK + words[i] for i in own.tolist()), dtype=np.uint8).reshape(len(own), size)


def held(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False)))


def _hashed(s: tk.Slice) -> tuple[np.ndarray, tk.Words, np.ndarray]:
    w, low = tk.words(s), tk.LOWER[s.data]
    return low, w, tk.range_hash(tk.prefix(low), w.starts, w.ends)


def vocabulary(docs: DataFrame) -> DataFrame:
    """h, word, c (occurrences in training documents), n (in all) of each distinct word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            for s in tk.slices(batch.column(0), 2 * tk.SLICE_BYTES):
                low, w, h = _hashed(s)
                if not len(h):
                    continue
                uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(back, weights=np.repeat(train[s.first : s.first + s.n], w.counts).astype(np.float64), minlength=len(uniq))
                raw = low.tobytes()
                words = [raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(words, pa.binary()), pa.array(n.astype(np.int64)), pa.array(np.bincount(back, minlength=len(uniq)).astype(np.int64))], names=["h", "word", "c", "n"])

    rows = held(docs).select("text", "held_out").mapInArrow(run, "h long, word binary, c long, n long")
    # Equal hashes are equal words, so the word is carried along as a key rather than aggregated.
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _start(path: str) -> tuple[Lattice, np.ndarray]:
    pieces, score = read_pieces(path)
    p = 1 / (OFFSET - score)
    hashes = np.array([tk.hash_bytes(x) for x in pieces], dtype=_U)
    # Words hold a space at their beginning only, so pieces with another one never fit.
    return Lattice(hashes, max(len(x) for x in pieces if MARK not in x[1:])), p / p.sum()


def learn(vocab: DataFrame, path: str, ends: int) -> tuple[np.ndarray, float]:
    """(log10 weights of pieces, log10 weight of the end) after one round of expected counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, p = _start(path)
        logp, total = np.log(p), np.zeros(len(p))
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for own, chars in by_length(words):
                if chars.shape[1] > LONG:
                    lattice.expected_long(chars[0], logp, float(c[own[0]]), total)
                else:
                    lattice.expected(lattice.arcs(chars), logp, c[own].astype(np.float64), total)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["piece", "n"])

    rows = vocab.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").toPandas()
    _, first = _start(path)
    n = PRIOR * first
    n[rows["piece"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy()
    end = ends + PRIOR / len(first)
    total = n.sum() + end
    return np.log10(n / total), float(np.log10(end / total))


def word_scores(vocab: DataFrame, path: str, logp10: np.ndarray) -> DataFrame:
    """h, c, n, lp (log10 of the word's marginal probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = _start(path)
        logp = logp10 * np.log(10)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for own, chars in by_length(batch.column(3).to_pylist()):
                if chars.shape[1] > LONG:
                    out[own] = lattice.forward_long(chars[0], logp)
                else:
                    out[own] = lattice.forward(lattice.arcs(chars), logp)[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out / np.log(10))], names=["h", "c", "n", "lp"])

    return vocab.select("h", "c", "n", "word").mapInArrow(run, "h long, c long, n long, lp double")


def frequent(scores: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words with the highest counts over all documents: as many whole bins of the logarithm of the count as fit below most."""
    bin_ = F.floor(F.log2(F.col("n") + 1) * 32)
    found = sorted(((r["b"], r["count"]) for r in scores.groupBy(bin_.alias("b")).count().collect()), reverse=True)
    total, least = 0, None
    for b, n in found:
        total += n
        if total > most:
            break
        least = b
    return scores.where(bin_ >= least) if least is not None else scores.where("false")


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    path = path or default_vocabulary()
    vocab = staged(vocabulary(docs), "lm-words")
    ends = held(docs).where(~F.col("held_out")).count()
    sums = vocab.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    logp, end = learn(vocab, path, ends)
    scores = staged(word_scores(vocab, path, logp), "lm-scores")
    size = n + 0.5 * (v + 1)
    top = frequent(scores).toPandas()
    order = np.argsort(top["h"].to_numpy())
    key, c, lp = (top[x].to_numpy()[order] for x in ("h", "c", "lp"))
    base = np.log10((c + 0.5) / size)
    known = (c > 0).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(2)):
                _, w, h = _hashed(s)
                h = h.view(np.int64)
                uniq, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(key, uniq), max(len(key) - 1, 0))
                hit = key[at] == uniq if len(key) else np.zeros(len(uniq), dtype=bool)
                values = [np.where(hit, x[at], 0)[back] if len(key) else np.zeros(len(h), x.dtype) for x in (base, lp, known)]
                rare = ~hit[back] if len(h) else np.zeros(0, dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[w.of].astype(np.int32)), pa.array(h[rare]))
                cut = [x.slice(s.first, s.n) for x in batch.columns]
                yield pa.RecordBatch.from_arrays([cut[0], cut[1], cut[3], pa.array(w.counts.astype(np.int64)), *(pa.array(tk.segment_sum(x, w.of)) for x in values), lists], names=names)

    names = ["doc_id", "held_out", "rid", "words", "base", "lp", "known", "rare"]
    rows = held(docs).withColumn("rid", F.monotonically_increasing_id()).select("doc_id", "held_out", "text", "rid")
    first = staged(rows.mapInArrow(run, "doc_id long, held_out boolean, rid long, words long, base double, lp double, known long, rare array<bigint>"), "lm-first")
    others = first.select("rid", F.explode("rare").alias("h")).join(scores, "h").groupBy("rid").agg(F.sum(F.log10((F.col("c") + 0.5) / F.lit(size))).alias("base_2"), F.sum("lp").alias("lp_2"), F.sum((F.col("c") > 0).cast("long")).alias("known_2"))
    out = first.drop("rare").join(others, "rid", "left")
    zero = F.lit(0)
    return out.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("known_2", zero) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_2", zero) + float(np.log10((ends + 0.5) / size))).alias("base_score"),
        (F.col("lp") + F.coalesce("lp_2", zero) + end).alias("score"),
    )


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
