"""Operator 12, cross-tokenizer alignment by union-find over overlapping tokens.

Each text is encoded by two tokenizers over the same bytes.  Tokens of the two whose byte
ranges overlap are joined by an edge; the connected components of this bipartite graph, found
by union-find over the arrays of a slice of texts at once, are exactly the minimal groups of
tokens that cover the same bytes.  The members of a component expand to links, every token of
one side with every token of the other; members with equal ids are counted first, so a long
group of few ids stays small.

How many documents hold an id pair linked is counted over the whole corpus from each document's
distinct pairs, with partial sums before the shuffle.  The commonest pairs (at most FREQUENT)
are held by all tasks, the others are joined.  The highest count of each id has at most as many
rows as the first vocabulary.

Defined cases: null and empty texts, and texts whose joined tokens differ from a space and the
text for either tokenizer, have no tokens, zeros and an empty groups_sha256; a null doc_id is a
document like any other; rows that repeat a doc_id, or all of a row, are documents of their own
and each counts; a very long text is one slice and one row; ties for the highest count all count
as best; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm import tokens
from quillspark.llm.common import documents, id_text, staged
from quillspark.llm.lattice import frequent

#: The id pairs that every task holds: bounded, whatever the corpus.
FREQUENT = 1 << 19
#: Links of long groups that are expanded at a time.
EXPAND = 1 << 22
_DIGITS = 10


def default_tokenizers() -> tuple[str, str]:
    """Paths of the byte-level BPE and of the piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Entries:
    """The bytes of every id in one array."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(x) for x in entries], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ids) else 0)]


@lru_cache(maxsize=2)
def entries_of(byte_path: str, spaced_path: str) -> tuple[Entries, Entries]:
    return Entries(tokens.byte_entries(byte_path)), Entries(tokens.spaced_entries(spaced_path))


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component under the edges u - v.

    In a round every root hooks to its smallest neighbour and all paths are halved until they
    are flat, so each round leaves at most half of the roots that have an edge outwards.
    """
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root = flat
    return root


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (of a, of b) that share a byte; both sides cover the same bytes, and each stretch between two ends lies in one token of each."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each token of a and of b, in order."""
    u, v = overlaps(ends_a, ends_b)
    n = len(ends_a)
    root = union_find(n + len(ends_b), u, n + v)
    # The smallest node of a component is a token of a.
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number[root[:n]], number[root[n:]]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, back = np.unique(key, return_inverse=True)
    return uniq, np.bincount(back, weights=n, minlength=len(uniq)).astype(np.int64)


def _members(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct members, by group."""
    key, n = np.unique(group * width + ids, return_counts=True)
    return key // width, key % width, n


def links_of(ids_a: np.ndarray, ids_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, doc: np.ndarray, width_a: int, width_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, a * width_b + b, links) of the distinct id pairs of each document; doc has the document of each group."""
    many = (np.bincount(ga, minlength=len(doc)) > 1) | (np.bincount(gb, minlength=len(doc)) > 1)
    lone_a, lone_b = ~many[ga], ~many[gb]
    space = np.int64(width_a) * width_b
    pair = doc[ga[lone_a]] * space + ids_a[lone_a].astype(np.int64) * width_b + ids_b[lone_b]
    parts = [np.unique(pair, return_counts=True)]
    g1, a, na = _members(ga[~lone_a], ids_a[~lone_a].astype(np.int64), width_a)
    g2, b, nb = _members(gb[~lone_b], ids_b[~lone_b].astype(np.int64), width_b)
    lo, hi = np.searchsorted(g2, g1, side="left"), np.searchsorted(g2, g1, side="right")
    each = np.cumsum(hi - lo)
    i = 0
    while i < len(g1):
        j = max(i + 1, int(np.searchsorted(each, (each[i - 1] if i else 0) + EXPAND, side="right")))
        take = hi[i:j] - lo[i:j]
        x = np.repeat(np.arange(i, j), take)
        y = np.arange(len(x)) - np.repeat(np.cumsum(take) - take, take) + lo[x]
        parts.append(_summed(doc[g1[x]] * space + a[x] * width_b + b[y], na[x] * nb[y]))
        i = j
    key, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    if len(parts) > 1:
        key, n = _summed(key, n)
    return key // space, key % space, n


def _spelled(ids_a: np.ndarray, ids_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, docs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(a1,a2|b1;... of all documents, place where each of docs ends, its last separator included); docs has the groups before the end of each document."""
    na, nb = np.bincount(ga), np.bincount(gb)
    before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    n = len(ids_a) + len(ids_b)
    ids, mark = np.zeros(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
    at_a, at_b = np.arange(len(ids_a)) + before_b[ga], np.arange(len(ids_b)) + (before_a + na)[gb]
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark[at_b[before_b + nb - 1]] = ord(";")
    mark[at_a[before_a + na - 1]] = ord("|")
    size = np.ones(n, dtype=np.int64)
    for k in range(1, _DIGITS):
        size += ids >= 10**k
    ends = np.cumsum(size + 1)
    out = np.zeros(int(ends[-1]) if n else 0, dtype=np.uint8)
    out[ends - 1] = mark
    rest, at = ids, ends - 2
    live = np.arange(n)
    while len(live):
        out[at[live]] = 48 + rest[live] % 10
        rest, at = rest // 10, at - 1
        live = live[rest[live] > 0]
    token_ends = np.concatenate([[0], np.cumsum(na + nb)])[docs]
    return out.tobytes(), np.concatenate([[0], ends])[token_ends]


def _valid(s: tk.Slice, of: np.ndarray, ids: np.ndarray, entries: Entries) -> np.ndarray:
    """Documents whose joined tokens are their bytes."""
    total = tk.segment_sum(entries.size[ids], of)
    ok = (total == np.diff(s.offsets)) & (total > 0)
    if not ok.all():
        ids, keep = ids[np.repeat(ok, np.diff(of))], np.repeat(ok, np.diff(s.offsets))
        data = s.data[keep]
    else:
        data = s.data
    other = entries.joined(ids) != data
    if other.any():
        ends = np.cumsum(np.diff(s.offsets)[ok])
        bad = np.unique(np.searchsorted(ends, np.flatnonzero(other), side="right"))
        ok[np.flatnonzero(ok)[bad]] = False
    return ok


def aligned(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, rid, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 32 | b, distinct) and how many links each has."""
    paths = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokens.aligned_encoders(*paths)
        bytes_a, bytes_b = entries_of(*paths)
        width_a, width_b = len(bytes_a.size), len(bytes_b.size)
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                (ids_a, of_a), (ids_b, of_b) = one.slice_ids(s), two.slice_ids(s)
                ok = _valid(s, of_a, ids_a, bytes_a) & _valid(s, of_b, ids_b, bytes_b)
                ids_a, ids_b = (x[np.repeat(ok, np.diff(of))].astype(np.int64) for x, of in ((ids_a, of_a), (ids_b, of_b)))
                n_a, n_b = (np.where(ok, np.diff(of), 0) for of in (of_a, of_b))
                ga, gb = groups_of(np.cumsum(bytes_a.size[ids_a]), np.cumsum(bytes_b.size[ids_b]))
                first = np.flatnonzero(np.diff(ga, prepend=-1))
                doc = np.repeat(np.arange(s.n), n_a)[first]
                ends = np.searchsorted(doc, np.arange(s.n), side="right")
                n_groups = np.diff(ends, prepend=0)
                n_links = np.bincount(doc, weights=np.bincount(ga) * np.bincount(gb), minlength=s.n).astype(np.int64) if len(doc) else np.zeros(s.n, np.int64)
                text, cut = _spelled(ids_a, ids_b, ga, gb, ends)
                shas = [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
                where, pair, n = links_of(ids_a, ids_b, ga, gb, doc, width_a, width_b)
                of = pa.array(np.searchsorted(where, np.arange(s.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(of, pa.array(x, type=pa.int64())) for x in ((pair // width_b << 32) | pair % width_b, n)]
                kept = [batch.column(c).slice(s.first, s.n) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(shas, pa.string()), *lists], names=["doc_id", "rid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    led = F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), "text"))
    rows = id_text(docs).select("doc_id", led.alias("text"), F.monotonically_increasing_id().alias("rid"))
    return rows.mapInArrow(run, "doc_id long, rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, links array<bigint>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of the same first id has more)."""
    counts = staged(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.shiftright("pair", 32).alias("a")
    # One row for each id of the first vocabulary at most.
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    found = staged(aligned(docs, tokenizers), "aligned")
    counts = staged(pair_counts(found), "pair-best")
    top = frequent(counts, most).toPandas().sort_values("pair")
    key, n, best = top["pair"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64), top["best"].to_numpy(dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, links = batch.column(1), batch.column(2)
            of = pairs.offsets.to_numpy().astype(np.int64)
            of, pairs, links = of - of[0], pairs.flatten().to_numpy(), links.flatten().to_numpy()
            at = np.minimum(np.searchsorted(key, pairs), max(len(key) - 1, 0))
            hit = key[at] == pairs if len(key) else np.zeros(len(pairs), dtype=bool)
            sums = [tk.segment_sum(np.where(hit, x[at] * links, 0) if len(key) else np.zeros(len(pairs), np.int64), of) for x in (best, n)]
            left = pa.array(np.concatenate([[0], np.cumsum(~hit)])[of].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *(pa.ListArray.from_arrays(left, pa.array(x[~hit])) for x in (pairs, links))], names=["rid", "n_best", "count_sum", "pairs", "links"])

    first = staged(found.select("rid", "pairs", "links").mapInArrow(run, "rid long, n_best long, count_sum long, pairs array<bigint>, links array<bigint>"), "aligned-frequent")
    rare = first.select("rid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.links").alias("k"))
    rare = rare.join(counts, "pair").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("best_2"), F.sum(F.col("k") * F.col("n")).alias("sum_2"))
    sums = first.select("rid", "n_best", "count_sum").join(rare, "rid", "left")
    sums = sums.select("rid", (F.col("n_best") + F.coalesce("best_2", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_2", F.lit(0))).alias("count_sum"))
    return found.drop("pairs", "links").join(sums, "rid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
