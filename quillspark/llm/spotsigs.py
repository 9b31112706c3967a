"""Operator 11, document fingerprints by spot signatures.

Every common word of a text (an anchor), and the text's beginning, is followed by a chain of the
next CHAIN content words; anchor and chain make a signature.  The set of a text's signatures,
32 bits each, is its fingerprint.  Two fingerprints are as like as the Jaccard index of their
sets.  Sets are partitioned by their size so that sets which reach a threshold stand in the same
partition or in neighbours; what is compared is first held to the bound that the two sizes
give, and members are looked at only where the bound leaves the threshold open.

near_groups() does the whole join: texts with equal fingerprints are one node; each node goes
to the buckets (partition, signature) of its rarest signatures, so many that two sets which reach
the threshold share one.  How rare a signature is comes from COUNTERS counters over all nodes.
Buckets are first compared with one member, then what is still apart in blocks of BLOCK
members, on full sets and inside the tasks; only links leave them.  A bucket of very many near
copies is so reduced to its components and never yields all its pairs.

Words are runs of ASCII letters and digits and of bytes above 127, in lower case.  A text with
words but without signatures (common words only) has one made of its whole bytes, and so has a
text without words that isn't empty.  Two empty fingerprints are alike (1), an empty and another are not (0).

Defined cases: null text counts as empty and has an empty fingerprint; a null doc_id comes after
all others in the order of documents; rows that repeat a doc_id stand in the order of a hash of
their texts, and of rows equal in both each is the next of the one before; a single
row is its own next document; a very long text is fingerprinted whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.common import documents, id_text, partitions, settled, staged
from quillspark.llm.exact_dedup import join_back
from quillspark.llm.graph import components

# The common words of four languages.
ENGLISH = "the of and to a in is that it for was on with as be by this are at from".split()
SPANISH = "de la que el en y los se del las un por con no su una para es al lo".split()
FRENCH = "de la le et les des en un du une que pour est par qui dans avec sur pas au".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split()
ANCHORS = tuple(sorted({*ENGLISH, *SPANISH, *FRENCH, *GERMAN}))
CHAIN = 3
PERCENT = 80
#: Counters of how many sets hold a signature; signatures share them by their remainder.
COUNTERS = 1 << 18
#: Members of a bucket that are compared at a time.
BLOCK = 512
#: Parts of the order of documents for each shuffle partition.
PARTS = 4

_U = np.uint64
_PLACE = tk.mix(np.arange(1, 65, dtype=_U) * _U(0x8CB92BA72F3D8DD7)) | _U(1)
_START = _U(0x5851F42D4C957F2D)
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Spotter:
    """Sorted sets of signatures of whole texts."""

    def __init__(self, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> None:
        self.anchors = np.sort(np.array([tk.hash_bytes(a.encode()) for a in anchors], dtype=_U))
        self.chain = chain

    def sets(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(signatures of all documents, ascending and distinct in each; offsets)."""
        low = tk.LOWER[s.data]
        w = tk.bounds(_WORD[low], s.offsets)
        sums = tk.prefix(low)
        h = tk.range_hash(sums, w.starts, w.ends)
        at = np.minimum(np.searchsorted(self.anchors, h), max(len(self.anchors) - 1, 0))
        common = self.anchors[at] == h if len(self.anchors) else np.zeros(len(h), dtype=bool)
        content = np.flatnonzero(~common)
        of = np.searchsorted(content, w.of)
        anchor = np.flatnonzero(common)
        doc = np.searchsorted(w.of, anchor, side="right") - 1
        # The beginnings of the texts, then the anchors; each with the place of the next content word.
        doc = np.concatenate([np.arange(s.n), doc])
        place = np.concatenate([of[:-1], np.searchsorted(content, anchor)])
        sig = np.concatenate([np.full(s.n, _START), h[anchor]]) * _PLACE[0]
        chained = place < of[doc + 1]
        doc, place, sig = doc[chained], place[chained], sig[chained]
        words = np.append(h[content], _U(0))
        for k in range(self.chain):
            inside = place + k < of[doc + 1]
            sig = sig + np.where(inside, words[np.minimum(place + k, len(content))] * _PLACE[k + 1], _U(0))
        sig = (tk.mix(sig) >> _U(32)).astype(np.int64)
        bare = np.flatnonzero((np.bincount(doc, minlength=s.n) == 0) & (np.diff(s.offsets) > 0))
        whole = tk.range_hash(tk.prefix(s.data), s.offsets[bare], s.offsets[bare + 1]) >> _U(32)
        key = np.unique(np.concatenate([doc << 32 | sig, bare << 32 | whole.astype(np.int64)]))
        return (key & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(key >> 32, np.arange(s.n + 1))

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, ends = [], [np.zeros(1, dtype=np.int64)]
        for s in tk.slices(pa.array(texts, pa.large_string())):
            x, of = self.sets(s)
            found.append(x)
            ends.append(of[1:] + ends[-1][-1])
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.concatenate(ends)


def spelled(x: np.ndarray, of: np.ndarray) -> list[str]:
    """Eight hexadecimal digits for each signature, ascending."""
    raw = x.astype(">u4").tobytes().hex()
    return [raw[8 * a : 8 * b] for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def size_part(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Partition of a set by its size: if two sets reach the threshold, they are in one partition or the larger one is in the next."""
    most, edges = int(n.max()) if len(n) else 0, [1]
    while edges[-1] <= most:
        # The first size that a set of the partition's first size can't reach.
        edges.append(edges[-1] * 100 // percent + 1)
    return np.searchsorted(np.array(edges), n, side="right")


def reaches(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members, of which so many are common, have a Jaccard index of the threshold or more."""
    return 100 * common >= percent * (n + m - common)


def likeness(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray, percent: int = 0) -> np.ndarray:
    """Jaccard index of set i of x and set i of y; 0 where it is below the threshold.

    Pairs whose sizes can't reach the threshold are settled by that bound alone.
    """
    n, m = np.diff(xo), np.diff(yo)
    out = np.where((n == 0) & (m == 0), 1.0, 0.0)
    open_ = (np.minimum(n, m) > 0) & reaches(np.minimum(n, m), n, m, percent)
    if open_.any():
        rows = np.arange(len(n), dtype=np.int64)
        a, b = ((np.repeat(rows, k) << 32 | v)[np.repeat(open_, k)] for k, v in ((n, x.astype(np.int64)), (m, y.astype(np.int64))))
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = np.bincount(a[b[at] == a] >> 32, minlength=len(n))
        out[open_] = np.where(reaches(common, n, m, percent), common / (n + m - common), 0.0)[open_]
    return out


class DocumentOrder:
    """Parts of the ascending order of (doc_id, hash of the text), so that each part is one stretch of it.

    An id with many rows takes several parts, by hash.
    """

    def __init__(self, rows: DataFrame, parts: int) -> None:
        shares = [i / parts for i in range(1, parts)]
        found = rows.agg(F.percentile_approx("key", shares, 10 * max(parts, 1000)).alias("p")).first()["p"] if shares else None
        self.bounds = np.array(found or [], dtype=np.int64)
        self.heads: dict[int, tuple[int, int]] = {}
        part = self.places()
        found = rows.select("key", "h", F.get(part("key", "h"), F.lit(0)).alias("part")).groupBy("part").agg(F.min(F.struct("key", "h")).alias("head")).collect()
        self.heads = {r["part"]: (r["head"]["key"], r["head"]["h"]) for r in found}

    def part(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.bounds, key, side="left"), np.searchsorted(self.bounds, key, side="right")
        times = hi - lo
        share = h.astype(np.float64) / 2.0**64 + 0.5
        return np.where(times > 1, lo + 1 + np.minimum((share * times).astype(np.int64), times - 1), hi)

    def places(self):
        """Column function: the part of a row, and for the first row of a part also the part before, where it is the next document of the last row."""
        order = sorted(self.heads)
        first = {self.heads[p]: order[i - 1] for i, p in enumerate(order)}
        keys = np.array(sorted({k for k, _ in first}), dtype=np.int64)
        part = self.part

        @F.pandas_udf("array<int>")
        def places(key: pd.Series, h: pd.Series) -> pd.Series:
            key, h = key.to_numpy(), h.to_numpy()
            own = part(key, h).tolist()
            out = [[p] for p in own]
            for i in np.flatnonzero(np.isin(key, keys)).tolist():
                before = first.get((int(key[i]), int(h[i])))
                if before is not None:
                    out[i].append(before)
            return pd.Series(out)

        return places


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, tail: each part in ascending order of documents within one task, then (tail) the document after it; the first follows the last."""
    spark = docs.sparkSession
    rows = id_text(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), F.xxhash64("text").alias("h"))
    order = DocumentOrder(rows, PARTS * partitions(spark))
    dealt = rows.select("doc_id", "text", "key", "h", F.posexplode(order.places()("key", "h")).alias("tail", "part"))
    return dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "tail", "key", "h").select("doc_id", "text", "part", "tail")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """Consecutive documents, at most about a slice of them; the last of a stretch is the first of the next one, or follows its part."""
    held: list[tuple[int | None, str]] = []
    part, size, ended = None, 0, False
    for batch in batches:
        for i, text, own, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != part:
                if len(held) > 1:
                    yield held
                part, held, size, ended = own, [], 0, False
            if ended:
                # One row after the part is enough.
                continue
            held.append((i, text))
            size += len(text)
            ended = bool(tail)
            if len(held) > 1 and size >= tk.SLICE_BYTES:
                yield held
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield held


def fingerprints(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, n_spots, fingerprint of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(anchors, chain)
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                x, of = spotter.sets(s)
                kept = [batch.column(c).slice(s.first, s.n) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(of)), pa.array(spelled(x, of), pa.string())], names=["doc_id", "n_chars", "n_spots", "fingerprint"])

    return id_text(docs).select("doc_id", "text", F.length("text").cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, n_chars long, n_spots long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next document."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def compared(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Each row of docs with its edited text's digest, both fingerprints, and the likeness to the edited text and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(anchors, chain)
        for rows in _stretches(batches):
            texts = [t for _, t in rows]
            other = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            x, xo = spotter.of_texts(texts)
            y, yo = spotter.of_texts(other)
            own = x[: xo[-2]], xo[:-1]
            near, after = likeness(*own, y, yo), likeness(*own, x[xo[1] :], xo[1:] - xo[1])
            columns = [
                pa.array([i for i, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other]),
                pa.array(spelled(*own), pa.string()),
                pa.array(spelled(y, yo), pa.string()),
                pa.array(near, pa.float64()),
                pa.array(after, pa.float64()),
                pa.array(np.diff(own[1]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long")


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(members, offsets) of a column of sets, each the bytes of its ascending signatures."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<u4"), np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)


def counters(sets: DataFrame) -> np.ndarray:
    """In how many sets a signature of each remainder occurs: COUNTERS numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_arrays(batch.column(0))[0] % COUNTERS, minlength=COUNTERS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["slot", "n"])

    found = sets.select("spots").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["slot"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def buckets(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """node, size, bucket, own: the buckets of each set's rarest signatures, in its partition (own) and in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, of = _arrays(batch.column(1))
            n = np.diff(of)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((x, counts[x % COUNTERS], doc))
            x, rank = x[order], np.arange(len(x)) - of[doc]
            # A set that shares none of these has too few others left.
            rare = rank < n[doc] - (-(-percent * n // 100))[doc] + 1
            part = size_part(n, percent)[doc[rare]]
            bucket = np.stack([part << 32 | x[rare], part + 1 << 32 | x[rare]], axis=1).reshape(-1)
            node, size = (np.repeat(v[doc[rare]], 2) for v in (batch.column(0).to_numpy(), n))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(size), pa.array(bucket), pa.array(np.arange(len(bucket)) % 2 == 0)], names=["node", "size", "bucket", "own"])

    return sets.select("node", "spots").mapInArrow(run, "node long, size long, bucket long, own boolean")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs u, v whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = pa.array(np.flatnonzero(likeness(*_arrays(batch.column(2)), *_arrays(batch.column(3)), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(met), batch.column(1).take(met)], names=["u", "v"])

    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("spots").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("spots").alias("b")), "v")
    return two.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _compare(node: np.ndarray, label: np.ndarray, own: np.ndarray, block: np.ndarray, x: np.ndarray, of: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of one group of a bucket between members of different labels: of the two blocks, or within the one."""
    n, out = np.diff(of), []
    member = np.repeat(np.arange(len(node)), n)
    order = np.argsort(x, kind="stable")
    posting, sorted_x = member[order], x[order]
    lo, hi = np.searchsorted(sorted_x, x, side="left"), np.searchsorted(sorted_x, x, side="right")
    kinds, times = np.unique(label, return_counts=True)
    two = len(np.unique(block)) > 1
    # Every pair of different labels has a member without the commonest label.
    for i in np.flatnonzero(label != kinds[np.argmax(times)]).tolist():
        take = np.concatenate([posting[a:b] for a, b in zip(lo[of[i] : of[i + 1]].tolist(), hi[of[i] : of[i + 1]].tolist(), strict=True)])
        common = np.bincount(take, minlength=len(node))
        met = reaches(common, n[i], n, percent) & (label != label[i]) & (own | own[i])
        if two:
            met &= block != block[i]
        out += [(max(node[i], node[j]), min(node[i], node[j])) for j in np.flatnonzero(met).tolist()]
    return out


def _blockwise(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: the links between members (bucket, own, node, label, n: of the bucket) of one bucket with different labels."""
    spark = members.sparkSession
    rows = members.withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("node", "label", "own", "bucket", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")).join(sets.select("node", "spots"), "node")
    rows = rows.repartition(partitions(spark), "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(t: pa.Table) -> pa.RecordBatch:
            col = {c: t.column(c).to_numpy() for c in ("node", "label", "own", "block", "bucket", "b1", "b2")}
            x, of = _arrays(t.column("spots"))
            edge = np.flatnonzero((np.diff(col["bucket"]) != 0) | (np.diff(col["b1"]) != 0) | (np.diff(col["b2"]) != 0)) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), t.num_rows], strict=True):
                g = slice(a, b)
                found += _compare(col["node"][g], col["label"][g], col["own"][g], col["block"][g], x[of[a] : of[b]], of[a : b + 1] - of[a], percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            # The last group may go on in the next batch.
            key = np.stack([t.column(c).to_numpy() for c in ("bucket", "b1", "b2")])
            cut = int(np.argmax((key == key[:, -1:]).all(axis=0)))
            if cut:
                yield links(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    return rows.select("node", "label", "own", "block", "bucket", "b1", "b2", "spots").mapInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_spots, group_id (the smallest doc_id that links reach, itself included) for each row of docs.

    Links are pairs of fingerprints whose Jaccard index is the threshold or more; an empty
    fingerprint links with nothing.  A null doc_id names a group only if all its documents have none.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(anchors, chain)
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                x, of = spotter.sets(s)
                kept = [batch.column(c).slice(s.first, s.n) for c in (0, 2)]
                spots = [x[a:b].astype("<u4").tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(of)), pa.array(spots, pa.binary())], names=["doc_id", "rid", "n_spots", "spots"])

    found = id_text(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).mapInArrow(run, "doc_id long, rid long, n_spots long, spots binary")
    rows = staged(found.withColumn("digest", F.when(F.col("n_spots") > 0, F.unhex(F.sha2("spots", 256)))), "spots")
    full = rows.where(F.col("digest").isNotNull())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least")
    classes = staged(full.groupBy("digest").agg(F.min("rid").alias("node"), least, F.count(F.lit(1)).alias("group_size")), "spot-classes")
    sets = staged(full.select(F.col("rid").alias("node"), "spots").join(classes.select("node"), "node", "left_semi"), "spot-sets")

    def grouped() -> DataFrame:
        all_ = staged(buckets(sets, counters(sets), percent), "spot-buckets")
        marks = [F.bit_xor(F.xxhash64("node", "own", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
        shared = all_.groupBy("bucket").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("n"), *marks).where("n > 1 AND hub IS NOT NULL")
        # Buckets with the same members are one.
        once = staged(shared.groupBy("hub", "n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "hub", "n"), "spot-shared")
        members = staged(join_back(all_, once, all_.count(), "bucket", "n"), "spot-members")
        stars = members.where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        labels = staged(components(staged(_verified(stars, sets, percent), "spot-links")), "spot-labels")
        named = members.select("bucket", "own", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = staged(named, "spot-named")
        apart = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "n")
        open_ = staged(join_back(named, apart, named.count(), "bucket", "n"), "spot-open")
        more = staged(_blockwise(open_, sets, percent), "spot-links")
        return components(more.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    labels = settled(spark, "spot-labels", grouped)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("least")).select("label", F.col("least.doc_id").alias("group_id"))
    groups = staged(named.select("digest", "label", "group_size").join(names, "label").select("digest", "group_size", "group_id"), "spot-groups")
    out = join_back(full.select("doc_id", "n_spots", "digest"), groups, rows.count()).select("doc_id", "n_spots", "group_id")
    return out.unionByName(rows.where(F.col("digest").isNull()).select("doc_id", "n_spots", F.col("doc_id").alias("group_id")))


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
