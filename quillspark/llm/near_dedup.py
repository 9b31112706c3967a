"""Operator 9, MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes the set of hashes of its word shingles and a signature of PERMS
   minima.  Texts with equal sets form a class at once, so exact copies cost one row.
2. Signatures are cut into bands; classes that share a band are candidates.  The bands
   (32 of 4 rows) miss a pair at similarity 0.8 with a chance below 1e-7.
3. Candidates are verified: signatures are compared 32 at a time and a pair is dropped as
   soon as the posterior chance of reaching the threshold (uniform prior) falls below MISS;
   survivors are verified exactly on the full sets.
4. Within a bucket only stars are compared first: each member with the smallest one and with
   one drawn by hash.  Buckets with the same members count once.  What is then left in one
   bucket but in different components is compared in blocks of BLOCK members, inside the
   tasks, on longer signatures (LONG_PERMS hashes of one byte); only pairs whose posterior
   stays above MISS leave a task, once each, and are verified exactly.  A bucket of over REFINE
   blocks (a passage that very many texts share) is first cut into buckets of the longer
   signatures' bands (128 of 8 hashes, which miss a pair at similarity 0.8 with a chance below
   1e-10), so its members are copied 128 times, however many they are.  So no link between
   components is lost, and a bucket of very many near copies never yields all its pairs.
   Members of hot bands are joined with them by a broadcast of at most HEAVY keys, never in one task.

Defined cases: null text counts as empty; a text without words has an empty set and links
with nothing; fewer words than a shingle make one shingle of all words; a null doc_id is
never a component's name unless all its documents have none; rows that repeat a doc_id
are documents of their own, and exactly one row of a group is kept; a very long text has one set
of all its shingles; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.common import documents, id_text, partitions, settled, staged
from quillspark.llm.exact_dedup import join_back, keep_rows, text_digest
from quillspark.llm.graph import components

SHINGLE = 5
PERCENT = 80
PERMS = 128
ROWS = 4
BANDS = PERMS // ROWS
BATCH = 32
#: Chance at which verification may give up a true link.
MISS = 1e-6
#: The longer signatures of the last step, one byte a hash, and how many are compared at a time.
LONG_PERMS = 1024
LONG_BATCH = 64
BLOCK = 1024
#: Blocks of a bucket beyond which it is cut by bands of LONG_ROWS hashes of the longer signatures.
REFINE = 64
LONG_ROWS = 8

_U = np.uint64
_SEEDS = tk.mix(np.arange(1, PERMS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_LONG_SEEDS = tk.mix(np.arange(1, LONG_PERMS + 1, dtype=_U) * _U(0xE7037ED1A0B428DB)) | _U(1)
_PLACE = tk.mix(np.arange(1, 65, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


def shingle_sets(s: tk.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, offsets)."""
    w = tk.words(s)
    h = tk.range_hash(tk.prefix(tk.LOWER[s.data]), w.starts, w.ends)
    count = w.counts
    last = np.repeat(w.of[1:], count)
    place = np.arange(len(h))
    acc = np.zeros(len(h), dtype=_U)
    # A slice may hold fewer words than a shingle.
    for k in range(min(n, len(h))):
        inside = place[: len(h) - k] + k < last[: len(h) - k] if k else slice(None)
        if k:
            acc[: len(h) - k] += np.where(inside, h[k:] * _PLACE[k], _U(0))
        else:
            acc += h * _PLACE[0]
    first = np.repeat(w.of[:-1], count)
    valid = (place + n <= last) | ((place == first) & (last - first < n))
    acc, doc = tk.mix(acc[valid]), np.repeat(np.arange(s.n), count)[valid]
    bounds = np.searchsorted(doc, np.arange(s.n + 1))
    parts = [np.unique(acc[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    of = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else acc), of


def set_digests(x: np.ndarray, of: np.ndarray) -> list[bytes]:
    """16 bytes for each set; equal sets, equal bytes."""
    a, b = tk.segment_sum(x, of), tk.segment_sum(tk.mix(x ^ _U(0xA0761D6478BD642F)), of)
    return [y.tobytes() for y in np.stack([a, b], axis=1)]


def signatures(x: np.ndarray, of: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """uint32 (documents, PERMS); empty sets are all ones."""
    out = np.full((len(of) - 1, PERMS), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(of))
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(of[full], of[full[i]] + chunk)))
        rows = full[i:j]
        lo, part = of[rows[0]], x[of[rows[0]] : of[rows[-1] + 1]]
        starts = of[rows] - lo
        for k in range(PERMS):
            out[rows, k] = np.minimum.reduceat((part * _SEEDS[k]) >> _U(32), starts)
        i = j
    return out


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, rid, sha (of the whole text), digest (of the set; null for an empty one), n_shingles, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                x, of = shingle_sets(s, n)
                size = np.diff(of)
                sig = signatures(x, of)
                none = size == 0
                digest = [None if e else d for d, e in zip(set_digests(x, of), none.tolist(), strict=True)]
                raw = [None if e else r.tobytes() for r, e in zip(sig, none.tolist(), strict=True)]
                kept = [batch.column(c).slice(s.first, s.n) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "rid", "sha", "digest", "n_shingles", "sig"])

    rows = id_text(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("rid"), text_digest(F.col("text")).alias("sha"))
    return rows.mapInArrow(run, "doc_id long, rid long, sha binary, digest binary, n_shingles long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """digest, shingles (array) of the documents whose doc_id is in wanted; each digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                x, of = shingle_sets(s, n)
                lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(x, of), pa.binary()), lists], names=["digest", "shingles"])

    ids = wanted.select(F.col("doc_id").alias("__id")).distinct()
    d = id_text(docs)
    return d.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").mapInArrow(run, "digest binary, shingles array<bigint>").where(F.size("shingles") > 0).dropDuplicates(["digest"])


def long_signatures(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """digest, keys (32 bits for each band), long (LONG_PERMS bytes) of the documents whose doc_id is in wanted; each digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                x, of = shingle_sets(s, n)
                full = np.flatnonzero(np.diff(of))
                out = np.zeros((len(full), LONG_PERMS), dtype=np.uint8)
                for i, d in enumerate(full.tolist()):
                    own = x[of[d] : of[d + 1]]
                    # Few hashes at a time for a very long text.
                    step = 64 if len(own) < 1 << 14 else 1
                    for k in range(0, LONG_PERMS, step):
                        least = (own[:, None] * _LONG_SEEDS[k : k + step]).min(axis=0)
                        out[i, k : k + step] = tk.mix(least) & _U(255)
                digest = set_digests(x, of)
                # Equal keys mean a shared band.
                bands = (tk.mix((signatures(x, of)[full].reshape(-1, BANDS, ROWS).astype(_U) * _LONG_SEEDS[:ROWS]).sum(axis=2)) >> _U(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in full], pa.binary()), pa.array([r.tobytes() for r in bands], pa.binary()), pa.array([r.tobytes() for r in out], pa.binary())], names=["digest", "keys", "long"])

    ids = wanted.select(F.col("doc_id").alias("__id")).distinct()
    d = id_text(docs)
    return d.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").mapInArrow(run, "digest binary, keys binary, long binary").dropDuplicates(["digest"])


def least_matches(percent: float = PERCENT, miss: float = MISS, perms: int = PERMS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, matches below which the chance of similarity >= threshold is under miss).

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and its
    mass above t equals the chance that n + 1 trials at t give at most m.
    """
    t, out = percent / 100, []
    for n in range(batch, perms + 1, batch):
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs u, v that no batch of signatures rules out."""
    table = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(k, PERMS) for c in (2, 3))
            live, got, done = np.arange(k), np.zeros(k, dtype=np.int64), 0
            for n, least in table:
                got = got + (a[live, done:n] == b[live, done:n]).sum(axis=1)
                keep = got >= least
                live, got, done = live[keep], got[keep], n
            at = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    one = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u")
    two = one.join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v")
    return two.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def linked(live: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v: nodes) whose full sets reach the threshold; staged."""
    live = staged(live, "near-plausible")
    met = live.select(F.col("u").alias("node")).unionByName(live.select(F.col("v").alias("node"))).distinct()
    wanted = staged(nodes.select("node", "doc_id", "digest").join(met, "node", "left_semi"), "near-wanted")
    sets = full_sets(docs, wanted, n).join(wanted.select("node", "digest"), "digest").select("node", "shingles")
    sets = staged(sets, "near-sets")
    both = live.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b")).cast("long")
    return staged(both.where(100 * common >= percent * (F.size("a").cast("long") + F.size("b").cast("long") - common)).select("u", "v"), "near-links")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with the number of blocks k of their bucket."""
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")
    open_ = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks, F.count(F.lit(1)).alias("n")).where("lo <> hi").select("band", "k", "n")
    return join_back(members, open_, members.count(), "band", "n").drop("n")


def _refined(members: DataFrame, long: DataFrame) -> DataFrame:
    """Members of large buckets in smaller ones, by bands of their longer signatures; a pair may share several."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(LONG_PERMS // LONG_ROWS - 1)), lambda i: F.xxhash64("band", i, F.substring(F.col("long"), i * LONG_ROWS + 1, F.lit(LONG_ROWS))))
    rows = members.join(long.select("node", "long"), "node").select("slot", "node", "label", F.explode(slots).alias("band"))
    return _mixed(staged(rows, "near-refined"))


def _compare(nodes: np.ndarray, labels: np.ndarray, keys: np.ndarray, long: np.ndarray, block: np.ndarray, slot: int, table: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of one group whose posterior stays up: of different components, of the two blocks (or the one), and met in no earlier band."""
    out = []
    two = len(np.unique(block)) > 1
    for i in range(len(nodes) - 1):
        j = i + 1 + np.flatnonzero((labels[i + 1 :] != labels[i]) & ((block[i + 1 :] != block[i]) if two else True))
        if slot and len(j):
            j = j[~(keys[j, :slot] == keys[i, :slot]).any(axis=1)]
        got, done = np.zeros(len(j), dtype=np.int64), 0
        for n, least in table:
            if not len(j):
                break
            got = got + (long[j, done:n] == long[i, done:n]).sum(axis=1)
            keep = got >= least
            j, got, done = j[keep], got[keep], n
        out += [(max(nodes[i], nodes[k]), min(nodes[i], nodes[k])) for k in j.tolist()]
    return out


def blockwise(members: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, miss: float) -> DataFrame:
    """u, v: the pairs of members (band, slot, node, label, k) in one bucket but different components that long signatures can't rule out."""
    spark, columns = members.sparkSession, ["band", "slot", "node", "label", "k"]
    met = members.select("node").distinct()
    wanted = staged(nodes.select("node", "doc_id", "digest").join(met, "node", "left_semi"), "near-open")
    long = long_signatures(docs, wanted, n).join(wanted.select("node", "digest"), "digest").select("node", "keys", "long")
    long = staged(long, "near-long")
    large = members.where(F.col("k") > REFINE)
    if not large.isEmpty():
        members = members.where(F.col("k") <= REFINE).select(*columns).unionByName(staged(_refined(large, long), "near-refined").select(*columns))
    rows = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")).cast("int"))
    # Each member goes to the groups (block, other) of its bucket, the smaller block first.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("node", "label", "band", "slot", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")).join(long, "node")
    rows = rows.repartition(partitions(spark), "band", "b1", "b2").sortWithinPartitions("band", "b1", "b2", "node")
    # One byte matches by chance in 1 of 256 cases.
    table = least_matches(percent + (100 - percent) / 256, miss, LONG_PERMS, LONG_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            col = {c: t.column(c).to_numpy() for c in ("node", "label", "band", "slot", "block", "b1", "b2")}
            keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), dtype=np.uint32).reshape(-1, BANDS)
            long = np.frombuffer(b"".join(t.column("long").to_pylist()), dtype=np.uint8).reshape(-1, LONG_PERMS)
            edge = np.flatnonzero((np.diff(col["band"]) != 0) | (np.diff(col["b1"]) != 0) | (np.diff(col["b2"]) != 0)) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), t.num_rows], strict=True):
                if b - a > 1:
                    g = slice(a, b)
                    found += _compare(col["node"][g], col["label"][g], keys[g], long[g], col["block"][g], int(col["slot"][a]), table)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            # The last group may go on in the next batch.
            key = np.stack([t.column(c).to_numpy() for c in ("band", "b1", "b2")])
            same = (key == key[:, -1:]).all(axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield pairs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held)

    return rows.select("node", "label", "band", "slot", "block", "b1", "b2", "keys", "long").mapInArrow(run, "u long, v long").distinct()


def near_classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(rows with digest and n_shingles, groups with digest, group_size, component_id and keep_rid, the row that stays)."""
    rows = staged(signed(docs, n), "near-signed")
    # A null doc_id comes last; of rows that share one, the first row stays.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    classes = staged(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("rid").alias("node"), least_row.alias("least"), F.count(F.lit(1)).alias("group_size")), "near-classes")
    heads = rows.where(F.col("digest").isNotNull()).select(F.col("rid").alias("node"), "doc_id", "digest", "sig")
    nodes = staged(heads.join(classes.select("node"), "node", "left_semi"), "near-nodes")

    slots = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS * 4 + 1, F.lit(ROWS * 4))))
    bands = nodes.select("node", F.posexplode(slots).alias("slot", "band"))
    # Buckets with the same members are one: the one of the first band is kept, since pairs are compared in the first band they share.
    shared = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("slot"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("x2")).where("n > 1")
    once = staged(shared.groupBy("hub", "n", "x1", "x2").agg(F.min(F.struct("slot", "band")).alias("s")).select("s.band", "hub", "n"), "near-shared")
    members = staged(bands.join(once.select("band", "hub"), "band"), "near-members")

    drawn = members.groupBy("band").agg(F.max(F.struct(F.xxhash64("node", "band"), "node")).alias("d"), F.count(F.lit(1)).alias("n")).select("band", F.col("d.node").alias("hub"), "n")
    stars = members.select("node", "hub").unionByName(join_back(members.select("band", "node"), drawn, members.count(), "band", "n").select("node", "hub"))
    stars = stars.where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    spark = docs.sparkSession
    labels = settled(spark, "near-labels", lambda: components(linked(plausible(stars, nodes, percent, miss), nodes, docs, n, percent)))
    mixed = staged(_mixed(_labelled(members.select("band", "slot", "node"), labels)), "near-mixed")
    if not mixed.isEmpty():
        first = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
        labels = settled(spark, "near-labels", lambda: components(linked(blockwise(mixed, nodes, docs, n, percent, miss), nodes, docs, n, percent).unionByName(first)))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("least")).select("label", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep_rid"))
    groups = staged(named.select("digest", "label", "group_size").join(least, "label").select("digest", "group_size", "component_id", "keep_rid"), "near-groups")
    return rows.select("doc_id", "rid", "sha", "digest", "n_shingles"), groups


def decided(docs: DataFrame, n: int, percent: int, miss: float) -> DataFrame:
    """doc_id, sha, n_shingles, component_id, kept for each row of docs; a group keeps exactly one row."""
    rows, groups = near_classes(docs, n, percent, miss)
    full = join_back(rows.where(F.col("digest").isNotNull()), groups, rows.count()).select("doc_id", "sha", "n_shingles", "component_id", (F.col("rid") == F.col("keep_rid")).alias("kept"))
    empty = rows.where(F.col("digest").isNull()).select("doc_id", "sha", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return full.unionByName(empty)


def near_dedup(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return decided(docs, n, percent, miss).drop("sha")


def keep_one_of_near(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of docs with one document of each group, all columns as they were.

    Rows are told apart by doc_id and the digest of their whole text, so rows that share an id,
    or have none, and hold other texts are documents of their own.  Rows without words (null and
    empty texts too) all stay, repeated or not; of other rows equal in doc_id and text at most one
    stays; an empty table gives no rows.
    """
    return keep_rows(docs, settled(docs.sparkSession, "near-decided", lambda: decided(docs, n, percent, MISS).select("doc_id", F.col("sha").alias("digest"), "kept")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), n=4)
