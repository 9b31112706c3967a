"""Operator 5, best-fit packing with swap-based local search.

Documents become ids plus an end id; longer ones than a sequence are cut into full pieces
and a rest.  Full pieces are sequences of their own.  Rests are dealt by a hash of doc_id
into groups of about GROUP pieces, so that no task holds more than its groups.  A group is
packed by best fit in decreasing order of length and then improved: underfull bins exchange
one piece for one, two for one, or pass a piece on, whenever that raises the sum of squared
fills, until no exchange is left.

Defined cases: null text counts as empty (one piece that holds the end id); a null doc_id
is a document like any other; rows that repeat a doc_id are packed each on its own; an
empty table gives no rows; extra columns are ignored; ties are broken by doc_id; a very long
text is encoded whole and gives a full sequence for every `length` ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, id_text, staged
from quillspark.llm.tokens import default_tokenizer, encoder_of

LENGTH = 2048
END = 0
#: Pieces of a group; a group's loss to its last bin falls with the size.
GROUP = 4096
#: Stands for no bin.
_NONE = 1 << 40


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, rid of every piece; each text is encoded once, whole."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for first, ids, of in encoder.encode(batch.column(1)):
                for i in range(len(of) - 1):
                    own = np.append(ids[of[i] : of[i + 1]], np.uint32(end)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), length)):
                        part = own[a : a + length]
                        row.append(first + i)
                        piece.append(k)
                        start.append(a)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
            at = pa.array(row, type=pa.int64())
            columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "piece", "start", "length", "ids_crc32"])

    rows = id_text(docs).withColumn("rid", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "doc_id long, rid long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one group during the local search."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        room: list[tuple[int, int]] = []
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            s = self.sizes[i]
            at = bisect_left(room, (s, -1))
            if at < len(room):
                left, b = room.pop(at)
                self.items[b].append(i)
                self.fill[b] += s
            else:
                b, left = len(self.items), self.capacity
                self.items.append([i])
                self.fill.append(s)
            insort(room, (left - s, b))

    def improve(self) -> None:
        """Local search on the sum of squared fills: the emptiest bins give, fuller ones gain, until a round changes nothing.

        Every exchange raises the sum, so the rounds end.
        """
        # For each length, how many pieces of it each bin holds, and the fill of the emptiest of these bins less the length.
        self.holders: list[dict[int, list[int]]] = [{} for _ in range(self.capacity + 1)]
        self.low = np.full(self.capacity + 1, _NONE, dtype=np.int64)
        for b in range(len(self.items)):
            self._enter(b)
        changed = True
        while changed:
            changed = False
            for b in sorted((b for b in range(len(self.items)) if self.items[b] and self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], -b)):
                if self.items[b]:
                    self._leave(b)
                    changed |= self._gain(b)
                    self._enter(b)

    def _enter(self, b: int) -> None:
        """The pieces of b are on offer."""
        for i in self.items[b]:
            s = self.sizes[i]
            self.holders[s].setdefault(b, []).append(i)
            self.low[s] = min(self.low[s], self.fill[b] - s)

    def _leave(self, b: int) -> None:
        for s in {self.sizes[i] for i in self.items[b]}:
            del self.holders[s][b]
            self.low[s] = min((self.fill[g] for g in self.holders[s]), default=_NONE + s) - s

    def _gain(self, b: int) -> bool:
        """Raises the fill of b, whose pieces are not on offer, as far as moves and swaps with emptier bins allow; says whether any was made."""
        any_ = False
        while (free := self.capacity - self.fill[b]) > 0:
            # Move: the longest piece of an emptier bin that fits.
            best = self._partner(free, 0, 0, self.fill[b])
            if best:
                self._swap(b, best, [])
                any_ = True
                continue
            # One for one and two for one: x, or x and z, of b for a longer y, y - x - z <= free, the closest fit first.
            own: dict[int, list[int]] = {}
            for i in self.items[b]:
                own.setdefault(self.sizes[i], []).append(i)
            lengths = sorted(own)
            gives = {s: [own[s][0]] for s in lengths}
            for p, s in enumerate(lengths):
                for t in lengths[p:]:
                    if s + t < self.capacity and (s < t or len(own[s]) > 1):
                        gives.setdefault(s + t, [own[s][0], own[t][-1]])
            gain, swap = 0, None
            for back, out in gives.items():
                y = self._partner(free + back, back + gain, back, self.fill[b])
                if y:
                    gain, swap = y - back, (y, out)
            if swap is None:
                break
            self._swap(b, *swap)
            any_ = True
        return any_

    def _partner(self, most: int, over: int, back: int, fill: int) -> int:
        """The longest length of at most `most` and over `over` in a bin whose exchange with one filled so far raises the squares; 0 if there is none."""
        # (f_b + d)^2 + (f_g - d)^2 grows if f_b + d > f_g, with d = y - back.
        hit = np.flatnonzero(self.low[over + 1 : most + 1] < fill - back)
        return over + 1 + int(hit[-1]) if len(hit) else 0

    def _swap(self, b: int, size: int, out: list[int]) -> None:
        """A piece of this length from the emptiest bin that holds one goes to b, and out goes there."""
        g = min(self.holders[size], key=lambda g: (self.fill[g], g))
        y = self.holders[size][g][0]
        self._leave(g)
        for i, a, to in [(y, g, b), *((x, b, g) for x in out)]:
            self.items[a].remove(i)
            self.items[to].append(i)
            self.fill[a] -= self.sizes[i]
            self.fill[to] += self.sizes[i]
        self._enter(g)


def pack_group(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Items of each bin."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.improve()
    return [b for b in bins.items if b]


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    cut = staged(pieces(docs, tokenizer, length, end), "pack-pieces")
    full, rest = cut.where(F.col("length") == length), cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    # Whole sequences: 2 x the number of their row in the staged table; packed ones: odd, group and bin.
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "rid"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf["group"].iloc[0]) << 32
        for k, items in enumerate(pack_group(sizes, length)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (base + k) * 2 + 1, at
                at += sizes[i]
        return pdf.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.unionByName(packed)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
