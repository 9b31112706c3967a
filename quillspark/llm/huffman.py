"""Operator 3, token ids under a canonical length-limited Huffman code.

Counts of ids over the whole corpus give code lengths of at most LIMIT bits (package-merge);
the canonical code follows from the lengths alone, and the codebook is a small table of
(id, length), never larger than the vocabulary.  Ids are range-partitioned by doc_id and written
as blocks that decode on their own, in ascending order of doc_id within blocks, from block to
block and from file to file.  A block holds whole documents, their lengths, and the bit offset
of every STEP-th id; the decoder looks the next LIMIT bits up in a table and advances all
checkpoints of a block at once.

File format: <path>/codebook and <path>/blocks, both Parquet.  A row of blocks has first_doc,
last_doc, block (numbers that ascend with the blocks), doc_ids, doc_tokens, n_ids, checkpoints
(64-bit little-endian) and payload.

Defined cases: null text counts as empty (only the end id); a null doc_id comes first; rows
that repeat a doc_id, or have none, stay apart, in order of their number of ids and then of where
they were read, and may lie in several partitions; a very long text is one document of one block;
an empty table gives empty files; one distinct id gets a code of one bit; extra columns are
ignored.  A tokenizer with more than 65,536 ids is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import documents, id_text, partitions, scratch, staged
from quillspark.llm.tokens import default_tokenizer, encoder_of

LIMIT = 16
STEP = 256
#: A block is closed once it holds so many ids.
BLOCK = 1 << 16
END = 2
#: Ids are held in 16 bits.
MOST_IDS = 1 << 16

_BLOCKS = "first_doc long, last_doc long, block long, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of over {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, lower = [], np.zeros(0)
    for _ in range(limit):
        packs = lower[: len(lower) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, packs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        lower = both[at]
    length, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), most significant bit first."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    per = np.bincount(lengths[order], minlength=1)
    at = 0
    for bits, n in enumerate(per.tolist()):
        if n:
            code <<= bits - last
            codes[order[at : at + n]] = code + np.arange(n)
            code, last, at = code + n, bits, at + n
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every step-th id)."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    size = total // 8 + 4
    # A code of at most 16 bits touches three bytes; the fields are disjoint, so sums are exact.
    field = codes[ids].astype(np.int64) << (24 - (at & 7) - bits)
    byte = at >> 3
    out = np.zeros(size)
    for k in range(3):
        out += np.bincount(byte + k, weights=(field >> (16 - 8 * k)) & 255, minlength=size)[:size]
    return out.astype(np.uint8)[: -(-total // 8)].tobytes(), at[::step]


class Decoder:
    """Table-driven: the next LIMIT bits give an id and its length."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT) -> None:
        codes = canonical(lengths)
        self.limit = limit
        self.symbol = np.zeros(1 << limit, dtype=np.uint32)
        self.bits = np.ones(1 << limit, dtype=np.int64)
        used = np.flatnonzero(lengths > 0)
        order = used[np.lexsort((used, lengths[used]))]
        span = 1 << (limit - lengths[order].astype(np.int64))
        lo = int(codes[order[0]]) if len(order) else 0
        total = int(span.sum())
        self.symbol[lo : lo + total] = np.repeat(order, span)
        self.bits[lo : lo + total] = np.repeat(lengths[order].astype(np.int64), span)

    def __call__(self, payload: bytes, checkpoints: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        """The n ids; all checkpoints advance together."""
        raw = np.frombuffer(payload + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
        # Three bytes from each place: 24 bits hold any window of 16 that begins in the first byte.
        three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        out = np.zeros((len(checkpoints), step), dtype=np.uint32)
        pos = checkpoints.astype(np.int64).copy()
        full = n - (len(checkpoints) - 1) * step
        mask = (1 << self.limit) - 1
        for k in range(step if len(checkpoints) > 1 else full):
            if k == full:
                pos = pos[:-1]
            window = (three[pos >> 3] >> (24 - self.limit - (pos & 7))) & mask
            out[: len(pos), k] = self.symbol[window]
            pos = pos + self.bits[window]
        return out.reshape(-1)[:n]


def tokenised(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """doc_id, rid (tells repeated rows apart), n, ids (16-bit little-endian with the end id)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        if max(encoder.size, end + 1) > MOST_IDS:
            raise ValueError(f"{path} has {encoder.size} ids, over {MOST_IDS}")
        for batch in batches:
            for first, ids, of in encoder.encode(batch.column(1)):
                n = len(of) - 1
                # One end id after each document.
                joined = np.insert(ids, of[1:], np.uint32(end)).astype("<u2")
                ends = of + np.arange(n + 1)
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(joined)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(ends), pa.int64()), blob], names=["doc_id", "rid", "n", "ids"])

    return id_text(docs).withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, rid long, n long, ids binary")


def id_counts(ids: DataFrame) -> np.ndarray:
    """Global counts; each task sends one row for each id it met, and the driver gets at most one for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), dtype="<u2"), minlength=1 << 16) if len(blob.as_buffer()) > 40_000 else 0
            small = [b for b in batch.column(0) if len(b.as_buffer()) <= 40_000]
            if small:
                total += np.bincount(np.frombuffer(b"".join(b.as_buffer() for b in small), dtype="<u2"), minlength=1 << 16)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def ascending(ids: DataFrame) -> DataFrame:
    """ids range-partitioned and sorted by doc_id.  Rows that repeat an id, or have none, are told apart by their length and rid, so they may spread over partitions too."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("n").asc(), F.col("rid").asc()]
    return ids.repartitionByRange(partitions(ids.sparkSession) * 2, *order).sortWithinPartitions(*order)


def write(ids: DataFrame, path: str) -> None:
    """Codebook and blocks of staged ids (the result of tokenised)."""
    spark = ids.sparkSession
    lengths = code_lengths(id_counts(ids))
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, block = TaskContext.get().partitionId() << 40, 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(held)
            payload, marks = encode_bits(flat, lengths, codes)
            key = [x for x in docs if x is not None]
            row = [[key[0] if key else None], [key[-1] if key else None], [base + block], [len(flat)], [docs], [[len(x) for x in held]], [marks.astype("<i8").tobytes()], [payload]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size >= BLOCK:
                    yield close()
                    block, docs, held, size = block + 1, [], [], 0
                held.append(np.frombuffer(blob.as_buffer(), dtype="<u2"))
                docs.append(doc)
                size += len(held[-1])
        if docs:
            yield close()

    # Blocks are incompressible.
    ascending(ids).select("doc_id", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def starts(blocks: DataFrame) -> DataFrame:
    """block, before: ids of all earlier blocks.  Blocks are summed within their partition; the driver sees one sum for each."""
    spark = blocks.sparkSession
    narrow = blocks.select("block", F.shiftright("block", 40).alias("part"), "n_ids")
    base, table = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in narrow.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        table.append((part, base))
        base += n
    offset = spark.createDataFrame(table, "part long, base long")
    earlier = F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_ids")
    return narrow.withColumn("own", earlier).join(offset, "part").select("block", (F.col("own") + F.col("base")).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.uint8)
    lengths[book["id"].to_numpy(dtype=np.int64)] = book["length"].to_numpy(dtype=np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                block, n, docs, sizes, marks, payload = (batch.column(c)[r].as_py() for c in range(6))
                ids = decode(payload, np.frombuffer(marks, dtype="<i8"), n).astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - s : b]) for b, s in zip(ends.tolist(), sizes, strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([block] * k, pa.int64()), pa.array(ends - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "block", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.select("block", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(run, "doc_id long, block long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts(blocks), "block").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op3_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "huffman")
    write(staged(tokenised(documents(spark, sf_dir)), "token-ids"), path)
    return read(spark, path)
