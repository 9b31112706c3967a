"""Operator 2, token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as additive deltas.  A batch of
changes (insert, delete, revise, move) is reduced to one signed row for each key before anything
is written, and committed once: deltas are written to a folder of the attempt, and the
batch exists from the moment its entry is renamed into the next free place of a numbered log,
which only one writer can do.  A batch that is committed again with the same content is skipped;
with other content it is an error.  A batch's name may be any string; it stands inside the entry.

compact() puts an entry into the same log that stands for all entries before it: their sums and
the names of their batches are tables of its own.  A commit that comes while it runs takes the
place first, and the compaction begins anew, or comes after it; so no committed batch is lost,
whatever runs at once.  Every FOLD_AFTER commits one is done by itself, so that readers open few
files.  sweep() removes deltas that a compaction replaced and those of attempts that crashed.

Counts are those of public tokenizers over whole texts; a tokenizer's file is its version.

Defined cases: null source or language are keys of their own; null counts are 0; a null
doc_id is a document like any other; rows that repeat a doc_id are counted each; an empty batch
commits and changes nothing; an empty table has no totals; a very long text is encoded whole; an
empty or null text has 0 tokens; keys whose totals are all 0 disappear; extra columns are ignored;
a revision keeps its document's key, a move changes it.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, hadoop_fs, remove, scratch, staged
from quillspark.llm.tokens import encoder_of

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "chars")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"

#: Commits after which one compacts.
FOLD_AFTER = 100
#: Seconds after which a table that nothing names counts as left behind.
SWEEP_AGE = 86_400.0
#: Names of the public tokenizer files whose counts the registered query keeps; a file is a version.
VERSIONS = ("word_bpe_49k.json", "byte_bpe_50k.json")


def default_tokenizers() -> dict[str, str]:
    """Path of each version's file, by the version's name."""
    import public_tokenizers

    return {os.path.splitext(name)[0]: public_tokenizers.path(name) for name in VERSIONS}


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of new documents; counts has the keys, tokens and chars, a row for each document and version."""
    return counts.select(*KEYS, F.lit(1).alias("docs"), "tokens", "chars")


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas that take documents out, with the counts they were last given."""
    return counts.select(*KEYS, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("chars")).alias("chars"))


def revisions(counts: DataFrame) -> DataFrame:
    """Deltas of changed counts; old_tokens and old_chars are what was counted before."""
    return counts.select(*KEYS, F.lit(0).alias("docs"), (F.coalesce("tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).alias("tokens"), (F.coalesce("chars", F.lit(0)) - F.coalesce("old_chars", F.lit(0))).alias("chars"))


def moves(counts: DataFrame) -> DataFrame:
    """Deltas of documents that change key; old_source, old_lang, old_tokenizer, old_tokens and old_chars are what they were counted under."""
    old = counts.select(*(F.col(f"old_{k}").alias(k) for k in (*KEYS, "tokens", "chars")))
    return inserts(counts).unionByName(deletes(old))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))


class Rollup:
    """State below path: log/<number>.json, one for each commit and compaction, and their tables deltas/<attempt> and batches/<attempt>.

    An entry of a batch has batch, attempt and content; one of a compaction has attempt alone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, at = hadoop_fs(self.spark, f"{self.path}/log")
        if not fs.exists(at):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _place(self, number: int) -> str:
        return f"{self.path}/log/{number:012d}.json"

    def _read(self) -> tuple[int, str | None, dict[str, dict]]:
        """(the next free place, the attempt of the last compaction, the entries of the batches since then by name)."""
        numbers, batches = self._numbers(), {}
        for n in reversed(numbers):
            entry = json.loads(self._text(self._place(n)))
            if "batch" not in entry:
                return numbers[-1] + 1, entry["attempt"], batches
            batches[entry["batch"]] = entry
        return (numbers[-1] + 1 if numbers else 1), None, batches

    def _text(self, path: str) -> str:
        fs, at = hadoop_fs(self.spark, path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Creates the file unless it is there already.

        It is written aside and renamed without overwriting, so no reader sees half an entry and,
        where the file system renames atomically, only one writer can win.
        """
        fs, at = hadoop_fs(self.spark, path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        aside = hadoop.Path(f"{self.path}/aside/{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.mkdirs(at.getParent())
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        context = hadoop.FileContext.getFileContext(fs.makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(at), plain)
        except Exception:
            # Another writer was first; any other failure goes on.
            fs.delete(aside, False)
            if not fs.exists(at):
                raise
            return False
        return True

    def _folded(self, attempt: str) -> DataFrame:
        """batch, content of the batches that a compaction stands for."""
        return self.spark.read.schema("batch string, content string").parquet(f"{self.path}/batches/{attempt}")

    def _known(self, batch: str, fold: str | None, batches: dict[str, dict]) -> str | None:
        """Content of a batch that was committed."""
        if batch in batches:
            return batches[batch]["content"]
        found = self._folded(fold).where(F.col("batch") == batch).first() if fold else None
        return found["content"] if found else None

    def commit(self, batch: str, *deltas: DataFrame) -> bool:
        """Adds the deltas under this batch name; False if the batch was there already."""
        rows = [d.select(*(F.col(k).cast("string").alias(k) for k in KEYS), *(F.coalesce(F.col(s).cast("long"), F.lit(0)).alias(s) for s in SUMS)) for d in deltas]
        all_ = rows[0]
        for d in rows[1:]:
            all_ = all_.unionByName(d)
        attempt = uuid.uuid4().hex
        at = f"{self.path}/deltas/{attempt}"
        _added(all_).coalesce(1).write.parquet(at)
        delta = self.spark.read.schema(SCHEMA).parquet(at)
        seen = delta.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*KEYS, *SUMS).cast("decimal(38,0)"))).first()
        content = f"{seen[0]}:{seen[1]}"
        while True:
            free, fold, batches = self._read()
            known = self._known(batch, fold, batches)
            if known is not None:
                remove(self.spark, at)
                if known != content:
                    raise ValueError(f"batch {batch!r} was committed with other content")
                return False
            if self._create(self._place(free), json.dumps({"batch": batch, "attempt": attempt, "content": content})):
                break
        if len(batches) + 1 >= FOLD_AFTER:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """The keys and their docs, tokens and chars over all committed batches."""
        _, fold, batches = self._read()
        return self._sums(fold, batches)

    def _sums(self, fold: str | None, batches: dict[str, dict]) -> DataFrame:
        attempts = sorted({*([fold] if fold else []), *(e["attempt"] for e in batches.values())})
        if not attempts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/deltas/{a}" for a in attempts))
        return _added(rows).where(" OR ".join(f"{s} <> 0" for s in SUMS))

    def compact(self) -> bool:
        """Puts one entry into the log that stands for all before it; False if there was nothing since the last one."""
        while True:
            free, fold, batches = self._read()
            if not batches:
                return False
            attempt = uuid.uuid4().hex
            self._sums(fold, batches).coalesce(1).write.parquet(f"{self.path}/deltas/{attempt}")
            names = self.spark.createDataFrame([(e["batch"], e["content"]) for e in batches.values()], "batch string, content string")
            (names.unionByName(self._folded(fold)) if fold else names).write.parquet(f"{self.path}/batches/{attempt}")
            if self._create(self._place(free), json.dumps({"attempt": attempt})):
                return True
            # A commit took the place: what was summed lacks it.
            self._drop(attempt)

    def _drop(self, attempt: str) -> None:
        for kind in ("deltas", "batches"):
            remove(self.spark, f"{self.path}/{kind}/{attempt}")

    def sweep(self, older: float = SWEEP_AGE) -> int:
        """Removes tables that no reader needs any more and that are older than so many seconds; returns how many.

        Those are the tables of attempts that never came to an entry, and of entries before the
        last compaction.  Commits, compactions and readers that take longer than that must not run meanwhile.
        """
        limit, gone = time.time() - older, 0
        for kind in ("deltas", "batches"):
            fs, at = hadoop_fs(self.spark, f"{self.path}/{kind}")
            old = [f.getPath().getName() for f in fs.listStatus(at) if f.getModificationTime() / 1000 <= limit] if fs.exists(at) else []
            # Read after the tables were listed, so that whatever was committed since then is kept.
            _, fold, batches = self._read()
            used = {fold, *(e["attempt"] for e in batches.values())}
            for name in old:
                if name not in used:
                    remove(self.spark, f"{self.path}/{kind}/{name}")
                    gone += 1
        return gone


def counted(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """source, lang, tokenizer, doc_id, tokens, chars and the estimate that ingestion books first (a quarter of n_chars).

    Each whole text is encoded once by every tokenizer (name to path); a row for each.
    """
    paths = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((batch.num_rows, len(paths)), dtype=np.int64)
            for k, path in enumerate(paths.values()):
                for first, _, of in encoder_of(path).encode(batch.column(0)):
                    n[first : first + len(of) - 1, k] = np.diff(of)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(paths)), pa.array(n.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*batch.schema.names[1:], "n"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.length(text).cast("long").alias("chars"), F.coalesce(F.floor(F.col("n_chars") / 4), F.lit(0)).cast("long").alias("guess"), F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("guess_chars"))
    rows = rows.mapInArrow(run, "doc_id long, source string, lang string, chars long, guess long, guess_chars long, n array<bigint>")
    return rows.select("doc_id", "source", "lang", "chars", "guess", "guess_chars", F.posexplode("n").alias("k", "tokens")).select("doc_id", "source", "lang", "chars", "guess", "guess_chars", F.element_at(F.array(*map(F.lit, paths)), F.col("k") + 1).alias("tokenizer"), "tokens")


def op2_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version.

    Ingestion books all documents at an estimate, a second batch revises every count to the exact
    one, a third takes toxic documents out; the state is compacted, and the second batch then sent again.
    """
    rows = staged(counted(documents(spark, sf_dir)), "rollup-counts")
    state = Rollup(spark, scratch(spark, "rollup"))
    guess = rows.select(*KEYS, F.col("guess").alias("tokens"), F.col("guess_chars").alias("chars"))
    exact = rows.select(*KEYS, "tokens", "chars", F.col("guess").alias("old_tokens"), F.col("guess_chars").alias("old_chars"))
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    state.commit("ingest", inserts(guess))
    state.commit("recount", revisions(exact))
    state.commit("takedown", deletes(rows.join(toxic, "doc_id", "left_semi")))
    state.compact()
    state.commit("recount", revisions(exact))
    return state.totals()
