"""Operator 13, fill-in-middle by run-length class encoding.

A text's code points fall into classes: ASCII letters, and other characters by the number of
their UTF-8 bytes.  A text is stored as its maximal runs of one class, each with the units
before it; a run of letters is one unit, any other run one unit a character.  A cut after so
many units lies in the run that a binary search over the cumulative units finds, and since all
units of a run are equally wide, its place in characters and bytes is start + units * width.
No list of tokens is made, and a text needs memory for its runs only.

Cuts and form come from SHA-256 of seed and doc_id, so they are the same in any order, on any
cluster and in SQL.  Texts that hold a sentinel stay plain, so every output can be undone.

Defined cases: null text counts as empty; an empty text is plain with 0 units and an empty
output; a null doc_id draws like an empty id; rows that repeat a doc_id draw alike; a very long
text is one row like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.common import documents, id_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are cut at all, and of these the ones in a hundred with the suffix first.
RATE, SPM_RATE = 90, 20
SEED = 1

#: Class of a byte that begins a character: 5 for letters, else its number of bytes; 0 for bytes inside a character.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[:128], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 1, 2, 3, 4
LETTERS = 5
_CLASS[65:91] = _CLASS[97:123] = LETTERS


@dataclass
class Runs:
    """Run r of a slice: class, first byte and character, units before it; document i has runs of[i]:of[i + 1].

    All counts go through the whole slice; the arrays have one entry more, where the slice ends.
    """

    kind: np.ndarray
    byte: np.ndarray
    char: np.ndarray
    unit: np.ndarray
    of: np.ndarray

    def units(self) -> np.ndarray:
        return np.diff(self.unit[self.of])

    def place(self, doc: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters, bytes) of these documents before the cut; cut counts units, and no document is empty."""
        first, target = self.of[doc], self.unit[self.of[doc]] + cut
        # The end of a document belongs to its last run.
        r = np.minimum(np.searchsorted(self.unit, target, side="right") - 1, self.of[doc + 1] - 1)
        k, letters = target - self.unit[r], self.kind[r] == LETTERS
        char = self.char[r] + k * np.where(letters, self.char[r + 1] - self.char[r], 1)
        byte = self.byte[r] + k * np.where(letters, self.byte[r + 1] - self.byte[r], self.kind[r])
        return char - self.char[first], byte - self.byte[first]


def class_runs(s: tk.Slice) -> Runs:
    """The runs of every text of a slice."""
    kind = _CLASS[s.data]
    at = np.flatnonzero(kind)
    kind, ends = kind[at], np.searchsorted(at, s.offsets)
    begin = np.ones(len(kind), dtype=bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[ends[:-1][np.diff(ends) > 0]] = True
    char = np.flatnonzero(begin)
    byte, kind, of = at[char], kind[char], np.searchsorted(char, ends)
    char = np.append(char, len(at))
    unit = np.zeros(len(char), dtype=np.int64)
    np.cumsum(np.where(kind == LETTERS, 1, np.diff(char)), out=unit[1:])
    return Runs(kind.astype(np.int64), np.append(byte, len(s.data)), char, unit, of)


def run_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_units, n_chars, and the runs of the text: their classes, and the characters and units before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                r = class_runs(s)
                doc = np.repeat(np.arange(s.n), np.diff(r.of))
                own = [x[:-1] - x[r.of[:-1]][doc] for x in (r.char, r.unit)]
                of = pa.array(r.of.astype(np.int32))
                lists = [pa.ListArray.from_arrays(of, pa.array(x, type=pa.int64())) for x in (r.kind, *own)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(r.units()), pa.array(np.diff(r.char[r.of])), *lists], names=["doc_id", "n_units", "n_chars", "kinds", "chars", "units"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_units long, n_chars long, kinds array<bigint>, chars array<bigint>, units array<bigint>")


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12)]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, x, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                ids, r = batch.column(0).slice(s.first, s.n), class_runs(s)
                n, h = r.units(), np.array([draws(i, seed) for i in ids.to_pylist()], dtype=np.int64)
                raw = [s.raw(i) for i in range(s.n)]
                cut = (h[:, 2] % 100 < rate) & (n > 0)
                for i in np.flatnonzero(cut).tolist():
                    cut[i] = not any(mark in raw[i] for mark in marks)
                doc = np.flatnonzero(cut)
                two = np.sort(h[doc, :2] % (n[doc] + 1)[:, None], axis=1)
                (c1, b1), (c2, b2) = r.place(doc, two[:, 0]), r.place(doc, two[:, 1])
                form, chars, out = ["plain"] * s.n, ([None] * s.n, [None] * s.n), raw
                spm = h[doc, 3] % 100 < spm_rate
                for i, a, b, first, last, late in zip(doc.tolist(), b1.tolist(), b2.tolist(), c1.tolist(), c2.tolist(), spm.tolist(), strict=True):
                    t = raw[i]
                    form[i], chars[0][i], chars[1][i] = "spm" if late else "psm", first, last - first
                    out[i] = x + t[b:] + p + t[:a] + m + t[a:b] if late else p + t[:a] + x + t[b:] + m + t[a:b]
                output = pa.array(out, type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(form), *(pa.array(c, type=pa.int64()) for c in chars), output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    def after(text: Column, head: Column | str) -> Column:
        return F.substr(text, (F.length(head) if isinstance(head, Column) else F.lit(len(head))) + 1)

    def parts(first: str, second: str) -> list[Column]:
        body = after(output, first)
        one = F.substring_index(body, second, 1)
        rest = after(body, F.concat(one, F.lit(second)))
        two = F.substring_index(rest, MIDDLE, 1)
        return [one, two, after(rest, F.concat(two, F.lit(MIDDLE)))]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late, early, between = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, between, late)).otherwise(output)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    again = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    return again.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
