from __future__ import annotations

import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import huffman as h
from quillspark.llm import registry
from quillspark.llm.common import scratch, staged
from quillspark.llm.tokens import PieceEncoder, default_tokenizer


def expected(rows, end=2):
    tok = Tokenizer.from_file(default_tokenizer())
    out, start = [], 0
    for i, text, _ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def result(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


def test_query_against_brute_force(spark, data, rows):
    assert result(registry.QUERIES["op3_huffman"](spark, data)) == expected(rows)


@pytest.mark.parametrize("shuffled", [False, True])
def test_order_of_input_does_not_matter(spark, docs, rows, shuffled):
    from pyspark.sql import functions as F

    d = docs.repartition(5).orderBy(F.rand(1)) if shuffled else docs
    path = scratch(spark, "t")
    h.write(staged(h.tokenised(d), "t"), path)
    assert result(h.read(spark, path)) == expected(rows)


def test_edges(spark, edge, nothing):
    from tests.llm.conftest import edge_rows

    path = scratch(spark, "t")
    h.write(staged(h.tokenised(edge), "t"), path)
    got = result(h.read(spark, path))
    lens = {i: n for i, _, n, _ in expected(edge_rows())}
    key = lambda r: (r[0] is not None, r[0] or 0, lens[r[0]])
    assert got == expected(sorted(edge_rows(), key=key))
    path = scratch(spark, "t")
    h.write(staged(h.tokenised(nothing), "t"), path)
    assert h.read(spark, path).count() == 0


def test_small_files_that_share_a_task(spark, docs, rows):
    from itertools import pairwise

    # 60 sorted files of unequal size: Spark packs them into tasks by size, not by doc_id.
    cuts = [0, *sorted((i * 37) % 199 + 1 for i in range(59)), len(rows)]
    parts = docs.orderBy("doc_id").collect()
    dealt = spark.sparkContext.parallelize(list(pairwise(cuts)), 60).flatMap(lambda c: parts[c[0] : c[1]])
    ids = staged(h.tokenised(spark.createDataFrame(dealt, docs.schema)), "t")
    assert len(ids.inputFiles()) == 60
    path = scratch(spark, "t")
    h.write(ids, path)
    assert result(h.read(spark, path)) == expected(rows)


def blocks_in_file_order(spark, path):
    import glob

    import pyarrow.parquet as pq

    return [r for f in sorted(glob.glob(f"{path.removeprefix('file:')}/blocks/part-*")) for r in pq.read_table(f).to_pylist()]


@pytest.mark.parametrize("ids", [[3, 4, 1, 2], list(range(400))[::-1], [5] * 300 + [4, 6], [None] * 200 + [1] * 200])
def test_files_are_in_ascending_order(spark, monkeypatch, ids):
    monkeypatch.setattr(h, "BLOCK", 40)
    rows = [(i, "word " * (k % 7), None) for k, i in enumerate(ids)]
    path = scratch(spark, "t")
    h.write(staged(h.tokenised(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)), "t"), path)
    blocks = blocks_in_file_order(spark, path)
    written = [(i is not None, i or 0) for b in blocks for i in b["doc_ids"]]
    assert written == sorted(written) and len(written) == len(ids)
    assert [b["block"] for b in blocks] == sorted({b["block"] for b in blocks})
    assert result(h.read(spark, path)) == expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))))
    if len(ids) > 4:
        # Rows of one id do not all fall into one partition.
        assert len({b["block"] >> 40 for b in blocks}) > 2


def test_large_vocabularies_are_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(h, "MOST_IDS", 1000)
    with pytest.raises(Exception, match="49408 ids, over 1000"):
        h.tokenised(docs).count()


def test_another_tokenizer(spark, docs, rows):
    import public_tokenizers

    path, tok = scratch(spark, "t"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    h.write(staged(h.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), 50256), "t"), path)
    for i, (_, _, n, crc) in zip(rows, result(h.read(spark, path)), strict=True):
        want = np.array([*tok.encode(i[1], add_special_tokens=False).ids, 50256], dtype="<u4")
        assert (n, crc) == (len(want), zlib.crc32(want))


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=200))
def test_lengths_are_optimal_and_prefix_free(counts):
    c = np.array(counts)
    if (c > 0).sum() < 2:
        return
    loose = h.code_lengths(c, 16)
    if huffman_cost(counts) and loose.max() < 16:
        assert int((loose * c).sum()) == huffman_cost(counts)
    tight = h.code_lengths(c, 8)
    assert tight.max() <= 8 and sum(2.0 ** -int(x) for x in tight if x) <= 1
    words = sorted(format(w, f"0{n}b") for w, n in zip(h.canonical(tight).tolist(), tight.tolist(), strict=True) if n)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=1500))
def test_round_trip(ids):
    x = np.array(ids)
    lengths = h.code_lengths(np.bincount(x))
    payload, marks = h.encode_bits(x, lengths, h.canonical(lengths))
    assert (h.Decoder(lengths)(payload, marks, len(x)) == x).all()


TEXTS = ["", "  ", "It's 'RE, don't;x'll 're É Ö 12ab <x|y áb́c ,'s", "a" * 600, "<|endoftext|> and <|ENDOFTEXT|>", "x,'s y.'t (1,2)[3] …—", "ﬁ ﬂ Ⅷ ǅ İ ß ẞ", "mixed space here\x0bthere", "á é́", "😀 漢字かな"]


def test_pieces_equal_the_library():
    import pyarrow as pa

    tok = Tokenizer.from_file(default_tokenizer())
    enc = PieceEncoder(default_tokenizer(), slots=64)
    for texts in (TEXTS, TEXTS[:4] + TEXTS[5:], ["ab cd ef gh"] * 3):
        got = [ids[a:b].tolist() for _, ids, of in enc.encode(pa.array(texts)) for a, b in zip(of[:-1], of[1:], strict=True)]
        assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBc's,. <|>-_1é́İ\n\t…'td")), max_size=40))
def test_pieces_equal_the_library_on_any_text(text):
    import pyarrow as pa

    enc = test_pieces_equal_the_library_on_any_text.__dict__.setdefault("enc", PieceEncoder(default_tokenizer(), slots=256))
    (_, ids, _), = enc.encode(pa.array([text]))
    assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids
