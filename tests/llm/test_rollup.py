from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from quillspark.llm import registry, tokens
from quillspark.llm import rollup as ru
from quillspark.llm.common import scratch


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(path) for name, path in ru.default_tokenizers().items()}


def n_ids(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_query_against_brute_force(spark, data, docs, encoders):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        if r["doc_id"] not in toxic:
            for name, tok in encoders.items():
                for i, x in enumerate((1, n_ids(tok, r["text"]), len(r["text"] or ""))):
                    want[(r["source"], r["lang"], name)][i] += x
    got = registry.QUERIES["op2_rollup"](spark, data).collect()
    assert toxic and {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"], r["chars"]] for r in got} == dict(want) and len(got) == len(want)


def counts(spark, *rows):
    return spark.createDataFrame([*rows], "source string, lang string, tokenizer string, tokens long, chars long, old_tokens long, old_chars long")


def state_of(state):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["chars"]) for r in state.totals().collect()}


def test_signed_batches(spark):
    s = ru.Rollup(spark, scratch(spark, "r"))
    assert state_of(s) == {}
    one, two = ("a", "en", "v1", 10, 50, 0, 0), ("a", "en", "v1", 5, 20, 0, 0)
    other = (None, None, "v1", None, None, None, None)
    assert s.commit("1", ru.inserts(counts(spark, one, two, other)))
    assert state_of(s) == {("a", "en", "v1"): (2, 15, 70), (None, None, "v1"): (1, 0, 0)}
    assert s.commit("2", ru.revisions(counts(spark, ("a", "en", "v1", 7, 20, 5, 20))), ru.deletes(counts(spark, one, other)))
    assert state_of(s) == {("a", "en", "v1"): (1, 7, 20)}
    assert s.commit("3", ru.inserts(counts(spark).where("false")))
    assert state_of(s) == {("a", "en", "v1"): (1, 7, 20)}


def test_batches_are_idempotent(spark):
    s = ru.Rollup(spark, scratch(spark, "r"))
    row = ("a", "en", "v1", 10, 50, 0, 0)
    assert s.commit("b", ru.inserts(counts(spark, row))) and not s.commit("b", ru.inserts(counts(spark, row)))
    assert state_of(s) == {("a", "en", "v1"): (1, 10, 50)}
    with pytest.raises(ValueError, match="other content"):
        s.commit("b", ru.inserts(counts(spark, row, row)))
    # A second writer with the same state sees the commit as well.
    assert not ru.Rollup(spark, s.path).commit("b", ru.inserts(counts(spark, row)))
    before = state_of(s)
    assert s.compact() and not s.compact()
    assert state_of(s) == before and not s.commit("b", ru.inserts(counts(spark, row)))


def test_a_lost_attempt_leaves_no_trace(spark):
    s = ru.Rollup(spark, scratch(spark, "r"))
    s.commit("1", ru.inserts(counts(spark, ("a", "en", "v1", 1, 1, 0, 0))))
    # Deltas written by a writer that died before its commit.
    counts(spark, ("a", "en", "v1", 9, 9, 0, 0)).selectExpr("source", "lang", "tokenizer", "1L AS docs", "tokens", "chars").write.parquet(f"{s.path}/deltas/dead")
    assert state_of(s) == {("a", "en", "v1"): (1, 1, 1)}


def adds(spark, n):
    return ru.inserts(counts(spark, ("a", "en", "v1", n, n, 0, 0)))


def test_compaction_keeps_batches_and_takes_more(spark):
    s = ru.Rollup(spark, scratch(spark, "r"))
    for i in range(3):
        s.commit(str(i), adds(spark, i))
    assert s.compact() and s.commit("3", adds(spark, 10)) and not s.commit("3", adds(spark, 10)) and not s.commit("1", adds(spark, 1))
    with pytest.raises(ValueError, match="other content"):
        s.commit("0", adds(spark, 9))
    assert s.compact() and not s.commit("3", adds(spark, 10)) and not s.commit("2", adds(spark, 2))
    assert state_of(s) == {("a", "en", "v1"): (4, 13, 13)}
    # A state that was opened before the compaction goes on with the same log.
    assert ru.Rollup(spark, s.path).commit("4", adds(spark, 1)) and state_of(s) == {("a", "en", "v1"): (5, 14, 14)}


NAMES = ["2024/01", "a:b", "", "..", "x y", "2024\\01", "ä", "a.json", "0" * 300, "2024/01/", "\n"]


def test_any_name(spark):
    s = ru.Rollup(spark, scratch(spark, "r"))
    assert all(s.commit(name, adds(spark, 1)) for name in NAMES)
    assert state_of(s) == {("a", "en", "v1"): (len(NAMES), len(NAMES), len(NAMES))}
    assert not any(s.commit(name, adds(spark, 1)) for name in NAMES)
    s.compact()
    assert not any(s.commit(name, adds(spark, 1)) for name in NAMES) and s.commit("2024", adds(spark, 1))


def test_two_writers_at_once(spark, monkeypatch):
    """The other writer takes the place between this one's look at the log and its entry."""
    path = scratch(spark, "r")
    one, two = ru.Rollup(spark, path), ru.Rollup(spark, path)
    plain, waiting = ru.Rollup._create, []

    def late(self, at, text):
        while waiting:
            waiting.pop()()
        return plain(self, at, text)

    monkeypatch.setattr(ru.Rollup, "_create", late)
    waiting.append(lambda: two.commit("b", adds(spark, 2)))
    assert one.commit("a", adds(spark, 1)) and state_of(one) == {("a", "en", "v1"): (2, 3, 3)}
    # The same batch from both: one of them wins, once.
    waiting.append(lambda: two.commit("c", adds(spark, 4)))
    assert not one.commit("c", adds(spark, 4)) and state_of(one) == {("a", "en", "v1"): (3, 7, 7)}
    # A commit that comes while a compaction runs is in the sums.
    waiting.append(lambda: two.commit("d", adds(spark, 8)))
    assert one.compact() and state_of(one) == {("a", "en", "v1"): (4, 15, 15)}
    # And a compaction that comes while a commit runs does not close the log to it.
    waiting.append(two.compact)
    assert one.commit("e", adds(spark, 16)) and one.commit("f", adds(spark, 32))
    assert state_of(two) == {("a", "en", "v1"): (6, 63, 63)}
    # Two compactions give one state.
    waiting.append(two.compact)
    one.compact()
    assert state_of(one) == state_of(two) == {("a", "en", "v1"): (6, 63, 63)}
    assert not any(two.commit(x, adds(spark, n)) for x, n in zip("abcdef", (1, 2, 4, 8, 16, 32), strict=True))


def test_compacts_by_itself_and_sweeps(spark, monkeypatch):
    monkeypatch.setattr(ru, "FOLD_AFTER", 3)
    s = ru.Rollup(spark, scratch(spark, "r"))
    for i in range(7):
        s.commit(f"n/{i}", adds(spark, 1))
    assert len(s._read()[2]) == 1
    counts(spark, ("a", "en", "v1", 9, 9, 0, 0)).selectExpr("source", "lang", "tokenizer", "1L AS docs", "tokens", "chars").write.parquet(f"{s.path}/deltas/dead")
    assert s.sweep() == 0
    # Six commits and the first compaction were replaced; one attempt is left behind; a batch table was replaced.
    assert s.sweep(older=-5) == 6 + 1 + 1 + 1 and s.sweep(older=-5) == 0
    assert state_of(s) == {("a", "en", "v1"): (7, 7, 7)} and not s.commit("n/0", adds(spark, 1))


def test_moves(spark):
    s = ru.Rollup(spark, scratch(spark, "r"))
    s.commit("1", ru.inserts(counts(spark, ("a", "en", "v1", 10, 50, 0, 0), ("a", "en", "v1", 1, 2, 0, 0))))
    moved = spark.createDataFrame([("b", "en", "v1", 12, 55, "a", "en", "v1", 10, 50)], "source string, lang string, tokenizer string, tokens long, chars long, old_source string, old_lang string, old_tokenizer string, old_tokens long, old_chars long")
    s.commit("2", ru.moves(moved))
    assert state_of(s) == {("a", "en", "v1"): (1, 1, 2), ("b", "en", "v1"): (1, 12, 55)}


def test_edges(edge, nothing, encoders):
    got = ru.counted(edge).collect()
    assert len(got) == 2 * edge.count() and ru.counted(nothing).count() == 0
    by_id = {r["doc_id"]: r["text"] for r in edge.collect()}
    for r in got:
        assert r["tokens"] == n_ids(encoders[r["tokenizer"]], by_id[r["doc_id"]])


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a b": 0, "c": 1, "?": 2}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    tok.save(str(tmp_path / "t.json"))
    e = tokens.PieceEncoder(str(tmp_path / "t.json"))
    assert e.form == "whole" and [(f, ids.tolist(), of.tolist()) for f, ids, of in e.encode(pa.array(["a b,c", None, "x y,c"]))] == [(0, [0, 1, 2, 1], [0, 2, 2, 4])]


@pytest.mark.parametrize("name", ru.VERSIONS)
def test_pieces_give_the_ids_of_whole_texts(name, rows):
    import public_tokenizers

    e, r = tokens.PieceEncoder(public_tokenizers.path(name)), random.Random(1)
    odd = ["".join(r.choice(" \t\n  ab'sZ1.,<|é漢😀\u00a0\u2003\x7f") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    odd += ["a b", "a  b", " a", "a ", "", None, "x <|endoftext|> y", "x" * 300_000]
    column = pa.array([t for _, t, _ in rows] + odd)
    assert e.form != "whole"
    for first, ids, of in e.encode(column):
        for i, want in enumerate(e._library([t or "" for t in column.slice(first, len(of) - 1).to_pylist()])):
            assert ids[of[i] : of[i + 1]].tolist() == want
