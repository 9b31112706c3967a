"""Documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random

import pytest

#: Names that operators use for columns of their own, or once did.
TAKEN = "size digest node score label start copies kept rid __id __rid __source __size __copies __copy __sha key_id KEY_DIGEST key_kept row draw of at c1 want batch sha word h".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in TAKEN)
CLASH = ("x",) * len(TAKEN)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghiklmnorstu") for _ in range(r.randint(1, 9))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and blank texts, ties, repeated rows, one very long text, near copies."""
    long = prose(1, 60_000)
    base = prose(2, 60)
    near = base.split()
    near[10] = "changed"
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n ", None),
        (4, base, "a"),
        (5, " ".join(near), "b"),
        (6, base, None),
        (6, base, None),
        (None, base, "b"),
        (7, long, "a"),
        (8, "One two", "c"),
        (9, "one TWO", "c"),
        (10, prose(3, 30), "c"),
        (11, "Ünïcode – текст 漢字 \x01 emoji 😀", "c"),
        (12, "only", None),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *CLASH) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
