"""Signals from remote models, behind an injectable client.

Duplicate texts are one job; known values come from the cache table; the rest go to the
client in batches inside the tasks.  A batch that fails is halved until single items fail
alone, except for refusals, which are not worth repeating.  Without a client every
signal is null, which the score rules treat as absent.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.decision import with_cache

REFUSALS = (401, 403, 404, 429)
REPEATABLE = (408, 429, 500, 502, 503, 504)

Client = Callable[[list[str]], list[float | None]]


class RemoteError(Exception):
    """A failed call; status is the HTTP status where there is one."""

    def __init__(self, status: int = 0, message: str = "") -> None:
        super().__init__(message or str(status))
        self.status = status


def patient(client: Client, texts: list[str], retries: int, pause: Callable[[float], None]) -> list[float | None]:
    """Calls the client, again after 0.5, 1, 2 ... seconds where the status invites it."""
    for k in range(retries + 1):
        try:
            out = client(texts)
            if len(out) != len(texts):
                raise RemoteError(0, "wrong number of scores")
            return out
        except RemoteError as e:
            if k == retries or e.status not in REPEATABLE:
                raise
            pause(0.5 * 2**k)
    return [None] * len(texts)


def halving(client: Client, texts: list[str], retries: int = 2, pause: Callable[[float], None] = time.sleep) -> list[float | None]:
    """A value for each text; null for those that fail alone or are refused."""
    if not texts:
        return []
    try:
        return patient(client, texts, retries, pause)
    except (RemoteError, ValueError) as e:
        if getattr(e, "status", 0) in REFUSALS or len(texts) == 1:
            return [None] * len(texts)
        mid = len(texts) // 2
        return halving(client, texts[:mid], retries, pause) + halving(client, texts[mid:], retries, pause)


def signals(jobs: DataFrame, cache: DataFrame, client: Client | None, batch: int = 8, retries: int = 2) -> DataFrame:
    """jobs (key, text and others) with value: cached, or from the client, or null."""
    hit, todo = with_cache(jobs, cache)
    if client is None:
        return hit
    texts = jobs.groupBy("key").agg(F.min("text").alias("text")).join(todo, "key", "left_semi")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for a in range(0, len(p), batch):
                own = p.iloc[a : a + batch]
                yield pd.DataFrame({"key": own["key"], "fresh": halving(client, own["text"].tolist(), retries)})

    fresh = texts.select("key", "text").mapInPandas(run, "key string, fresh double")
    return hit.join(fresh, "key", "left").withColumn("value", F.coalesce("value", "fresh")).drop("fresh")
