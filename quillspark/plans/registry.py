"""All queries of the library and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import corpus_queries, detector_queries, mail_queries, model_queries, service_queries, source_queries, text_queries

_MODULES = (text_queries, corpus_queries, mail_queries, model_queries, source_queries, service_queries, detector_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
