"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from quillspark.plans import registry
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    if name not in registry.ORACLES:
        assert df.columns
        df.collect()
        return
    assert rows_of(df) == rows_of_sql(duck, registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    d = entry.entry(spark)
    assert d.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_plan_is_native(spark, data):
    plan = registry.QUERIES["doc_verdict"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
