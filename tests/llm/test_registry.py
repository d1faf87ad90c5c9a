from __future__ import annotations

import re

import __spark_entry__ as entry
from bidloom.llm import registry
from tests.oracle import rows_of, sql_rows


def test_all_queries_and_the_pipeline():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_sql_agrees(spark, tiny):
    for name, sql in registry.oracle_sql().items():
        assert rows_of(registry.queries()[name](spark, tiny)) == sql_rows(tiny, sql)
