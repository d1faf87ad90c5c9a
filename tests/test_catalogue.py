from __future__ import annotations

import pytest

from bidloom.plans import catalogue
from tests.conftest import DATA
from tests.oracle import rows_of, sql_rows


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, name):
    at = f"{DATA}/sf0.01" if name != "pages_text" else f"{DATA}/sf0.001"
    names, got = rows_of(catalogue.queries()[name](spark, at))
    want_names, want = sql_rows(at, catalogue.oracle_sql()[name])
    assert names == want_names
    assert len(got) == len(want)
    assert got == want
