"""Every registered query with an oracle, against DuckDB on the same tables; the others run."""

from __future__ import annotations

import pytest

from recallspark.plans import catalog
from tests.conftest import SF_DIR, same_rows

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    same_rows(QUERIES[name](spark, SF_DIR), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    out = QUERIES[name](spark, SF_DIR)
    assert len(out.columns) == len(set(out.columns)) and out.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(QUERIES) and set(__spark_entry__.oracle_sql()) >= set(ORACLES)
    assert __spark_entry__.entry(spark).columns == ["query_id", "reason", "outcome", "best", "margin"]
