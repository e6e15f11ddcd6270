"""Every core query with SQL against DuckDB on the smallest data; the others must run."""

import pytest

from tests.oracle import DATA, difference
from waymark.plans.catalog import CORE

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_equals_sql(spark, name):
    assert difference(spark, name, CORE.builders[name], CORE.sql[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(CORE.builders) - set(CORE.sql)))
def test_runs(spark, name):
    assert CORE.builders[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
