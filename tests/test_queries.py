"""Every registered query against its SQL equivalent on the smallest tables."""

import importlib

import pytest

import __spark_entry__ as entry_module
from tools.compare import connect, difference

MODULES = [importlib.import_module(f"tablelift.queries.{name}") for name in entry_module._MODULES]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query_and_names_are_unique():
    assert set(ORACLES) <= set(QUERIES) and sum(len(module.QUERIES) for module in MODULES) == len(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry_returns_the_reconciled_checks(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 11 and {row.status for row in rows} == {"MATCH"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, database, name):
    assert difference(QUERIES[name](spark, sf_dir), database, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
