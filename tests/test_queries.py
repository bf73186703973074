"""Every registered query with check SQL equals DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from zonecast.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


# Up to 18 fits of 120 rounds each; test_study.py has the same contract with few rounds.
LONG_FITS = {"poisson_model", "boosted_model", "boosted_absolute", "depth_grid", "borough_models", "weather_models"}


@pytest.mark.parametrize("name", sorted((set(entry.oracle_sql()) & set(QUERIES)) - LONG_FITS))
def test_query_equals_sql(spark, duck, name):
    text, good, _ = compare(spark, duck, SF, name)
    assert good, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
