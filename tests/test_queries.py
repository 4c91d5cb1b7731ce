"""Every registered query against its DuckDB statement, on the whole small tables."""

import pytest

from __spark_entry__ import entry, queries
from repoweave.registry.oracles import ORACLES
from repoweave.registry.queries import QUERIES
from tests.check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    same, n, *_ = compare(spark, con, name, SF_DIR)
    assert same is True
    assert n > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["repo_name", "rel_path", "level", "pos"]
    assert df.count() == 200
