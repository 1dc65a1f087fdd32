"""Every query against its DuckDB SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.all_queries()
ORACLES = entry_point.all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con.execute(ORACLES[name]).df()) == []


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["loc", "lastmod", "changefreq", "priority", "sitemap_no"]
