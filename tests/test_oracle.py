"""Every query with SQL gives the SQL's rows; every other one gives rows."""

import os

import pytest

from workload import check, registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# Long iterative runs; their operators have brute-force tests of their own.
SLOW = {"gmm_select", "cluster_all", "hier_select", "kmeans_elbow", "gmm_em", "hier_large_micro"}


@pytest.fixture(scope="module")
def duck():
    return check.oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    assert check.compare(spark, duck, FOLDER, name, registry.QUERIES[name], registry.ORACLE[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - SLOW))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).head(1)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
