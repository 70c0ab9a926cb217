import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import assert_same  # noqa: E402
from cytoloom.plans import cell_queries, spatial_queries  # noqa: F401
from cytoloom.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"graph_communities", "k_means_elbow"}))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
