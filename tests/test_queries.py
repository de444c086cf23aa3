import pytest
from oracle import check

import driftmark.queries as base

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    check(spark, base.QUERIES[name], base.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE_SQL) - {"extract_themes", "evolution_graph", "long_period_themes"}))
def test_query_runs(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "cnt", "total", "p"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
