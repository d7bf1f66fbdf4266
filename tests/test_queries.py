import pytest
from oracle import same

import __spark_entry__
from placefinder import queries

SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), small, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - SLOW))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry_has_rows(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["asked", "gid", "name_norm", "sim", "score", "rank"]
    assert rows.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
