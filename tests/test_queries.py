import pytest

from synthloom.queries import QUERIES, SQL
from tests.helpers import same

SLOW = {"minhash_signature", "weighted_sample_lineitem"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_its_sql(spark, sf, tmp_path, name):
    same(spark, QUERIES[name], SQL[name], sf, tmp_path)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
