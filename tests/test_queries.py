import pytest
from oracle import compare

from shutterlake.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
