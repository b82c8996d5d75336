import pytest
from compare import connect, same
from conftest import DATA

from tessera.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same(df, ORACLES[name], con)
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
