import pytest

from fernmark import catalog
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, db, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        check(db, got, catalog.ORACLES[name])
    else:  # tests/test_models.py holds these against something
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
