"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, con, sf_dir, key):
    status, detail, _ = compare(spark, con, key, sf_dir)
    assert status in ("OK", "ROWS"), f"{status} {detail}"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "rank", "cost", "used", "dropped"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
