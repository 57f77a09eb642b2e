"""Every registered query beside its SQL equivalent on the smallest tables."""

import pytest

from ectolog.workload import ORACLES, QUERIES
from tools.check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    result = compare(spark, con, name, sf_dir)
    assert not result.startswith("FAIL"), result
    if name not in ORACLES:
        assert int(result.split()[-1]) > 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert {"id", "season", "sex", "e_index"} <= set(df.columns)
    assert df.count() > 0
