"""Every query of the library against its SQL."""

import pytest

from quern.catalogue import ORACLES, QUERIES
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.fixture(scope="module")
def larger():
    return connection(LARGER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


#: Queries of many jobs or of long SQL, that are left out on more rows to keep the tests short.
LONG = ("str_", "store_", "tool_calls", "txt_reindexed", "txt_chunks_lateral")


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith(LONG)))
def test_query_on_more_rows(spark, larger, name):
    """Ties and repeats that the smallest tables lack."""
    assert difference(QUERIES[name](spark, LARGER), larger, ORACLES[name]) == ""
