import pytest

from kindframe.queries import ORACLES, QUERIES
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        compare(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SF).count() >= 0
