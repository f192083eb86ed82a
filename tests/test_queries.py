"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from cuesheet.queries import gather
from tests.harness import compare

SF, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = gather("queries"), gather("oracles")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        message = compare(spark, name, QUERIES[name], ORACLES[name], SF)
        if message == f"{name}: no rows":  # nothing of the kind in the smallest tables
            message = compare(spark, name, QUERIES[name], ORACLES[name], NEXT)
        assert message is None, message
    else:
        assert QUERIES[name](spark, SF).count() > 0
