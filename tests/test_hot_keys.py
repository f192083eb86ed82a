"""The chunked plan, forced by a tiny group limit, against the SQL twins."""

import pytest

from cuesheet.queries import gather
from tests.harness import compare

QUERIES, ORACLES = gather("queries"), gather("oracles")
NAMES = ["fill_labels", "smooth_islands", "max_concurrency"]


@pytest.mark.parametrize("name", NAMES)
def test_chunked_plan(spark, name):
    spark.conf.set("spark.cuesheet.maxGroupRows", "20")
    try:
        assert compare(spark, name, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") is None
    finally:
        spark.conf.unset("spark.cuesheet.maxGroupRows")
