"""The planar queries over a whole table."""

import pytest

from prismframe import catalog


@pytest.mark.parametrize("name", ["yuv_to_rgb_table", "yuv_planes_table"])
def test_every_row_is_taken(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count()
