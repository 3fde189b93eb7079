"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.functions.crops import direct_resized
from prismframe.plans import metadata
from prismframe.plans import pixelplane  # noqa: F401  registers its queries

QUERIES, ORACLES = metadata.QUERIES, metadata.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch 0 with seed 42: shuffled rows in batches of 32, with batch, slot and crop rectangle."""
    rows = metadata.Loader(metadata.meta(spark, sf_dir), 32, seed=42).plan()
    return rows.select("_batch", "_slot", "_idx", "label", direct_resized(F.col("width"), F.col("height"), F.col("_idx")).alias("crop"))
