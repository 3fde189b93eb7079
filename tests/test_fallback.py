"""Fallback rates over every size, against the crops themselves."""

from pyspark.sql import functions as F

from prismframe import catalog
from prismframe.functions import crops
from prismframe.operators import fallback


def test_counts_are_those_of_the_crops(spark):
    sizes = spark.createDataFrame([(64, 64), (64, 500), (500, 64), (300, 200), (7, 5), (1, 1), (64, 64)], "width int, height int")
    for scale in ((0.08, 1.0), (0.5, 1.0)):
        got = {(r.width, r.height): (r.fallback_count, r.total_samples) for r in fallback.by_size(sizes, scale=scale, samples=2_000).collect()}
        w, h = F.col("width"), F.col("height")
        box = sizes.distinct().crossJoin(spark.range(2_000)).select(w, h, crops.random_resized(w, h, F.col("id"), scale=scale).alias("a"), crops.centre(w, h, F.least(w, h)).alias("b"))
        want = {(r.width, r.height): (r.n, 2_000) for r in box.groupBy("width", "height").agg(F.sum((F.col("a") == F.col("b")).cast("long")).alias("n")).collect()}
        assert got == want and got[64, 500][0] > 0
        one = fallback.estimate(sizes, scale=scale, samples=2_000).first()
        count = sum(n for n, _ in want.values())
        assert (one.fallback_count, one.total_samples, one.fallback_rate, one.recommend_direct) == (count, 12_000, count / 12_000, count / 12_000 > 0.05)
    assert fallback.estimate(sizes.limit(0)).first().asDict() == {"fallback_rate": 0.0, "fallback_count": 0, "total_samples": 0, "recommend_direct": False}


def test_every_size_is_taken(spark, sf):
    n = spark.read.parquet(f"{sf}/part.parquet").select(64 + F.col("p_partkey") * 37 % 577, 64 + (F.col("p_partkey") * 53 + 11) % 449).distinct().count()
    rows = catalog.QUERIES["fallback_by_size"](spark, sf).collect()
    assert len(rows) == n and all(r.total_samples == 50_000 for r in rows)
