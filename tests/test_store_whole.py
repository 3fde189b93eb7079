"""The store's queries over whole tables."""

from prismframe import catalog


def test_repeated_ids_reach_all_of_documents(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    ids = [r._idx for r in catalog.QUERIES["store_load_batch_spread"](spark, sf).collect()]
    assert len(set(ids)) < len(ids) == spark.read.parquet(f"{sf}/labels.parquet").count()
    assert max(ids) > 100 and len({10 * k // n for k in ids}) == 10


def test_both_shards_are_whole(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = catalog.QUERIES["store_merge_whole_shards"](spark, sf)
    assert rows.count() == rows.select("_idx").distinct().count() == 2 * n
