"""Prepared datasets, planar YUV and saved indexes of a store, copies between folders."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.functions.imagebytes import rgb_to_yuv
from prismframe.operators import kernels, prepare, store
from prismframe.operators.loader import Loader
from prismframe.sources import remote


def picture(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


@pytest.fixture(scope="module")
def images(spark):
    rows = [(0, bytearray(kernels.encode_png(picture(31, 20))), "a"), (1, bytearray(kernels.encode_png(picture(9, 40, 1))), "b"), (2, None, "a"), (3, bytearray(kernels.encode_png(picture(1, 1, 2))), None)]
    return spark.createDataFrame(rows, "_idx long, image binary, label string")


def test_short_long(spark, images):
    out = {r._idx: r for r in prepare.short_long(16, 24)(images).collect()}
    assert out[2].image is None and out[0].label == "a"
    shapes = {k: kernels.decode(bytes(out[k].image)).shape for k in (0, 1, 3)}
    assert shapes == {0: (24, 16, 3), 1: (16, 24, 3), 3: (16, 16, 3)}
    whole = kernels.resize(picture(9, 40, 1), 16, 71)
    assert np.array_equal(kernels.decode(bytes(out[1].image)), whole[:, round(47 / 2) : round(47 / 2) + 24])
    sizes = spark.createDataFrame([(20, 31), (40, 9), (1, 1)], "w long, h long").select(prepare.short_long_size(F.col("w"), F.col("h"), 16, 24).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in sizes] == [(16, 24, 0, 0, 16, 24), (71, 16, 24, 0, 24, 16), (16, 16, 0, 0, 16, 16)]
    assert prepare.prepared_hash("x", "/d", "val") != prepare.prepared_hash("x", "/d", "train")
    assert prepare.short_long()(images.limit(0)).count() == 0


def test_store_tables_beside_rows(spark, images, tmp_path):
    s = store.Store(spark, str(tmp_path / "s")).build(images, {"image": "ImageBytes", "label": "str"})
    assert s.yuv() is None and s.indexes() == [] and s.image_format("image") == "png"
    rows = {r._idx: r for r in s.build_yuv().collect()}
    data, h, w = rgb_to_yuv(picture(31, 20))
    assert (bytes(rows[0].image), rows[0].height, rows[0].width) == (data, h, w) == (data, 32, 20)
    assert rows[2].image is None and len(rows[3].image) == 6
    before = sorted(p.name for p in (tmp_path / "s/yuv420/image").iterdir())
    assert s.build_yuv().count() == 4 and sorted(p.name for p in (tmp_path / "s/yuv420/image").iterdir()) == before
    s.save_index("label")
    assert s.indexes() == ["label"]
    assert {r.value: r.rows for r in s.saved_index("label").collect()} == {"a": [0, 2], "b": [1], None: [3]}
    for wrong in (lambda: s.saved_index("image"), lambda: s.image_format("label")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        s.save_index("image")


def test_warmup_keeps_the_epoch(images):
    one = Loader(images, 2, seed=5).set_epoch(3)
    assert one.warmup()["rows"] == 4 and one.epoch == 3
    one.shutdown()


def test_copies(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "x").mkdir(parents=True)
    (a / "x/one").write_bytes(b"1" * 1000)
    (a / "two").write_bytes(b"")
    (a / "three.gz").write_bytes(gzip.compress(b"3" * 9000))
    assert remote.exists(str(a)) and not remote.exists(str(b))
    assert remote.copy_folder(spark, str(a), str(b)) == {"files": 3, "bytes": 1000 + (a / "three.gz").stat().st_size}
    assert (b / "three.gz").read_bytes() == (a / "three.gz").read_bytes()
    assert (b / "x/one").read_bytes() == b"1" * 1000 and not list(b.rglob("*.part"))
    assert remote.copy_folder(spark, str(a), f"file://{b}") == {"files": 0, "bytes": 0}
    (b / "three").write_bytes(b"333")
    (a / "four").write_bytes(b"4444")
    assert remote.sync(spark, str(a), str(b)) == {"download": {"files": 1, "bytes": 3}, "upload": {"files": 1, "bytes": 4}}
    assert remote.local_name("s3://x/y/") == remote.local_name("s3://x/y/") != remote.local_name("s3://z/y/")


@pytest.mark.parametrize("name", ["prepare_images", "images_to_yuv420", "preset_simclr", "stage_resize_crop_png", "decode_jpeg_solid"])
def test_images_of_one_small_file_are_dealt_to_tasks(spark, sf, name):
    from prismframe.plans.pixelplane import QUERIES

    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4
