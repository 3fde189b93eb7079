import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.functions import crops, hashing, imagebytes
from prismframe.functions.imagebytes import _size, rgb_to_yuv
from prismframe.operators import kernels, stages, store
from prismframe.operators.loader import Loader
from prismframe.sources import folders, packed


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.range(500).select(F.col("id").alias("_idx"), (40 + F.col("id") * 37 % 500).alias("width"), (30 + F.col("id") * 91 % 400).alias("height"))


def W():
    return F.col("width")


def H():
    return F.col("height")


def K():
    return F.col("_idx")


@pytest.mark.parametrize("make", [crops.random_resized, crops.direct_resized])
@pytest.mark.parametrize("scale", [(0.08, 1.0), (0.01, 0.1), (0.5, 1.0)])
def test_crops_lie_inside(sizes, make, scale):
    bad = sizes.select(W(), H(), make(W(), H(), K(), "t", scale).alias("r")).where("r.x < 0 or r.y < 0 or r.w < 1 or r.h < 1 or r.x + r.w > width or r.y + r.h > height")
    assert bad.count() == 0


def test_yoked_crops_share_their_centre(sizes):
    one = lambda scale: crops.direct_resized(W(), H(), K(), "y", scale, (1.0, 1.0))
    d = sizes.select(W(), H(), one((0.05, 0.1)).alias("a"), one((0.1, 0.2)).alias("b")).where("b.x > 0 and b.y > 0 and b.x + b.w < width and b.y + b.h < height")
    assert d.where("abs(a.x + a.w / 2 - b.x - b.w / 2) > 1.5 or abs(a.y + a.h / 2 - b.y - b.h / 2) > 1.5").count() == 0


def test_loader_epochs(sizes):
    one = Loader(sizes, 32, seed=3)
    a, b = one.plan().collect(), Loader(sizes, 32, seed=3).plan().collect()
    assert sorted(a) == sorted(b) and len(a) == len(one) * 32
    assert [r._idx for r in sorted(a, key=lambda r: r._pos)] != [r._idx for r in sorted(one.set_epoch(1).plan().collect(), key=lambda r: r._pos)]
    shards = [set(r._idx for r in Loader(sizes, 32, seed=3, world=4, rank=k).order().collect()) for k in range(4)]
    assert set.union(*shards) == set(range(500)) and sum(map(len, shards)) == 500
    batches = list(Loader(sizes, 64, shuffle=False, drop_last=False))
    assert [len(x.rows) for x in batches] == [64] * 7 + [52]


def test_loader_wants_enough_rows_to_pad(spark, sizes):
    with pytest.raises(ValueError):
        Loader(sizes.limit(1), 1, world=5).order()


def test_store_round_trip(spark, tmp_path, sizes):
    rows = sizes.withColumn("data", F.encode(F.col("width").cast("string"), "UTF-8")).withColumn("name", F.concat(F.lit("n"), K().cast("string")))
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.problems() == ["no manifest"]
    s.build(rows)
    m = s.manifest()
    assert s.problems() == [] and m["num_samples"] == 500 and m["fields"]["data"]["max_size"] == 3
    assert store.differing(s.rows(), rows, "data").count() == 0
    assert s.index("width").where("value = 40").first().rows[0] == 0
    with pytest.raises(ValueError):
        s.index("data")
    with pytest.raises(KeyError):
        s.batch(spark.createDataFrame([(0, 1)], "_at long, _idx long"), ["none"])
    victim = next(p for p in (tmp_path / "s" / "rows").glob("part-*.parquet"))
    victim.unlink()
    assert any("missing" in p for p in s.problems())
    s.wipe()
    assert not s.exists()


def test_png_bmp_and_yuv():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (kernels.decode(kernels.encode_png(px)) == px).all()
    for rgb, want in (((255, 0, 0), (76, 85, 255)), ((0, 255, 0), (149, 43, 21)), ((0, 0, 255), (29, 255, 107))):
        data, h, w = rgb_to_yuv(np.full((3, 3, 3), rgb, np.uint8))
        assert (h, w) == (4, 4) and all(abs(data[k] - v) <= 1 for k, v in zip((0, 16, 20), want))
        assert np.abs(kernels.decode(data, h, w).astype(int) - rgb).max() <= 3


def test_header_walks():
    assert _size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\0" * 9) == (48, 32)
    assert _size(b"junk") == (0, 0) == _size(None)
    assert _size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)


def test_kernels_against_closed_forms():
    px = np.arange(48.0).reshape(3, 4, 4)
    assert np.allclose(kernels.affine(px, np.eye(3)), px)
    assert np.allclose(kernels.affine(px, np.diag([-1.0, 1, 1])), px[:, :, ::-1])
    assert np.allclose(kernels.blur(np.ones((3, 8, 8)), 1.0), 1)
    assert np.allclose(kernels.gaussian(5, 1.0).sum(), 1) and kernels.filter_size(1.5) == 11
    assert np.allclose(kernels.resize(np.full((6, 5, 3), 0.25), 3, 9), 0.25)
    n = kernels.power_noise(16, 16, channels=2)
    assert n.min() == -1 and n.max() == 1
    assert np.allclose(kernels.patch_shuffle(px, 2, np.arange(4)), px)
    assert kernels.lgn(np.ones((3, 9, 9))).shape == (5, 9, 9)
    assert kernels.circle_mask(32)[16, 16] == 1


def test_stages_decode_once_and_keep_nulls(spark):
    px = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(0, 30, 20, bytearray(kernels.encode_png(px))), (1, 30, 20, None)], "_idx long, width long, height long, image binary")
    got = {r._idx: r for r in stages.multi_crop({"a": {"size": 8}, "b": {"size": 4, "salt": "a"}})(rows).collect()}
    assert len(got[0].a) == 8 * 8 * 3 and len(got[0].b) == 4 * 4 * 3 and got[1].a is None
    r = got[0].a_rect
    assert got[0].a == kernels.crop_resize(px, r.x, r.y, r.w, r.h, 8).tobytes()
    with pytest.raises(ValueError):
        stages.copies("image", ["x", "x"])


def test_packed_file(spark, tmp_path):
    path, images = tmp_path / "x.beton", [b"\xff\xd8" + bytes([k]) * 5 + b"\xff\xd9" for k in range(6)]
    row = np.dtype([("f0", packed.ROWS[packed.IMAGE]), ("f1", "<i8")], align=True)
    fields = np.zeros(2, packed.FIELD)
    for f, (name, kind) in zip(fields, (("image", packed.IMAGE), ("label", packed.INT))):
        f["kind"], f["name"][: len(name)] = kind, list(name.encode())
    start = packed.HEADER.itemsize + fields.nbytes + 6 * row.itemsize
    rows, table, at = np.zeros(6, row), np.zeros(6, packed.ENTRY), start
    for k, data in enumerate(images):
        rows[k] = ((0, 3, 2, at), 10 * k)
        table[5 - k] = (k, at, len(data) + 2)
        at += len(data) + 2
    head = np.array([(2, 2, 1 << 21, 6, at)], packed.HEADER)
    path.write_bytes(head.tobytes() + fields.tobytes() + rows.tobytes() + b"".join(d + b"\0\0" for d in images) + table.tobytes())
    spark.dataSource.register(packed.PackedSource)
    got = sorted(spark.read.format("packed").option("rows", 4).load(str(path)).collect())
    table = spark.read.format("packed").option("rows", 4).load(f"file://{path}")
    assert [tuple(r) for r in packed.sample_info(table, "image").orderBy("_idx").collect()] == [(k, 9, 2, 3) for k in range(6)]
    ids = spark.createDataFrame([(0, 5), (1, 0), (2, 5)], "_at long, _idx long")
    assert [r.label for r in store.load_batch(table, ids, ["label"]).orderBy("_at").collect()] == [50, 0, 50]
    assert [bytes(r.image.data) for r in got] == images and [r.label for r in got] == [0, 10, 20, 30, 40, 50] and got[0].image.width == 3


def test_folders_and_kinds(spark, tmp_path):
    for c in ("b", "a"):
        (tmp_path / "set" / c).mkdir(parents=True)
        for k in range(2):
            (tmp_path / "set" / c / f"{k}.png").write_bytes(kernels.encode_png(np.zeros((2, 2, 3), np.uint8)))
    rows = folders.class_folders(spark, str(tmp_path / "set")).orderBy("_idx").collect()
    assert [(r._idx, r.label, r.path) for r in rows] == [(0, 0, "set/a/0.png"), (1, 0, "set/a/1.png"), (2, 1, "set/b/0.png"), (3, 1, "set/b/1.png")]
    assert folders.kind_of(str(tmp_path / "set")) == "imagefolder" and folders.kind_of("x.tar.gz") == "archive" and folders.kind_of("x.beton?v=1") == "packed" and folders.kind_of(str(tmp_path / "no")) == "unknown"
    got = spark.createDataFrame([("a.TGZ",), ("b.beton?x",), ("c.BETON",)], "p string").select(folders.is_archive(F.col("p")), folders.is_packed(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False)]


def test_streaming_ingest(spark, tmp_path, sizes):
    from prismframe.streaming.ingest import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sizes.limit(10).write.parquet(src)
    for want in (10, 20):
        ingest(spark, src, sizes.schema, out, str(tmp_path / "ck"), {"width": "int", "height": "int"}).awaitTermination(60)
        assert spark.read.parquet(out).count() == want
        sizes.limit(10).write.mode("append").parquet(src)


def test_remembered_hashes(tmp_path):
    import hashlib
    import os

    path = tmp_path / "x.tar"
    path.write_bytes(b"one")
    want = hashlib.sha256(b"one").hexdigest()
    assert hashing.remembered(str(path)) is None and hashing.file_hash(str(path)) == want[:12] and hashing.remembered(str(path)) == want
    hashing.remember(str(path), "f" * 64)
    assert hashing.file_hash(str(path)) == "f" * 12
    os.utime(path, (1, 1))
    assert hashing.file_hash(str(path), 20) == want[:20]
    assert hashing.cache_path("abc", "/base") == "/base/dataset-abc"


def test_which_bytes_and_types_are_images(spark):
    rows = spark.createDataFrame([(0, b"\xff\xd8\xff\xe0"), (1, b"RIFF1234WEBP"), (2, b"plain text"), (3, b""), (4, None)], "k long, data binary")
    assert [r.x for r in rows.select("k", imagebytes.is_image(F.col("data")).alias("x")).orderBy("k").collect()] == [True, True, False, False, False]
    kinds = spark.createDataFrame([], "a struct<bytes: binary, path: string>, b struct<path: string>, c binary, d struct<bytes: string, path: string>").schema
    assert [imagebytes.is_image_struct(f.dataType) for f in kinds] == [True, False, False, True]


def test_archives_in_one_folder(tmp_path):
    import tarfile

    (tmp_path / "in" / "set" / "a").mkdir(parents=True)
    (tmp_path / "in" / "set" / "a" / "1.png").write_bytes(b"x")
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        t.add(tmp_path / "in" / "set", "set")
    out = folders.extract(str(tmp_path / "x.tar"), str(tmp_path / "out"))
    assert folders.content_root(out) == str(tmp_path / "out" / "set") and folders.content_root(str(tmp_path / "out" / "set")) == str(tmp_path / "out" / "set")


def test_entry_offers_no_corpus_queries_only_where_they_are_absent(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry._corpus() == ({}, {})


@pytest.mark.parametrize("name", ["supervised_train", "supervised_val", "simclr_symmetric", "simclr_standard", "ipcl", "multicrop"])
def test_presets_give_finite_views(spark, name):
    from functools import reduce

    from prismframe.operators import jpeg
    from prismframe.plans import presets

    px = np.random.default_rng(3).integers(0, 256, (24, 32, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(k, 32, 24, bytearray(f(px))) for k, f in enumerate((kernels.encode_png, jpeg.encode))], "_idx long, width long, height long, image binary")
    options = {"size": 16} if name.startswith("supervised") else {"size": 16, "seed": 1}
    out = reduce(lambda d, f: f(d), getattr(presets, name)(**options), rows)
    views = [c for c in out.columns if c == "px" or c.endswith("_px")]
    got = out.collect()
    assert views and len(got) == 2 and all(np.isfinite(r[c]).all() and len(r[c]) % 3 == 0 for r in got for c in views)
