"""Decoding, resampling and drawn stages against other decoders and values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.operators import jpeg, kernels, mixup, stages


def smooth(h: int, w: int, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    y, x = np.meshgrid(np.linspace(0, 3, h), np.linspace(0, 3, w), indexing="ij")
    waves = [np.sin(x * a + b) * np.cos(y * c) for a, b, c in r.uniform(0.5, 2, (3, 3))]
    return np.clip(128 + 110 * np.stack(waves, -1), 0, 255).astype(np.uint8)


def java_encoded(spark, px: np.ndarray, quality: float, gray: bool = False, progressive: bool = False) -> bytes:
    """A JPEG as the JVM's own writer makes it (chroma at half size)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    h, w = px.shape[:2]
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if gray else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    flat = gateway.new_array(gateway.jvm.int, h * w * (1 if gray else 3))
    for k, v in enumerate((px[..., 0] if gray else px).ravel().tolist()):
        flat[k] = v
    image.getRaster().setPixels(0, 0, w, h, flat)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    params = writer.getDefaultWriteParam()
    params.setCompressionMode(2)
    params.setCompressionQuality(quality)
    if progressive:
        params.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    writer.dispose()
    return bytes(out.toByteArray())


def java_decoded(spark, folder, images: dict[str, bytes]) -> dict[str, np.ndarray]:
    for name, data in images.items():
        (folder / f"{name}.jpg").write_bytes(data)
    rows = spark.read.format("image").load(str(folder)).select("image.*").collect()
    out = {}
    for r in rows:
        px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        out[r.origin.split("/")[-1][:-4]] = np.repeat(px, 3, 2) if r.nChannels == 1 else px[..., ::-1]
    return out


def test_jpeg_against_the_jvm_decoder(spark, tmp_path):
    cases = {"java_a": java_encoded(spark, smooth(37, 50), 0.9), "java_b": java_encoded(spark, smooth(16, 16, 1), 0.5), "gray": java_encoded(spark, smooth(21, 33, 2), 0.8, True), "one": java_encoded(spark, smooth(1, 1, 3), 0.9)}
    cases |= {f"own_{k}": jpeg.encode(smooth(9 + 7 * k, 40 - 5 * k, k), 1 + 3 * k) for k in range(4)}
    cases["noise"] = jpeg.encode(np.random.default_rng(1).integers(0, 256, (24, 24, 3)).astype(np.uint8), 2)
    want = java_decoded(spark, tmp_path, cases)
    got = dict(zip(cases, jpeg.decode(list(cases.values()))))
    for name, px in want.items():
        assert got[name].shape == px.shape, name
        assert np.abs(got[name].astype(int) - px.astype(int)).max() <= 4, name
    assert np.abs(got["own_0"].astype(int) - smooth(9, 40)).max() <= 3


def with_restarts(px: np.ndarray) -> bytes:
    """The same image as two restart intervals: its halves' scans with a marker between them."""
    top, bottom = jpeg.encode(px[:8]), jpeg.encode(px[8:])
    head, scan = top.split(b"\xff\xda", 1)
    size = head.index(b"\xff\xc0") + 5
    head = head[:size] + px.shape[0].to_bytes(2, "big") + head[size + 2 :]
    restart = b"\xff\xdd\x00\x04" + (-(-px.shape[1] // 8)).to_bytes(2, "big")
    return head + restart + b"\xff\xda" + scan[:-2] + b"\xff\xd0" + bottom.split(b"\xff\xda", 1)[1][12:]


def test_jpeg_restart_intervals_and_batches(monkeypatch):
    px = smooth(16, 24, 5)
    whole, parts = jpeg.decode([jpeg.encode(px), with_restarts(px)])
    assert np.array_equal(whole, parts)
    monkeypatch.setattr(jpeg, "BATCH_BLOCKS", 5)
    assert all(np.array_equal(a, whole) for a in jpeg.decode([jpeg.encode(px)] * 3))
    assert jpeg.decode([]) == []


def test_jpeg_that_cannot_be_decoded_raises(spark):
    data = jpeg.encode(smooth(8, 8))
    for bad in (b"\xff\xd8\xff\xd9", b"", data[:-40], java_encoded(spark, smooth(16, 16), 0.9, progressive=True)):
        with pytest.raises(ValueError):
            jpeg.decode([bad])
    assert kernels.image_end(data + b"junk") == len(data) and kernels.image_end(b"plain") == 5


def test_solid_and_gradient_jpegs_through_the_stages(spark):
    solid = np.full((20, 30, 3), (200, 100, 50), np.uint8)
    ramp = np.repeat(np.arange(0, 240, 8, dtype=np.uint8)[None, :, None], 20, 0).repeat(3, 2)
    rows = [(0, 30, 20, bytearray(jpeg.encode(solid))), (1, 30, 20, bytearray(jpeg.encode(ramp))), (2, 30, 20, None), (3, 30, 20, bytearray(kernels.encode_png(solid)))]
    table = spark.createDataFrame(rows, "_idx long, width long, height long, image binary")
    got = {r._idx: None if r.view is None else np.frombuffer(r.view, np.uint8).reshape(8, 8, 3).astype(int) for r in stages.centre_crop(8)(table).collect()}
    assert np.abs(got[0] - (200, 100, 50)).max() <= 2 and got[2] is None and np.abs(got[0] - got[3]).max() <= 2
    assert np.abs(got[1] - ramp[6:14, 11:19]).max() <= 2
    yuv = {r._idx: r.view for r in stages.centre_crop(8, rgb=False)(table).collect()}
    assert np.abs(np.frombuffer(yuv[0], np.uint8).reshape(-1, 3).astype(int) - (124, 86, 182)).max() <= 2 and yuv[2] is None
    assert np.abs(np.frombuffer(stages.resize_crop(16, 8)(table).where("_idx = 0").first().view, np.uint8).reshape(-1, 3).astype(int) - (200, 100, 50)).max() <= 2


def test_cubic_resize():
    flat = np.full((9, 7, 3), 77, np.uint8)
    assert (kernels.crop_resize(flat, 1, 2, 5, 6, 13) == 77).all() and (kernels.crop_resize(flat, 0, 0, 7, 9, 3) == 77).all()
    px = smooth(8, 8)
    assert np.array_equal(kernels.crop_resize(px, 0, 0, 8, 8, 8), px)
    # Catmull-Rom at a quarter: -9, 111, 29, -3 of 128.
    line = np.repeat(np.array([0, 0, 128, 0, 0], np.uint8)[None, :, None], 5, 0).repeat(3, 2)
    assert kernels.crop_resize(line, 0, 0, 5, 5, 10)[0, :, 0].tolist() == [0, 0, 0, 29, 111, 111, 29, 0, 0, 0]


def test_distortion_by_hand():
    px = np.arange(16.0).reshape(1, 4, 4)
    # In the middle of 4 x 4, place (2, 2) has radius 0 and maps to itself, half a pixel off its sample.
    got = kernels.distort(px)
    assert got[0, 2, 2] == (px[0, 1, 1] + px[0, 1, 2] + px[0, 2, 1] + px[0, 2, 2]) / 4
    # (0, 0): r^2 = 0.5, factor 1 - 0.25 - 0.125 = 0.625: at -0.3125 of the side, or 0.75 pixels, less the half.
    assert np.isclose(got[0, 0, 0], 0.25 + 4 * 0.25)
    assert np.allclose(kernels.distort(px, 0.0)[0, 1:, 1:], (px[0, 1:, 1:] + px[0, :-1, 1:] + px[0, 1:, :-1] + px[0, :-1, :-1]) / 4)


def test_circle_mask_falls_to_its_tolerance():
    m = kernels.circle_mask(64, 8.0)
    sigma = 8.0
    while np.exp(-(8.0**2) / (2 * sigma**2)) > 5e-4:
        sigma *= 0.975
    assert m[32, 32] == 1 and m.shape == (64, 64)
    assert np.isclose(m[0, 0], np.exp(-((np.hypot(31.5, 31.5) - 24) ** 2) / (2 * sigma**2)))
    assert np.isclose(m[31, 4], np.exp(-((np.hypot(27.5, 0.5) - 24) ** 2) / (2 * sigma**2)))


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(0)
    rows = [(k, k // 4, k % 4, int(r.integers(0, 10)), r.random(48).tolist()) for k in range(40)] + [(40, 10, 0, 0, None)]
    return spark.createDataFrame(rows, "_idx long, _batch long, _slot long, label long, px array<double>")


def test_drawn_stages_replay_and_keep_nulls(small):
    shape = (3, 4, 4)
    for step in (stages.random_rotate("px", shape, keep=True), stages.random_zoom("px", shape, keep=True), stages.random_patch_shuffle("px", shape, [0.25, 0.5], 1.0, keep=True), stages.random_embed("px", shape, 6, (0, 1), (0, 1), "noise", alpha_range=(1.0, 2.0), p_fade=0.5, keep=True)):
        a, b = ({r._idx: r.px for r in step(small).collect()} for _ in range(2))
        assert a == b and a[40] is None and len({len(v) for v in a.values() if v is not None}) == 1
    px = {r._idx: sorted(r.px) for r in small.where("px is not null").collect()}
    assert all(sorted(r.px) == px[r._idx] for r in stages.random_patch_shuffle("px", shape, [0.25, 0.5], 1.0)(small.where("px is not null")).collect())
    assert {r._idx: r.px for r in stages.random_rotate("px", shape, 0.0)(small).collect()}[3] == pytest.approx(small.where("_idx = 3").first().px)
    assert stages.random_rotate("px", shape)(small).columns == small.columns


def test_random_apply_takes_whole_batches(small):
    half = stages.random_apply([lambda df: df.withColumn("px", F.lit(None).cast("array<double>"))], 0.5)
    by_batch = {}
    for r in half(small.where("px is not null")).collect():
        by_batch.setdefault(r._batch, set()).add(r.px is None)
    assert all(len(v) == 1 for v in by_batch.values()) and {True} in by_batch.values() and {False} in by_batch.values()


def test_views_on_a_canvas(spark):
    rows = spark.createDataFrame([(0, 30, 20, bytearray(jpeg.encode(np.full((20, 30, 3), 90, np.uint8)))), (1, 30, 20, None)], "_idx long, width long, height long, image binary")
    got = {r._idx: r for r in stages.multi_crop_embed({"a": {"size": 6, "sizes": (8, 12)}, "b": {"size": 4}}, 10, (0, 1), (0, 1), 3)(rows).collect()}
    a, place = np.frombuffer(got[0].a, np.uint8).reshape(10, 10, 4), got[0].a_place
    inside = np.zeros((10, 10), bool)
    inside[place.y : place.y + place.h, place.x : place.x + place.w] = True
    assert (a[..., 3] == np.where(inside, 255, 0)).all() and np.abs(a[inside][:, :3].astype(int) - 90).max() <= 1 and got[1].a is None


def test_mixing_wants_even_batches_and_known_columns(small):
    with pytest.raises(ValueError):
        mixup.mix(small, 3, 4, 4, 10)
    with pytest.raises(KeyError):
        mixup.mix(small, 4, 4, 4, 10, px="none")
    with pytest.raises(ValueError):
        mixup.parameters(small, 4, 4, 0.0, 0.0)
    whole = small.where("px is not null")
    out = mixup.mix(whole, 4, 4, 4, 10, mixup_alpha=0.8, cutmix_alpha=1.0, minmax=(0.25, 0.75))
    rows = out.collect()
    assert len(rows) == 40 and all(abs(sum(r.label) - 1) < 1e-9 and 0 <= r._lam <= 1 for r in rows) and {r._cut for r in rows} == {True, False}
    draws = whole.select(mixup.beta(0.5, "b", F.col("_idx")).alias("x")).collect()
    assert all(0 <= r.x <= 1 for r in draws)


def test_blur_of_a_batch_is_that_of_its_images():
    r = np.random.default_rng(4)
    px, sigmas = r.random((150, 3, 8, 9)), r.uniform(0.1, 2, 150)
    sigmas[::7] = np.nan
    assert all((a == (p if np.isnan(s) else kernels.blur(p, s))).all() for a, p, s in zip(kernels.blur_all(px, sigmas), px, sigmas))
