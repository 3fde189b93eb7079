"""Named pipelines: lists of steps from images to normalised views, with the random parameters as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismframe.functions import pixels
from prismframe.functions.rng import between, chosen, uniform
from prismframe.operators import kernels
from prismframe.operators.stages import Step, batch_kernel, multi_crop, random_resized_crop, resize_crop, to_float

#: What is added to a base seed for each kind of draw.
OFFSETS = {"crop": 1234, "flip": 1111, "color": 2222, "gray": 3333, "solar": 4444, "blur": 5555}


def salt(base: int | None, kind: str, view: int = 0) -> str:
    return f"{kind}/{(base or 0) + OFFSETS[kind] + view}"


def normalise(column: str, size: int) -> Step:
    return lambda df: df.withColumn(column, pixels.normalized(F.col(column), size * size))


def flip(column: str, size: int, s: str, p: float = 0.5) -> Step:
    return lambda df: df.withColumn(column, F.when(chosen(p, s, "_idx"), pixels.hflip(F.col(column), size, size)).otherwise(F.col(column)))


def jitter(column: str, size: int, s: str, p: float = 0.8) -> Step:
    """Hue, saturation and value about their middle, in YIQ."""
    m = pixels.bound(pixels.jitter_rows, between(-36, 36, uniform(s + "/h", "_idx")), between(0.6, 1.4, uniform(s + "/s", "_idx")), between(0.6, 1.4, uniform(s + "/v", "_idx")))
    turned = lambda: pixels.each(pixels.mixed(F.col(column), size * size, pixels.held(F.col("_m"))), pixels.clamp)
    return lambda df: df.withColumn("_m", m).withColumn(column, F.when(chosen(p, s, "_idx"), turned()).otherwise(F.col(column))).drop("_m")


def gray(column: str, size: int, s: str, p: float = 0.2) -> Step:
    return lambda df: df.withColumn(column, F.when(chosen(p, s, "_idx"), pixels.grayscale(F.col(column), size * size, 3)).otherwise(F.col(column)))


def solarise(column: str, s: str, p: float = 0.2) -> Step:
    return lambda df: df.withColumn(column, F.when(chosen(p, s, "_idx"), pixels.solarize(F.col(column))).otherwise(F.col(column)))


def blurred(column: str, size: int, s: str, p: float = 0.5) -> Step:
    """sigma is a column: null where the draw leaves the image alone."""
    draw = F.when(chosen(p, s, "_idx"), between(0.1, 2.0, uniform(s + "/sigma", "_idx")))
    kernel = batch_kernel(column, (3, size, size), lambda px, sigmas: kernels.blur_all(px, sigmas.astype(float)), f"{column}_sigma")
    return lambda df: kernel(df.withColumn(f"{column}_sigma", draw))


def supervised_train(size: int = 224, seed: int | None = None) -> list[Step]:
    return [random_resized_crop(size, salt=salt(seed, "crop")), to_float("view", size), normalise("px", size)]


def supervised_val(size: int = 224) -> list[Step]:
    return [resize_crop(256 * size // 224, size), to_float("view", size), normalise("px", size)]


def _view(name: str, k: int, size: int, seed: int | None, solar: float = 0.0, blur: float = 0.5, late_blur: bool = False) -> list[Step]:
    px = f"{name}_px"
    steps = [to_float(name, size, px), flip(px, size, salt(seed, "flip", k)), jitter(px, size, salt(seed, "color", k)), gray(px, size, salt(seed, "gray", k))]
    if solar:
        steps.append(solarise(px, salt(seed, "solar", k), solar))
    tail = [blurred(px, size, salt(seed, "blur", k), blur), normalise(px, size)]
    return steps + (tail[::-1] if late_blur else tail)


def simclr_symmetric(size: int = 224, seed: int | None = None) -> list[Step]:
    crop = multi_crop({f"view_{k}": {"size": size, "salt": salt(seed, "crop", k)} for k in range(2)})
    return [crop, *(s for k in range(2) for s in _view(f"view_{k}", k, size, seed))]


def simclr_standard(size: int = 224, seed: int | None = None) -> list[Step]:
    crop = multi_crop({f"view_{k}": {"size": size, "salt": salt(seed, "crop", k)} for k in range(2)})
    return [crop, *_view("view_0", 0, size, seed, blur=1.0, late_blur=True), *_view("view_1", 1, size, seed, solar=0.2, blur=0.1)]


def ipcl(crops: int = 5, size: int = 224, seed: int | None = None) -> list[Step]:
    crop = multi_crop({f"crop_{k}": {"size": size, "scale": (0.2, 1.0), "salt": salt(seed, "crop", k)} for k in range(crops)}, (1.0, 1.0))
    return [crop, *(s for k in range(crops) for s in _view(f"crop_{k}", k, size, seed, blur=0.2, late_blur=True))]


def multicrop(large: int = 2, small: int = 4, size: int = 224, small_size: int | None = None, large_scale=(0.3, 1.0), small_scale=(0.05, 0.3), seed: int | None = None) -> list[Step]:
    small_size = small_size or int(0.4375 * size)
    views = {f"global_{k}": {"size": size, "scale": large_scale, "salt": salt(seed, "crop", k)} for k in range(large)}
    views |= {f"local_{k}": {"size": small_size, "scale": small_scale, "salt": salt(seed, "crop", large + k)} for k in range(small)}
    return [multi_crop(views, (1.0, 1.0)), *(s for k, (n, v) in enumerate(views.items()) for s in _view(n, k, v["size"], seed))]


lejepa = multicrop
