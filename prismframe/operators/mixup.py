"""Mixing a batch with its own reverse: slot i with slot B - 1 - i."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismframe.functions import crops, pixels
from prismframe.functions.rng import chosen, let, uniform


def paired(df: DataFrame, batch_size: int, fields: list[str]) -> DataFrame:
    """Every row with its partner's fields, as other_<field>. Both sides share the batch as join key."""
    other = df.select("_batch", (F.lit(batch_size - 1) - F.col("_slot")).alias("_slot"), *[F.col(f).alias(f"other_{f}") for f in fields])
    return df.join(other, ["_batch", "_slot"])


def mixed_pixels(px: Column, other: Column, lam: Column) -> Column:
    return F.zip_with(px, other, lambda a, b: a * lam + b * (F.lit(1.0) - lam))


def pasted(px: Column, other: Column, h: int, w: int, box: Column, channels: int = 3) -> Column:
    """other inside a box (yl, yh, xl, xh), px outside."""
    hw = h * w

    def at(x: Column, i: Column) -> Column:
        row, col = F.floor(i % hw / w), i % w
        hit = (row >= box["yl"]) & (row < box["yh"]) & (col >= box["xl"]) & (col < box["xh"])
        return F.when(hit, F.element_at(other, (i + 1).cast("int"))).otherwise(x)

    return F.transform(px, at)


def kept_share(box: Column, h: int, w: int) -> Column:
    """The weight of the own label: what the box leaves of the image."""
    return F.lit(1.0) - (box["yh"] - box["yl"]) * (box["xh"] - box["xl"]) / F.lit(float(h * w))


def target(label: Column, other: Column, classes: int, lam: Column, smoothing: float = 0.0) -> Column:
    off = smoothing / classes
    a, b = (pixels.one_hot(x, classes, 1.0 - smoothing + off, off) for x in (label, other))
    return F.zip_with(a, b, lambda x, y: x * lam + y * (F.lit(1.0) - lam))


def beta(a: float, salt: str, key: Column, tries: int = 24) -> Column:
    """A draw from Beta(a, a): of two powers of uniform draws the first pair that sums to one at most (Jöhnk). If no try fits, one half."""
    if a == 1.0:
        return uniform(salt, key)

    def attempt(k: Column) -> Column:
        draw = lambda c: F.pow(uniform(F.concat(F.lit(f"{salt}/{c}"), k.cast("string")), key), F.lit(1.0 / a))
        return let(F.struct(draw("x").alias("x"), draw("y").alias("y")), lambda t: F.when((t["x"] + t["y"] <= 1) & (t["x"] + t["y"] > 0), t["x"] / (t["x"] + t["y"])))

    first = F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("double"), lambda got, k: F.when(got.isNotNull(), got).otherwise(attempt(k)))
    return F.coalesce(first, F.lit(0.5))


def parameters(df: DataFrame, h: int, w: int, mixup_alpha: float = 0.8, cutmix_alpha: float = 1.0, minmax: tuple[float, float] | None = None, prob: float = 1.0, switch_prob: float = 0.5, correct: bool = True, salt: str = "mix") -> DataFrame:
    """df with _cut (whether a box is pasted), _box (yl, yh, xl, xh) and _lam (the weight of the own label) for each row."""
    if minmax is not None:
        cutmix_alpha = 1.0
    if mixup_alpha <= 0 and cutmix_alpha <= 0:
        raise ValueError("mixup or cutmix must be on")
    key = F.col("_idx")
    u = lambda s: uniform(f"{salt}/{s}", key)
    mixes = u("do") < prob
    cuts = chosen(switch_prob, f"{salt}/switch", key) if mixup_alpha > 0 and cutmix_alpha > 0 else F.lit(cutmix_alpha > 0)
    lam = F.when(cuts, beta(cutmix_alpha, f"{salt}/cut", key)).otherwise(beta(mixup_alpha, f"{salt}/lam", key)) if mixup_alpha > 0 and cutmix_alpha > 0 else beta(max(mixup_alpha, cutmix_alpha), f"{salt}/cut" if cutmix_alpha > 0 else f"{salt}/lam", key)
    df = df.withColumn("_mix", mixes).withColumn("_cut", mixes & cuts).withColumn("_lam", F.when(mixes, lam).otherwise(F.lit(1.0)))
    if minmax is None:
        box = crops.cutout(h, w, F.col("_lam"), F.floor(u("cy") * h), F.floor(u("cx") * w))
    else:
        box = crops.cutout_between(h, w, minmax, *(u(s) for s in ("bh", "bw", "cy", "cx")))
    df = df.withColumn("_box", F.when(F.col("_cut"), box))
    if correct or minmax is not None:
        df = df.withColumn("_lam", F.when(F.col("_cut"), kept_share(F.col("_box"), h, w)).otherwise(F.col("_lam")))
    return df.drop("_mix")


def mix(df: DataFrame, batch_size: int, h: int, w: int, classes: int, px: str = "px", label: str = "label", smoothing: float = 0.0, channels: int = 3, **options) -> DataFrame:
    """Planned rows (_batch, _slot) with px and label mixed with their partner's: a share of all pixels, or a box pasted, drawn for each row."""
    if batch_size % 2:
        raise ValueError("batches must be even")
    for c in (px, label):
        if c not in df.columns:
            raise KeyError(c)
    both = parameters(paired(df, batch_size, [px, label]), h, w, **options)
    a, b, lam = F.col(px), F.col(f"other_{px}"), F.col("_lam")
    image = F.when(F.col("_cut"), pasted(a, b, h, w, F.col("_box"), channels)).when(lam < 1, mixed_pixels(a, b, lam)).otherwise(a)
    return both.select("*", image.alias("_px"), target(F.col(label), F.col(f"other_{label}"), classes, lam, smoothing).alias("_target")).drop(px, label, f"other_{px}", f"other_{label}").withColumnsRenamed({"_px": px, "_target": label})
