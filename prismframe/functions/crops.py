"""Crop geometry: rectangles (x, y, w, h) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismframe.functions.rng import between, let, uniform

#: Decode scales, least first.
SCALES = ((1, 8), (1, 4), (3, 8), (1, 2), (5, 8), (3, 4), (7, 8), (1, 1))


def whole(x: Column) -> Column:
    """Rounded half up, as a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def halved(x: Column) -> Column:
    return F.floor(x / 2).cast("long")


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def align(value: Column, size: int = 8, up: bool = False) -> Column:
    return ((F.ceil if up else F.floor)(value / size) * size).cast("long")


def centre(w: Column, h: Column, size: int | Column) -> Column:
    s = F.least(F.lit(size) if isinstance(size, int) else size, w, h)
    return rect(halved(w - s), halved(h - s), s, s)


def aligned(r: Column, w: Column, h: Column, size: int = 8) -> Column:
    """A rectangle moved out to block borders: its place down, its end up, within the image."""

    def moved(r: Column) -> Column:
        x, y = align(r["x"], size), align(r["y"], size)
        return rect(x, y, F.least(align(r["w"] + r["x"] - x, size, True), w - x), F.least(align(r["h"] + r["y"] - y, size, True), h - y))

    return let(r, moved)


def about(cx: Column, cy: Column, w: Column, h: Column, cw: Column, ch: Column) -> Column:
    """A rectangle about a fractional centre, pushed inside the image: equal centres with other scales stay together."""
    x = F.least(F.greatest(cx * w, cw / 2), w - cw / 2) - cw / 2
    y = F.least(F.greatest(cy * h, ch / 2), h - ch / 2) - ch / 2
    return rect(F.least(F.greatest(whole(x), F.lit(0)), w - cw), F.least(F.greatest(whole(y), F.lit(0)), h - ch), cw, ch)


def random_resized(w: Column, h: Column, key: Column, salt: str = "rrc", scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3), attempts: int = 10) -> Column:
    """Up to ten tries of area and aspect; else the middle square."""
    cx, cy = uniform(f"{salt}/cx", key), uniform(f"{salt}/cy", key)

    def attempt(k: Column) -> Column:
        area = w * h * between(*scale, uniform(F.concat(F.lit(f"{salt}/s"), k.cast("string")), key))
        aspect = F.exp(between(math.log(ratio[0]), math.log(ratio[1]), uniform(F.concat(F.lit(f"{salt}/r"), k.cast("string")), key)))
        return let(F.struct(area.alias("a"), aspect.alias("r")), lambda t: F.struct(whole(F.sqrt(t["a"] * t["r"])).alias("w"), whole(F.sqrt(t["a"] / t["r"])).alias("h")))

    # A try is drawn only where none before it fits.
    fits = lambda c: (c["w"] > 0) & (c["w"] <= w) & (c["h"] > 0) & (c["h"] <= h)
    first = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), F.lit(None).cast("struct<w:bigint,h:bigint>"), lambda got, k: F.when(got.isNotNull(), got).otherwise(let(attempt(k), lambda c: F.when(fits(c), c))))
    return let(first, lambda c: F.when(c.isNull(), centre(w, h, F.least(w, h))).otherwise(about(cx, cy, w, h, c["w"], c["h"])))


def direct_resized(w: Column, h: Column, key: Column, salt: str = "rrc", scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3)) -> Column:
    """No tries: aspect from the feasible interval, then area up to what that aspect allows."""
    cx, cy = uniform(f"{salt}/cx", key), uniform(f"{salt}/cy", key)
    wf, hf = w.cast("double"), h.cast("double")
    least_r = F.greatest(F.lit(float(ratio[0])), wf * scale[0] / hf)
    most_r = F.least(F.lit(float(ratio[1])), wf / (hf * scale[0]))

    def area_of(r: Column) -> Column:
        most = F.greatest(F.least(F.lit(float(scale[1])), wf / hf / r, hf * r / wf), F.lit(float(scale[0])))
        return wf * hf * (F.lit(float(scale[0])) + uniform(f"{salt}/s", key) * (most - F.lit(float(scale[0]))))

    def size_of(t: Column) -> Column:
        cw = F.greatest(F.least(whole(F.sqrt(t["a"] * t["r"])), w), F.lit(1))
        ch = F.greatest(F.least(whole(F.sqrt(t["a"] / t["r"])), h), F.lit(1))
        return F.struct(cw.alias("w"), ch.alias("h"))

    aspect = let(F.struct(F.ln(least_r).alias("low"), F.ln(most_r).alias("high")), lambda t: F.exp(t["low"] + uniform(f"{salt}/r", key) * (t["high"] - t["low"])))
    placed = let(let(let(aspect, lambda r: F.struct(area_of(r).alias("a"), r.alias("r"))), size_of), lambda c: about(cx, cy, w, h, c["w"], c["h"]))
    return F.when(least_r > most_r, centre(w, h, F.least(w, h))).otherwise(placed)


def short_edge_scale(w: Column, h: Column, target: Column) -> Column:
    return F.when(h < w, target / h).otherwise(target / w)


def inside(x: Column, y: Column, cw: Column, ch: Column, w: Column, h: Column) -> Column:
    x, y = F.least(F.greatest(x, F.lit(0)), w - 1), F.least(F.greatest(y, F.lit(0)), h - 1)
    return rect(x, y, F.greatest(F.least(cw, w - x), F.lit(1)), F.greatest(F.least(ch, h - y), F.lit(1)))


def _resized(w: Column, h: Column, target: Column) -> tuple[Column, Column, Column]:
    s = short_edge_scale(w, h, target)
    return s, F.when(h < w, whole(w * s)).otherwise(target.cast("long")), F.when(h < w, target.cast("long")).otherwise(whole(h * s))


def short_crop_long(w: Column, h: Column, target: Column, x_at: Column, y_at: Column) -> Column:
    """Short edge to `target`, a square slid along the long edge, in source coordinates."""
    s, nw, nh = _resized(w, h, target)
    x0 = F.floor(x_at * F.greatest(nw - target, F.lit(0)))
    y0 = F.floor(y_at * F.greatest(nh - target, F.lit(0)))
    return inside(whole(x0 / s), whole(y0 / s), whole(target / s), whole(target / s), w, h)


def resize_centre(w: Column, h: Column, resize: int = 256, crop: int = 224) -> Column:
    """Short edge to `resize`, middle square of `crop`, in source coordinates."""
    s, nw, nh = _resized(w, h, F.lit(resize))
    cw, ch = F.least(F.lit(crop), nw), F.least(F.lit(crop), nh)
    return inside(whole(halved(nw - cw) / s), whole(halved(nh - ch) / s), whole(cw / s), whole(ch / s), w, h)


def embed_rect(cw: Column, ch: Column, canvas: int, x_at: Column, y_at: Column) -> Column:
    x, y = F.floor(x_at * F.greatest(F.lit(canvas) - cw, F.lit(0))), F.floor(y_at * F.greatest(F.lit(canvas) - ch, F.lit(0)))
    return rect(x, y, F.least(cw, F.lit(canvas) - x), F.least(ch, F.lit(canvas) - y))


def embed_centre(cw: Column, ch: Column, canvas: int, cx: Column, cy: Column) -> Column:
    """Placed about a point, what overhangs cut off; null where nothing is left."""
    x, y = cx - halved(cw), cy - halved(ch)
    dx, dy = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    w, h = F.least(cw - F.greatest(-x, F.lit(0)), F.lit(canvas) - dx), F.least(ch - F.greatest(-y, F.lit(0)), F.lit(canvas) - dy)
    return F.when((w > 0) & (h > 0), rect(dx, dy, w, h))


def best_scale(source: Column, target: int) -> Column:
    """The least decode scale whose result is not smaller than the target; else 1/1."""
    options = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(d).cast("long").alias("d")) for n, d in SCALES])
    fits = F.filter(options, lambda s: F.floor(source * s["n"] / s["d"]) >= target)
    return F.coalesce(F.get(fits, F.lit(0)), options[len(SCALES) - 1])


def cutout(h: int, w: int, lam: Column, cy: Column, cx: Column) -> Column:
    """(yl, yh, xl, xh) of the box whose share of the image is 1 - lam, cut at its borders."""
    cut = F.sqrt(F.greatest(F.least(F.lit(1.0) - lam, F.lit(1.0)), F.lit(0.0)))
    ch, cw = halved(F.floor(F.lit(h) * cut)), halved(F.floor(F.lit(w) * cut))
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("long")
    return F.struct(clip(cy - ch, h).alias("yl"), clip(cy + ch, h).alias("yh"), clip(cx - cw, w).alias("xl"), clip(cx + cw, w).alias("xh"))


def cutout_between(h: int, w: int, share: tuple[float, float], uh: Column, uw: Column, uy: Column, ux: Column) -> Column:
    """(yl, yh, xl, xh) of a box whose sides are drawn between shares of the image's, placed anywhere in it."""
    side = lambda n, u: int(n * share[0]) + F.floor(u * (max(int(n * share[1]), int(n * share[0]) + 1) - int(n * share[0])))

    def placed(t: Column) -> Column:
        low = lambda n, size, u: F.floor(u * F.greatest(F.lit(n) - size, F.lit(0))).cast("long")
        y, x = low(h, t["h"], uy), low(w, t["w"], ux)
        return F.struct(y.alias("yl"), F.least(y + t["h"], F.lit(h)).cast("long").alias("yh"), x.alias("xl"), F.least(x + t["w"], F.lit(w)).cast("long").alias("xh"))

    return let(F.struct(side(h, uh).alias("h"), side(w, uw).alias("w")), placed)


def centre_share(w: Column, h: Column, share: float) -> Column:
    """The middle square whose side is a share of the shorter edge."""
    return centre(w, h, F.greatest(F.floor(F.least(w, h) * share), F.lit(1)))
