"""Point-wise operators on pixels: `px` is a flat channel-first array<double> in [0, 1], `hw` its pixels a channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismframe.functions.rng import let

#: Luma weights, the YIQ matrix, sRGB to cone responses, ImageNet statistics.
LUMA = (0.2989, 0.587, 0.114)
YIQ = ((0.299, 0.587, 0.114), (0.596, -0.274, -0.321), (0.211, -0.523, 0.311))
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: The same for the five channels of centre and surround responses.
LGN_MEAN, LGN_STD = (0.2,) * 5, (0.2,) * 5


def clamp(x: Column, top: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(float(top)))


def each(px: Column, f) -> Column:
    return F.transform(px, lambda x: f(x))


def channel(px: Column, c: int, hw: int) -> Column:
    return F.slice(px, c * hw + 1, hw)


def joined(*channels: Column) -> Column:
    return F.concat(*channels)


def remap(px: Column, count: int, source) -> Column:
    """source(i): which old pixel stands at i."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(px, (source(i) + 1).cast("int")))


def divided(px: Column, by: float) -> Column:
    return each(px, lambda x: x / F.lit(float(by)))


def normalized(px: Column, hw: int, mean=MEAN, std=STD) -> Column:
    return joined(*[each(channel(px, c, hw), lambda x, m=m, s=s: (x - F.lit(m)) / F.lit(s)) for c, (m, s) in enumerate(zip(mean, std))])


def mixed(px: Column, hw: int, rows) -> Column:
    """Every pixel's colour times a 3 x 3 matrix; rows: numbers or columns."""
    num = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    r, g, b = (channel(px, c, hw) for c in range(3))
    rgb = F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))
    times = lambda m: lambda p: p["r"] * num(m[0]) + p["g"] * num(m[1]) + p["b"] * num(m[2])
    return joined(*[F.transform(rgb, times(m)) for m in rows])


def luma(px: Column, hw: int) -> Column:
    r, g, b = (channel(px, c, hw) for c in range(3))
    return F.zip_with(F.zip_with(r, g, lambda x, y: x * LUMA[0] + y * LUMA[1]), b, lambda x, y: x + y * LUMA[2])


def grayscale(px: Column, hw: int, channels: int = 1) -> Column:
    return joined(*[luma(px, hw)] * channels)


def brightness(px: Column, factor: Column, top: float = 1.0) -> Column:
    return each(px, lambda x: clamp(x * factor, top))


def mean_of(xs: Column, count: int) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.lit(float(count))


def contrast(px: Column, hw: int, factor: Column, top: float = 1.0) -> Column:
    m = mean_of(luma(px, hw), hw)
    return each(px, lambda x: clamp(m * (F.lit(1.0) - factor) + x * factor, top))


def saturation(px: Column, hw: int, factor: Column) -> Column:
    return F.zip_with(px, grayscale(px, hw, 3), lambda x, g: clamp(x * factor + g * (F.lit(1.0) - factor)))


def solarize(px: Column, threshold: float = 0.5) -> Column:
    return each(px, lambda x: F.when(x >= threshold, F.lit(1.0) - x).otherwise(x))


def linear(px: Column) -> Column:
    """sRGB to linear light."""
    return each(px, lambda x: F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92))


# --- hue, saturation, value --------------------------------------------------------


def _hsv(p: Column) -> Column:
    top, low = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])

    def of(t: Column) -> Column:
        spread = F.when(t["top"] == t["low"], F.lit(1.0)).otherwise(t["top"] - t["low"])
        from_top = lambda c: (t["top"] - p[c]) / spread
        hue = F.when(t["top"] == p["r"], from_top("b") - from_top("g")).when(t["top"] == p["g"], F.lit(2.0) + from_top("r") - from_top("b")).otherwise(F.lit(4.0) + from_top("g") - from_top("r"))
        most = F.when(t["top"] == t["low"], F.lit(1.0)).otherwise(t["top"])
        return F.struct(((hue / 6 + 1.0) % 1.0).alias("h"), ((t["top"] - t["low"]) / most).alias("s"), t["top"].alias("v"))

    return let(F.struct(top.alias("top"), low.alias("low")), of)


def _rgb(c: Column) -> Column:
    place = F.floor(c["h"] * 6)

    def of(t: Column) -> Column:
        p = clamp(c["v"] * (F.lit(1.0) - c["s"]))
        q = clamp(c["v"] * (F.lit(1.0) - c["s"] * t["f"]))
        u = clamp(c["v"] * (F.lit(1.0) - c["s"] * (F.lit(1.0) - t["f"])))
        v = c["v"]
        pick = lambda *xs: F.when(t["i"] == 0, xs[0]).when(t["i"] == 1, xs[1]).when(t["i"] == 2, xs[2]).when(t["i"] == 3, xs[3]).when(t["i"] == 4, xs[4]).otherwise(xs[5])
        return F.struct(pick(v, q, p, p, u, v).alias("r"), pick(u, v, v, q, p, p).alias("g"), pick(p, p, u, v, v, q).alias("b"))

    return let(F.struct(F.pmod(place, F.lit(6)).alias("i"), (c["h"] * 6 - place).alias("f")), of)


def _by_pixel(px: Column, hw: int, names: str, f, out: str) -> Column:
    """f over the pixels as structs of three channels; the channels of its result, end to end."""
    channels = [channel(px, c, hw) for c in range(3)]
    done = F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(channels, names)]), lambda p: f(p))
    return let(done, lambda d: joined(*[d[n] for n in out]))


def to_hsv(px: Column, hw: int) -> Column:
    """Hue as a share of the circle, saturation and value."""
    return _by_pixel(px, hw, "rgb", _hsv, "hsv")


def from_hsv(px: Column, hw: int) -> Column:
    return _by_pixel(px, hw, "hsv", _rgb, "rgb")


def hue_shifted(px: Column, hw: int, by: Column) -> Column:
    """Hue moved by a share of the circle, from -0.5 to 0.5."""
    moved = lambda c: F.struct(((c["h"] + by) % 1.0).alias("h"), c["s"].alias("s"), c["v"].alias("v"))
    return _by_pixel(px, hw, "rgb", lambda p: let(let(_hsv(p), moved), _rgb), "rgb")


def blended(a: Column, b: Column, ratio: Column, top: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: clamp(x * ratio + y * (F.lit(1.0) - ratio), top))


def colour_jitter(px: Column, hw: int, hue: Column | None = None, sat: Column | None = None, bright: Column | None = None, con: Column | None = None) -> Column:
    """Brightness, contrast, saturation and hue, in this order; None leaves one out."""
    held = lambda step: let(px, lambda x: step(x))  # noqa: E731  each step's images are worked out once
    px = px if bright is None else held(lambda x: brightness(x, bright))
    px = px if con is None else held(lambda x: contrast(x, hw, con))
    px = px if sat is None else held(lambda x: saturation(x, hw, sat))
    return px if hue is None else held(lambda x: hue_shifted(x, hw, hue))


def twisted(px: Column, hw: int, rows, bright: Column, con: Column) -> Column:
    """A YIQ jitter matrix, then contrast about one half, then brightness."""
    offset = (F.lit(0.5) - con * 0.5) * bright
    return each(mixed(px, hw, rows), lambda x: clamp(x * (bright * con) + offset))


def rescaled(px: Column, top_from: float, top_to: float) -> Column:
    """Values of one number type as another's: their greatest values meet; to whole numbers, cut off below the next one."""
    if top_to == 1.0:
        return each(px, lambda x: x / F.lit(float(top_from)))
    if top_from == 1.0:
        return each(px, lambda x: F.floor(x * F.lit(top_to + 1.0 - 1e-3)).cast("double"))
    ratio = (top_to + 1) / (top_from + 1)
    return each(px, lambda x: F.floor(x * F.lit(float(ratio))).cast("double"))


def hflip(px: Column, h: int, w: int, channels: int = 3) -> Column:
    return remap(px, channels * h * w, lambda i: i - i % w + (F.lit(w - 1) - i % w))


def vflip(px: Column, h: int, w: int, channels: int = 3) -> Column:
    hw = h * w
    return remap(px, channels * hw, lambda i: i - i % hw + (F.lit(h - 1) - F.floor(i % hw / w)) * w + i % w)


def channels_last(px: Column, hw: int, channels: int = 3) -> Column:
    return remap(px, channels * hw, lambda i: i % channels * hw + F.floor(i / channels))


def channels_first(px: Column, hw: int, channels: int = 3) -> Column:
    return remap(px, channels * hw, lambda i: i % hw * channels + F.floor(i / hw))


def where_inside(px: Column, h: int, w: int, x0: Column, y0: Column, rw: Column, rh: Column, value, channels: int = 3) -> Column:
    """value(channel, old) inside a rectangle, the old pixels outside."""
    hw = h * w

    def at(x: Column, i: Column) -> Column:
        col, row = i % w, F.floor(i % hw / w)
        hit = (col >= x0) & (col < x0 + rw) & (row >= y0) & (row < y0 + rh)
        return F.when(hit, value(F.floor(i / hw), x)).otherwise(x)

    return F.transform(px, at)


def padded(px: Column, h: int, w: int, left: int, top: int, right: int, bottom: int, mode: str = "constant", fill: float = 0.0, channels: int = 3) -> Column:
    """constant, edge, reflect or symmetric borders."""
    nh, nw = h + top + bottom, w + left + right

    def fold(v: Column, n: int) -> Column:
        if mode == "edge":
            return F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
        if mode == "reflect":
            return F.lit(n - 1) - F.abs(F.lit(n - 1) - F.abs(v))
        if mode == "symmetric":
            low = F.when(v < 0, -v - 1).otherwise(v)
            return F.when(low >= n, F.lit(2 * n - 1) - low).otherwise(low)
        return v

    def at(i: Column) -> Column:
        c, row, col = F.floor(i / (nh * nw)), F.floor(i % (nh * nw) / nw) - top, i % nw - left
        r, k = fold(row, h), fold(col, w)
        place = F.least(F.greatest(c * h * w + r * w + k, F.lit(0)), F.lit(channels * h * w - 1))
        value = F.element_at(px, (place + 1).cast("int"))
        ok = (row >= 0) & (row < h) & (col >= 0) & (col < w) if mode == "constant" else F.lit(True)
        return F.when(ok, value).otherwise(F.lit(float(fill)))

    return F.transform(F.sequence(F.lit(0), F.lit(channels * nh * nw - 1)), at)


def one_hot(label: Column, classes: int, on: float = 1.0, off: float = 0.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, F.lit(float(on))).otherwise(F.lit(float(off))))


# --- matrices as arrays of rows ------------------------------------------------------


def product(a: list[list], b: list[list]) -> list[list]:
    num = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return [[sum((num(x) * num(b[k][j]) for k, x in enumerate(row)), F.lit(0.0)) for j in range(len(b[0]))] for row in a]


def inverse(m) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m)).tolist()


def hue_rows(degrees: Column) -> list[list]:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return [[1, 0, 0], [0, c, s], [0, -s, c]]


def jitter_rows(hue: Column, sat: Column, value: Column) -> list[list]:
    """Hue turned, saturation and value scaled in YIQ, back in RGB."""
    turn = product(hue_rows(hue), [[1, 0, 0], [0, sat, 0], [0, 0, sat]])
    return product(product(product(inverse(YIQ), turn), [[value, 0, 0], [0, value, 0], [0, 0, value]]), [list(r) for r in YIQ])


def cones(px: Column, hw: int) -> Column:
    import numpy as np

    return mixed(linear(px), hw, (np.array(CAT02) @ np.array(XYZ)).tolist())


# --- affine matrices, on places from -1 to 1 ------------------------------------------


def rotate_rows(degrees: Column, x: Column, y: Column) -> list[list]:
    """About a point given from 0 to 1; positive degrees turn the image counter-clockwise."""
    c, s = F.cos(F.radians(-degrees)), F.sin(F.radians(-degrees))
    x, y = x * 2 - 1, y * 2 - 1
    return [[c, s, x - c * x - s * y], [-s, c, y + s * x - c * y], [0, 0, 1]]


def zoom_rows(scale: Column, x: Column, y: Column) -> list[list]:
    return [[scale, 0, (1 - scale) * (x * 2 - 1)], [0, scale, (1 - scale) * (y * 2 - 1)], [0, 0, 1]]


def flip_rows(flip: Column) -> list[list]:
    """Left to right where flip is true."""
    return [[F.when(flip, F.lit(-1.0)).otherwise(F.lit(1.0)), 0, 0], [0, 1, 0], [0, 0, 1]]


def shift_rows(x: Column, y: Column) -> list[list]:
    return [[1, 0, x * 2], [0, 1, y * 2], [0, 0, 1]]


def rotate_object_rows(degrees: Column, x: Column, y: Column, scale: Column, to_x: Column, to_y: Column) -> list[list]:
    return product(product(rotate_rows(degrees, x, y), zoom_rows(scale, x, y)), shift_rows(x - to_x, y - to_y))


def flat(rows: list[list]) -> Column:
    return F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for row in rows for x in row])


def bound(rows, *draws: Column) -> Column:
    """flat(rows(*draws)), with each draw worked out once a row, however many entries use it."""
    return let(F.struct(*[d.alias(f"d{k}") for k, d in enumerate(draws)]), lambda t: flat(rows(*[t[f"d{k}"] for k in range(len(draws))])))


def held(m: Column, size: int = 3) -> list[list]:
    """The rows of a matrix that a column holds flat."""
    return [[F.get(m, F.lit(size * i + j)) for j in range(size)] for i in range(size)]
