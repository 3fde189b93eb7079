"""Datasets made ready once: short edge resized, long edge cut, encoded again; planar YUV beside encoded images."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions.imagebytes import rgb_to_yuv
from prismframe.operators import kernels
from prismframe.operators.stages import Step, _slices


def _half_even(x: Column) -> Column:
    """Half of a whole number, ties to the even one."""
    half = F.floor(x / 2)
    return (half + F.pmod(x, F.lit(2)) * F.pmod(half, F.lit(2))).cast("long")


def short_long_size(w: Column, h: Column, short: int = 256, long: int = 512) -> Column:
    """(width, height) after the short edge is resized to `short`, (out_width, out_height) after the long one is cut to `long`, and the cut's (x, y)."""
    other = lambda a, b: F.floor(short * a / b).cast("long")
    nw = F.when(w <= h, F.lit(short).cast("long")).otherwise(other(w, h))
    nh = F.when(w <= h, other(h, w)).otherwise(F.lit(short).cast("long"))
    cw, ch = F.least(nw, F.lit(long)), F.least(nh, F.lit(long))
    return F.struct(nw.alias("width"), nh.alias("height"), _half_even(nw - cw).alias("x"), _half_even(nh - ch).alias("y"), cw.alias("out_width"), ch.alias("out_height"))


def _short_long(px: np.ndarray, short: int, long: int) -> np.ndarray:
    h, w = px.shape[:2]
    nw, nh = (short, short * h // w) if w <= h else (short * w // h, short)
    px = kernels.resize(px, nh, nw)
    ch, cw = min(nh, long), min(nw, long)
    y, x = round((nh - ch) / 2), round((nw - cw) / 2)
    return px[y : y + ch, x : x + cw]


def _each_image(image: str, out: dict[str, T.DataType], f) -> Step:
    """f(pixels) gives the values of the columns `out`, which replace columns of these names; null images give nulls."""

    def step(df: DataFrame) -> DataFrame:
        sized = {"height", "width"} <= set(df.columns)
        kept = [x for x in df.schema if x.name not in out]
        schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in out.items())])
        types = [pa.binary() if isinstance(t, T.BinaryType) else pa.int64() for t in out.values()]

        def run(batches):
            for b in (part for whole in batches for part in _slices(whole, image)):
                names = b.schema.names
                heights, widths = (b.column(names.index(c)).to_pylist() if sized else [0] * b.num_rows for c in ("height", "width"))
                decoded = kernels.decode_all(b.column(names.index(image)).to_pylist(), heights, widths)
                rows = [(None,) * len(out) if px is None else f(px) for px in decoded]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(x.name)) for x in kept), *made], [x.name for x in schema])

        return df.mapInArrow(run, schema)

    return step


def short_long(short: int = 256, long: int = 512, image: str = "image") -> Step:
    """Encoded images with the short edge resized and the long edge cut about its middle, as PNG: nothing is lost by encoding again."""
    return _each_image(image, {image: T.BinaryType()}, lambda px: (kernels.encode_png(_short_long(px, short, long)),))


def to_yuv420(image: str = "image") -> Step:
    """Encoded images as planar YUV 4:2:0 bytes with the (even) height and width of the planes."""
    return _each_image(image, {image: T.BinaryType(), "height": T.LongType(), "width": T.LongType()}, rgb_to_yuv)


def prepared_hash(name: str, root: str, split: str, short: int = 256, long: int = 512) -> str:
    """The identity of a prepared dataset: of where it came from and what was done."""
    return hashlib.sha256(f"{name}:{root}:{split}:s{short}_l{long}:png".encode()).hexdigest()[:8]
