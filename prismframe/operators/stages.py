"""Decode stages: crop rectangles from the metadata plane, pixels from kernels, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions import crops, pixels
from prismframe.functions.rng import EMBED_STEP, between, chosen, uniform
from prismframe.operators import kernels

Step = Callable[[DataFrame], DataFrame]


def cropped(df: DataFrame, rects: dict[str, tuple[Column, int]], image: str = "image", rgb: bool = True) -> DataFrame:
    """A [size, size, 3] byte image for each named rectangle, decoded once a row; rectangles stay as <name>_rect.

    image: binary (JPEG, PNG, BMP, or YUV with height and width columns). A null
    image or rectangle gives null crops.  Not rgb: luma and chroma instead.
    """
    marked = df.select("*", *[r.alias(f"{n}_rect") for n, (r, _) in rects.items()])
    sized = {"height", "width"} <= set(df.columns)
    sizes = {n: size for n, (_, size) in rects.items()}
    schema = T.StructType([*marked.schema, *(T.StructField(n, T.BinaryType()) for n in rects)])

    def run(batches):
        for b in (part for whole in batches for part in _slices(whole, image)):
            names = b.schema.names
            out: dict[str, list] = {n: [] for n in sizes}
            heights, widths = (b.column(names.index(c)).to_pylist() if sized else [0] * b.num_rows for c in ("height", "width"))
            pixels = kernels.decode_all(b.column(names.index(image)).to_pylist(), heights, widths, rgb)
            for n, size in sizes.items():
                rect = b.column(names.index(f"{n}_rect"))
                boxes = zip(*(rect.field(f).to_pylist() for f in ("x", "y", "w", "h")), rect.is_valid().to_pylist())
                out[n] = [None if px is None or not ok else kernels.crop_resize(px, x, y, w, h, size).tobytes() for px, (x, y, w, h, ok) in zip(pixels, boxes)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, pa.binary()) for v in out.values())], [*names, *sizes])

    return marked.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, image: str, limit: int = 8 << 20):
    """Slices of about so many encoded bytes: what is decoded at a time."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(image))), 0)).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        stop = min(batch.num_rows, int(np.searchsorted(ends, (int(ends[start - 1]) if start else 0) + limit)) + 1)
        yield batch.slice(start, stop - start)
        start = stop


def dealt(df: DataFrame, key: str = "_idx") -> DataFrame:
    """Rows dealt to tasks by a key, before a step that takes far longer than reading: a file of a few MB, or of one row group, is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def stacked(column: pa.Array, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column that are there, as one array [n, *shape]; and which are."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, *shape), np.asarray(column.is_valid())


def as_lists(values: np.ndarray, there: np.ndarray) -> pa.ListArray:
    """A list for each row that is there, nulls between."""
    flat = np.ascontiguousarray(values, np.float64).reshape(len(values), -1)
    offsets = np.append(0, np.cumsum(there * flat.shape[1])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()), mask=pa.array(~there))


def W():
    return F.col("width")


def H():
    return F.col("height")


def K():
    return F.col("_idx")


def centre_crop(size: int = 224, rgb: bool = True) -> Step:
    return lambda df: cropped(df, {"view": (crops.centre(W(), H(), size), size)}, rgb=rgb)


def random_resized_crop(size: int = 224, scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3), salt: str = "rrc", direct: bool = False, rgb: bool = True) -> Step:
    return multi_crop({"view": {"size": size, "scale": scale, "salt": salt}}, ratio, direct, rgb)


def resize_crop(resize: int = 256, size: int = 224, rgb: bool = True) -> Step:
    return lambda df: cropped(df, {"view": (crops.resize_centre(W(), H(), resize, size), size)}, rgb=rgb)


def short_crop_long(size: int = 224, x_range=(0.5, 0.5), y_range=(0.5, 0.5), salt: str = "slide") -> Step:
    rect = crops.short_crop_long(W(), H(), F.lit(size), between(*x_range, uniform(salt + "/x", K())), between(*y_range, uniform(salt + "/y", K())))
    return lambda df: cropped(df, {"view": (rect, size)})


def multi_crop(views: dict[str, dict], ratio=(3 / 4, 4 / 3), direct: bool = False, rgb: bool = True) -> Step:
    """Named views with size, scale and salt; views of one salt share their centre."""
    make = crops.direct_resized if direct else crops.random_resized
    return lambda df: cropped(df, {n: (make(W(), H(), K(), v.get("salt", n), v.get("scale", (0.08, 1.0)), v.get("ratio", ratio)), v["size"]) for n, v in views.items()}, rgb=rgb)


def multi_short_crop_long(views: dict[str, dict], per_batch: int | None = None) -> Step:
    """Named views of the short edge at a drawn size and a square slid along the long edge.

    Each view: size, and sizes (least and greatest short edge), x_range, y_range, salt.
    per_batch: rows with one value of _idx // per_batch draw one size.
    """

    def rect(n: str, v: dict) -> Column:
        salt, (low, high) = v.get("salt", n), v.get("sizes", (v["size"], v["size"]))
        key = K() if per_batch is None else F.floor(K() / per_batch)
        short = low + F.floor(uniform(salt + "/size", key) * (high - low + 1))
        return crops.short_crop_long(W(), H(), short, between(*v.get("x_range", (0.5, 0.5)), uniform(salt + "/x", K())), between(*v.get("y_range", (0.5, 0.5)), uniform(salt + "/y", K())))

    return lambda df: cropped(df, {n: (rect(n, v), v["size"]) for n, v in views.items()})


def multi_crop_embed(views: dict[str, dict], canvas: int = 224, x_range=(0.5, 0.5), y_range=(0.5, 0.5), seed: int = 0) -> Step:
    """multi_short_crop_long(), each view on a [canvas, canvas, 4] image whose alpha is 255 inside; places stay as <name>_place."""

    def step(df: DataFrame) -> DataFrame:
        df = multi_short_crop_long(views)(df)
        for k, (n, v) in enumerate(views.items()):
            salt, size = f"embed/{seed + k * EMBED_STEP}", F.lit(v["size"])
            df = df.withColumn(f"{n}_place", crops.embed_rect(size, size, canvas, between(*x_range, uniform(salt + "/x", K())), between(*y_range, uniform(salt + "/y", K()))))
            df = _on_canvas(n, v["size"], canvas)(df)
        return df

    return step


def _on_canvas(view: str, size: int, canvas: int) -> Step:
    def run(batches):
        for b in batches:
            names = b.schema.names
            px, there = byte_images(b.column(names.index(view)), size)
            place = b.column(names.index(f"{view}_place"))
            x, y, w, h = (np.asarray(place.field(f).to_numpy(zero_copy_only=False))[there].astype(int) for f in ("x", "y", "w", "h"))
            out = np.zeros((len(px), canvas, canvas, 4), np.uint8)
            for k in range(len(px)):
                out[k, y[k] : y[k] + h[k], x[k] : x[k] + w[k], :3] = px[k, : h[k], : w[k]]
                out[k, y[k] : y[k] + h[k], x[k] : x[k] + w[k], 3] = 255
            step, data = canvas * canvas * 4, out.tobytes()
            rows = iter(data[k : k + step] for k in range(0, len(data), step))
            new = pa.array([next(rows) if ok else None for ok in there.tolist()], pa.binary())
            yield b.set_column(names.index(view), b.schema.field(names.index(view)), new)

    return lambda df: df.mapInArrow(run, df.schema)


def byte_images(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The images of a binary column that are there, [n, size, size, 3]; and which are."""
    there = np.asarray(column.is_valid())
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), np.uint8).reshape(-1, size, size, 3), there


def to_float(view: str, size: int, out: str = "px") -> Step:
    """A byte image as flat channel-first doubles in [0, 1]."""

    def run(batches):
        for b in batches:
            px, there = byte_images(b.column(b.schema.names.index(view)), size)
            yield pa.RecordBatch.from_arrays([*b.columns, as_lists(px.transpose(0, 3, 1, 2) / 255.0, there)], [*b.schema.names, out])

    return lambda df: df.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def batch_kernel(column: str, shape: tuple[int, int, int], f: Callable[..., np.ndarray], *params: str, out: str | None = None) -> Step:
    """f(images [n, *shape], *arrays of the params) over a column of flat images; params are columns, so a replay reuses them."""
    out = out or column

    def step(df: DataFrame) -> DataFrame:
        keep = [s.name for s in df.schema if s.name != out]
        schema = T.StructType([s for s in df.schema if s.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

        def values(c: pa.Array) -> np.ndarray:
            return np.asarray(c.flatten()).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)

        def run(batches):
            for b in batches:
                col = lambda c: b.column(b.schema.names.index(c))
                px, there = stacked(col(column), shape)
                own = pa.array(there)
                new = f(px, *(values(col(p).filter(own)) for p in params)) if len(px) else px
                yield pa.RecordBatch.from_arrays([*(col(c) for c in keep), as_lists(new, there)], [*keep, out])

        return df.mapInArrow(run, schema)

    return step


def pixel_kernel(column: str, shape: tuple[int, int, int], f: Callable[..., np.ndarray], *params: str, out: str | None = None) -> Step:
    """batch_kernel() of a function of one image and its params (None where null)."""

    def each(px: np.ndarray, *args: np.ndarray) -> np.ndarray:
        plain = lambda a: None if isinstance(a, float) and np.isnan(a) else a
        return np.stack([f(x, *map(plain, a)) for x, *a in zip(px, *(a.tolist() for a in args))])

    return batch_kernel(column, shape, each, *params, out=out)


# --- draws of each row, for flat images ------------------------------------------------


def _drawn(column: str, name: str, params: dict[str, Column], kernel: Step, keep: bool) -> Step:
    """kernel after its params became columns <column>_<name>_<param>; they stay if `keep`, so that the same draws can be used again."""
    columns = {f"{column}_{name}_{k}": c for k, c in params.items()}
    return lambda df: (lambda out: out if keep else out.drop(*columns))(kernel(df.withColumns(columns)))


def warped(column: str, shape: tuple[int, int, int], matrix: Column, p: float, salt: str, name: str, mode: str = "zeros", keep: bool = False) -> Step:
    """Seen through a flat matrix, with probability p; else as it is."""
    still = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    m = F.when(chosen(p, salt, K()), matrix).otherwise(pixels.flat(still))
    kernel = batch_kernel(column, shape, lambda px, m: kernels.affine(px, m, mode), f"{column}_{name}_m")
    return _drawn(column, name, {"m": m}, kernel, keep)


def random_rotate(column: str, shape: tuple[int, int, int], p: float = 0.5, most: float = 45, x=(0.5, 0.5), y=(0.5, 0.5), angles: list[float] | None = None, mode: str = "zeros", salt: str = "rotate", keep: bool = False) -> Step:
    """By up to `most` degrees either way, or by one of `angles`, about a point from 0 to 1."""
    u = uniform(salt + "/deg", K())
    degrees = between(-most, most, u) if angles is None else F.get(F.array(*[F.lit(float(a)) for a in angles]), F.floor(u * len(angles)).cast("int"))
    return warped(column, shape, pixels.bound(pixels.rotate_rows, degrees, between(*x, uniform(salt + "/x", K())), between(*y, uniform(salt + "/y", K()))), p, salt, "rotate", mode, keep)


def random_zoom(column: str, shape: tuple[int, int, int], p: float = 0.5, zoom=(0.5, 1.0), x=(0.5, 0.5), y=(0.5, 0.5), mode: str = "zeros", salt: str = "zoom", keep: bool = False) -> Step:
    rows = pixels.bound(pixels.zoom_rows, between(*zoom, uniform(salt + "/z", K())), between(*x, uniform(salt + "/x", K())), between(*y, uniform(salt + "/y", K())))
    return warped(column, shape, rows, p, salt, "zoom", mode, keep)


def random_rotate_object(column: str, shape: tuple[int, int, int], p: float = 0.5, most: float = 45, x=(0.5, 0.5), y=(0.5, 0.5), scale=(1.0, 2.0), to_x=(0.25, 0.75), to_y=(0.25, 0.75), mode: str = "border", salt: str = "object", keep: bool = False) -> Step:
    """Turned and scaled about a point that moves to another."""
    draw = lambda k, r: between(*r, uniform(f"{salt}/{k}", K()))
    rows = pixels.bound(pixels.rotate_object_rows, draw("deg", (-most, most)), draw("x", x), draw("y", y), draw("z", scale), draw("tx", to_x), draw("ty", to_y))
    return warped(column, shape, rows, p, salt, "object", mode, keep)


def random_patch_shuffle(column: str, shape: tuple[int, int, int], sizes: list[float], p: float = 0.5, salt: str = "patches", keep: bool = False) -> Step:
    """Square images in tiles of one of `sizes` (shares of the side), in an order drawn for each row; the order is held, so a replay keeps it."""
    side = shape[1]
    tiles = [int(s * side) for s in sizes]
    pick = F.when(chosen(p, salt, K()), F.floor(uniform(salt + "/size", K()) * len(tiles)).cast("int")).otherwise(F.lit(-1))
    params = {"pick": pick, **{f"o{k}": permutation(salt + f"/{k}", (side // t) ** 2) for k, t in enumerate(tiles)}}

    def kernel(px: np.ndarray, pick: np.ndarray, *orders: np.ndarray) -> np.ndarray:
        out = px.copy()
        for k, (size, order) in enumerate(zip(tiles, orders)):
            own = np.flatnonzero(pick == k)
            if len(own):
                if side % size:
                    raise ValueError("tiles must fill the side")
                out[own] = kernels.patch_shuffle(px[own], size, order[own])
        return out

    return _drawn(column, "patch", params, batch_kernel(column, shape, kernel, *(f"{column}_patch_{k}" for k in params)), keep)


def permutation(salt: str, count: int) -> Column:
    """A random order of 0 ... count - 1 for each row."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(uniform(F.concat(F.lit(salt + "/"), k.cast("string")), K()).alias("u"), k.alias("k")))
    return F.transform(F.array_sort(drawn), lambda t: t["k"])


def random_embed(column: str, shape: tuple[int, int, int], canvas: int, x_range=(0.5, 0.5), y_range=(0.5, 0.5), background: str = "zeros", fill=(0.0, 0.0, 0.0), alpha_range=(2.0, 2.0), p_fade: float = 0.0, salt: str = "embed", keep: bool = False) -> Step:
    """On a canvas of zeros, one colour, or noise whose spectrum falls by a drawn power; with p_fade the image fades out in a circle."""
    c, h, w = shape
    place = crops.embed_rect(F.lit(w), F.lit(h), canvas, between(*x_range, uniform(salt + "/x", K())), between(*y_range, uniform(salt + "/y", K())))
    params = {"x": place["x"], "y": place["y"], "alpha": between(*alpha_range, uniform(salt + "/alpha", K())), "seed": F.floor(uniform(salt + "/seed", K()) * 2**31).cast("long"), "fade": chosen(p_fade, salt + "/fade", K()).cast("int")}

    def kernel(px: np.ndarray, xs: np.ndarray, ys: np.ndarray, alpha: np.ndarray, seed: np.ndarray, fade: np.ndarray) -> np.ndarray:
        out = np.broadcast_to(np.asarray(fill, float)[:c, None, None] if background == "constant" else 0.0, (len(px), c, canvas, canvas)).copy()
        mask = kernels.circle_mask(h, min(8.0, h / 4), width=w)
        for k, image in enumerate(px):
            if background == "noise":
                out[k] = kernels.power_noise(canvas, canvas, alpha[k], c, 0.0, 1.0, int(seed[k]))
            x, y = int(xs[k]), int(ys[k])
            if fade[k]:
                ends = out[k][:, y : y + h, x : x + w]
                image = image.copy()
                image[:, : ends.shape[1], : ends.shape[2]] = kernels.blend(np.concatenate([image, mask[None].repeat(1, 0)])[:, : ends.shape[1], : ends.shape[2]], ends) if c == 3 else image[:, : ends.shape[1], : ends.shape[2]] * mask[: ends.shape[1], : ends.shape[2]]
            out[k] = kernels.embed(image, out[k], x, y)
        return out

    return _drawn(column, "embed", params, batch_kernel(column, shape, kernel, *(f"{column}_embed_{k}" for k in params)), keep)


def background_blend(column: str, side: int, background: str = "zeros", fill=(0.0, 0.0, 0.0), alpha_range=(2.0, 2.0), p_background: float = 1.0, salt: str = "blend", keep: bool = False) -> Step:
    """Four channels, the last one alpha, over zeros, one colour or noise: three channels. Rows without a background blend over zeros."""
    params = {"on": chosen(p_background, salt, K()).cast("int"), "alpha": between(*alpha_range, uniform(salt + "/alpha", K())), "seed": F.floor(uniform(salt + "/seed", K()) * 2**31).cast("long")}

    def kernel(px: np.ndarray, on: np.ndarray, alpha: np.ndarray, seed: np.ndarray) -> np.ndarray:
        back = np.zeros((len(px), 3, side, side))
        if background == "constant":
            back[on > 0] = np.asarray(fill, float)[:, None, None]
        elif background == "noise":
            for k in np.flatnonzero(on):
                back[k] = kernels.power_noise(side, side, alpha[k], 3, 0.0, 1.0, int(seed[k]))
        return px[:, :3] * px[:, 3:] + back * (1 - px[:, 3:])

    return _drawn(column, "blend", params, batch_kernel(column, (4, side, side), kernel, *(f"{column}_blend_{k}" for k in params)), keep)


def random_apply(steps: list[Step], p: float, batch: str = "_batch", salt: str = "apply") -> Step:
    """All steps, or none, for all rows of a batch. Steps keep the columns."""

    def step(df: DataFrame) -> DataFrame:
        on = chosen(p, salt, F.col(batch))
        out = df.where(on)
        for s in steps:
            out = s(out)
        return out.unionByName(df.where(~on))

    return step


def copies(column: str, names: list[str]) -> Step:
    if not names or len(set(names)) != len(names):
        raise ValueError("names must be there and differ")
    return lambda df: df.select("*", *[F.col(column).alias(n) for n in names])


def each_view(steps: dict[str, list[Step]]) -> Step:
    """A list of steps for each named column; a name that is not there is an error."""

    def step(df: DataFrame) -> DataFrame:
        for name, own in steps.items():
            if name not in df.columns:
                raise KeyError(name)
            for s in own:
                df = s(df)
        return df

    return step
