"""How often crops by rejection fall back to the middle square, by distinct image size."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _uniform(salt: str, n: int) -> np.ndarray:
    """rng.uniform() of the keys below n."""
    md5, head = hashlib.md5, f"{salt}|".encode()
    return np.fromiter((int.from_bytes(md5(head + b"%d" % k).digest()[:4], "big") for k in range(n)), np.float64, n) / 4294967296.0


@functools.lru_cache(2)
def _draws(salt: str, scale: tuple, ratio: tuple, samples: int, attempts: int):
    low, high = math.log(ratio[0]), math.log(ratio[1])
    tries = [(scale[0] + _uniform(f"{salt}/s{k}", samples) * (scale[1] - scale[0]), np.exp(low + _uniform(f"{salt}/r{k}", samples) * (high - low))) for k in range(attempts)]
    return tries, _uniform(f"{salt}/cx", samples), _uniform(f"{salt}/cy", samples)


def _place(c: np.ndarray, size: int, cut: int) -> np.ndarray:
    x = np.minimum(np.maximum(c * size, cut / 2), size - cut / 2) - cut / 2
    return np.minimum(np.maximum(np.floor(x + 0.5), 0), size - cut)


def fallbacks(w: int, h: int, draws) -> int:
    """Draws of crops.random_resized() whose crop is the middle square: none of the attempts fits, or the one that does is that square."""
    tries, cx, cy = draws
    least, left, count = min(w, h), np.arange(len(cx)), 0
    for s, r in tries:
        area = w * h * s[left]
        cw, ch = np.floor(np.sqrt(area * r[left]) + 0.5), np.floor(np.sqrt(area / r[left]) + 0.5)
        fits = (cw > 0) & (cw <= w) & (ch > 0) & (ch <= h)
        same = left[fits & (cw == least) & (ch == least)]
        if len(same):
            count += int(((_place(cx[same], w, least) == (w - least) // 2) & (_place(cy[same], h, least) == (h - least) // 2)).sum())
        left = left[~fits]
        if not len(left):
            break
    return count + len(left)


def by_size(sizes: DataFrame, scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3), samples: int = 50_000, salt: str = "rrc", attempts: int = 10) -> DataFrame:
    """(width, height, fallback_rate, fallback_count, total_samples) for every distinct width and height; each size has the same draws."""

    def run(batches):
        for b in batches:
            draws = _draws(salt, tuple(scale), tuple(ratio), samples, attempts)
            counts = [fallbacks(w, h, draws) for w, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c / samples for c in counts], pa.float64()), pa.array(counts, pa.int64()), pa.array([samples] * len(counts), pa.int64())], ["width", "height", "fallback_rate", "fallback_count", "total_samples"])

    distinct = sizes.select(F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")).distinct()
    # Few bytes, much work: dealt by count, not by size.
    return distinct.repartition(4 * sizes.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "width long, height long, fallback_rate double, fallback_count long, total_samples long")


def estimate(sizes: DataFrame, **options) -> DataFrame:
    """One row over all distinct sizes: (fallback_rate, fallback_count, total_samples, recommend_direct)."""
    total = by_size(sizes, **options).agg(F.coalesce(F.sum("fallback_count"), F.lit(0)).alias("fallback_count"), F.coalesce(F.sum("total_samples"), F.lit(0)).alias("total_samples"))
    rate = F.when(F.col("total_samples") > 0, F.col("fallback_count") / F.col("total_samples")).otherwise(0.0)
    return total.select(rate.alias("fallback_rate"), "fallback_count", "total_samples", (rate > 0.05).alias("recommend_direct"))
