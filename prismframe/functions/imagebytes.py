"""Encoded image bytes: format, size from headers, YUV planes and colour, as column expressions where bytes have fixed places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte(data: Column, at: int | Column) -> Column:
    """The byte at a place (from 0), as a long."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("long")


def big(data: Column, at: int, count: int) -> Column:
    return sum((byte(data, at + k) * (256 ** (count - 1 - k)) for k in range(count)), F.lit(0).cast("long"))


def little(data: Column, at: int, count: int) -> Column:
    return sum((byte(data, at + k) * 256**k for k in range(count)), F.lit(0).cast("long"))


def starts(data: Column, prefix: bytes, at: int = 0) -> Column:
    return F.substring(data, at + 1, len(prefix)) == F.lit(bytearray(prefix))


PNG = b"\x89PNG\r\n\x1a\n"


def image_format(data: Column) -> Column:
    """jpeg, png or other."""
    return F.when(starts(data, b"\xff\xd8"), "jpeg").when(starts(data, PNG), "png").otherwise("other")


def is_image(data: Column) -> Column:
    """Whether bytes begin like an image of a known format; null: false."""
    known = starts(data, b"\xff\xd8\xff") | starts(data, PNG) | starts(data, b"GIF8") | starts(data, b"BM") | (starts(data, b"RIFF") & starts(data, b"WEBP", 8))
    return F.coalesce(known, F.lit(False))


def is_image_struct(kind: T.DataType) -> bool:
    """Whether a column's type is a struct of encoded bytes, or of a path to them."""
    fields = {f.name: f.dataType for f in kind} if isinstance(kind, T.StructType) else {}
    return isinstance(fields.get("bytes"), T.BinaryType) or "bytes" in fields and isinstance(fields.get("path"), T.StringType)


def _size(data: bytes | None) -> tuple[int, int]:
    """(width, height) by markers; (0, 0) where there are none."""
    if data and data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            at -= mark == 0xFF
    if data and data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8 ":
            return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return 0, 0


def _sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_size(d) for d in data], columns=["width", "height"])


def marker_size(data: Column) -> Column:
    """(width, height) of formats whose header must be walked: JPEG and WebP."""
    return F.pandas_udf(_sizes, "width long, height long")(data)


def image_size(data: Column) -> Column:
    """(width, height) of PNG, GIF, BMP, JPEG and WebP; (0, 0) for other bytes. Only the last two leave the JVM."""
    pair = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    signed = little(data, 22, 4)
    height = F.abs(F.when(signed >= 2**31, signed - 2**32).otherwise(signed))
    long = F.octet_length(data) >= 26
    return F.when(starts(data, PNG) & long, pair(big(data, 16, 4), big(data, 20, 4))).when((starts(data, b"GIF87a") | starts(data, b"GIF89a")) & long, pair(little(data, 6, 2), little(data, 8, 2))).when(starts(data, b"BM") & long, pair(little(data, 18, 4), height)).when(starts(data, b"\xff\xd8") | starts(data, b"RIFF"), marker_size(data)).otherwise(pair(F.lit(0), F.lit(0)))


def yuv_planes(data: Column, h: Column, w: Column) -> Column:
    luma, chroma = (h * w).cast("int"), (F.floor(h / 2) * F.floor(w / 2)).cast("int")
    return F.struct(F.substring(data, F.lit(1), luma).alias("y"), F.substring(data, luma + 1, chroma).alias("u"), F.substring(data, luma + chroma + 1, chroma).alias("v"))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """Fixed-point BT.601, whole numbers from 0 to 255."""
    top = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("long")
    u, v = (u - 128).cast("int"), (v - 128).cast("int")
    part = lambda x: F.shiftright(x + 32768, 16)
    return F.struct(top(y + part(v * 91881)).alias("r"), top(y + part(u * -22554 + v * -46802)).alias("g"), top(y + part(u * 116130)).alias("b"))


def rgb_to_yuv(rgb: np.ndarray) -> tuple[bytes, int, int]:
    """Planar YUV 4:2:0 of an [h, w, 3] image, odd sides repeated to even ones. Truncates, then takes means of 2 x 2, then truncates again."""
    h, w = rgb.shape[:2]
    rgb = np.pad(rgb, ((0, h % 2), (0, w % 2), (0, 0)), mode="edge").astype(np.float32)
    m = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]], np.float32)
    y, u, v = (np.clip(rgb @ row + np.float32(128 * (k > 0)), 0, 255).astype(np.uint8) for k, row in enumerate(m))
    half = lambda p: p.reshape(p.shape[0] // 2, 2, -1, 2).mean((1, 3)).astype(np.uint8)
    return y.tobytes() + half(u).tobytes() + half(v).tobytes(), rgb.shape[0], rgb.shape[1]
