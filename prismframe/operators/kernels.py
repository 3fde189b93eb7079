"""Pixel kernels on NumPy arrays: decode, resample, convolve, noise. They run in Arrow batches of a few images."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

from prismframe.functions.imagebytes import PNG, rgb_to_yuv
from prismframe.operators import jpeg

# --- decoding ------------------------------------------------------------------------


def decode_png(data: bytes) -> np.ndarray:
    """[h, w, 3] of an 8-bit PNG (gray, gray and alpha, palette, RGB, RGBA; not interlaced)."""
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if depth != 8 or laced:
        raise ValueError("only plain 8-bit PNG")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.int32)
    kinds = raw[:, 0]
    out[1:, 1:] = raw[:, 1:].reshape(h, w, n)
    # Lines that need no other line at once, then the others in turn.
    alone = 1 + np.flatnonzero(kinds == 1)
    if len(alone):
        out[alone, 1:] = np.cumsum(out[alone, 1:], axis=1) & 255
    for y in np.flatnonzero(kinds > 1).tolist():
        kind, up, row = kinds[y], out[y], out[y + 1]
        line = row[1:].copy()
        if kind == 2:
            row[1:] = (line + up[1:]) & 255
        else:
            for x in range(w):
                a, b, c = row[x], up[x + 1], up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                row[x + 1] = (line[x] + guess) & 255
    px = out[1:, 1:].astype(np.uint8)
    if colour == 3:
        return palette[px[..., 0]]
    return np.repeat(px[..., :1], 3, 2) if colour in (0, 4) else px[..., :3]


def encode_png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1).tobytes()
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    start, w, h = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26])
    n = struct.unpack("<H", data[28:30])[0] // 8
    step = (w * n + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * n].reshape(abs(h), w, n)
    return (rows[::-1] if h > 0 else rows)[..., 2::-1]


def decode_yuv(data: bytes, h: int, w: int, rgb: bool = True) -> np.ndarray:
    """[h, w, 3] of planar YUV 4:2:0 (even sides): RGB in fixed point, or the planes with chroma repeated."""
    n, m = h * w, (h // 2) * (w // 2)
    raw = np.frombuffer(data, np.uint8)
    y = raw[:n].reshape(h, w).astype(np.int32)
    u, v = (np.repeat(np.repeat(raw[n + k * m : n + (k + 1) * m].reshape(h // 2, w // 2), 2, 0), 2, 1).astype(np.int32) for k in (0, 1))
    if not rgb:
        return np.stack([y, u, v], 2).astype(np.uint8)
    u, v = u - 128, v - 128
    part = lambda x: (x + 32768) >> 16
    return np.clip(np.stack([y + part(91881 * v), y + part(-22554 * u - 46802 * v), y + part(116130 * u)], 2), 0, 255).astype(np.uint8)


def decode(data: bytes, h: int = 0, w: int = 0, rgb: bool = True) -> np.ndarray:
    """By the bytes: JPEG, PNG, BMP, or planar YUV of the given size; not rgb: luma and chroma at full size."""
    return decode_all([data], [h], [w], rgb)[0]


def decode_all(data: list[bytes | None], heights: list[int], widths: list[int], rgb: bool = True) -> list[np.ndarray | None]:
    """decode() of a batch: its JPEGs together; null bytes give None."""
    out: list = [None] * len(data)
    jpegs = [k for k, d in enumerate(data) if d is not None and d[:2] == b"\xff\xd8"]
    for k, px in zip(jpegs, jpeg.decode([data[k] for k in jpegs])):
        out[k] = px if rgb else to_yuv(px)
    for k, d in enumerate(data):
        if d is None or out[k] is not None:
            continue
        h, w = heights[k] or 0, widths[k] or 0
        if d[:8] == PNG or d[:2] == b"BM":
            px = decode_png(d) if d[:8] == PNG else decode_bmp(d)
            out[k] = px if rgb else to_yuv(px)
        elif h and w and len(d) == h * w + 2 * (h // 2) * (w // 2):
            out[k] = decode_yuv(d, h, w, rgb)
        else:
            raise ValueError("format")
    return out


def to_yuv(px: np.ndarray) -> np.ndarray:
    """Luma and chroma at full size, of an image that is stored as RGB: through planar 4:2:0, as a store would hold it."""
    data, h, w = rgb_to_yuv(px)
    return decode_yuv(data, h, w, False)[: px.shape[0], : px.shape[1]]


def image_end(data: bytes) -> int:
    """Where an encoded image ends: behind the first end marker of a JPEG, else with the bytes."""
    at = data.find(b"\xff\xd9") if data[:2] == b"\xff\xd8" else -1
    return at + 2 if at >= 0 else len(data)


# --- resampling ----------------------------------------------------------------------


@functools.lru_cache(4096)
def _weights(n: int, to: int) -> np.ndarray:
    """Rows of a triangle filter; wider when shrinking."""
    scale = n / to
    reach = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resize(px: np.ndarray, h: int, w: int) -> np.ndarray:
    """Antialiased bilinear, one axis after the other."""
    n, m, c = px.shape
    out = np.einsum("yi,ik->yk", _weights(n, h), px.reshape(n, m * c).astype(np.float64)).reshape(h, m, c)
    # The same sums in the same order, with long rows inside.
    out = np.einsum("xj,jk->xk", _weights(m, w), np.ascontiguousarray(out.swapaxes(0, 1)).reshape(m, h * c))
    out = np.ascontiguousarray(out.reshape(w, h, c).swapaxes(0, 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if px.dtype == np.uint8 else out


def _cubic(x: np.ndarray, b: float, c: float) -> np.ndarray:
    """The cubic filters of Mitchell and Netravali."""
    x = np.abs(x)
    near = (12 - 9 * b - 6 * c) * x**3 + (12 * b + 6 * c - 18) * x**2 + 6 - 2 * b
    far = -(b + 6 * c) * x**3 + (6 * b + 30 * c) * x**2 - (12 * b + 48 * c) * x + 8 * b + 24 * c
    return np.where(x < 1, near, np.where(x < 2, far, 0)) / 6


@functools.lru_cache(4096)
def _cubic_weights(n: int, to: int) -> np.ndarray:
    """Catmull-Rom when growing, Mitchell and as much wider when shrinking; what reaches over an edge counts for its last sample."""
    scale = n / to
    if scale == 1:
        return np.eye(n, dtype=np.float32)
    centre, reach = (np.arange(to) + 0.5) * scale - 0.5, max(scale, 1.0)
    first = np.floor(centre - 2 * reach).astype(int)
    taps = first[:, None] + np.arange(int(4 * reach) + 3)
    w = _cubic((taps - centre[:, None]) / reach, *((0, 0.5) if scale < 1 else (1 / 3, 1 / 3)))
    out = np.zeros((to, n))
    np.add.at(out, (np.arange(to)[:, None], np.clip(taps, 0, n - 1)), w)
    return (out / out.sum(1, keepdims=True)).astype(np.float32)


def crop_resize(px: np.ndarray, x: int, y: int, w: int, h: int, size: int) -> np.ndarray:
    """A rectangle at [size, size], cubic, one axis after the other; values are taken as they are."""
    part = px[y : y + h, x : x + w].astype(np.float32)
    h, w, c = part.shape
    out = (_cubic_weights(h, size) @ part.reshape(h, w * c)).reshape(size, w, c)
    out = np.matmul(_cubic_weights(w, size), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if px.dtype == np.uint8 else out


def _fold(i: np.ndarray, n: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    ok = np.ones(i.shape, bool)
    if mode == "zeros":
        ok = (i >= 0) & (i < n)
    elif mode == "reflection":
        i = np.abs((i + 0.5) % (2 * n) - n)
        i = np.clip(n - 1 - np.floor(i), 0, n - 1)
    return np.clip(i, 0, n - 1).astype(np.int64), ok


def grid_sample(px: np.ndarray, gx: np.ndarray, gy: np.ndarray, mode: str = "zeros", corners: bool = False) -> np.ndarray:
    """Bilinear samples of [..., c, h, w] at places [..., h, w] from -1 to 1."""
    one = px.ndim == 3
    px, gx, gy = (px[None], gx[None], gy[None]) if one else (px, np.broadcast_to(gx, (len(px), *gx.shape[-2:])), np.broadcast_to(gy, (len(px), *gy.shape[-2:])))
    n, c, h, w = px.shape
    to = lambda g, k: (g + 1) / 2 * (k - 1) if corners else ((g + 1) * k - 1) / 2
    x, y = to(gx, w), to(gy, h)
    if mode == "border":
        x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x), np.floor(y)
    flat, out = px.reshape(n, c, h * w), np.zeros((n, c, *gx.shape[-2:]))
    for dx in (0, 1):
        for dy in (0, 1):
            wx, wy = (x - x0 if dx else 1 - x + x0), (y - y0 if dy else 1 - y + y0)
            ix, okx = _fold(x0 + dx, w, mode)
            iy, oky = _fold(y0 + dy, h, mode)
            at = (iy * w + ix).reshape(n, 1, -1)
            out += np.take_along_axis(flat, np.broadcast_to(at, (n, c, at.shape[-1])), 2).reshape(out.shape) * (wx * wy * (okx & oky))[:, None]
    return out[0] if one else out


def affine(px: np.ndarray, m: np.ndarray, mode: str = "zeros") -> np.ndarray:
    """[..., c, h, w] seen through 3 x 3 matrices on places from -1 to 1; off-diagonal terms are corrected for the aspect."""
    h, w = px.shape[-2:]
    m = np.array(m, float).reshape(*px.shape[:-3], 3, 3)
    m[..., 0, 1] *= h / w
    m[..., 1, 0] *= w / h
    x, y = np.meshgrid((np.arange(w) * 2 + 1) / w - 1, (np.arange(h) * 2 + 1) / h - 1)
    e = lambda i, j: m[..., i, j, None, None]
    return grid_sample(px, e(0, 0) * x + e(0, 1) * y + e(0, 2), e(1, 0) * x + e(1, 1) * y + e(1, 2), mode)


def distort(px: np.ndarray, k: float = -0.5, dx: float = 0.0, dy: float = 0.0) -> np.ndarray:
    """Radial distortion by 1 + k r^2 + k r^4 about the middle, moved by dx and dy pixels; r is 0.5 at the middle of an edge."""
    h, w = px.shape[-2:]
    x, y = np.meshgrid((np.arange(w) - w / 2 - dx) / w, (np.arange(h) - h / 2 - dy) / h)
    r = x * x + y * y
    f = 1 + k * r + k * r * r
    return grid_sample(px, 2 * (x * f + dx / w), 2 * (y * f + dy / h))


# --- filters and noise ---------------------------------------------------------------


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x[None] ** 2 + x[:, None] ** 2) / (2 * sigma**2))
    return k / k.sum()


def filter_size(sigma: float) -> int:
    n = int(6 * sigma) + 1
    return n + 1 - n % 2


def convolve(px: np.ndarray, k: np.ndarray, mode: str = "constant") -> np.ndarray:
    """Correlation of [c, h, w] with a square kernel, borders of np.pad's modes."""
    n = len(k)
    p = np.pad(px, ((0, 0), (n // 2, (n - 1) // 2), (n // 2, (n - 1) // 2)), mode=mode)
    return np.tensordot(np.lib.stride_tricks.sliding_window_view(p, (n, n), axis=(1, 2)), k, 2)


def blur(px: np.ndarray, sigma: float, size: int = 6) -> np.ndarray:
    return convolve(px, gaussian(size, sigma), "reflect")


def blur_all(px: np.ndarray, sigmas: np.ndarray, size: int = 6, most: int = 64) -> np.ndarray:
    """blur() of [n, c, h, w], each image by its sigma; as it is where that is NaN."""
    out, (c, h, w), sides = px.copy(), px.shape[1:], (size // 2, (size - 1) // 2)
    some = np.flatnonzero(~np.isnan(sigmas))
    for at in range(0, len(some), most):
        own = some[at : at + most]
        seen = np.lib.stride_tricks.sliding_window_view(np.pad(px[own], ((0, 0), (0, 0), sides, sides), mode="reflect"), (size, size), axis=(2, 3))
        for k, x in zip(own.tolist(), seen):
            out[k] = np.dot(x.reshape(c * h * w, size * size), gaussian(size, sigmas[k]).reshape(-1, 1)).reshape(c, h, w)
    return out


def centre_surround(px: np.ndarray, centre: float, surround: float) -> np.ndarray:
    return convolve(px, gaussian(filter_size(centre), centre)) - convolve(px, gaussian(filter_size(surround), surround))


def lgn(lms: np.ndarray, parvo=(1.5, 5.0), magno=(2.5, 5.0), konio=(2.5, 6.5)) -> np.ndarray:
    """Five channels of half-rectified centre and surround responses: red-green twice, luminance twice, blue-yellow."""
    up = lambda x: np.maximum(x, 0)
    both = lms[:1] + lms[1:2]
    rg = centre_surround(lms[:1], *parvo) - centre_surround(lms[1:2], *parvo)
    light = centre_surround(both, *magno)
    blue = centre_surround(lms[2:3], *konio) - centre_surround(both, *konio)
    return np.concatenate([up(rg), up(-rg), up(light), up(-light), up(blue)])


def magno(lms: np.ndarray, centre: float = 2.5, surround: float = 5.0) -> np.ndarray:
    """Two channels: light on and off, half-rectified."""
    light = centre_surround(lms[:1] + lms[1:2], centre, surround)
    return np.maximum(np.concatenate([light, -light]), 0)


def power_noise(h: int, w: int, alpha: float = 2.0, channels: int = 1, low: float = -1.0, high: float = 1.0, seed: int = 0) -> np.ndarray:
    """Noise whose spectrum falls as frequency to the power -alpha, scaled to a range."""
    rng = np.random.default_rng(seed)
    f = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None])
    gain = np.where(f > 0, np.where(f > 0, f, 1) ** -alpha, 0)
    out = np.real(np.fft.ifft2(np.fft.fft2(rng.standard_normal((channels, h, w))) * gain))
    a, b = out.min((1, 2), keepdims=True), out.max((1, 2), keepdims=True)
    return low + (out - a) / np.where(b > a, b - a, 1) * (high - low)


def circle_mask(size: int, span: float = 8.0, tolerance: float = 5e-4, width: int | None = None) -> np.ndarray:
    """1 inside a circle `span` smaller than the image; beyond, a Gaussian narrowed until it has fallen to the tolerance after `span` pixels."""
    sigma = span
    while np.exp(-(span**2) / (2 * sigma**2)) > tolerance:
        sigma *= 0.975
    x, y = np.arange(width or size) - ((width or size) - 1) / 2, np.arange(size) - (size - 1) / 2
    over = np.hypot(x[None], y[:, None]) - (size / 2 - span)
    return np.where(over < 0, 1.0, np.exp(-(over**2) / (2 * sigma**2)))


def patch_shuffle(px: np.ndarray, size: int, order: np.ndarray) -> np.ndarray:
    """Tiles of [..., c, h, w] in a new order: place k takes tile order[..., k]."""
    *lead, c, h, w = px.shape
    gy, gx = h // size, w // size
    tiles = px.reshape(-1, c, gy, size, gx, size).transpose(0, 2, 4, 1, 3, 5).reshape(-1, gy * gx, c, size, size)
    tiles = np.take_along_axis(tiles, np.asarray(order).reshape(-1, gy * gx, 1, 1, 1), 1)
    return tiles.reshape(-1, gy, gx, c, size, size).transpose(0, 3, 1, 4, 2, 5).reshape(*lead, c, h, w)


def embed(px: np.ndarray, canvas: np.ndarray, x: int, y: int) -> np.ndarray:
    """px on a copy of the canvas at (x, y), what overhangs cut off."""
    out = canvas.copy()
    h, w = canvas.shape[1:]
    ax, ay, bx, by = max(x, 0), max(y, 0), min(x + px.shape[2], w), min(y + px.shape[1], h)
    if ax < bx and ay < by:
        out[:, ay:by, ax:bx] = px[:, ay - y : by - y, ax - x : bx - x]
    return out


def blend(rgba: np.ndarray, background: np.ndarray) -> np.ndarray:
    return rgba[:3] * rgba[3:] + background * (1 - rgba[3:])
