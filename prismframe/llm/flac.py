"""FLAC media columns: Rice residuals, linear predictors, frame checksums, seekable PCM blocks.

A batch of streams is coded and decoded as whole arrays, with a lane for each
frame: every step of the decoder reads one sample of every frame.  The seek table
has a point for each frame, so lanes can start anywhere and any block of samples
can be had without what stands before it.  Streams that others wrote (stereo,
partitions, other widths, no seek table) go through decode_stream(), sample by
sample, with the same checks.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import in_slices, ragged
from .common import Texts, id_and_text

BLOCK = 1024
UNIT = 64
RATE = 8000
ORDER = 4
PRECISION = 10


# --- checksums: a table for each distance from the end makes them one gather ------


def _crc_step(crc: np.ndarray, width: int, poly: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    for _ in range(8):
        crc = np.where(crc & top, (crc << 1) ^ poly, crc << 1) & mask
    return crc


_CRC: dict[tuple[int, int], np.ndarray] = {}


def crc_table(width: int, poly: int, size: int) -> np.ndarray:
    """Row j: the checksum of each byte with j zero bytes after it."""
    key = (width, poly)
    have = _CRC.get(key)
    if have is None or len(have) < size:
        rows = [_crc_step(np.arange(256, dtype=np.int64) << (width - 8), width, poly)]
        first = rows[0]
        for _ in range(max(size, 1200) - 1):
            c = rows[-1]
            rows.append(((c << 8) & ((1 << width) - 1)) ^ first[(c >> (width - 8)) & 255])
        have = _CRC[key] = np.array(rows).astype(np.uint16)
    return have


def checksums(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, poly: int) -> np.ndarray:
    """The checksum of each range of bytes (none empty)."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    table = crc_table(width, poly, int(sizes.max()))
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]))
    far = np.repeat(ends, sizes) - 1 - at
    return np.bitwise_xor.reduceat(table[far, raw[ragged(starts, sizes)]], ends - sizes)


def frame_checksums(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of adjoining frames, each up to its last two bytes; those count as zero. int32 keeps the index small."""
    table = crc_table(16, 0x8005, int(sizes.max()))
    ends = np.cumsum(sizes)
    far = np.repeat((ends - 3).astype(np.int32), sizes) - np.arange(len(raw), dtype=np.int32)
    np.maximum(far, 0, out=far)
    far <<= 8
    far |= raw
    parts = table.ravel()[far]
    parts[ends - 1] = 0
    parts[ends - 2] = 0
    return np.bitwise_xor.reduceat(parts, ends - sizes)


# --- coding -----------------------------------------------------------------------


def _frame_headers(number: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Header bytes, a row for each frame, without the checksum, and their count."""
    f = len(number)
    head = np.zeros((f, 12), np.uint8)
    head[:, 0], head[:, 1], head[:, 3] = 0xFF, 0xF8, 0x02
    full = size == BLOCK
    head[:, 2] = np.where(full, 0xA0, 0x70)
    count = np.zeros(f, np.int64)
    for width, low, high in ((1, 0, 1 << 7), (2, 1 << 7, 1 << 11), (3, 1 << 11, 1 << 16), (4, 1 << 16, 1 << 21), (5, 1 << 21, 1 << 26)):
        own = np.flatnonzero((number >= low) & (number < high))
        for k in range(width):
            bits = number[own] >> (6 * (width - 1 - k))
            head[own, 4 + k] = bits if width == 1 else ((0xFF00 >> width) & 0xFF) | bits if k == 0 else 0x80 | (bits & 0x3F)
        count[own] = 4 + width
    short = np.flatnonzero(~full)
    head[short, count[short]] = (size[short] - 1) >> 8
    head[short, count[short] + 1] = (size[short] - 1) & 255
    count[short] += 2
    return head, count


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of a linear predictor for each row (Levinson and Durbin)."""
    y = x.astype(np.float32)  # sums of at most 2 ** 24: exact
    r = np.stack([np.einsum("ij,ij->i", y[:, j:], y[:, : y.shape[1] - j]) for j in range(ORDER + 1)], 1).astype(np.float64)
    a = np.zeros((len(x), ORDER))
    error = np.maximum(r[:, 0], 1e-9)
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        k = np.clip(k, -0.999, 0.999)
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(1), 1e-6))), 0, 14).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top, top).astype(np.int64), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def encode_frames(pcm: np.ndarray, starts: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames' bytes end to end, and each one's first byte (and the end). pcm: int8; size: samples, at most BLOCK."""
    f = len(starts)
    column = np.arange(BLOCK)
    inside = column < size[:, None]
    x = np.where(inside, pcm[np.minimum(starts[:, None] + column, len(pcm) - 1)], 0).astype(np.int32)
    coef, shift = _predictors(x)
    # Residuals of the fixed predictors 0 and 1 and of the linear one; those of the first samples are not coded.
    step = np.zeros_like(x)
    np.subtract(x[:, 1:], x[:, :-1], out=step[:, 1:])
    guess, part = np.zeros_like(x), np.empty((f, BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        np.multiply(x[:, ORDER - 1 - j : BLOCK - 1 - j], coef[:, j : j + 1].astype(np.int32), out=part)
        guess[:, ORDER:] += part
    guess >>= shift[:, None].astype(np.int32)
    r = np.subtract(x, guess, out=guess)
    orders = np.array([0, 1, ORDER])
    # What stands after a short frame's end weighs too, but only in this choice.
    weight = np.stack([np.abs(x).sum(1), np.abs(step).sum(1), 1.03 * np.abs(r[:, ORDER:]).sum(1)], 1)
    pick = weight.argmin(1)
    for k, other in enumerate((x, step)):
        rows = np.flatnonzero(pick == k)
        r[rows] = other[rows]
    order = orders[pick]
    coded = inside & (column >= order[:, None])
    u = (r << 1) ^ (r >> 31)
    u *= coded
    n = size - order
    near = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / n, 1))), 1, 13).astype(np.int32)
    costs = np.stack([n * (k + 1) + (u >> k[:, None]).sum(1) for k in (near - 1, near)], 1)
    rice = near - 1 + costs.argmin(1).astype(np.int32)
    linear = pick == 2
    body = 8 * order + np.where(linear, 9 + ORDER * PRECISION, 0) + 10 + costs.min(1)
    constant = np.zeros(f, bool)
    rows = np.flatnonzero(weight[:, 1] <= 128)
    constant[rows] = (np.where(inside[rows], x[rows], x[rows, :1]) == x[rows, :1]).all(1)
    verbatim = ~constant & (body >= 8 * size)
    body = np.where(constant, 8, np.where(verbatim, 8 * size, body))
    head, count = _frame_headers(number, size)
    total = count + 1 + 1 + (body + 7) // 8 + 2
    ends = np.cumsum(total)
    first = ends - total
    bits = np.zeros(8 * int(ends[-1]), bool)
    at = 8 * (first + count + 2)
    own = np.flatnonzero(~constant & ~verbatim)
    cursor = at[own].copy()
    for k in range(ORDER):
        some = order[own] > k
        _put(bits, cursor[some], x[own[some], k] & 255, 8)
        cursor[some] += 8
    some = linear[own]
    _put(bits, cursor[some], np.full(some.sum(), PRECISION - 1), 4)
    _put(bits, cursor[some] + 4, shift[own[some]], 5)
    for j in range(ORDER):
        _put(bits, cursor[some] + 9 + PRECISION * j, coef[own[some], j] & ((1 << PRECISION) - 1), PRECISION)
    cursor[some] += 9 + ORDER * PRECISION
    _put(bits, cursor + 6, rice[own], 4)  # method 0 and partition order 0 are zero bits
    cursor += 10
    all_own = len(own) == f
    value = u[coded] if all_own else u[own][coded[own]]
    counts = n[own]
    k = np.repeat(rice[own], counts)
    length = (value >> k) + 1 + k
    stop = np.cumsum(length)
    base = np.concatenate([[0], stop])[np.cumsum(counts) - counts] if len(own) else np.zeros(0, np.int64)
    stop += np.repeat(cursor - base - 1, counts)  # the place of each code's last bit
    # A code is its stop bit and k more, at most 15: they lie in three bytes, and no two codes share a bit.
    code = ((1 << k) | (value & ((1 << k) - 1))) << (7 - (stop & 7)).astype(np.int32)
    stop >>= 3
    out = np.packbits(bits)
    for back in range(3):
        out += np.bincount(np.maximum(stop - back, 0), (code >> (8 * back)) & 255, len(out)).astype(np.uint8)
    out[ragged(first, count)] = head[np.repeat(np.arange(f), count), ragged(np.zeros(f, np.int64), count)]
    out[first + count] = checksums(out, first, count, 8, 0x07)
    out[first + count + 1] = np.where(constant, 0, np.where(verbatim, 2, np.where(linear, (32 | (ORDER - 1)) << 1, (8 | order) << 1)))
    out[(at >> 3)[constant]] = x[constant, 0] & 255
    v = np.flatnonzero(verbatim)
    out[ragged(at[v] >> 3, size[v])] = (x[v] & 255)[inside[v]]
    crc = frame_checksums(out, total)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 255
    return out, np.append(first, ends[-1])


def payloads(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zero bytes after each up to a positive multiple of UNIT, end to end, and each one's first byte."""
    size = np.diff(t.offsets)
    full = np.maximum((size + UNIT - 1) // UNIT, 1) * UNIT
    firsts = np.append(0, np.cumsum(full))
    out = np.zeros(firsts[-1], np.uint8)
    out[ragged(firsts[:-1], size)] = t.bytes
    return out, firsts


def encode(payload: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """A FLAC stream (8 bit, mono) for each payload; a sample is its byte less 128."""
    if len(firsts) < 2:
        return []
    pcm = (payload ^ 0x80).view(np.int8)
    size = np.diff(firsts)
    frames = (size + BLOCK - 1) // BLOCK
    number = ragged(np.zeros(len(size), np.int64), frames)
    start = np.repeat(firsts[:-1], frames) + number * BLOCK
    count = np.minimum(BLOCK, np.repeat(firsts[1:], frames) - start)
    raw, at = encode_frames(pcm, start, count, number)
    own = np.append(0, np.cumsum(frames))
    data, samples = raw.tobytes(), pcm.tobytes()
    out = []
    for d in range(len(size)):
        a, b = int(own[d]), int(own[d + 1])
        points = np.zeros(b - a, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        points["sample"], points["offset"], points["count"] = number[a:b] * BLOCK, at[a:b] - at[a], count[a:b]
        widths = np.diff(at[a : b + 1])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(widths.min()).to_bytes(3, "big") + int(widths.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(size[d])).to_bytes(8, "big") + hashlib.md5(samples[int(firsts[d]) : int(firsts[d + 1])]).digest()
        table = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + data[int(at[a]) : int(at[b])])
    return out


# --- decoding ---------------------------------------------------------------------


class Info:
    """What the metadata blocks of a stream say."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points = 4, False, None
        self.block = self.total = None
        while not last:
            last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                word = int.from_bytes(body[10:18], "big")
                self.block, self.rate, self.channels, self.bits, self.total = struct.unpack(">H", body[2:4])[0], word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & ((1 << 36) - 1)
                self.md5 = body[18:34]
            elif kind == 3:
                self.points = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
            at += 4 + size
        self.frames = at


def decode_frames(raw: np.ndarray, first: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (a row for each frame), their counts and the frame numbers. Raises ValueError where a check fails.

    For 8-bit mono frames with one Rice partition, as encode() writes them.
    """
    byte = lambda k: raw[np.minimum(first + k, len(raw) - 1)].astype(np.int64)
    if not ((byte(0) == 0xFF) & (byte(1) == 0xF8) & ((byte(3) & 0xFE) == 0x02)).all():
        raise ValueError("frame header")
    lead = byte(4)
    width = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8], [1, 2, 3, 4], 5)
    number = np.where(width == 1, lead, lead & (0x7F >> width))
    for k in range(1, 5):
        number = np.where(width > k, number << 6 | byte(4 + k) & 0x3F, number)
    code = byte(2) >> 4
    after = 4 + width
    size = np.where(code == 7, (byte(after) << 8 | byte(after + 1)) + 1, np.where(code == 6, byte(after) + 1, 256 << np.maximum(code - 8, 0)))
    count = after + np.where(code == 7, 2, np.where(code == 6, 1, 0))
    if (checksums(raw, first, count, 8, 0x07) != byte(count)).any():
        raise ValueError("header checksum")
    ends = first + total
    if (frame_checksums(raw, total) != (raw[ends - 2].astype(np.int64) << 8 | raw[ends - 1])).any():
        raise ValueError("frame checksum")
    kind = byte(count + 1) >> 1
    f, most = len(first), int(size.max())
    out = np.zeros((f, most), np.int32)
    at = first + count + 2
    own = np.flatnonzero(kind == 0)
    out[own] = raw[at[own]].view(np.int8)[:, None]
    own = np.flatnonzero(kind == 1)
    out[np.repeat(own, size[own]), ragged(np.zeros(len(own), np.int64), size[own])] = raw[ragged(at[own], size[own])].view(np.int8)
    own = np.flatnonzero(kind >= 8)
    order = np.where(kind >= 32, (kind & 31) + 1, kind & 7)
    if len(own):
        wide = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
        wide = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

        def take(pos, n):
            """n bits (at most 25) from each position."""
            return ((wide[pos >> 3] << (pos & 7).astype(np.uint32)) >> (32 - n).astype(np.uint32)).astype(np.int64) * (n > 0)

        const = lambda n, k: np.full(len(k), n, np.int64)
        pos = 8 * at[own]
        for k in range(int(order[own].max())):
            some = order[own] > k
            out[own[some], k] = ((take(pos[some], const(8, pos[some])) ^ 128) - 128).astype(np.int32)
            pos[some] += 8
        linear = np.flatnonzero(kind[own] >= 32)
        coef, shift = np.zeros((len(own), 32), np.int32), np.zeros(len(own), np.int32)
        if len(linear):
            p = pos[linear]
            precision = take(p, const(4, p)) + 1
            shift[linear] = take(p + 4, const(5, p))
            p = p + 9
            for j in range(int(order[own[linear]].max())):
                some = order[own[linear]] > j
                c = take(p[some], precision[some])
                coef[linear[some], j] = (c ^ (1 << (precision[some] - 1))) - (1 << (precision[some] - 1))
                p[some] += precision[some]
            pos[linear] = p
        if (take(pos, const(6, pos)) != 0).any():
            raise ValueError("partitions")
        rice = take(pos + 6, const(4, pos)).astype(np.int64)
        pos += 10
        # One sample of every frame at a time; the longest first, so that those that are done fall away.
        n = size[own] - order[own]
        rank = np.argsort(-n, kind="stable")
        pos, rice, n = pos[rank].astype(np.int32), rice[rank].astype(np.int32), n[rank]
        lanes = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0])), "right")
        grid = np.zeros((most, len(n)), np.int32)
        drop = np.uint32(31) - rice.astype(np.uint32)
        for j in range(int(n[0])):
            live = int(lanes[j])
            p, k = pos[:live], rice[:live]
            window = wide[p >> 3] << (p & 7).view(np.uint32)
            # zeros before the first one bit: from the exponent of the number
            zeros = 1054 - (window.astype(np.float64).view(np.int64) >> 52).astype(np.int32)
            rest = zeros + 1
            far = rest + k > 25
            if far.any():  # the code does not lie in the window
                for lane in np.flatnonzero(far):
                    at_ = int(p[lane])
                    while not raw[at_ >> 3] >> (7 - (at_ & 7)) & 1:
                        at_ += 1
                    zeros[lane] = at_ - p[lane]
                    after_one = at_ + 1
                    window[lane] = (int(wide[after_one >> 3]) << (after_one & 7)) & 0xFFFFFFFF
                rest = zeros + 1
                shifted = np.where(far, window, window << np.minimum(rest, 31).view(np.uint32))
            else:
                shifted = window << rest.view(np.uint32)
            # shifting by 31 - k and then 1 keeps k = 0 right
            low = (shifted >> drop[:live] >> np.uint32(1)).view(np.int32)
            np.left_shift(zeros, k, out=zeros)
            grid[j, :live] = zeros | low
            pos[:live] += rest + k
        u = np.empty((len(n), most), np.int32)
        u[rank] = grid.T
        r = (u >> 1) ^ -(u & 1)
        for o in np.unique(order[own]).tolist():
            rows = np.flatnonzero((order[own] == o) & (kind[own] < 32))
            if len(rows):
                w = r[rows][:, : most - o]
                seed = out[own[rows], :o]
                for level in range(o, 0, -1):  # undo one difference at a time
                    d = np.diff(seed, level - 1, axis=1)[:, -1:] if level > 1 else seed[:, -1:]
                    w = d + np.cumsum(w, axis=1)
                out[own[rows], o:] = w
        if len(linear):
            deep = int(order[own[linear]].max())
            s, c, sh, o = out[own[linear]].T.copy(), coef[linear, :deep].T.copy(), shift[linear], order[own[linear]]
            res = np.zeros((most, len(linear)), np.int32)
            for j in np.unique(o).tolist():
                res[j:, o == j] = r[linear[o == j], : most - j].T
            least = int(o.min())
            for j in range(least, most):
                guess = c[0] * s[j - 1]
                for q in range(1, min(deep, j)):
                    guess += c[q] * s[j - 1 - q]
                v = res[j] + (guess >> sh)
                s[j] = v if j >= deep else np.where(o <= j, v, s[j])
            out[own[linear]] = s.T
    return out, size, number


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream: its samples plus 128. Every checksum is verified, and the digest of all samples."""
    if not streams:
        return []
    infos = [Info(s) for s in streams]
    ours = all(i.points is not None and i.bits == 8 and i.channels == 1 and i.block == BLOCK and int(i.points["count"].sum()) == i.total for i in infos)
    if not ours:
        return [(decode_stream(s).astype(np.int8).view(np.uint8) ^ 0x80).tobytes() for s in streams]
    raw = np.frombuffer(b"".join(s[i.frames :] for s, i in zip(streams, infos)), np.uint8)
    size = np.array([len(s) - i.frames for s, i in zip(streams, infos)])
    base = np.cumsum(size) - size
    first = np.concatenate([i.points["offset"].astype(np.int64) + b for i, b in zip(infos, base)])
    samples, count, number = decode_frames(raw, first, np.diff(np.append(first, len(raw))))
    flat = samples[np.arange(samples.shape[1]) < count[:, None]].astype(np.int8)
    said = np.concatenate([i.points["count"].astype(np.int64) for i in infos])
    if (said != count).any():
        raise ValueError("seek table")
    out, at = [], 0
    for i in infos:
        own = flat[at : at + i.total]
        at += i.total
        if hashlib.md5(own.tobytes()).digest() != i.md5:
            raise ValueError("digest of the samples")
        out.append((own.view(np.uint8) ^ 0x80).tobytes())
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _crc(data: bytes, width: int, poly: int) -> int:
    crc = 0
    for b in data:
        crc ^= b << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc >> (width - 1) else crc << 1) & ((1 << width) - 1)
    return crc


def decode_stream(data: bytes) -> np.ndarray:
    """Samples of any FLAC stream, channel by channel interleaved. Raises ValueError where a check fails."""
    info, channels = Info(data), []
    at, out = info.frames, []
    sizes = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
    depths = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
    done = 0
    while at < len(data) and done < info.total:
        b = _Bits(data, at)
        if b.take(15) != 0x7FFC:
            raise ValueError("frame header")
        b.take(1)
        block, rate, assignment, depth = b.take(4), b.take(4), b.take(4), b.take(3)
        b.take(1)
        lead = b.take(8)
        while lead & 0x40 and lead & 0x80:
            b.take(8)
            lead = (lead << 1) & 0xFF
        n = b.take(8) + 1 if block == 6 else b.take(16) + 1 if block == 7 else sizes[block]
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if _crc(data[at : b.at >> 3], 8, 0x07) != b.take(8):
            raise ValueError("header checksum")
        bits = depths.get(depth, info.bits)
        many = assignment + 1 if assignment < 8 else 2
        channels = [_subframe(b, n, bits + ((assignment, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(many)]
        b.at = (b.at + 7) & ~7
        if _crc(data[at : b.at >> 3], 16, 0x8005) != b.take(16):
            raise ValueError("frame checksum")
        if assignment == 8:
            channels[1] = channels[0] - channels[1]
        elif assignment == 9:
            channels[0] = channels[1] + channels[0]
        elif assignment == 10:
            mid = (channels[0] << 1) | (channels[1] & 1)
            channels = [(mid + channels[1]) >> 1, (mid - channels[1]) >> 1]
        out.append(np.stack(channels, 1).ravel())
        done += n
        at = b.at >> 3
    samples = np.concatenate([*out, np.zeros(0, np.int64)])
    width = (info.bits + 7) // 8
    packed = samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    if any(info.md5) and hashlib.md5(packed).digest() != info.md5:
        raise ValueError("digest of the samples")
    return samples


def _subframe(b: _Bits, n: int, bits: int) -> np.ndarray:
    b.take(1)
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
        bits -= wasted
    if kind == 0:
        s = [b.signed(bits)] * n
    elif kind == 1:
        s = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        s = [b.signed(bits) for _ in range(order)]
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        else:
            shift, coef = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        wide = 4 + b.take(2)
        parts = b.take(4)
        residual: list[int] = []
        for p in range(1 << parts):
            k = b.take(wide)
            count = (n >> parts) - (order if p == 0 else 0)
            if k == (1 << wide) - 1:
                raw = b.take(5)
                residual += [b.signed(raw) for _ in range(count)]
            else:
                for _ in range(count):
                    u = b.unary() << k | b.take(k)
                    residual.append((u >> 1) ^ -(u & 1))
        for r in residual:
            s.append(r + (sum(c * x for c, x in zip(coef, reversed(s[-order:] if order else []))) >> shift))
    else:
        raise ValueError("subframe")
    return np.array(s, np.int64) << wasted


# --- columns ----------------------------------------------------------------------


def feature(payload: bytes) -> str:
    """Sample count, sum, energy, sign changes, least and greatest sample: whole numbers, alike on every machine."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"{len(s)}:{s.sum()}:{(s * s).sum()}:{np.count_nonzero(np.diff(s < 0))}:{s.min()}:{s.max()}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as a FLAC stream. Null and empty texts become one unit of zero bytes."""

    def run(batches):
        for b in batches:
            for part in in_slices(b):
                t = Texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(t.offsets)), pa.array(encode(*payloads(t)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, n_samples, byte_offset, pcm) of a table (doc_id, media).

    first_sample and byte_offset say where a block begins in the sound and in the
    stored stream, so a reader can seek to it.  Rows without media give no blocks.
    """

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for key, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m is None:
                    continue
                info, pcm = Info(m), decode([m])[0]
                if info.points is not None:
                    at = [(int(p["sample"]), int(p["count"]), info.frames + int(p["offset"])) for p in info.points]
                else:
                    at = [(k, min(BLOCK, len(pcm) - k), None) for k in range(0, len(pcm), BLOCK)]
                rows += [(key, k, s, n, o, pcm[s : s + n]) for k, (s, n, o) in enumerate(at)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "block", "first_sample", "n_samples", "byte_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, first_sample long, n_samples long, byte_offset long, pcm binary")


def report(docs: DataFrame) -> DataFrame:
    """Each row's text stored as FLAC, read back, and what was read: sizes, digests and features.

    Null texts count as empty; repeated rows each get a row; an empty table gives
    none; other columns are left out.
    """
    import zlib

    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        for b in batches:
            for part in in_slices(b):
                t = Texts(part.column(1))
                media = encode(*payloads(t))
                back = decode(media)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(t.offsets)),
                        pa.array([len(x) for x in back], pa.int64()),
                        pa.array([sha(x) for x in back], pa.string()),
                        pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()),
                        pa.array([len(x) for x in media], pa.int64()),
                        pa.array([sha(x) for x in media], pa.string()),
                        pa.array([feature(x) for x in back], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
