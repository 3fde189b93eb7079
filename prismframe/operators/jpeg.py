"""Sequential Huffman JPEG in whole batches of NumPy: a lane for each image, or for each restart interval.

All lanes take one symbol a step, so the interpreter's cost is shared by the batch:
a step looks up the next code of every lane in its table, reads the value behind it
and writes one coefficient.  Blocks are then transformed, chroma interpolated and
colours converted for whole images.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Blocks (64 coefficients each) that a batch decodes at a time, unless one image has more.
BATCH_BLOCKS = 1 << 18


def _zigzag() -> np.ndarray:
    """Places in a block by the order of a scan along its diagonals."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
#: Rows of the cosine transform.
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


@dataclass
class Component:
    name: int
    h: int
    v: int
    quantiser: int
    dc: int = 0
    ac: int = 0
    wide: int = 0  # blocks of a row, whole units
    high: int = 0
    first: int = 0  # its first block in the batch


@dataclass
class Header:
    """What an image says about itself, and the bytes of its scan, a part for each restart interval."""

    height: int = 0
    width: int = 0
    parts: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    transform: int | None = None
    scan: list[bytes] = field(default_factory=list)

    @property
    def unit(self) -> tuple[int, int]:
        return 8 * max(p.v for p in self.parts), 8 * max(p.h for p in self.parts)

    @property
    def units(self) -> tuple[int, int]:
        y, x = self.unit
        return -(-self.height // y), -(-self.width // x)


def parse(data: bytes) -> Header:
    """The header of one image. ValueError where it is no sequential Huffman JPEG of 8 bits."""
    out, at = Header(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                table = np.empty(64, np.float32)
                table[ZIGZAG] = values
                out.quantisers[body[0] & 15] = table
                body = body[1 + (128 if wide else 64) :]
        elif mark == 0xC4:
            while body:
                count = sum(body[1:17])
                out.codes[body[0] >> 4, body[0] & 15] = body[1 : 17 + count]
                body = body[17 + count :]
        elif mark in (0xC0, 0xC1):
            bits, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not out.height or not out.width:
                raise ValueError("only 8 bits and a height")
            out.parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only sequential Huffman JPEG")
        elif mark == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            out.transform = body[11]
        elif mark == 0xDA:
            if body[0] != len(out.parts):
                raise ValueError("only one scan")
            by_name = {p.name: p for p in out.parts}
            for k in range(body[0]):
                p = by_name[body[1 + 2 * k]]
                p.dc, p.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            out.scan = _intervals(data[at:])
            if len(out.parts) == 1:  # units of one block, whatever the factors say
                out.parts[0].h = out.parts[0].v = 1
            return out
    raise ValueError("no scan")


def _intervals(data: bytes) -> list[bytes]:
    """The coded bytes up to the end of the scan, without stuffing, cut at restart markers."""
    raw = np.frombuffer(data, np.uint8)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF)) if len(raw) > 1 else np.zeros(0, np.int64)
    out, start = [], 0
    for m in mark.tolist():
        out.append(data[start:m].replace(b"\xff\x00", b"\xff"))
        start = m + 2
        if not 0xD0 <= data[m + 1] <= 0xD7:
            return out
    return [*out, data[start:].replace(b"\xff\x00", b"\xff")]


def _lookup(spec: bytes) -> np.ndarray:
    """For every 16 bits the length of the code they begin with, and its symbol: 256 * length + symbol; 0 where there is none."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = 256 * length + spec[at]
            at, code = at + 1, code + 1
        code <<= 1
    return table


class _Lanes:
    """What each lane decodes: its bits, and for every block of its units the component, the tables and the place."""

    def __init__(self, images: list[Header]):
        specs: dict[bytes, int] = {}
        number = lambda spec: specs.setdefault(spec, len(specs))
        self.blocks = 0
        patterns: list[list[tuple[int, int, int]]] = []  # of each image: component, table of DC, of AC for each block of a unit
        bits, begin, lane_image, first_unit, n_units, at = [], [], [], [], [], 0
        self.place: list[np.ndarray] = []
        for k, x in enumerate(images):
            rows, cols = x.units
            pattern, own = [], []
            unit_y, unit_x = np.divmod(np.arange(rows * cols), cols)
            for c, p in enumerate(x.parts):
                p.wide, p.high, p.first = cols * p.h, rows * p.v, self.blocks
                self.blocks += p.wide * p.high
                for j in range(p.v):
                    for i in range(p.h):
                        pattern.append((c, number(x.codes[0, p.dc]), number(x.codes[1, p.ac])))
                        own.append(p.first + (unit_y * p.v + j) * p.wide + unit_x * p.h + i)
            patterns.append(pattern)
            self.place.append(np.stack(own, 1).ravel())
            step = x.restart or rows * cols
            for n, part in enumerate(x.scan[: -(-rows * cols // step)]):
                bits.append(part + b"\0" * 8)
                begin.append(8 * at)
                at += len(part) + 8
                lane_image.append(k)
                first_unit.append(n * step)
                n_units.append(min(step, rows * cols - n * step))
        self.bytes = np.frombuffer(b"".join(bits), np.uint8).astype(np.int64)
        self.tables = np.stack([_lookup(s) for s in specs]) if specs else np.zeros((0, 1 << 16), np.int32)
        self.begin, self.image = np.array(begin, np.int64), np.array(lane_image, np.int64)
        self.end = self.begin + 8 * np.array([len(b) - 8 for b in bits], np.int64)
        self.size = np.array([len(p) for p in patterns], np.int64)
        # patterns side by side, and the blocks' places one image after the other
        self.pattern_at = np.cumsum(self.size) - self.size
        self.component, self.dc, self.ac = (np.array([b[f] for p in patterns for b in p], np.int64) for f in range(3))
        lengths = np.array([len(p) for p in self.place], np.int64)
        place_at = np.cumsum(lengths) - lengths
        self.places = np.concatenate(self.place) if self.place else np.zeros(0, np.int64)
        per = self.size[self.image]
        self.block = place_at[self.image] + np.array(first_unit, np.int64) * per
        self.last = self.block + np.array(n_units, np.int64) * per


def _coefficients(images: list[Header]) -> np.ndarray:
    """All blocks of the images, 64 coefficients each, not yet scaled."""
    lanes = _Lanes(images)
    out = np.zeros((lanes.blocks, 64), np.int16)
    flat = out.reshape(-1)
    n = len(lanes.begin)
    bit, block, last, end = lanes.begin.copy(), lanes.block.copy(), lanes.last, lanes.end
    start, size = lanes.pattern_at[lanes.image], lanes.size[lanes.image]
    turn, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before = np.zeros((n, 4), np.int64)  # the last DC of each component
    zigzag = np.append(ZIGZAG, np.full(64, 63))
    live = np.flatnonzero(block < last)
    raw, tables = lanes.bytes, lanes.tables.reshape(-1)
    bit, block, last, end, start, size, turn, k, before = (a[live] for a in (bit, block, last, end, start, size, turn, k, before))
    while len(bit):
        slot = start + turn
        first = k == 0
        byte = bit >> 3
        window = raw[byte] << 32 | raw[byte + 1] << 24 | raw[byte + 2] << 16 | raw[byte + 3] << 8 | raw[byte + 4]
        window = window >> (8 - (bit & 7)) & 0xFFFFFFFF
        table = np.where(first, lanes.dc[slot], lanes.ac[slot])
        found = tables[(table << 16) + (window >> 16)].astype(np.int64)
        length, symbol = found >> 8, found & 255
        run, count = np.where(first, 0, symbol >> 4), np.where(first, symbol, symbol & 15)
        value = window >> (32 - length - count) & ((1 << count) - 1)
        value -= np.where(value < (1 << count >> 1), (1 << count) - 1, 0)
        bit += length + count
        if not found.all() or (bit > end).any():
            raise ValueError("damaged scan")
        lane = np.flatnonzero(first)
        part = lanes.component[slot[lane]]
        before[lane, part] += value[lane]
        value[lane] = before[lane, part]
        k += run
        write = first | (count > 0)
        flat[lanes.places[block[write]] * 64 + zigzag[k[write]]] = value[write]
        k = np.where(first | (count > 0), k + 1, np.where(run == 15, k + 1, 64))
        done = k >= 64
        if done.any():
            k[done] = 0
            block[done] += 1
            turn[done] = (turn[done] + 1) % size[done]
            over = block >= last
            if over.any():
                stay = ~over
                bit, block, last, end, start, size, turn, k, before = (a[stay] for a in (bit, block, last, end, start, size, turn, k, before))
    return out


def _plane(blocks: np.ndarray, p: Component, quantiser: np.ndarray) -> np.ndarray:
    """The samples of a component, whole blocks."""
    own = blocks[p.first : p.first + p.wide * p.high].astype(np.float32) * quantiser
    px = np.matmul(_COSINES.T, np.matmul(own.reshape(-1, 8, 8), _COSINES)) + 128
    return np.clip(np.rint(px), 0, 255).reshape(p.high, p.wide, 8, 8).swapaxes(1, 2).reshape(p.high * 8, p.wide * 8)


def _doubled(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples, a quarter of the next ones in each: samples lie midway between those of the wider grid."""
    x = np.moveaxis(x, axis, -1)
    low, high = np.concatenate([x[..., :1], x[..., :-1]], -1), np.concatenate([x[..., 1:], x[..., -1:]], -1)
    out = np.stack([(3 * x + low) / 4, (3 * x + high) / 4], -1).reshape(*x.shape[:-1], -1)
    return np.moveaxis(out, -1, axis)


def _widened(plane: np.ndarray, p: Component, x: Header) -> np.ndarray:
    """A component at the image's size."""
    top_v, top_h = max(c.v for c in x.parts), max(c.h for c in x.parts)
    own = plane[: -(-x.height * p.v // top_v), : -(-x.width * p.h // top_h)]
    for axis, (part, top) in enumerate(((p.v, top_v), (p.h, top_h))):
        if top == 2 * part:
            own = _doubled(own, axis)
        elif top != part:
            own = np.take(own, np.arange((x.height, x.width)[axis]) * part // top, axis)
    return own[: x.height, : x.width]


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)


def _image(x: Header, blocks: np.ndarray) -> np.ndarray:
    planes = [_widened(_plane(blocks, p, x.quantisers[p.quantiser]), p, x) for p in x.parts]
    if len(planes) == 1:
        rgb = np.repeat(planes[0][..., None], 3, 2)
    elif len(planes) == 3:
        plain = x.transform == 0 or x.transform is None and [p.name for p in x.parts] == [ord(c) for c in "RGB"]
        rgb = np.stack(planes, -1) if plain else to_rgb(*planes)
    elif len(planes) == 4:  # inks, stored inverted
        ink = to_rgb(*planes[:3]) if x.transform == 2 else np.stack(planes[:3], -1)
        rgb = np.clip(ink, 0, 255) * planes[3][..., None] / 255
    else:
        raise ValueError("components")
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: list[bytes]) -> list[np.ndarray]:
    """[h, w, 3] of each image, a bounded count of blocks at a time, images of like size together."""
    heads = [parse(d) for d in data]
    load = [h.units[0] * h.units[1] * sum(p.h * p.v for p in h.parts) for h in heads]
    out: list = [None] * len(data)
    held: list[int] = []
    total = 0
    for k in [*sorted(range(len(data)), key=lambda k: load[k]), None]:
        if held and (k is None or total + load[k] > BATCH_BLOCKS):
            blocks = _coefficients([heads[j] for j in held])
            for j in held:
                out[j] = _image(heads[j], blocks)
            held, total = [], 0
        if k is not None:
            held.append(k)
            total += load[k]
    return out


def encode(px: np.ndarray, quantiser: int = 1) -> bytes:
    """A baseline JPEG of an [h, w, 3] image, no chroma left out, all coefficients divided by one number: for fixtures and tests."""
    h, w = px.shape[:2]
    full = np.pad(px, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = full[..., 0], full[..., 1], full[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = (y - 128, (b - y) / 1.772, (r - y) / 1.402)
    cut = lambda p: p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    turned = [np.rint(_COSINES @ cut(p) @ _COSINES.T / quantiser).astype(int).reshape(-1, 64)[:, ZIGZAG] for p in planes]
    # Codes of 4 bits for the sizes of steps; else of 8 for the symbols below 128 and of 9 for the others.
    code = lambda s: (s, 8) if s < 128 else (256 + s - 128, 9)
    bits: list[str] = []

    def put(symbol: int, value: int, size: int, first: bool = False) -> None:
        c, n = (symbol, 4) if first else code(symbol)
        bits.append(format(c, f"0{n}b") + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""))

    before = [0, 0, 0]
    for blocks in zip(*turned):
        for c, block in enumerate(blocks):
            step, before[c] = int(block[0]) - before[c], int(block[0])
            put(abs(step).bit_length(), step, abs(step).bit_length(), True)
            run = 0
            for v in block[1 : 1 + int(np.flatnonzero(block)[-1:].sum())].tolist():
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(0xF0, 0, 0)
                    run -= 16
                put(run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                run = 0
            if not block[63]:
                put(0, 0, 0)
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    codes = bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12), 0x10, *[0] * 7, 128, 128, *[0] * 7, *range(256)])
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k, 0x11, 0]) for k in (1, 2, 3))
    return b"\xff\xd8" + part(0xDB, b"\0" + bytes([quantiser] * 64)) + part(0xC0, frame) + part(0xC4, codes) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
