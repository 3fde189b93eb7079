"""Secret scans with a recursive decoding worklist.

The text is the first layer.  Each layer is scanned, and unwrapped in every way
that applies: percent escapes and Unicode escapes over the whole layer, base64 run
by run, and compressed data (gzip, zlib, bz2, xz, in each other too) where decoded
bytes start like it.  What comes out is a new layer and goes to the worklist, until no new layer
appears.  A layer whose content and place were seen before is not taken again,
so layers that unwrap to themselves end too.  Every layer keeps, for each of its
characters, where it came from in the text; a find in any layer is reported as a
span of code points of the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import Texts, id_and_text

#: The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: A run, with the lines that go on with it: breaks may be escaped, and indented or quoted lines follow.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:(?:\\[rn]|\\?\r?\n)++[ \t>]*+[A-Za-z0-9+/_-]++)*+={0,2}")
BETWEEN = re.compile(r"(?:\\[rn]|\\?\r?\n)++[ \t>]*+")
#: What compressed data start with: gzip, zlib, bz2, xz.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: UTF-8 without control characters, where it may be long enough.
READABLE = re.compile(rb"(?=[\t\n\r\x20-\x7e\x80-\xf4]{16})(?:[\t\n\r\x20-\x7e]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++")
#: No find, and nothing that unwraps to one, is shorter.
SHORTEST = 16
MASK = "[REDACTED]"
#: Characters that the layers of one document may hold in all: bombs stop here, `unfinished` says so, and redact() masks what was not scanned.
LAYER_CHARS = 1 << 30
#: Bytes that a decompressor takes and gives at a time; characters of a piece of what comes out, of those that the next piece repeats, and of the longest piece.
CHUNK, PIECE, OVERLAP, LONGEST = 1 << 18, 2 << 20, 64 << 10, 32 << 20
#: Layers of compression straight in each other that are taken, and bytes by which a layer is known.
DEEPEST, HEAD = 64, 64 << 10
#: Neither base64 nor escapes, one line or many, run through these.
BREAK = re.compile(r"(?<=\S)\x20(?=\S)|(?<=\s{64})\s|[^\sA-Za-z0-9+/_=.%\\{}&#;:\"'>-]")


class Layer:
    """Text, and for each character the span of the document it came from."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:  # the document itself
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def origin(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            x = np.arange(a, b)
            return x, x + 1
        return self.starts[a:b], self.ends[a:b]


def find(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of the base finds in a text."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Greedy runs: those of 16 and more are what the plain pattern leaves after the short ones are dropped.
    out += [(m.start(), m.end(), 2, m.start()) for m in LONG_HEX.finditer(text)]
    return out


class Packed:
    """Compressed data from `end` on, all members.  After the pieces, `end` is the place behind them; `whole`: nothing is missing."""

    def __init__(self, data: bytes, start: int = 0):
        self.data, self.end, self.whole = data, start, True

    def chunks(self):
        while make := _decompressor(self.data[self.end : self.end + 6]):
            d, at, size, dry, over = make(), self.end, 0, True, False
            try:
                while not d.eof:
                    fed = getattr(d, "unconsumed_tail", b"")
                    if not fed and (dry or getattr(d, "needs_input", False)):
                        fed = self.data[at : at + CHUNK]
                        at += len(fed)
                    got = d.decompress(fed, CHUNK)
                    dry = not got
                    if dry and not fed and at >= len(self.data):
                        break
                    size += len(got)
                    yield got
            except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError) as e:
                over = "limit" in str(e)
            if not d.eof:
                # A few bytes only happen to look like compressed data.
                self.whole = size < SHORTEST and not over
                self.end = self.end + 1 if self.whole else len(self.data)
                return
            self.end = at - len(d.unused_data)
            while self.data[self.end : self.end + 1] == b"\0":  # padding between members
                self.end += 1

    def unwrapped(self):
        """The data out of all their layers of compression: what comes out and starts like compressed data is inflated again."""
        chunks, seen = self.chunks(), set()
        for _ in range(DEEPEST):
            head, ended = b"", True
            for got in chunks:
                head += got
                if len(head) >= HEAD:
                    ended = False
                    break
            rest = chunks
            chunks = (x for part in ((head,), rest) for x in part) if not ended else iter((head,))
            if not _inflates(head, ended):
                yield from chunks
                return
            if ended:
                if head in seen:  # it unwraps to itself
                    return
                seen.add(head)
            chunks = self._again(chunks)
        self.whole = False

    def _again(self, chunks):
        """What a stream of compressed data holds, all its members."""
        held = b""
        while True:
            while len(held) < 6 and (more := next(chunks, None)) is not None:
                held = (held + more).lstrip(b"\0") if not held.strip(b"\0") else held + more
            make = _decompressor(held[:6])
            if make is None:
                return
            d = make()
            try:
                while not d.eof:
                    if not held and getattr(d, "needs_input", True):
                        held = next(chunks, None)
                        if held is None:
                            self.whole = False
                            return
                    got = d.decompress(held, CHUNK)
                    held = getattr(d, "unconsumed_tail", b"")
                    yield got
            except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
                self.whole = False
                return
            held = d.unused_data.lstrip(b"\0")

    def pieces(self):
        """The text of the data, what is no UTF-8 replaced, in pieces that overlap and cut no run."""
        decoder, held, new, size, since = codecs.getincrementaldecoder("utf-8")("replace"), "", [], 0, 0
        for got in self.unwrapped():
            new.append(decoder.decode(got))
            size += len(new[-1])
            if size < PIECE:
                continue
            held, new, size = "".join([held, *new]), [], 0
            till = len(held) - OVERLAP
            cut = 0
            for k in range(till, since, -OVERLAP):  # the last one
                for m in BREAK.finditer(held, max(since, k - OVERLAP), k):
                    cut = m.start()
                if cut:
                    break
            if not cut and len(held) >= LONGEST:
                self.whole, cut = False, till
            if cut:
                yield held
                held = held[cut:]
            since = till - cut
        held = "".join([held, *new, decoder.decode(b"", True)])
        if len(held) >= 4:
            yield held


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    return None


def _inflates(head: bytes, ended: bool) -> bool:
    """Whether data that begin so are compressed: they look like it, and something comes out of them, or may still."""
    make = _decompressor(head[:6])
    try:
        return make is not None and (len(make().decompress(head, CHUNK)) > 0 or not ended)
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
        return False


class Work:
    """What a scan may still take, and the spans of the text that it did not scan to their end."""

    __slots__ = ("left", "stopped")

    def __init__(self):
        self.left, self.stopped = LAYER_CHARS, []

    def inflated(self, packed: Packed, a: int, b: int):
        """Layers of packed data whose place is a..b."""
        whole = True
        for text in packed.pieces():
            if self.left < 0:
                whole = False
                break
            yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))
        if not (whole and packed.whole):
            self.stopped.append((a, b))


def _spread(parts: list, layer: Layer) -> Layer | None:
    """A layer out of parts: (start, end) copied from the layer, or (text, start, end) decoded from there."""
    text, starts, ends = [], [], []
    for p in parts:
        if len(p) == 2:
            text.append(layer.text[p[0] : p[1]])
            s, e = layer.origin(*p)
        else:
            text.append(p[0])
            a, b = layer.span(p[1], p[2])
            s, e = np.full(len(p[0]), a), np.full(len(p[0]), b)
        starts.append(s)
        ends.append(e)
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def unwrap_percent(layer: Layer, work: Work):
    at, parts = 0, []
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m.group(0).replace("%", ""))
        inner = work.inflated(Packed(data), *layer.span(m.start(), m.end()))
        got = list(itertools.islice(inner, 2))
        if len(got) == 1:
            parts += [(at, m.start()), (got[0].text, m.start(), m.end())]
            at = m.end()
        elif got:
            yield from itertools.chain(got, inner)
        if got:
            continue
        try:
            # one character at a time, so that each keeps its own place
            got, k = data.decode("utf-8"), m.start()
        except UnicodeDecodeError:
            continue
        parts.append((at, m.start()))
        for c in got:
            size = 3 * len(c.encode())
            parts.append((c, k, k + size))
            k += size
        at = m.end()
    if parts:
        yield _spread([*parts, (at, len(layer.text))], layer)


def unwrap_escapes(layer: Layer, work: Work):
    at, parts, run, high = 0, [], [], None
    for m in ESCAPE.finditer(layer.text):
        code = int(m.group(6)) if m.group(6) else int(next(g for g in m.groups() if g), 16)
        if 0xDC00 <= code < 0xE000 and high and high[1].end() == m.start():  # the second half of a pair
            both = chr(0x10000 + (high[0] - 0xD800 << 10) + code - 0xDC00)
            parts += [(at, high[1].start()), (both, high[1].start(), m.end())]
            at = m.end()
        high = (code, m) if 0xD800 <= code < 0xDC00 else None
        if run and (code > 255 or run[-1][1].end() != m.start()):
            yield from _escaped_bytes(run, layer, work)
            run = []
        if code < 256:
            run.append((code, m))
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts += [(at, m.start()), (chr(code), m.start(), m.end())]
            at = m.end()
    yield from _escaped_bytes(run, layer, work)
    if parts:
        yield _spread([*parts, (at, len(layer.text))], layer)


def _escaped_bytes(run: list, layer: Layer, work: Work):
    """Layers of compressed data in neighbouring escapes of bytes."""
    data, taken = bytes(code for code, _ in run), 0
    for head in PACKED.finditer(data):
        if head.start() >= taken:
            packed = Packed(data, head.start())
            yield from work.inflated(packed, *layer.span(run[head.start()][1].start(), run[-1][1].end()))
            taken = packed.end


def unwrap_base64(layer: Layer, work: Work):
    for m in BASE64.finditer(layer.text):
        run, place = m.group(0).rstrip("="), None
        if "\n" in run or "\\" in run:  # lines are joined; place: of each character in the layer
            keep = np.ones(len(run), bool)
            for gap in BETWEEN.finditer(run):
                keep[gap.start() : gap.end()] = False
            place = m.start() + np.flatnonzero(keep)
            run = BETWEEN.sub("", run)
        run = run.translate(_URL_SAFE)
        # A path or a key may stand before the data, and more behind them: with the groups of four begun at each of
        # four places, any start is on a border of some decoding, and what is not the data's is unreadable or harmless.
        for shift in range(4):
            body = run[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            taken = 0  # bytes that compressed data took
            for head in PACKED.finditer(data):
                if head.start() < taken:
                    continue
                packed = Packed(data, head.start())
                yield from work.inflated(packed, *layer.span(m.start(), m.end()))
                taken = packed.end
            for r in READABLE.finditer(data):
                if r.end() - r.start() < SHORTEST:
                    continue
                got = r.group(0).decode("utf-8")
                if layer.starts is not None and not layer.starts.strides[0]:  # all from one place
                    yield Layer(got, np.broadcast_to(layer.starts[0], len(got)), np.broadcast_to(layer.ends[0], len(got)))
                    continue
                sizes = np.fromiter((len(c.encode()) for c in got), np.int64, len(got))
                group = shift + r.start() // 3 * 4
                first = r.start() % 3 + np.cumsum(sizes) - sizes
                until = min(group + (int(sizes.sum()) + 4) // 3 * 4 + 4, len(run))
                if place is None:
                    s, e = layer.origin(m.start() + group, m.start() + until)
                elif layer.starts is None:
                    s, e = place[group:until], place[group:until] + 1
                else:
                    s, e = layer.starts[place[group:until]], layer.ends[place[group:until]]
                left = first // 3 * 4 + first % 3
                last = first + sizes - 1
                right = np.minimum(last // 3 * 4 + last % 3 + 1, len(s) - 1)
                yield Layer(got, s[np.minimum(left, len(s) - 1)], e[right])


_URL_SAFE = str.maketrans("-_", "+/")
UNWRAP = (unwrap_percent, unwrap_escapes, unwrap_base64)


def scan(text: str) -> tuple[list, list, int, bool]:
    """Base finds; all finds as sorted distinct (start, end, kind, start of the value); layers; whether something was not scanned to its end."""
    base, every, layers, stopped = scanned(text)
    return base, every, layers, bool(stopped)


def scanned(text: str) -> tuple[list, list, int, list]:
    """scan(), with the spans that were not scanned to their end."""
    base = find(text)
    every, layers, work = {(a, b, k): v for a, b, k, v in base}, 1, Work()
    unwrapped = lambda layer: (new for way in UNWRAP for new in way(layer, work))
    # Depth first, so that pieces do not pile up.
    stack, seen = [unwrapped(Layer(text, None, None))], {hash_of(text, 0, len(text))}
    while stack:
        new = next(stack[-1], None)
        if new is None:
            stack.pop()
            continue
        if not new.text:
            continue
        a, b = new.span(0, len(new.text))
        work.left -= len(new.text)
        key = hash_of(new.text, a, b)
        if key in seen:
            continue
        if work.left < 0:
            work.stopped.append((a, b))
            continue
        seen.add(key)
        layers += 1
        for s, e, kind, v in find(new.text):
            x, y = new.span(s, e)
            every.setdefault((x, y, kind), new.span(v, e)[0])
        stack.append(unwrapped(new))
    return sorted(base, key=lambda f: (f[0], f[2])), sorted(((a, b, k, v) for (a, b, k), v in every.items()), key=lambda f: (f[0], f[2], f[1])), layers, work.stopped


def hash_of(text: str, a: int, b: int) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass") + b"%d:%d" % (a, b), digest_size=16).digest()


def worth(t: Texts) -> np.ndarray:
    """Which texts have a character sequence that a find or an unwrapping needs: all others have neither."""
    raw = t.bytes
    n = len(raw)
    hit = np.zeros(n + 1, np.int32)
    if n:
        mark = _MARK[raw]
        flag = (mark & 1) > 0  # : = % \ &
        for bit in (2, 4):  # runs of 16 hexadecimal digits, and of base64
            run = (mark & bit) > 0
            d = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]])))
            begin, end = d[::2], d[1::2]
            flag[begin[end - begin >= 16]] = True
        a = np.flatnonzero(raw == 75)  # the K of AKIA
        a = a[(a > 0) & (a < n - 2)]
        flag[a[(raw[a - 1] == 65) & (raw[a + 1] == 73) & (raw[a + 2] == 65)]] = True
        hit[1:] = np.cumsum(flag)
    return hit[t.offsets[1:]] > hit[t.offsets[:-1]]


_MARK = np.zeros(256, np.uint8)
_MARK[[ord(c) for c in ":=%\\&"]] |= 1
_MARK[[ord(c) for c in "0123456789abcdef"]] |= 2
_MARK[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] |= 4


def digest_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers, unfinished) for every row of docs.

    Null texts count as empty; repeated rows each get a row; an empty table gives
    none; other columns are left out.
    """

    def run(batches):
        for b in batches:
            for part in in_slices(b):
                out: list[list] = [[] for _ in range(7)]
                for ok, x in zip(worth(Texts(part.column(1))).tolist(), part.column(1)):
                    base, every, layers, unfinished = scan(x.as_py()) if ok else ([], [], 1, False)
                    for k in range(3):
                        out[k].append(sum(f[2] == k for f in base))
                    out[3].append(hashlib.sha256(digest_of(base).encode()).hexdigest() if base else _NOTHING)
                    out[4].append(digest_of(every))
                    out[5].append(layers)
                    out[6].append(unfinished)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "unfinished"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, unfinished boolean")


def masked(text: str) -> str:
    """The text with the value of every find, in any layer, and what was not scanned to its end replaced by MASK."""
    out, at = [], 0
    _, every, _, stopped = scanned(text)
    for a, b in merged([*((v, b) for _, b, _, v in every), *stopped]):
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]]) if out else text


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def redact(docs: DataFrame) -> DataFrame:
    """docs with its secrets masked, all rows and columns; n_chars, where there is one, follows.

    Null texts stay null; empty ones and repeated rows are kept as they are or
    masked alike; an empty table gives none; other columns may have any name.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches):
        at = names.index("text")
        for b in (part for whole in batches for part in in_slices(whole, column=at)):
            texts = b.column(at)
            flags = worth(Texts(texts)).tolist()
            if any(flags):
                new = pa.array([masked(x.as_py()) if ok else x.as_py() for ok, x in zip(flags, texts)], pa.string())
                b = b.set_column(at, b.schema.field(at), new.cast(b.schema.field(at).type))
            yield b

    return with_lengths(docs.mapInArrow(run, schema))


def with_lengths(docs: DataFrame) -> DataFrame:
    """n_chars is the length of text again (where there is such a column)."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
