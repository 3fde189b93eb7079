"""Hierarchical multi-length packing of tokenised documents.

Context sizes are tiers, each twice the one before it (256 ... 2048).  A document
longer than the largest is cut into full windows; what is left, and every
shorter document, goes to the smallest tier that holds it.

1. Each tier is packed by itself, best fit: a piece goes to the open window with
   the least room that holds it.
2. Gaps of long windows are filled with the pieces of shorter tiers, and then
   with cut pieces, so that windows become full.
3. What remains at the end of a pack is laid out in windows whose lengths are
   powers of two, which need no padding.
4. Windows are dealt to step groups of equal token counts, long ones first, each
   to the group with the least tokens so far.

A pack is a batch of documents of bounded size in one task: nothing is shuffled,
no window depends on another task, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Encoder, byte_symbols, in_slices
from .common import id_and_text

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
#: The least byte that begins a character from U+0500 on.
LATE = 0xD4
#: Windows of one training step.
STEP_WINDOWS = 8

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long, tier int, step_group long"


class LibraryEncoder(Encoder):
    """The library's ids; words met before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        of = byte_symbols()
        self.symbols = np.array([ord(c) for c in sorted(of, key=of.get)], "<u4")
        super().__init__(path)

    def _walk(self):
        return self._library_ids

    def _library_ids(self, words: list[bytes]) -> list[list[int]]:
        # Each is one word of the library's own pattern, so its model may take it, in the
        # characters that stand for bytes. Which later characters are letters depends on the
        # version of Unicode, and the library may know another: it cuts those words itself.
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        late = np.maximum.reduceat(raw, ends - size) >= LATE
        text, split = self.symbols[raw].tobytes().decode("utf-32-le"), self.library.model.tokenize
        out = [[] if x else [t.id for t in split(text[a:b])] for a, b, x in zip((ends - size).tolist(), ends.tolist(), late.tolist())]
        rest = np.flatnonzero(late).tolist()
        for k, x in zip(rest, self.library.encode_batch_fast([words[k].decode("utf-8") for k in rest], add_special_tokens=False)):
            out[k] = x.ids
        return out


_LIBRARY: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryEncoder(path)
    return _LIBRARY[path]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces for documents of these token counts.

    Every token lies in one piece; a window holds at most the largest tier; every
    window's total is the largest tier or a power of two.
    """
    top = tiers[-1]
    windows: list[list[tuple[int, int, int]]] = []
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        whole = n // top
        windows.extend([(d, k * top, top)] for k in range(whole))
        if rest := n - whole * top:
            routed[next(t for t in tiers if rest <= t)].append((d, whole * top, rest))
    # Each tier by itself; what it closes exactly is done.
    open_: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    small: list[tuple[int, int, int]] = []
    for t in tiers:
        rooms: dict[int, list[list]] = {}
        sizes: list[int] = []
        for piece in sorted(routed[t], key=lambda p: (-p[2], p[0])):
            k = np.searchsorted(sizes, piece[2]) if sizes else 0
            if k < len(sizes):
                room = sizes[k]
                window = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(k)
            else:
                room, window = t, []
            window.append(piece)
            room -= piece[2]
            if room:
                if room not in rooms:
                    rooms[room] = []
                    sizes.insert(int(np.searchsorted(sizes, room)), room)
                rooms[room].append(window)
            else:
                windows.append(window)
        left = [(room, w) for room in sizes for w in rooms[room]]
        if t == top:
            open_ = [(room, k, w) for k, (room, w) in enumerate(left)]
        else:
            small.extend(p for _, w in left for p in w)
    # Gaps of long windows take pieces of the shorter tiers: whole ones first, then cut ones.
    small.sort(key=lambda p: (p[2], -p[0]))
    sizes = [p[2] for p in small]
    for room, _, window in sorted(open_, key=lambda x: (x[0], x[1])):
        while room and small:
            k = int(np.searchsorted(sizes, room, "right")) - 1
            if k < 0:
                d, s, n = small.pop(0)
                sizes.pop(0)
                window.append((d, s, room))
                rest = (d, s + room, n - room)
                at = int(np.searchsorted(sizes, rest[2]))
                small.insert(at, rest)
                sizes.insert(at, rest[2])
                room = 0
            else:
                window.append(small.pop(k))
                room -= sizes.pop(k)
        if room:
            small.extend(window)  # nothing shorter is left: the tail takes it
            small.sort(key=lambda p: (p[2], -p[0]))
            sizes = [p[2] for p in small]
        else:
            windows.append(window)
    # The tail: end to end, in full windows and then in powers of two.
    total, room, window = sum(sizes), 0, []
    for d, s, n in reversed(small):
        while n:
            if not room:
                room = top if total >= top else 1 << (total.bit_length() - 1)
            take = min(n, room)
            window.append((d, s, take))
            s, n, room, total = s + take, n - take, room - take, total - take
            if not room:
                windows.append(window)
                window = []
    return windows


def step_groups(totals: list[int], per_step: int = STEP_WINDOWS) -> list[int]:
    """A group for each window, so that groups have nearly equal token counts."""
    groups = max(1, -(-len(totals) // per_step))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(totals)
    for k in sorted(range(len(totals)), key=lambda k: -totals[k]):
        held, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (held + totals[k], g))
    return out


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence.

    Null and empty texts are one token, the end id.  Repeated rows are packed as
    often as they come.  An empty table gives no rows; other columns are left out.
    sequence_id is unique: the task's partition, then a count.
    """

    def run(batches):
        e, number = library_encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            for part in in_slices(b):
                ids, firsts = e.ids(part.column(1))
                # the end id after each document
                ids = np.insert(ids, firsts[1:], END).astype("<u4")
                firsts = firsts + np.arange(len(firsts))
                counts = np.diff(firsts)
                windows = plan(counts.tolist(), tiers)
                totals = [sum(n for _, _, n in w) for w in windows]
                groups = step_groups(totals)
                pieces = [(d, s, n, number + k) for k, w in enumerate(windows) for d, s, n in w]
                d, s, n, q = (np.array(x, np.int64) for x in zip(*pieces))
                k = q - number
                ends = np.cumsum(n)
                before = ends - n
                opening = np.flatnonzero(np.diff(k, prepend=-1))
                offset = before - np.repeat(before[opening], np.diff(np.append(opening, len(k))))
                at = firsts[d] + s
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip((at * 4).tolist(), ((at + n) * 4).tolist())]
                size = np.array(totals, np.int64)
                tier = np.array([next((t for t in tiers if x <= t), tiers[-1]) for x in totals], np.int32)
                padded = np.where((size & (size - 1)) == 0, size, tiers[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), pa.array(s), pa.array(n), pa.array(crc, pa.int64()), pa.array(counts[d]), pa.array(q), pa.array(offset), pa.array(size[k]), pa.array(padded[k]), pa.array(tier[k]), pa.array(np.array(groups, np.int64)[k] + number)],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )
                number += len(windows)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
