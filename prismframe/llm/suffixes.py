"""Suffix-array deduplication by a depth-limited radix sort.

Every byte that a string of DEPTH bytes covers which also starts earlier in the
corpus (smaller doc_id, or same document and earlier place) is removed.  To know
such strings, suffixes need to be sorted only through their first DEPTH bytes:
most-significant-digit passes of eight bytes split groups of suffixes, a group of
one is dropped, and what is still together after the last pass is a repeated
window.

The first digit deals suffixes to tasks.  It is the least hash of the SEED-byte
strings in the window: equal windows have equal digits, and neighbouring windows
mostly share theirs, so a stretch of windows travels as one string.

    digits of a chunk  -> those that other chunks have too
    their stretches    -> equal ones merge; radix passes over the windows of the rest
    repeated windows   -> marked in their chunk, bytes cut out

Stretches that repeat within a chunk are settled there, and equal stretches are
merged before the passes, so a passage in every document costs one entry a chunk.
A digit that more than HOT stretches have (a phrase in very many contexts) would
still fill one task: its windows are dealt by a digit of their whole DEPTH bytes
instead, one entry a chunk for each; first the digits alone, then the bytes of those
that another chunk has too.  Hashes only deal windows out: bytes decide that they
are equal, in the passes and everywhere else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLOB_SCHEMA, U64, Texts, apply_back, back_rows, bins_for, blob_rows, by_bin, checkpointed, cut_bins, cut_out, doc_keys, emit, from_least, make_chunks, mix, narrow, pack_arrays, ragged, reduce_bins, runs_per_text, to_ids, unpack_arrays, with_texts

DEPTH = 100
SEED = 32
#: Windows of one stretch at most.
STRETCH = 512
#: Bytes that are hashed at a time: what fits the processor's caches.
STEP = 1 << 18
#: Stretches of one digit in the corpus above which its windows are dealt one by one.
HOT = 20_000
#: Windows that are sorted at a time (more only where one digit has more).
WINDOWS = 1 << 18


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _seeds(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` (a multiple of eight) bytes from each place on."""
    words = np.ascontiguousarray(np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw), strides=(1,)))
    n = len(raw) - size + 1
    h = words[:n] * U64(0x9E3779B97F4A7C15)
    for k in range(8, size, 8):
        h ^= h >> U64(29)
        h += words[k : k + n]
        h *= U64(0xC2B2AE3D27D4EB4F)
    return mix(h)


def stretches(t: Texts, depth: int = DEPTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, count of windows, digit, and whether windows may repeat inside, of every stretch; windows are numbered by their first byte in the chunk.

    Two equal windows of one stretch hold the digit's string at equal places.  So
    it stands at two places at least, one of them before the last window and one
    past the first: the stretch is periodic if those differ.
    """
    starts, counts, digits, inners = [], [], [], []
    reach = depth - seed
    edges = t.offsets[1:-1]
    for low in range(0, len(t.bytes) - depth + 1, STEP):
        n = min(STEP, len(t.bytes) - depth + 1 - low)
        h = _seeds(t.bytes[low : low + n + depth - 1], seed)
        digit = _least(h, depth - seed + 1)
        # windows that reach over the end of a text are none
        ends = edges[np.searchsorted(edges, low, "right") : np.searchsorted(edges, low + n + depth - 1)] - low
        over = np.zeros(n + 1, np.int32)
        np.add.at(over, np.maximum(ends - depth + 1, 0), 1)
        np.add.at(over, np.minimum(ends, n), -1)
        ok = np.cumsum(over[:n]) == 0
        begin = ok.copy()
        begin[1:] &= ~ok[:-1] | (digit[1:] != digit[:-1])
        at = np.flatnonzero(begin)
        if not len(at):
            continue
        stop = ok.copy()
        stop[:-1] &= ~ok[1:] | begin[1:]
        size = np.flatnonzero(stop) + 1 - at
        own = mix(digit[at])  # least hashes are small: spread over all bins again
        q = np.arange(n, dtype=np.int32)
        left = np.minimum.reduceat(np.where((h[:n] == digit) & ok, q, np.int32(2**31 - 1)), at)
        right = np.maximum.reduceat(np.where((h[reach : reach + n] == digit) & ok, q + np.int32(reach), np.int32(-1)), at)
        inner = (left < right) & (right >= 0)
        if size.max() > STRETCH:
            parts = (size + STRETCH - 1) // STRETCH
            k = ragged(np.zeros(len(parts), np.int64), parts)
            at, size, own, inner = np.repeat(at, parts) + STRETCH * k, np.minimum(np.repeat(size, parts) - STRETCH * k, STRETCH), np.repeat(own, parts), np.repeat(inner, parts)
        starts.append(at + low)
        counts.append(size)
        digits.append(own)
        inners.append(inner)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(digits), np.concatenate(inners)


def _emit_digits(bins: int, depth: int):
    def run(number, table):
        digits, counts = np.unique(stretches(Texts(table.column("text")), depth)[2], return_counts=True)
        if len(digits):
            yield by_bin(number, bins, digits, counts)

    return run


SHARED_SCHEMA = "chunk long, bin int, blob binary, hot long"
DIGITS, WINDOW_DIGITS = 0, 1


def _shared(kind: int, limit: int | None):
    def run(number: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        """For each chunk the digits that another chunk has too, and which of them more than `limit` stretches have."""
        parts = [unpack_arrays(b) for b in blobs]
        keys, at, many = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        hot = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)) > (np.inf if limit is None else limit)
        out_chunks, out, count, start = [], [], [], 0
        for c, p in zip(chunks, parts):
            mine = at[start : start + len(p[0])]
            start += len(p[0])
            own = many[mine] > 1
            if own.any():
                out_chunks.append(c)
                out.append(pack_arrays(np.array([kind], np.uint8), p[0][own], hot[mine][own].astype(np.uint8)))
                count.append(int(hot[mine][own].sum()))
        rows = back_rows(out_chunks, number, out)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(count, pa.int64())], [*rows.schema.names, "hot"])

    return run


def _told(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _shared() said: digits of stretches, which of them are hot, and digits of single windows."""
    got = [unpack_arrays(b) for b in blobs]
    some = lambda kind: [g for g in got if g[0][0] == kind]
    join = lambda parts: np.concatenate([np.zeros(0, U64), *parts])
    return join(g[1] for g in some(DIGITS)), join(g[1][g[2] > 0] for g in some(DIGITS)), join(g[1] for g in some(WINDOW_DIGITS))


def equal_strings(raw: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each string the number of the first one that equals it, byte by byte (key: equal strings have equal keys)."""
    data, seen = raw.tobytes(), {}
    out = np.empty(len(at), np.int64)
    for i, (a, n, k) in enumerate(zip(at.tolist(), size.tolist(), key.tolist())):
        out[i] = seen.setdefault((k, data[a : a + n]), i)
    return out


class _Stretches:
    """The stretches of a chunk that may have an equal, in the order of the corpus and each only once; `gone`: the others of each."""

    def __init__(self, table: pa.Table, blobs: list[bytes], depth: int):
        t = self.t = Texts(table.column("text"))
        self.start, self.count, self.digit, self.inner = stretches(t, depth)
        shared, hot, self.windows = _told(blobs)
        kinds, at, many = np.unique(self.digit, return_inverse=True, return_counts=True)
        outside = np.zeros(len(kinds), bool)
        outside[np.searchsorted(kinds, shared)] = True
        own = np.flatnonzero(((many > 1) | outside)[at] | self.inner)
        # in the order of the corpus, so that the first of equal stretches is the one that stays
        docs = doc_keys(table)
        text = np.searchsorted(t.offsets, self.start[own], "right") - 1
        order = np.lexsort((self.start[own], text, docs[text]))
        own, text = own[order], text[order]
        first = equal_strings(t.bytes, self.start[own], self.count[own] + depth - 1, self.digit[own])
        stays = first == np.arange(len(own))
        self.gone = own[~stays]
        # Alone in the chunk and in the corpus once copies are merged: nothing left to compare.
        own, text = own[stays], text[stays]
        alone = np.bincount(at[own], minlength=len(kinds))
        keep = outside[at[own]] | (alone[at[own]] > 1) | self.inner[own]
        self.own, self.docs = own[keep], docs[text[keep]]
        self.hot = np.isin(self.digit[self.own], hot)

    def single_windows(self, depth: int):
        """The windows of hot digits, the first of equal ones, with their documents and digits; and the others."""
        own = self.own[self.hot]
        at = np.repeat(self.start[own], self.count[own]) + ragged(np.zeros(len(own), np.int64), self.count[own])
        docs = np.repeat(self.docs[self.hot], self.count[own])
        equal, begin = radix_groups(self.t.bytes, at, np.zeros(len(at), np.int64), depth)
        again = np.zeros(len(at), bool)
        again[equal[~begin]] = True
        key = window_digits(self.t.bytes, at[~again], depth)
        order = np.argsort(key, kind="stable")
        return at[~again][order], docs[~again][order], key[order], at[again]


def window_digits(raw: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """A digit of the `depth` bytes from each place on."""
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    h = np.full(len(at), depth, U64)
    for place in range(0, depth, 8):
        word = np.zeros(len(at), U64)
        for k in range(min(8, depth - place)):
            word = word << U64(8) | wide[at + (place + k)]
        h = mix(h ^ word)
    return h


def _emit_window_digits(bins: int, depth: int):
    def run(number, table, blobs):
        digits = np.unique(_Stretches(table, blobs, depth).single_windows(depth)[2])
        return by_bin(number, bins, digits, np.ones(len(digits), np.int64))

    return run


def _emit_stretches(bins: int, depth: int):
    def run(number, table, blobs):
        s = _Stretches(table, blobs, depth)
        t, start, count, digit, inner = s.t, s.start, s.count, s.digit, s.inner
        # Windows of hot digits one by one; the order of the corpus is kept.
        w_start, w_docs, w_key, again = s.single_windows(depth)
        some = np.isin(w_key, s.windows)
        w_start, w_docs, w_key = w_start[some], w_docs[some], w_key[some]
        gone = np.concatenate([s.gone, again])
        settled = pack_arrays(np.concatenate([start[s.gone], again]), np.concatenate([count[s.gone], np.ones(len(again), np.int64)]))
        own, docs = s.own[~s.hot], s.docs[~s.hot]
        by = np.argsort(digit[own], kind="stable")
        own, docs = own[by], docs[by]
        cuts, w_cuts = cut_bins(digit[own], bins), cut_bins(w_key, bins)
        rows, out = [], []
        used = np.flatnonzero(np.diff(cuts) + np.diff(w_cuts)).tolist()
        for b in used or [0] if len(gone) else used:
            x = slice(cuts[b], cuts[b + 1])
            w = slice(w_cuts[b], w_cuts[b + 1])
            w_ids, w_low = from_least(w_docs[w])
            ids, low = from_least(docs[x])
            w_bytes = t.bytes[ragged(w_start[w], np.full(w.stop - w.start, depth))]
            x = own[x]
            rows.append(b)
            out.append(pack_arrays(digit[x], narrow(ids), low, narrow(start[x]), narrow(count[x]), t.bytes[ragged(start[x], count[x] + depth - 1)], inner[x].view(np.uint8), np.frombuffer(settled if not rows[:-1] else b"", np.uint8), w_key[w], w_bytes, narrow(w_ids), w_low, narrow(w_start[w])))
        return blob_rows(rows, [number] * len(rows), out)

    return run


def radix_groups(raw: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes (their first bytes in raw: at) group by group through `depth` bytes, most significant digit first.

    Gives the suffixes that have an equal, by groups of equals and in their own
    order within, and for each whether it begins a group.  Each pass looks at
    eight more bytes and drops the suffixes that stand alone.
    """
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    active = np.arange(len(at))
    for place in range(0, depth, 8):
        if not len(active):
            break
        n = min(8, depth - place)
        where = at[active] + place
        digit = np.zeros(len(active), U64)
        for k in range(n):
            digit = digit << U64(8) | wide[where + k]
        order = np.lexsort((digit, group))
        active, g, d = active[order], group[order], digit[order]
        new = np.ones(len(active), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        group = np.cumsum(new)
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, group = active[~alone], group[~alone]
    begin = np.ones(len(active), bool)
    begin[1:] = group[1:] != group[:-1]
    return active, begin


def _repeated(depth: int):
    def run(number: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        """For each chunk its windows that an earlier window equals, as (first window, count)."""
        parts = [unpack_arrays(b) for b in blobs]
        digit = np.concatenate([p[0] for p in parts])
        docs = np.concatenate([to_ids(p[1], p[2]) for p in parts])
        start = np.concatenate([p[3].astype(np.int64) for p in parts])
        count = np.concatenate([p[4].astype(np.int64) for p in parts])
        raw = np.concatenate([p[5] for p in parts])
        inner = np.concatenate([p[6] for p in parts]) > 0
        chunk = np.repeat(np.array(chunks, np.int64), [len(p[0]) for p in parts])
        place = np.cumsum(count + depth - 1) - (count + depth - 1)
        order = np.lexsort((start, chunk, docs))
        digit, start, count, inner, chunk, place = digit[order], start[order], count[order], inner[order], chunk[order], place[order]
        first = equal_strings(raw, place, count + depth - 1, digit)
        stays = np.flatnonzero(first == np.arange(len(first)))
        out_chunk, out_start, out_count = [chunk[first != np.arange(len(first))]], [start[first != np.arange(len(first))]], [count[first != np.arange(len(first))]]
        # Digits with two different stretches at least, and periodic stretches: their windows are sorted.
        kinds, at, many = np.unique(digit[stays], return_inverse=True, return_counts=True)
        some = (many[at] > 1) | inner[stays]
        pick = stays[some]
        # Digits are apart from each other, so they can be taken a few at a time.
        group = at[some]
        pick, group = pick[np.argsort(group, kind="stable")], np.sort(group)
        edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(pick))
        load = np.append(0, np.cumsum(count[pick]))[edge]
        turn = 0
        while turn < len(edge) - 1:
            stop = max(turn + 1, int(np.searchsorted(load, load[turn] + WINDOWS, "right")) - 1)
            mine = pick[edge[turn] : edge[stop]]
            owner = np.repeat(mine, count[mine]).astype(np.int32)
            offset = ragged(np.zeros(len(mine), np.int64), count[mine]).astype(np.int32)
            found, begin = radix_groups(raw, place[owner] + offset, np.repeat(group[edge[turn] : edge[stop]], count[mine]), depth)
            turn = stop
            # The sort is stable, so a group's first is the earliest.
            later = np.sort(found[~begin])
            if len(later):
                own, window = owner[later], start[owner[later]] + offset[later]
                new = np.ones(len(later), bool)
                new[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
                begins = np.flatnonzero(new)
                out_chunk.append(chunk[own[begins]])
                out_start.append(window[begins])
                out_count.append(np.diff(np.append(begins, len(later))))
        # Windows of hot digits: each digit's are compared byte by byte.
        key = np.concatenate([p[8] for p in parts])
        if len(key):
            w_raw, ids = np.concatenate([p[9] for p in parts]), np.concatenate([to_ids(p[10], p[11]) for p in parts])
            w_start = np.concatenate([p[12].astype(np.int64) for p in parts])
            w_chunk = np.repeat(np.array(chunks, np.int64), [len(p[8]) for p in parts])
            order = np.lexsort((w_start, w_chunk, ids, key))
            edge = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order))
            turn = 0
            while turn < len(edge) - 1:
                stop = max(turn + 1, int(np.searchsorted(edge, edge[turn] + WINDOWS, "right")) - 1)
                some = order[edge[turn] : edge[stop]]
                turn = stop
                found, first = radix_groups(w_raw, some * depth, key[some].view(np.int64), depth)
                again = some[found[~first]]
                out_chunk.append(w_chunk[again])
                out_start.append(w_start[again])
                out_count.append(np.ones(len(again), np.int64))
        for c, p in zip(chunks, parts):
            if len(p[7]):
                s, n = unpack_arrays(p[7].tobytes())
                out_chunk.append(np.full(len(s), c))
                out_start.append(s)
                out_count.append(n)
        to, s, n = np.concatenate(out_chunk), np.concatenate(out_start), np.concatenate(out_count)
        by = np.argsort(to, kind="stable")
        names, begins = np.unique(to[by], return_index=True)
        edges = np.append(begins, len(by))
        return back_rows(names.tolist(), number, [pack_arrays(narrow(s[by][a:b]), narrow(n[by][a:b])) for a, b in zip(edges, edges[1:])])

    return run


def _gone(t: Texts, blobs: list[bytes], depth: int) -> np.ndarray:
    """The bytes that repeated windows cover."""
    change = np.zeros(len(t.bytes) + 1, np.int32)
    for b in blobs:
        start, count = (x.astype(np.int64) for x in unpack_arrays(b))
        np.add.at(change, start, 1)
        np.add.at(change, start + count + depth - 1, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _matched(chunks: DataFrame, depth: int) -> DataFrame:
    bins = bins_for(chunks)
    shared = checkpointed(reduce_bins(emit(chunks, _emit_digits(bins, depth)), _shared(DIGITS, HOT), SHARED_SCHEMA))
    told = shared.drop("hot")
    if not shared.where("hot > 0").isEmpty():
        windows = apply_back(chunks, told, _emit_window_digits(bins, depth), BLOB_SCHEMA)
        told = told.unionByName(reduce_bins(windows, _shared(WINDOW_DIGITS, None), SHARED_SCHEMA).drop("hot"))
    moved = apply_back(chunks, told, _emit_stretches(bins, depth), BLOB_SCHEMA)
    return reduce_bins(moved, _repeated(depth))


def report(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Null texts count as empty and texts shorter than `depth` have no window;
    repeated rows each get a row, and all but the first lose their windows; null
    ids come first; an empty table gives none; other columns are left out.
    """
    chunks = make_chunks(docs.select("doc_id", "text"))

    def run(number, table, blobs):
        t = Texts(table.column("text"))
        gone = _gone(t, blobs, depth)
        removed, runs = runs_per_text(gone, t.offsets)
        kept, offsets = cut_out(t, gone)
        raw = kept.tobytes()
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return pa.table([table.column("doc_id"), pa.array(np.diff(t.offsets)), pa.array(removed), pa.array(runs), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return apply_back(chunks, _matched(chunks, depth), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs, all rows and columns, without the bytes of repeated windows; n_chars follows.

    Same cases as report(), but a character goes only if all its bytes do, so texts
    stay valid; rows stay even if nothing of their text does.
    """
    chunks = make_chunks(docs)

    def run(number, table, blobs):
        t = Texts(table.column("text"))
        gone = _gone(t, blobs, depth)
        lead = np.flatnonzero((t.bytes & 0xC0) != 0x80)
        if len(lead):
            whole = np.logical_and.reduceat(gone, lead)
            gone = np.repeat(whole, np.diff(np.append(lead, len(gone))))
        return with_texts(table, *cut_out(t, gone))

    return apply_back(chunks, _matched(chunks, depth), run, docs.schema)
