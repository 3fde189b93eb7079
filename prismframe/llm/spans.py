"""Substring deduplication by sliding sentence spans.

Every run of SPAN consecutive sentences is hashed to 128 bits, runs are matched over the whole
corpus, and each sentence that a run covers which is not the first of its kind (by
doc_id, then place) is removed.  A chunk settles its own repeats; only its first
run of each kind is matched with those of other chunks.

A sentence ends with . ! ? (or their full-width forms) before white space, or with
a line; one of over LONG words is cut, so that text without punctuation has spans
too: by content at the words whose hash is the least of NEAR words in a row, which
are the same wherever a passage stands, or else after every LONG words.  By content,
a span is the least run with SPAN * UNIT units: a whole sentence has UNIT, a piece
of a cut one as many as it has words; spans begin with sentences and at the words
whose hash is the least of FAR in a row.  Two equal passages of over 50 words in cut
sentences always have an equal span: one begins at a word from 7 to 14 and ends by 47,
and what stands around a passage has no say in words 7 to 43 for FAR, 3 to 47 for NEAR.  Sentences are compared by their words,
A-Z in lower case.  Texts of fewer than SPAN sentences, or fewer units, have no span.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, Texts, apply_back, back_rows, bins_for, by_bin, cut_out, doc_keys, emit, from_least, item_hashes, lowered, make_chunks, narrow, pack_arrays, reduce_bins, runs_per_text, span_hashes, to_ids, unpack_arrays, with_texts, word_bounds

SPAN = 3
LONG = 16
NEAR, FAR, UNIT = 4, 8, 10


def least_of(near: int, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words whose hash is the least (the last such one) of `near` words in a row of one sentence of over LONG words."""
    n = len(words) - near + 1
    chosen = np.zeros(len(words), bool)
    if n > 0:
        sentence = np.repeat(np.arange(len(at)), size)
        whole = np.flatnonzero((sentence[:n] == sentence[near - 1 :]) & (size > LONG)[sentence[:n]])
        least, place = words[whole + near - 1], whole + near - 1
        for k in range(near - 2, -1, -1):
            less = words[whole + k] < least
            least, place = np.where(less, words[whole + k], least), np.where(less, whole + k, place)
        chosen[place] = True
    return chosen


def sentences(t: Texts, content: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """First byte, hash (both lanes) and units of each sentence, whether spans begin there, and each text's first sentence."""
    raw = lowered(t.bytes)
    starts, ends, firsts = word_bounds(t)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), [np.zeros(0, U64)] * 2, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(t) + 1, np.int64)
    words, other = (span_hashes(raw, starts, ends, lane) for lane in (0, 1))
    last = raw[ends - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    wide = ends - starts >= 3
    three = raw[ends - 3].astype(np.int64) << 16 | raw[ends - 2].astype(np.int64) << 8 | last
    stop |= wide & np.isin(three, [0xE38082, 0xEFBC81, 0xEFBC9F])
    lines = np.append(0, np.cumsum(raw == 10, dtype=np.int32))
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    begin = np.empty(n, bool)
    begin[0], begin[1:] = True, stop[:-1]
    begin[firsts[:-1][firsts[:-1] < n]] = True
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, n))
    cut = size > LONG
    if content and cut.any():
        starting = begin | least_of(FAR, words, at, size)
        begin |= least_of(NEAR, words, at, size)
        sentence = np.repeat(np.arange(len(at)), size)
        at = np.flatnonzero(begin)
        starting = starting[at]
        units = np.where(cut[sentence[at]], np.diff(np.append(at, n)), UNIT)
    elif cut.any():
        pieces = (size + LONG - 1) // LONG
        at = np.repeat(at, pieces) + LONG * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    if not (content and cut.any()):
        units, starting = np.full(len(at), UNIT), np.ones(len(at), bool)
    own = [item_hashes(x, at, np.append(at[1:], n), lane) for lane, x in enumerate((words, other))]
    return starts[at], own, units, starting, np.searchsorted(at, firsts)


def span_runs(own: list[np.ndarray], units: np.ndarray, starting: np.ndarray, firsts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hash (both lanes), first sentence and the place behind the last one of all spans that lie in one text."""
    total = np.append(0, np.cumsum(units))
    stop = np.searchsorted(total, total[:-1] + SPAN * UNIT)
    at = np.flatnonzero(starting & (stop <= np.repeat(firsts[1:], np.diff(firsts))))
    return [item_hashes(x, at, stop[at], lane) for lane, x in enumerate(own)], at, stop[at]


class _Spans:
    """The spans of a chunk in the order of their keys, those of one key in the order of the corpus."""

    def __init__(self, table: pa.Table, content: bool):
        self.t = Texts(table.column("text"))
        self.begin, own, units, starting, self.firsts = sentences(self.t, content)
        keys, at, stop = span_runs(own, units, starting, self.firsts)
        self.stop = np.zeros(len(self.begin), np.int64)
        self.stop[at] = stop
        docs = doc_keys(table)
        text = np.searchsorted(self.firsts, at, "right") - 1
        order = np.lexsort((at, docs[text], keys[1], keys[0]))
        self.keys, self.check, self.at, self.docs = keys[0][order], keys[1][order], at[order], docs[text][order]
        self.first = np.ones(len(at), bool)
        self.first[1:] = (self.keys[1:] != self.keys[:-1]) | (self.check[1:] != self.check[:-1])

    def gone(self, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentences to remove, and their bytes; later: spans that stand first here, but not in the corpus."""
        n = len(self.begin)
        change = np.zeros(n + 1, np.int64)
        for at in (self.at[~self.first], later):
            np.add.at(change, at, 1)
            np.add.at(change, self.stop[at], -1)
        covered = np.cumsum(change[:n]) > 0
        bytes_ = np.zeros(len(self.t.bytes), bool)
        # A sentence reaches to the next one, or to the end of its text.
        stop = np.append(self.begin[1:], len(bytes_))
        last = self.firsts[1:][np.diff(self.firsts) > 0] - 1
        stop[last] = self.t.offsets[1:][np.diff(self.firsts) > 0]
        mark = np.zeros(len(bytes_) + 1, np.int64)
        np.add.at(mark, self.begin[covered], 1)
        np.add.at(mark, stop[covered], -1)
        bytes_[:] = np.cumsum(mark[:-1]) > 0
        return covered, bytes_


def _emit(bins: int, content: bool):
    def run(number, table):
        s = _Spans(table, content)
        if len(s.at):
            docs, low = from_least(s.docs[s.first])
            yield by_bin(number, bins, s.keys[s.first], docs, s.at[s.first], s.check[s.first], whole=(low,))

    return run


def _later(number: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    """For each chunk the spans that an earlier span of another chunk equals."""
    parts = [unpack_arrays(b) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    docs = np.concatenate([to_ids(p[1], p[4]) for p in parts])
    at = np.concatenate([p[2].astype(np.int64) for p in parts])
    chunk = np.repeat(np.array(chunks, np.int64), [len(p[0]) for p in parts])
    check = np.concatenate([p[3].astype(U64) for p in parts])
    order = np.lexsort((at, chunk, docs, check, keys))
    k, c = keys[order], check[order]
    again = order[1:][(k[1:] == k[:-1]) & (c[1:] == c[:-1])]
    again = again[np.argsort(chunk[again], kind="stable")]
    to, begin = np.unique(chunk[again], return_index=True)
    return back_rows(to.tolist(), number, [pack_arrays(narrow(x)) for x in np.split(at[again], begin[1:])] if len(to) else [])


def _matched(chunks: DataFrame, content: bool) -> DataFrame:
    return reduce_bins(emit(chunks, _emit(bins_for(chunks), content)), _later)


def _read(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpack_arrays(b)[0].astype(np.int64) for b in blobs)])


def report(docs: DataFrame, content: bool = False) -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_runs, n_bytes, n_bytes_removed, kept_sha256) for every row of docs.

    n_runs: maximal runs of removed sentences.  Null texts count as empty;
    repeated rows each get a row, and all but the first lose their spans; null ids
    come first; an empty table gives none; other columns are left out.  content: cut
    long sentences by content, as the query does; the plain version in tests does not.
    """
    chunks = make_chunks(docs.select("doc_id", "text"))

    def run(number, table, blobs):
        s = _Spans(table, content)
        covered, gone = s.gone(_read(blobs))
        removed, runs = runs_per_text(covered, s.firsts)
        kept, offsets = cut_out(s.t, gone)
        raw = kept.tobytes()
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return pa.table([table.column("doc_id"), pa.array(np.diff(s.firsts)), pa.array(removed), pa.array(runs), pa.array(np.diff(s.t.offsets)), pa.array(np.diff(s.t.offsets) - np.diff(offsets)), pa.array(sha, pa.string())], names=["doc_id", "n_sentences", "n_removed", "n_runs", "n_bytes", "n_bytes_removed", "kept_sha256"])

    return apply_back(chunks, _matched(chunks, content), run, "doc_id long, n_sentences long, n_removed long, n_runs long, n_bytes long, n_bytes_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, content: bool = True) -> DataFrame:
    """docs, all rows and columns, without the sentences of repeated spans; n_chars follows. Same cases as report()."""
    chunks = make_chunks(docs)

    def run(number, table, blobs):
        s = _Spans(table, content)
        return with_texts(table, *cut_out(s.t, s.gone(_read(blobs))[1]))

    return apply_back(chunks, _matched(chunks, content), run, docs.schema)
