"""Language-model scoring by a weighted backoff automaton.

The model is a bigram model smoothed towards unigrams: with P(w) = (c(w) + 0.5) /
(N + 0.5 (V + 1)),

    P(w | u) = (c(u w) + PRIOR P(w)) / (c(u) + PRIOR),

which sums to one for every u.  As an automaton: a state for each word u with an
arc for each bigram u w that was seen, weighted log P(w | u), and a failure arc to
the root, weighted log PRIOR / (c(u) + PRIOR); the root has an arc for each word.
A text is one walk from left to right: take the state's arc for the next word, or
fail to the root and take its arc; then stand in the state of that word.

Counts are of the whole corpus.  A chunk asks for the counts of the n-grams it
holds, and builds from them the part of the automaton that its texts can reach, so
no task ever holds the model.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BACK_SCHEMA, U64, Texts, apply_back, back_rows, bins_for, by_bin, checkpointed, cut_bins, emit, free, id_and_text, lowered, make_chunks, mix, narrow, pack_arrays, reduce_bins, span_hashes, unpack_arrays, word_bounds

#: Weight of the unigram model, in counts.
PRIOR = 1000.0
FOLDS, HELD_OUT = 5, 1
_END = U64(0x5DEECE66D1234567)
_PAIR = U64(0xC2B2AE3D27D4EB4F)


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


class Grams:
    """The words of a chunk, each text's closed by the end word, and the distinct n-grams with their counts in training texts."""

    def __init__(self, table: pa.Table):
        t = Texts(table.column("text"))
        raw = lowered(t.bytes)
        starts, ends, firsts = word_bounds(t)
        n = len(t)
        self.firsts = firsts + np.arange(n + 1)  # each text has one more word
        self.words = np.empty(len(starts) + n, U64)
        last = self.firsts[1:] - 1
        inner = np.ones(len(self.words), bool)
        inner[last] = False
        self.words[last] = _END
        self.words[inner] = span_hashes(raw, starts, ends)
        self.held = held_out(table.column("doc_id").to_pylist())
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.firsts[:-1]] = _END  # a text begins where another ended
        self.train = np.repeat(~self.held, np.diff(self.firsts))
        self.single, self.at_single, self.count_single = self._count(mix(self.words))
        self.double, self.at_double, self.count_double = self._count(mix(mix(before * _PAIR) ^ self.words))
        self.at_before = np.searchsorted(self.single, mix(before)) if len(before) else np.zeros(0, np.int64)

    def _count(self, keys: np.ndarray):
        distinct, at = np.unique(keys, return_inverse=True)
        return distinct, at, np.bincount(at[self.train], minlength=len(distinct))

    def sorted_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, as they are sent, and where each stood among words and then bigrams."""
        keys = np.concatenate([self.single, self.double])
        order = np.argsort(keys, kind="stable")  # of a word and a bigram with one key, the word first
        return keys[order], order

    def learn(self, bins: int, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The corpus counts of the words and of the bigrams, from what the bins sent back."""
        keys, order = self.sorted_keys()
        cuts, found = cut_bins(keys, bins), np.zeros(len(keys), np.int64)
        for number, counts in map(unpack_arrays, blobs):
            found[cuts[number[0]] : cuts[number[0] + 1]] = counts
        total = np.empty_like(found)
        total[order] = found
        return total[: len(self.single)], total[len(self.single) :]


def _emit(bins: int):
    def run(number, table):
        g = Grams(table)
        keys, order = g.sorted_keys()
        yield by_bin(number, bins, keys, np.concatenate([g.count_single, g.count_double])[order], order < len(g.single))

    return run


SUMS_SCHEMA = BACK_SCHEMA + ", tokens long, kinds long"


def _sum(number: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    """For each chunk the corpus counts of the keys it sent, in their order; and, with no chunk, the bin's N and V."""
    parts = [unpack_arrays(b) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    own = np.concatenate([p[1].astype(np.int64) for p in parts])
    single = np.concatenate([p[2].astype(bool) for p in parts])
    # A word and a bigram with one key stay apart.
    order = np.lexsort((single, keys))
    k, w = keys[order], single[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    begin = np.flatnonzero(new)
    sums = np.add.reduceat(own[order], begin) if len(begin) else own
    total = np.empty(len(k), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(begin, len(k))))
    words = w[begin]
    back = np.split(total, np.cumsum([len(p[0]) for p in parts])[:-1])
    rows = back_rows([None, *chunks], number, [None, *(pack_arrays(np.array([number]), narrow(x)) for x in back)])
    none = [None] * len(chunks)
    total_columns = [pa.array([int(sums[words].sum()), *none], pa.int64()), pa.array([int(np.count_nonzero(sums[words])), *none], pa.int64())]
    return pa.RecordBatch.from_arrays([*rows.columns, *total_columns], [*rows.schema.names, "tokens", "kinds"])


class Automaton:
    """The states and arcs that a chunk's texts can reach."""

    def __init__(self, g: Grams, single: np.ndarray, double: np.ndarray, total: int, kinds: int, prior: float = PRIOR):
        self.root = np.log10((single + 0.5) / (total + 0.5 * (kinds + 1)))  # arcs of the root
        self.fail = np.log10(prior / (single + prior))  # failure arcs; a state's number is its word's
        # The arcs of states, by bigram: those never seen do not exist.
        self.arc = np.full(len(double), np.nan)
        if len(double):
            left, right = np.empty(len(double), np.int64), np.empty(len(double), np.int64)
            left[g.at_double], right[g.at_double] = g.at_before, g.at_single
            seen = double > 0
            self.arc[seen] = np.log10((double[seen] + prior * 10 ** self.root[right[seen]]) / (single[left[seen]] + prior))

    def walk(self, g: Grams) -> np.ndarray:
        """The log10 probability of each text. Each step's state is the word before, so all steps are looked up at once and summed in order."""
        step = self.arc[g.at_double]
        none = np.isnan(step)
        step[none] = self.fail[g.at_before[none]] + self.root[g.at_single[none]]
        return np.add.reduceat(step, g.firsts[:-1]) if len(step) else np.zeros(0)


def report(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose remainder is HELD_OUT are scored but not learnt from.  Null and
    empty texts are one token, the end; null ids have the remainder of the empty
    text; repeated rows each count and each get a row; an empty table gives none;
    other columns are left out.
    """
    chunks = make_chunks(id_and_text(docs))
    bins = bins_for(chunks)
    back = checkpointed(reduce_bins(emit(chunks, _emit(bins)), _sum, SUMS_SCHEMA))
    n, v = back.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    free(docs.sparkSession)

    def run(number, table, blobs):
        g = Grams(table)
        single, double = g.learn(bins, blobs)
        model = Automaton(g, single, double, n, v, prior)
        known = np.append(0, np.cumsum(single[g.at_single] > 0))
        base = np.add.reduceat(model.root[g.at_single], g.firsts[:-1]) if len(g.held) else np.zeros(0)
        rows = len(g.held)
        return pa.table([table.column("doc_id"), pa.array(g.held), pa.array(np.diff(g.firsts)), pa.array(np.diff(known[g.firsts])), pa.array(np.full(rows, n, np.int64)), pa.array(base), pa.array(model.walk(g))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return apply_back(chunks, back.where("chunk is not null").select("chunk", "bin", "blob"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
