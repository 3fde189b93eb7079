"""BPE encoding and decoding by a prefix-sharing trie.

For every prefix of a word, the BPE encoding of that prefix is fixed by its last
token: it is the one token that ends the prefix and is compatible with the
encoding of what stands before it.  Two neighbouring tokens are compatible when
encoding their joined bytes gives back the two.  So distinct words of a batch go
into one trie; a depth-first walk gives each node its last token and the node
before it, computing a prefix once for all the words that share it; the ids of a
word are read off by following those links back.

The vocabulary file is a parameter and is never copied.  Files larger than a
word (added tokens such as <|endoftext|>) are matched in the text first, as the
file asks.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Texts, distinct_spans, give_back, id_and_text, ragged

#: The byte-level word pattern of the public vocabulary files.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids by one worker; when there are more, those go that were not met for longest.
CACHE_WORDS = 250_000
#: Pairs of tokens known to be compatible or not, likewise.
COMPATIBLE = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE = (-1, 0, 0)  # what no merge has made


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.token = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for s, i in ids.items():
            self.token[i] = s
        for s, i in self.added.items():
            self.token[i] = s.encode()
        self.single = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = (r, whole)
            self.split.setdefault(whole, (r, left, right))
        self.length = [len(t) for t in self.token]
        self.good: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self._tokens = ids
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(WORDS)

    def automaton(self) -> None:
        """States are the prefixes of tokens; ends[state]: the tokens that end there, longest first."""
        ids = self._tokens
        self.step: list[dict[int, int]] = [{}]
        own, self.fail = [-1], [0]
        for s, i in ids.items():
            at = 0
            for b in s:
                to = self.step[at].get(b)
                if to is None:
                    to = self.step[at][b] = len(self.step)
                    self.step.append({})
                    own.append(-1)
                at = to
            own[at] = i
        self.fail = [0] * len(self.step)
        self.ends: list[tuple[int, ...]] = [()] * len(self.step)
        todo = [*self.step[0].values()]
        for at in todo:
            self.ends[at] = ((own[at],) if own[at] >= 0 else ()) + self.ends[self.fail[at]]
            for b, to in self.step[at].items():
                f = self.fail[at]
                while f and b not in self.step[f]:
                    f = self.fail[f]
                self.fail[to] = self.step[f].get(b, 0)
                todo.append(to)

    def follow(self, state: int, b: int) -> int:
        """The state after one more byte; what is found is kept as a direct arc."""
        f = state
        while f and b not in self.step[f]:
            f = self.fail[f]
        return self.step[f].get(b, 0)

    def merge(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank first: for the vocabulary's own tokens and for tests."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(self.rank[pair][1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two."""
        key = (left, right)
        got = self.good.get(key)
        if got is None:
            if len(self.good) > COMPATIBLE:
                self.good.clear()
            got = self.good[key] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges at the border, the latest first (equal ranks are made from the
        # left). A merge across the border that would have come sooner rules the two out.
        rank, split, limit = self.rank, self.split, len(self.rank)
        while True:
            across = rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = split.get(left, _BYTE), split.get(right, _BYTE)
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        got = self.alone.get(token)
        if got is None:
            got = self.alone[token] = self.merge(self.token[token]) == [token]
        return got

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words, given in sorted order: so the trie's nodes come depth first, and the open branch is all of it that is kept."""
        out: list[list[int]] = []
        lasts, states, before = [-1], [0], b""
        length, good, whole, ends, step = self.length, self.good, self.alone, self.ends, self.step
        for w in words:
            keep, most = 0, min(len(w), len(before))
            while keep < most and before[keep] == w[keep]:
                keep += 1
            del lasts[keep + 1 :], states[keep + 1 :]
            state, depth = states[keep], keep
            for b in w[keep:]:
                depth += 1
                to = step[state].get(b)
                state = self.follow(state, b) if to is None else to
                states.append(state)
                for token in ends[state]:
                    n = length[token]
                    if n == depth:
                        ok = whole.get(token)
                        if self.whole(token) if ok is None else ok:
                            break
                    else:
                        left = lasts[depth - n]
                        ok = good.get((left, token))
                        if self.compatible(left, token) if ok is None else ok:
                            break
                else:
                    raise AssertionError("every byte is a token")
                lasts.append(token)
            ids, k = [], depth
            while k:
                token = lasts[k]
                ids.append(token)
                k -= length[token]
            ids.reverse()
            out.append(ids)
            before = w
        return out


# --- splitting texts into words -------------------------------------------------

_CLASS: list[np.ndarray] = []
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """The class of every code point, as the word pattern sees it."""
    if not _CLASS:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _CLASS.append(table)
    return _CLASS[0]


def word_spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words that WORDS finds in each text, and for each text its first word's number.

    The same as the pattern, read off whole arrays: a word is a run of one class,
    with one space before it; of white space before a word the last character
    stands alone unless it is that space; an apostrophe that starts its run and
    has no space before it takes s, t, m, d, re, ve or ll with it.
    """
    raw = t.bytes.tobytes()
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64)
    at = np.flatnonzero((t.bytes & 0xC0) != 0x80)  # the byte of each code point
    at = np.append(at, len(t.bytes))
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, t.offsets)] = True
    kind = char_classes()[cp]
    white = kind == WHITE
    fresh = edge[:n].copy()  # a new run begins
    fresh[1:] |= kind[1:] != kind[:-1]
    start = fresh.copy()
    # the last of the white space before a word
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
    start[last] = True
    spaced = last[cp[last] == 32]
    start[spaced + 1] = False  # it belongs to the word
    # contractions
    ap = np.flatnonzero((cp[:-1] == 39) & start[:-1] & fresh[:-1] & (kind[1:] == LETTER) & ~edge[1:n])
    if len(ap):
        c1 = cp[ap + 1]
        c2 = np.where((ap + 2 < n) & ~edge[np.minimum(ap + 2, n)], cp[np.minimum(ap + 2, n - 1)], 0)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        hit = one | two
        start[ap[hit] + 1] = False
        after = ap[hit] + np.where(one[hit], 2, 3)
        after = after[after < n]
        start[after[~edge[after]]] |= kind[after[~edge[after]]] == LETTER
    first = np.flatnonzero(start)
    ends = np.append(first[1:], n)
    return at[first], at[ends], np.searchsorted(at[first], t.offsets)


class Encoder:
    """A vocabulary with the words that were encoded before."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.fresh = self._walk()
        self.cache: dict[bytes, bytes] = {}
        self.bytes = np.frombuffer(b"".join(self.v.token), np.uint8)
        self.lengths = np.array(self.v.length, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _walk(self):
        self.v.automaton()
        return self.v.encode_words

    def _plain(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, end to end, and each text's first."""
        starts, ends, firsts = word_spans(t)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(t) + 1, np.int64)
        code, first = distinct_spans(t.bytes, starts, ends)
        raw, cache = t.bytes.tobytes(), self.cache
        words = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
        found = list(map(cache.pop, words, repeat(None)))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            order = sorted(new, key=words.__getitem__)
            for k, ids in zip(order, self.fresh([words[k] for k in order])):
                found[k] = array("i", ids).tobytes()
        cache.update(zip(words, found))  # at its end, so that its first words are those not met for longest
        for w in list(islice(cache, max(0, len(cache) - CACHE_WORDS))):
            del cache[w]
        table = np.frombuffer(b"".join(found), np.int32)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        per_word = size[code]
        ids = table[ragged((np.cumsum(size) - size)[code], per_word)]
        return ids, np.append(0, np.cumsum(per_word))[firsts]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (int32), and for each text where its own begin."""
        v = self.v
        if v.added_pattern is not None:
            import pyarrow.compute as pc

            if pc.any(pc.match_substring_regex(texts, "|".join(regex.escape(x) for x in v.added))).as_py():
                return self._with_added(texts.to_pylist())
        return self._plain(Texts(texts))

    def _with_added(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            at = 0
            for m in self.v.added_pattern.finditer(text or ""):
                parts += [text[at : m.start()], self.v.added[m.group(0)]]
                owner += [k, k]
                at = m.end()
            parts.append((text or "")[at:])
            owner.append(k)
        ids, firsts = self._plain(Texts(pa.array([p if isinstance(p, str) else "" for p in parts], pa.large_string())))
        pieces = [np.array([p], np.int32) if isinstance(p, int) else ids[firsts[k] : firsts[k + 1]] for k, p in enumerate(parts)]
        counts = np.zeros(len(texts) + 1, np.int64)
        np.add.at(counts, np.array(owner, np.int64) + 1, [len(p) for p in pieces])
        return np.concatenate([*pieces, np.zeros(0, np.int32)]), np.cumsum(counts)

    def decode(self, ids: np.ndarray, firsts: np.ndarray) -> list[str]:
        """The texts of ids; bytes that are no UTF-8 become replacement characters."""
        size = self.lengths[ids]
        raw = self.bytes[ragged(self.starts[ids], size)].tobytes()
        at = np.append(0, np.cumsum(size))[firsts].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def in_slices(batch: pa.RecordBatch, limit: int = 2 << 20, column: int = 1):
    """Slices of about so many text bytes: bounds what one step holds."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(batch.num_rows, int(np.searchsorted(ends, before + limit)) + 1)
        yield batch.slice(start, stop - start)
        start = stop
        give_back()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row of docs.

    Null texts count as empty and have no ids; repeated rows each get a row; an
    empty table gives none; other columns are left out.
    """

    def run(batches):
        e = encoder(path)
        for b in batches:
            for part in in_slices(b):
                ids, firsts = e.ids(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids)), pa.array(e.decode(ids, firsts), pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and its digests in one pass, without moving the ids. Same cases."""

    def run(batches):
        e = encoder(path)
        say = [str(k) for k in range(len(e.v.token))]
        for b in batches:
            for part in in_slices(b):
                ids, firsts = e.ids(part.column(1))
                named = list(map(say.__getitem__, ids.tolist()))
                at = firsts.tolist()
                hashes = [hashlib.sha256(",".join(named[x:y]).encode()).hexdigest() for x, y in zip(at, at[1:])]
                decoded = [hashlib.sha256(x.encode()).hexdigest() for x in e.decode(ids, firsts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(firsts)), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
