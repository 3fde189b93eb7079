"""Small tables with every awkward row, and plain versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(b: bytes) -> bytes:
    return bytes(x | 32 if 65 <= x <= 90 else x for x in b)


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, row, chunk, payload): nulls, empty and long texts, copies, near copies, repeats, clashing columns."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + r.choice([".", "!", "?\n", ". "])
    text = lambda k: " ".join(sentence(r.randint(3, 12)) for _ in range(k))
    passage = text(8)
    base = text(12)
    out = [text(r.randint(1, 15)) for _ in range(n)]
    for k in range(0, n, 6):
        out[k] += " " + passage + " " + text(2)
    for k in range(1, n, 7):
        w = base.split(" ")
        w[r.randrange(len(w))] = "edit" + str(k)
        out[k] = " ".join(w)
    out += [out[3], out[3], "", "", None, "abc " * 900, "same line again and again here now\n" * 40, "one", "two words", passage]
    # one of many thousand words, that repeats a passage and itself
    long = " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", str(r.randrange(100))]) for _ in range(30_000))
    out.append(f"{long} {passage} {long[:3000]}")
    rows = [(k, t, r.choice(["en", "de", None]), f"s{k % 3}", None if t is None else len(t), k % 2, "x", None) for k, t in enumerate(out)]
    return [*rows, rows[4], (None, "a text without an id. It has sentences. And more of them.", None, None, 5, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, chunk string, payload binary"


def key(d) -> int:
    return -(2**63) if d is None else d


def ordered(rows):
    """Rows in the order of the corpus; equal ids as they come."""
    return sorted(((key(d), t or "") for d, t in rows), key=lambda x: x[0])


def sentences(t: bytes, long: int) -> list[tuple[int, bytes]]:
    words = [(m.start(), m.end()) for m in WORD.finditer(t)]
    out, held = [], []

    def close():
        for k in range(0, len(held), long):
            out.append(held[k : k + long])
        held.clear()

    for i, (a, b) in enumerate(words):
        held.append((a, b))
        w = t[a:b]
        if w[-1:] in b".!?" or w.endswith((b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")) or (i + 1 < len(words) and b"\n" in t[b : words[i + 1][0]]):
            close()
    close()
    return [(s[0][0], b" ".join(lower(t[a:b]) for a, b in s)) for s in out]


def spans(rows, span: int, long: int) -> list[tuple]:
    seen, out = set(), []
    for d, t in ordered(rows):
        raw = t.encode()
        s = sentences(raw, long)
        gone = [False] * len(s)
        for k in range(len(s) - span + 1):
            x = tuple(y[1] for y in s[k : k + span])
            if x in seen:
                gone[k : k + span] = [True] * span
            seen.add(x)
        at = [x[0] for x in s] + [len(raw)]
        kept = raw[: at[0]] + b"".join(raw[at[k] : at[k + 1]] for k in range(len(s)) if not gone[k]) if s else raw
        out.append((d, len(s), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def windows(rows, depth: int) -> list[tuple]:
    seen, out = set(), []
    for d, t in ordered(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            w = raw[k : k + depth]
            if w in seen:
                gone[k : k + depth] = b"\1" * depth
            seen.add(w)
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def without_windows(rows, depth: int) -> dict:
    """doc_id -> text without the characters all of whose bytes lie in windows that come again; ids distinct."""
    seen, out = set(), {}
    for d, t in ordered(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            w = raw[k : k + depth]
            if w in seen:
                gone[k : k + depth] = b"\1" * depth
            seen.add(w)
        kept, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[d] = "".join(kept)
    return out


def toxicity_score(text: str, model) -> float:
    """The score by plain loops over words, filters and places."""
    from prismframe.llm import toxicity

    raw = lower((text or "").encode())
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    import numpy as np

    ids = []
    for w in words:
        one = np.frombuffer(w, np.uint8)
        ids.append(toxicity.rows_of(one, np.array([0]), np.array([len(w)]))[0])
    x = [sum(model.table[i].astype(float) for i in row) * (1 - toxicity.DROP) for row in ids]
    x += [np.zeros(toxicity.WIDTH)] * max(toxicity.SPANS)
    logit = model.bias
    for j, f in enumerate(model.filters):
        for k in range(toxicity.FILTERS):
            best = max(sum(float(x[at + s] @ f[s][:, k]) for s in range(len(f)) if at + s < len(x)) for at in range(len(x)))
            logit += max(best, 0.0) * float(model.weights[j * toxicity.FILTERS + k])
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, logit))))


def language_model(rows, prior: float) -> list[tuple]:
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    texts = [(d, [*WORD.findall(lower((t or "").encode())), None]) for d, t in rows]
    train = [w for d, w in texts if fold(d) != 1]
    c = collections.Counter(x for w in train for x in w)
    pairs = collections.Counter(p for w in train for p in zip([None, *w], w))
    n, v = sum(c.values()), len(c)
    p = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for d, w in texts:
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((pairs[a, b] + prior * p(b)) / (c[a] + prior)) for a, b in zip([None, *w], w))
        out.append((key(d), fold(d) == 1, len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out)


def near_classes(rows, words: int, least: float) -> list[tuple]:
    """(doc_id, class_id) by all pairs that share a shingle."""
    bags = []
    for _, t in rows:
        w = WORD.findall(lower((t or "").encode()))
        bags.append(collections.Counter(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))) if w else collections.Counter())
    n, df = len(rows), collections.Counter(s for b in bags for s in b)
    weight = [{s: k * (1 + math.log(n / df[s]) / math.log(n)) for s, k in b.items()} for b in bags]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            low = sum(min(v, weight[b].get(s, 0)) for s, v in weight[a].items())
            total = sum(weight[a].values()) + sum(weight[b].values()) - low
            if (rows[a][1] or "") == (rows[b][1] or "") or total and low / total >= least:
                root[find(a)] = find(b)
    head: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        head[find(k)] = min(head.get(find(k), 2**63), key(d))
    return sorted((key(d), head[find(k)]) for k, (d, _) in enumerate(rows))
