"""A convolutional text classifier for toxicity, trained in numpy.

Words (runs of letters and digits; A-Z in lower case) are hashed to rows of an
embedding table: a word's vector is the sum of its own row and of those of its
beginnings, so rare forms share what their stems have learnt.  Filters one, two and three words wide slide over the whole
text, each keeps its greatest response, and a logistic layer weighs those.  Only
the places of the greatest responses carry a gradient, so training is cheap.

What is learnt is learnt from every labelled row whose remainder is not 0, over
its whole text.  Those rows are dealt to shards of some SHARD_BYTES of text by a hash
of the id.  In each epoch every shard goes on from the common model; then the shards'
models are averaged, an embedding row over the shards that touched it.  One shard, as
small tables have, is trained without a break.  A fifth of the rows, by another hash
of the id, is kept from training to set the thresholds: one for each language with
enough rows of both classes, and one for the rest.  Language decides only the
threshold, never the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import BACK_SCHEMA, Texts, back_rows, checkpointed, distinct_spans, free, give_back, lowered, narrow, pack_arrays, ragged, reduce_bins, remainder, span_hashes, unpack_arrays, word_bounds

BUCKET_BITS = 16
#: Beginnings of words, in bytes, that have rows too.
STEMS = (4, 5, 6, 7, 8, 9)
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
#: Text bytes of a shard of labelled rows, and of all rows that are searched for them at a time.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 32 << 20
#: Blocks of the embedding table that are averaged apart, at least, and shards for each of them beyond that.
BLOCKS, SHARDS_PER_BLOCK = 32, 16
#: Words of one stretch where shortened() takes a long text's.
STRETCH = 64
EPOCHS = 8
BATCH = 64
#: Text bytes scored at a time.
SLICE = 1 << 20
RATE = 0.02
#: Share of rows left out at random while training.
DROP = 0.3
#: Labelled rows of each class that a language needs for a threshold of its own.
THRESHOLD_ROWS = 20
#: A threshold stays within these: a handful of rows must not turn it to either end.
THRESHOLDS = (0.3, 0.8)
#: Cells of scores between which thresholds may lie.
CELLS = 1 << 16

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, A-Z in lower case, the starts and ends of their words, and each text's first word."""
    t = Texts(texts)
    raw = lowered(t.bytes)
    return raw, *word_bounds(Texts.of(raw, t.offsets), _BETWEEN)


def rows_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The embedding rows (from 1; 0 is padding) of words, a column for the word and for each beginning."""
    out = np.zeros((len(starts), 1 + len(STEMS)), np.int32)
    for k, size in enumerate((0, *STEMS)):
        own = np.flatnonzero(ends - starts > size) if size else np.arange(len(starts))
        h = span_hashes(raw, starts[own], starts[own] + size if size else ends[own]) ^ np.uint64(size << 40)
        out[own, k] = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) % ((1 << BUCKET_BITS) - 1) + 1
    return out


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """rows_of() all words end to end, and each text's first word."""
    raw, starts, ends, firsts = words_of(texts)
    code, first = distinct_spans(raw, starts, ends)
    return rows_of(raw, starts[first], ends[first])[code], firsts


class Sample:
    """Texts for training as numbers of distinct words; an item is a text's embedding rows."""

    def __init__(self, rows: np.ndarray, numbers: np.ndarray, firsts: np.ndarray):
        self.rows, self.numbers, self.firsts = rows, numbers, firsts

    @classmethod
    def of(cls, texts: pa.Array) -> Sample:
        numbers, rows, own, sizes = {}, [np.zeros((0, 1 + len(STEMS)), np.int32)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for part in in_slices(pa.RecordBatch.from_arrays([texts], ["text"]), SLICE, 0):
            raw, starts, ends, firsts = words_of(part.column(0))
            code, first = distinct_spans(raw, starts, ends)
            words = [raw[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            new = np.array([k for k, w in enumerate(words) if w not in numbers], np.int64)
            numbers.update(zip([words[k] for k in new.tolist()], range(len(numbers), len(numbers) + len(new))))
            rows.append(rows_of(raw, starts[first[new]], ends[first[new]]))
            own.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))[code])
            sizes.append(np.diff(firsts))
        return cls(np.concatenate(rows), np.concatenate(own), np.cumsum(np.concatenate(sizes)))

    def __len__(self):
        return len(self.firsts) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        return self.rows[self.numbers[self.firsts[k] : self.firsts[k + 1]]]

    def some(self, keep: np.ndarray) -> Sample:
        size = np.diff(self.firsts)[keep]
        return Sample(self.rows, self.numbers[ragged(self.firsts[:-1][keep], size)], np.append(0, np.cumsum(size)))


def shortened(texts: pa.Array, words: int) -> list[bytes]:
    """Texts of at most `words` words as they are; of longer ones the words of evenly spaced stretches, their end among them."""
    raw, starts, ends, firsts = words_of(texts)
    out = []
    for k, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
        if b - a <= words:
            out.append(raw[starts[a] : ends[b - 1]].tobytes() if b > a else b"")
        else:
            begins = np.linspace(a, b - STRETCH, words // STRETCH).astype(np.int64).tolist()
            out.append(b" ".join(raw[starts[x] : ends[x + STRETCH - 1]].tobytes() for x in begins))
    return out


def padded(ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padding after each text, as long as the widest filter: so that every text, empty ones too, has a window that lies in it and its padding."""
    n, pad = len(firsts) - 1, max(SPANS)
    size = np.diff(firsts)
    begins = firsts[:-1] + pad * np.arange(n)
    out = np.zeros((len(ids) + pad * n, ids.shape[1]), np.int32)
    out[np.arange(len(ids)) + np.repeat(pad * np.arange(n), size)] = ids
    return out, begins


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # for each span: (span, WIDTH, FILTERS)
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    trained: bool = True

    def scorer(self):
        """ids, firsts -> scores."""

        def run(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
            n = len(firsts) - 1
            if not self.trained:
                return np.full(n, self.bias)
            if not n:
                return np.zeros(0)
            line, begins = padded(ids, firsts)
            x = embed(self.table, line) * np.float32(1 - DROP)
            logit = np.full(n, self.bias, np.float64)
            for j, f in enumerate(self.filters):
                best = np.maximum.reduceat(responses(x, f, np.append(begins[1:], len(line))), begins, axis=0)
                logit += np.maximum(best, 0) @ self.weights[j * FILTERS : (j + 1) * FILTERS]
            return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

        return run


def embed(table: np.ndarray, line: np.ndarray) -> np.ndarray:
    x = table[line[:, 0]]
    for k in range(1, line.shape[1]):
        x += table[line[:, k]]
    return x


def convolve(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    y = x @ f[0]
    for k in range(1, len(f)):
        y[:-k] += x[k:] @ f[k]
    return y


def responses(x: np.ndarray, f: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """convolve(), without the windows that begin in one text's padding and reach into the next text."""
    y = convolve(x, f)
    for k in range(1, len(f)):
        y[ends - k] = -np.inf
    return y


def start(rate: float, rng: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray]]:
    """An untrained table, and filters, weights and bias; rate: the share of rows with label 1."""
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    table[0] = 0
    dense = [rng.normal(0, 0.4, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS] + [np.full(len(SPANS) * FILTERS, 0.3, np.float32), np.zeros(1, np.float32)]
    dense[-1][0] = np.log(rate / (1 - rate)) - 0.5
    return table, dense


def descend(table: np.ndarray, dense: list[np.ndarray], texts, labels: np.ndarray, epochs: Iterable[int], rng: np.random.Generator) -> np.ndarray:
    """Adam over shuffled batches, in place; texts: a sequence of their embedding rows. Which rows of the table have changed."""
    m1, m2 = [np.zeros_like(d) for d in dense], [np.zeros_like(d) for d in dense]
    t1, t2 = np.zeros_like(table), np.zeros_like(table)
    touched = np.zeros(len(table), bool)
    step = 0
    for epoch in epochs:
        order = rng.permutation(len(texts))
        pace = RATE * (1 - epoch / (EPOCHS + 1))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            parts = [texts[int(k)] for k in pick]
            line, begins = padded(np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])))
            line[rng.random(line.shape) < DROP] = 0  # so that stems learn too
            ends = np.append(begins[1:], len(line))
            x = embed(table, line)
            pooled, places = [], []
            for f in dense[: len(SPANS)]:
                y = responses(x, f, ends)
                places.append(np.stack([a + y[a:b].argmax(0) for a, b in zip(begins, ends)]))
                pooled.append(np.take_along_axis(y, places[-1], 0))
            h = np.concatenate(pooled, 1)
            active = h > 0
            logit = np.where(active, h, 0) @ dense[-2] + dense[-1][0]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
            grads: list = [np.zeros_like(d) for d in dense]
            grads[-2], grads[-1][0] = np.where(active, h, 0).T @ error, error.sum()
            back = (error[:, None] * dense[-2]) * active
            rows, steps = [], []
            for j, f in enumerate(dense[: len(SPANS)]):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(f)):
                    where = np.minimum(places[j] + k, len(line) - 1)
                    grads[j][k] = np.einsum("bfd,bf->df", x[where], g)
                    own = (g[:, :, None] * f[k].T[None]).reshape(-1, WIDTH)
                    for column in range(line.shape[1]):
                        rows.append(line[where, column].ravel())
                        steps.append(own)
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for d, g, a, b in zip(dense, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                d -= pace * (a / fix1) / (np.sqrt(b / fix2) + 1e-8)
            rows, where = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(rows), WIDTH), np.float32)
            np.add.at(g, where, np.concatenate(steps))
            keep = rows > 0
            rows, g = rows[keep], g[keep]
            touched[rows] = True
            t1[rows] = 0.9 * t1[rows] + 0.1 * g
            t2[rows] = 0.999 * t2[rows] + 0.001 * g * g
            table[rows] -= pace * (t1[rows] / fix1) / (np.sqrt(t2[rows] / fix2) + 1e-8)
    return touched


def best_threshold(n: np.ndarray, toxic: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The cut with the greatest F1; of equal ones the one nearest to 0.5. n, toxic, low, high: rows, rows with label 1, least and greatest score of each cell. Cuts lie midway between cells."""
    order = np.argsort(-low, kind="stable")
    n, toxic, low, high = n[order], toxic[order], low[order], high[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    cuts = np.append((low[:-1] + high[1:]) / 2, low[-1] / 2)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(np.clip(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]], *THRESHOLDS))


def _packed(sample: Sample, y: np.ndarray, held: np.ndarray, lang: list[str]) -> bytes:
    kinds = sorted(set(lang))
    names = [x.encode() for x in kinds]
    at = {x: k for k, x in enumerate(kinds)}
    own = np.array([at[x] for x in lang], np.int64)
    return pack_arrays(sample.rows.reshape(-1).astype(np.uint32), narrow(sample.numbers), narrow(np.diff(sample.firsts)), y.astype(np.uint8), held.astype(np.uint8), narrow(own), narrow(np.array([len(x) for x in names], np.int64)), np.frombuffer(b"".join(names), np.uint8))


def _unpacked(blob: bytes) -> tuple[Sample, np.ndarray, np.ndarray, list[str]]:
    rows, numbers, sizes, y, held, own, lengths, names = unpack_arrays(blob)
    cuts = np.append(0, np.cumsum(lengths.astype(np.int64))).tolist()
    kinds = [names[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
    sample = Sample(rows.astype(np.int32).reshape(-1, 1 + len(STEMS)), numbers.astype(np.int32), np.append(0, np.cumsum(sizes.astype(np.int64))))
    return sample, y.astype(np.int64), held.astype(bool), [kinds[k] for k in own.tolist()]


SHARD_SCHEMA = "shard long, blob binary, size long, n long, toxic long"


def _shard(number: int, blob: bytes, size: int, y: np.ndarray) -> pa.Table:
    return pa.table([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), pa.array([size], pa.int64()), pa.array([len(y)], pa.int64()), pa.array([int(y.sum())], pa.int64())], names=["shard", "blob", "size", "n", "toxic"])


def _none() -> pa.Table:
    return _shard(0, b"", 0, np.zeros(0, np.int64)).slice(0, 0)


def shards_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, blob, size, n, toxic): every labelled row of docs whose remainder is not 0, with its whole text, packed for training.

    Rows of labels without id or label are left out; of several labels of an id
    the greatest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(remainder("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    language = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), language.alias("lang")).where("doc_id is not null").where(remainder("doc_id") != 0)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    pieces = max(1, -(-total // PIECE_BYTES))
    piece = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece")

    def take(docs: pa.Table, known: pa.Table) -> pa.Table:
        marks = dict(zip(known.column("doc_id").to_pylist(), known.column("toxic").to_pylist()))
        ids = docs.column("doc_id").to_pylist()
        at = [k for k, x in enumerate(ids) if x in marks]
        if not at:
            return _none()
        docs = docs.take(pa.array(at, pa.int64())).combine_chunks()
        ids, lang = docs.column("doc_id").to_pylist(), docs.column("lang").to_pylist()
        texts = docs.column("text").chunk(0)
        digest = [zlib.crc32(x.as_buffer()) for x in texts]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] * 2654435761 % 2**32, ids[k], digest[k], lang[k]))
        y = np.array([marks[ids[k]] for k in order], np.int64)
        held = np.array([zlib.crc32(b"thresholds %d" % ids[k]) % 5 == 0 for k in order])
        texts = texts.take(pa.array(order, pa.int64()))
        out = _shard(docs.column("piece")[0].as_py(), _packed(Sample.of(texts), y, held, [lang[k] for k in order]), texts.nbytes, y)
        give_back()
        return out

    shards = checkpointed(rows.select(piece(), "*").groupBy("piece").cogroup(known.select(piece(), "*").groupBy("piece")).applyInArrow(take, SHARD_SCHEMA))
    free(docs.sparkSession)
    got, size = shards.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = max(1, -(-size // SHARD_BYTES))
    if got <= 2 * wanted and (got < 2 or wanted > 1):
        return shards

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("shard").to_numpy())
        parts = [_unpacked(table.column("blob")[int(k)].as_py()) for k in order]
        sizes, words = [len(p[0].rows) for p in parts], [p[0].firsts for p in parts]
        numbers = [p[0].numbers + np.int32(a) for p, a in zip(parts, np.cumsum([0, *sizes]).tolist())]
        sample = Sample(np.concatenate([p[0].rows for p in parts]), np.concatenate(numbers), np.append(0, np.cumsum(np.concatenate([np.diff(x) for x in words]))))
        y = np.concatenate([p[1] for p in parts])
        return _shard(int(table.column("shard").to_numpy().min()), _packed(sample, y, np.concatenate([p[2] for p in parts]), [x for p in parts for x in p[3]]), sum(table.column("size").to_pylist()), y)

    return checkpointed(shards.groupBy(F.pmod("shard", F.lit(wanted))).applyInArrow(merge, SHARD_SCHEMA))


def _averaged(state: tuple, shards: DataFrame, epochs: list[int], hold: bool, blocks: int) -> tuple:
    """The model after these epochs in every shard, averaged: filters, weights and bias by the shards' rows, a row of the table over the shards that touched it."""
    given = shards.sparkSession.sparkContext.broadcast(state)
    cuts = np.linspace(0, 1 << BUCKET_BITS, blocks + 1).astype(np.int64)

    def run(batches):
        for number, blob in ((n, x) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            table, dense = given.value[0].copy(), [d.copy() for d in given.value[1]]
            sample, y, held, _ = _unpacked(blob)
            if hold:
                sample, y = sample.some(~held), y[~held]
            touched = descend(table, dense, sample, y.astype(np.float32), epochs, np.random.default_rng([1, number, epochs[0]]))
            rows = np.flatnonzero(touched)
            of = np.searchsorted(rows, cuts)
            packed = [pack_arrays(rows[a:b].astype(np.uint32), table[rows[a:b]].reshape(-1)) for a, b in zip(of.tolist(), of[1:].tolist())]
            packed.append(pack_arrays(np.array([len(y)]), np.concatenate([d.reshape(-1) for d in dense])))
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array([number] * (blocks + 1), pa.int64()), pa.array(packed, pa.binary())], ["bin", "chunk", "blob"])
            give_back()

    def reduce(block: int, numbers: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        # In the shards' order, so that the sums come out alike each time.
        if block == blocks:
            total, rows = 0.0, 0
            for k in np.argsort(numbers):
                n, values = unpack_arrays(blobs[k])
                total, rows = total + values.astype(np.float64) * int(n[0]), rows + int(n[0])
            return back_rows([0], block, [pack_arrays((total / max(rows, 1)).astype(np.float32))])
        low, high = int(cuts[block]), int(cuts[block + 1])
        total, count = np.zeros((high - low, WIDTH)), np.zeros(high - low, np.int64)
        for k in np.argsort(numbers):
            rows, values = unpack_arrays(blobs[k])
            total[rows.astype(np.int64) - low] += values.reshape(-1, WIDTH)
            count[rows.astype(np.int64) - low] += 1
        own = np.flatnonzero(count)
        return back_rows([0], block, [pack_arrays((own + low).astype(np.uint32), (total[own] / count[own, None]).astype(np.float32).reshape(-1))])

    parts = {r["bin"]: unpack_arrays(bytes(r["blob"])) for r in reduce_bins(shards.select("shard", "blob").mapInArrow(run, "bin int, chunk long, blob binary"), reduce, BACK_SCHEMA).collect()}
    given.destroy()
    table, dense = state[0].copy(), []
    for k in range(blocks):
        table[parts[k][0].astype(np.int64)] = parts[k][1].reshape(-1, WIDTH)
    values, at = parts[blocks][0], 0
    for d in state[1]:
        dense.append(values[at : at + d.size].reshape(d.shape).copy())
        at += d.size
    return table, dense


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows whose remainder is not 0, as shards_of() has them."""
    shards = shards_of(docs, labels)
    count, n, toxic = shards.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        # Without rows of both classes, the base rate is the score.
        return Model(np.zeros((1 << BUCKET_BITS, WIDTH), np.float32), [np.zeros((s, WIDTH, FILTERS), np.float32) for s in SPANS], np.zeros(len(SPANS) * FILTERS, np.float32), toxic / n if n else 0.0, trained=False)
    hold = n >= 50
    state, blocks = start(toxic / n, np.random.default_rng(1)), max(BLOCKS, count // SHARDS_PER_BLOCK)
    for epochs in [list(range(EPOCHS))] if count == 1 else [[k] for k in range(EPOCHS)]:
        state = _averaged(state, shards, epochs, hold, blocks)
        free(docs.sparkSession)
    table, dense = state
    model = Model(table, dense[: len(SPANS)], dense[-2], float(dense[-1][0]))
    if hold:
        model.threshold, model.thresholds = _thresholds(shards, model)
    return model


def _thresholds(shards: DataFrame, model: Model) -> tuple[float, dict[str, float]]:
    """The common threshold, and those by language, of all rows that were kept from training.

    Rows are counted by language and score cell, of which there are CELLS, so what
    the driver gets does not grow with them; languages with too few rows are one.
    """

    def run(batches):
        scorer = model.scorer()
        for blob in (x for b in batches for x in b.column(1).to_pylist()):
            sample, y, held, lang = _unpacked(blob)
            sample = sample.some(held)
            scores = np.zeros(len(sample))
            begin = 0
            while begin < len(sample):
                end = max(begin + 1, int(np.searchsorted(sample.firsts, sample.firsts[begin] + (SLICE >> 3), "right")) - 1)
                a, b = sample.firsts[begin], sample.firsts[end]
                scores[begin:end] = scorer(sample.rows[sample.numbers[a:b]], sample.firsts[begin : end + 1] - a)
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(lang, held.tolist()) if k], pa.string()), pa.array((scores * CELLS).astype(np.int64)), pa.array(scores), pa.array(y[held])], ["lang", "cell", "score", "toxic"])

    rows = shards.select("shard", "blob").mapInArrow(run, "lang string, cell long, score double, toxic long")
    cells = checkpointed(rows.groupBy("lang", "cell").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("score").alias("low"), F.max("score").alias("high")))
    enough = cells.groupBy("lang").agg((F.least(F.sum("toxic"), F.sum("n") - F.sum("toxic")) >= THRESHOLD_ROWS).alias("own"))
    both = cells.join(enough, "lang").groupBy(F.when(F.col("own"), F.col("lang")).alias("lang"), "cell")
    got = both.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    if not 0 < got["toxic"].sum() < got["n"].sum():
        return model.threshold, {}
    cut = lambda x: best_threshold(*(x[c].to_numpy() for c in ("n", "toxic", "low", "high")))
    every = got.groupby("cell").agg({"n": "sum", "toxic": "sum", "low": "min", "high": "max"})
    return cut(every), {k: cut(x) for k, x in got.groupby("lang")}


def score(docs: DataFrame, model: Model, keep: list[str], limit: str | None = None) -> DataFrame:
    """The columns `keep` of docs and, last, the score: from 0 to 1 for every row, null and empty texts too.

    limit: instead, only the rows below the threshold of their language (that
    column), without the score.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    # Positions, not names, carry the columns: names may clash with ours. A text that is kept is not sent twice.
    names = list(docs.columns)
    at = keep.index("text") if "text" in keep else len(keep)
    extra = [] if "text" in keep else [F.col("text")]
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], *extra)
    schema = StructType([docs.schema[names.index(c)] for c in keep] + ([] if limit else [StructField("score_of_text", DoubleType())]))

    def run(batches):
        scorer = model.scorer()
        for b in (part for whole in batches for part in in_slices(whole, SLICE, at)):
            scores = scorer(*buckets(b.column(at)))
            if limit:
                own = b.column(keep.index(limit)).to_pylist() if limit in keep else [None] * b.num_rows
                cuts = np.array([model.thresholds.get("" if x is None else str(x), model.threshold) for x in own], np.float64)
                yield b.filter(pa.array(scores < cuts))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, "score_of_text"])

    return inner.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, rejected) for every row of docs.

    predicted is score >= 0.5; rejected is score >= the threshold of the row's
    language.  Null texts count as empty; repeated rows each get a row; an empty
    table gives none; other columns are left out.
    """
    model = fit(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
    out = score(own, model, ["doc_id", "lang"])
    limit = F.lit(model.threshold)
    for k, v in model.thresholds.items():
        limit = F.when(F.coalesce(F.col("lang"), F.lit("")) == k, F.lit(v)).otherwise(limit)
    return out.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), F.col("score_of_text").alias("score"), (F.col("score_of_text") >= 0.5).cast("int").alias("predicted"), limit.alias("lang_threshold"), (F.col("score_of_text") >= limit).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the threshold of their language lets pass.

    Null texts count as empty and stay null; repeated rows are judged alike; without
    a column lang, or where it is null, the threshold of the empty language or else
    the common one holds; an empty table gives none; a column may have any name.
    """
    return score(docs, fit(docs, labels), docs.columns, limit="lang")
