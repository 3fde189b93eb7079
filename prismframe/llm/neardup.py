"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is a bag of shingles (WORDS consecutive words; A-Z in lower case; a
shorter text is one shingle).  A shingle weighs

    tf * (1 + ln(N / df) / ln(N)),

its count in the document times an inverse document frequency between 1 and 2: so
rare shingles weigh more, but passages that a large group of copies shares still
count.  N and df are of all documents.  Two texts are linked if their weighted
Jaccard similarity (sum of the lesser weights over sum of the greater) is at least
SIMILARITY; a class is a connected component of links.

Improved consistent weighted sampling gives each text BANDS * ROWS samples, of
which two texts share each with a probability equal to their similarity.  Texts
that share a whole band are candidates.  Each band's texts are tried against its
best placed one (that with the largest part of its weight in shared shingles)
first; then, exactly, all pairs of its texts that the links so far leave in
different classes.  Every candidate is verified on the shingles themselves.

A text with less than SIMILARITY of its weight in shingles that other documents
have can have no link; that is known once document frequencies are, so only the
others are sampled.  Nothing but the final links' classes is iterated on.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Texts, apply_back, back_rows, bins_for, by_bin, checkpointed, cut_bins, emit, free, item_hashes, join_hot, lowered, make_chunks, mix, narrow, pack_arrays, ragged, reduce_bins, row_ids, run_hashes, span_hashes, unpack_arrays, word_bounds

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Texts of one side of a task that pairs a band's texts.
GRID = 2000
#: Shingles of the bags that a task compares others with at once.
BLOCK = 1 << 19
#: Precomputed draws of the sampling; a shingle takes one by its hash, another for each sample.
POOL_BITS = 16


def shingles(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted within it), their counts, and each text's first."""
    t = Texts(table.column("text"))
    raw = lowered(t.bytes)
    starts, ends, firsts = word_bounds(t)
    words = span_hashes(raw, starts, ends)
    keys, at = run_hashes(words, WORDS, firsts)
    text = np.searchsorted(firsts, at, "right") - 1
    size = np.diff(firsts)
    short = np.flatnonzero((size > 0) & (size < WORDS))
    if len(short):
        own = item_hashes(words, firsts[short], firsts[short + 1])
        keys, text = np.concatenate([keys, own]), np.concatenate([text, short])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), np.searchsorted(text[at], np.arange(len(t) + 1))


def _emit(bins: int):
    def run(number, table):
        keys, _, firsts = shingles(table)
        distinct, counts = np.unique(keys, return_counts=True)
        if len(distinct):
            yield by_bin(number, bins, distinct, counts)

    return run


def _frequencies(number: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    """For each chunk how many documents of others have each key it sent, in their order."""
    parts = [unpack_arrays(b) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    own = np.concatenate([p[1].astype(np.int64) for p in parts])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    others = np.empty(len(k), np.int64)
    others[order] = np.repeat(np.add.reduceat(own[order], begin), np.diff(np.append(begin, len(k))))
    others -= own
    back = np.split(others, np.cumsum([len(p[0]) for p in parts])[:-1])
    return back_rows(chunks, number, [pack_arrays(np.array([number]), narrow(x)) for x in back])


def weights(tf: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    scale = np.log(max(total, 2))
    return tf * (1 + np.maximum(np.log(max(total, 1) / df), 0) / scale)


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010), with draws from a pool.

    Sample j of shingle x with weight w: r and c are Gamma(2, 1), b is uniform;
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the least ln a wins, and
    the sample is (x, t).  Of shingles with one draw the lesser hash wins.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float64)
        self.log_c = np.log(rng.gamma(2, 1, size))
        self.b = rng.random(size)
        self.turn = (rng.integers(0, 2**63, samples, dtype=np.uint64) << U64(1)) | U64(1)

    def __call__(self, keys: np.ndarray, weight: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """A row of samples for each text (none empty); keys sorted within each."""
        log_w = np.log(weight)
        kinds, kind = np.unique(log_w, return_inverse=True)
        out = np.empty((len(firsts) - 1, len(self.turn)), U64)
        # A weight that many shingles have is worked out once for each draw.
        common = kinds[np.argsort(-np.bincount(kind), kind="stable")[:1]] if len(kinds) else kinds
        base = self._value(np.arange(1 << POOL_BITS), common[0])
        rare = np.flatnonzero(log_w != common[0])
        size = np.diff(firsts)
        for j, turn in enumerate(self.turn):
            draw = ((keys * turn) >> U64(64 - POOL_BITS)).astype(np.int64)
            a = base[0][draw]
            a[rare] = self._value(draw[rare], log_w[rare])[0]
            least = np.minimum.reduceat(a, firsts[:-1])
            hit = np.flatnonzero(a == np.repeat(least, size))
            # the first of each text: keys are sorted
            own = np.searchsorted(firsts, hit, "right") - 1
            pick = hit[np.append(True, own[1:] != own[:-1])]
            t = self._value(draw[pick], log_w[pick])[1]
            out[:, j] = mix(keys[pick] + t.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15))
        return out

    def _value(self, draw, log_w):
        t = np.floor(log_w / self.r[draw] + self.b[draw])
        return self.log_c[draw] - self.r[draw] * (t - self.b[draw] + 1), t


def _banded(samples: np.ndarray) -> np.ndarray:
    """A hash of each band's samples; the band's number goes into it."""
    h = np.zeros((len(samples), BANDS), U64)
    for k in range(ROWS):
        h = mix(h * U64(31) + samples[:, k::ROWS])
    return mix(h + np.arange(1, BANDS + 1, dtype=U64) * U64(0xA24BAED4963EE407))


ROWS_SCHEMA = "row long, doc_id long, text_a long, text_b long, shared double, weight double, bands array<long>, bag binary"


def _apply(total: int, bins: int):
    def run(number, table, blobs):
        keys, tf, firsts = shingles(table)
        n = table.num_rows
        distinct, at, df = np.unique(keys, return_inverse=True, return_counts=True)
        cuts = cut_bins(distinct, bins)
        for bin_, others in map(unpack_arrays, blobs):
            df[cuts[bin_[0]] : cuts[bin_[0] + 1]] += others
        df = df[at]
        w = weights(tf, df, total)
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[firsts])
        full, common = sums(w), sums(np.where(df > 1, w, 0))
        rows = np.flatnonzero((common >= SIMILARITY * full * (1 - 1e-9)) & (np.diff(firsts) > 0))
        bands: list = [None] * n
        bags: list = [None] * n
        if len(rows):
            size = np.diff(firsts)[rows]
            pick = ragged(firsts[:-1][rows], size)
            samples = Sampler()(keys[pick], w[pick], np.append(0, np.cumsum(size)))
            for k, b in zip(rows.tolist(), _banded(samples).view(np.int64)):
                x = slice(firsts[k], firsts[k + 1])
                bands[k], bags[k] = b, pack_arrays(keys[x], narrow(tf[x]), narrow(df[x]))
        digest = [hashlib.blake2b((x or "").encode(), digest_size=16).digest() for x in table.column("text").to_pylist()]
        text = np.frombuffer(b"".join(digest), np.int64).reshape(n, 2)
        part = np.divide(common, full, out=np.zeros(n), where=full > 0)
        return pa.table([pa.array(row_ids(number, n)), table.column("doc_id").cast(pa.int64()), pa.array(text[:, 0]), pa.array(text[:, 1]), pa.array(part), pa.array(full), pa.array(bands, pa.list_(pa.int64())), pa.array(bags, pa.binary())], names=["row", "doc_id", "text_a", "text_b", "shared", "weight", "bands", "bag"])

    return run


def similarity(a: list[np.ndarray], b: list[np.ndarray], total: int) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts, document frequencies)."""
    wa, wb = weights(a[1].astype(np.int64), a[2].astype(np.int64), total), weights(b[1].astype(np.int64), b[2].astype(np.int64), total)
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(wa[same], wb[at[same]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def linked(a: np.ndarray, b: np.ndarray, bags: dict[int, bytes], total: int, least: float) -> np.ndarray:
    """Which pairs (a, b) of rows, each pair once, have a similarity of at least `least`; bags: packed, by row.

    A block of the bags of b is unpacked and its shingles are numbered; each text of
    a then meets all its texts of the block in one pass over arrays, so a pair in a
    large group costs some microseconds.  Sums of another order differ in their last
    bits: pairs that close to `least` are left to similarity().
    """
    out = np.zeros(len(a), bool)
    rows, of = np.unique(b, return_inverse=True)
    order = np.lexsort((a, of))
    begin = 0
    while begin < len(rows):
        block, items = [], 0
        while begin + len(block) < len(rows) and (not block or items < BLOCK):
            block.append(unpack_arrays(bags[int(rows[begin + len(block)])]))
            items += len(block[-1][0])
        size = np.array([len(x[0]) for x in block])
        firsts = np.append(0, np.cumsum(size))
        kinds, kind = np.unique(np.concatenate([x[0] for x in block]), return_inverse=True)
        tf = np.concatenate([x[1].astype(np.int64) for x in block])
        one = weights(np.ones(len(tf)), np.concatenate([x[2].astype(np.int64) for x in block]), total)
        full = np.add.reduceat(tf * one, firsts[:-1])
        own = order[slice(*np.searchsorted(of[order], [begin, begin + len(block)]))]
        own = own[np.argsort(a[own], kind="stable")]
        count = np.zeros(len(kinds), np.int64)
        cuts = np.flatnonzero(np.append(True, a[own][1:] != a[own][:-1])) if len(own) else own
        for pick in np.split(own, cuts[1:]):
            mine = unpack_arrays(bags[int(a[pick[0]])])
            weight = weights(mine[1].astype(np.int64), mine[2].astype(np.int64), total).sum()
            at = np.searchsorted(kinds, mine[0])
            at[at == len(kinds)] = 0
            same = kinds[at] == mine[0]
            count[at[same]] = mine[1][same]
            to = of[pick] - begin
            if len(to) == len(block):
                low = np.add.reduceat(np.minimum(count[kind], tf) * one, firsts[:-1])[to]
            else:
                x = ragged(firsts[to], size[to])
                low = np.add.reduceat(np.minimum(count[kind[x]], tf[x]) * one[x], np.append(0, np.cumsum(size[to])[:-1]))
            count[at[same]] = 0
            got = low / (weight + full[to] - low)
            out[pick] = got >= least
            for k in np.flatnonzero(np.abs(got - least) < 1e-9).tolist():
                out[pick[k]] = similarity(mine, block[to[k]], total) >= least
        begin += len(block)
    return out


def _verified(pairs: DataFrame, bags: DataFrame, total: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows whose similarity is at least `least`.

    Pairs are dealt to a grid of blocks by the hashes of both rows.  A bag goes once
    to each block that has a pair of it: in a large group to a side of the grid
    instead of to every pair.
    """
    side = math.ceil((4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))) ** 0.5)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    dealt = pairs.select("a", "b", block("a").alias("i"), block("b").alias("j"))
    of = lambda c: dealt.select(F.col("i").alias("p"), F.col("j").alias("q"), F.col(c).alias("row"))
    sent = of("a").unionByName(of("b")).distinct().join(bags, "row").select("p", "q", "row", "bag")
    none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["a", "b"])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return none
        have = dict(zip(y.column("row").to_pylist(), y.column("bag").to_pylist()))
        a, b = (x.column(c).to_numpy() for c in ("a", "b"))
        hit = linked(a, b, have, total, least)
        return pa.table([pa.array(a[hit], pa.int64()), pa.array(b[hit], pa.int64())], names=["a", "b"])

    return dealt.groupBy("i", "j").cogroup(sent.groupBy("p", "q")).applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row, root): the least row of its component, for every row that has a link.

    Large-star and small-star steps in turn: each takes every node's neighbours to
    its least one, halving paths; the links are written each round, and the rounds
    end when none changes.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    old = state(edges)
    while True:
        # large star: neighbours above a node go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.where("v > u"), least, ["u"], old[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the same for a node and its neighbours below
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, ["u"], old[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = checkpointed(small)
        free(links.sparkSession)
        new = state(edges)
        if new == old:
            break
        old = new
    return edges.select(F.col("u").alias("row"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("row"), F.col("v").alias("root"))).distinct()


def classes(chunks: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, class_row): every row of the chunks, and the row that stands for its class."""
    spark = chunks.sparkSession
    total = chunks.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    bins = bins_for(chunks)
    # Written down, so that the keys that were sent are gone before the chunks are.
    frequencies = checkpointed(reduce_bins(emit(chunks, _emit(bins)), _frequencies))
    free(spark)
    rows = checkpointed(apply_back(chunks, frequencies, _apply(total, bins), ROWS_SCHEMA))
    free(spark)
    # Equal texts: the row with the least doc_id (null first) stands for them.
    texts = rows.groupBy("text_a", "text_b").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "row"))["row"].alias("node"), F.count("*").alias("n"))
    own = checkpointed(join_hot(rows.select("row", "doc_id", "text_a", "text_b", "shared", "weight", F.col("bag").isNotNull().alias("sampled")), texts, ["text_a", "text_b"], total).select("row", "doc_id", "node", "shared", "weight", "sampled"))
    nodes = own.where("row = node and sampled").select("row", "shared", "weight")
    bags = rows.where("bag is not null").select("row", "bag")
    members = checkpointed(rows.where("bag is not null").select("row", F.explode("bands").alias("band")).join(nodes, "row"))
    # First each band against its best placed text.
    best = members.groupBy("band").agg(F.max(F.struct("shared", (-F.col("row")).alias("minus"))).alias("m"), F.count("*").alias("n")).where("n > 1").select("band", (-F.col("m.minus")).alias("b"), "n")
    first = checkpointed(join_hot(members, best, ["band"], total).where("row <> b").select(F.col("row").alias("a"), "b").distinct())
    links = checkpointed(_verified(first.select(F.col("b").alias("a"), F.col("a").alias("b")), bags, total, least))
    root = components(links)
    free(spark)
    rest = _unlike(members.join(root, "row", "left").withColumn("root", F.coalesce("root", "row")), rows, total, least)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = checkpointed(_verified(checkpointed(rest.join(tried, ["a", "b"], "left_anti")), bags, total, least))
    if not more.isEmpty():
        root = components(links.unionByName(more))
    heads = own.groupBy("node").agg(F.count("*").alias("n")).join(root.select(F.col("row").alias("node"), "root"), "node", "left")
    return join_hot(own, heads, ["node"], total).select("row", "doc_id", F.coalesce("root", "node").alias("class_row"))


def _unlike(members: DataFrame, rows: DataFrame, total: int, least: float) -> DataFrame:
    """The pairs (a, b) of a band's texts that lie in different classes so far and may be alike.

    Most of a band is usually one class, its major one, so pairs are made of the
    texts outside it with each other and with all the band.  Bands are dealt to a
    grid: a task gets GRID texts of each side at most.  No more of two texts can be
    alike than the lesser shared weight, which must be least / (1 + least) of both
    weights.  A pair comes up in the first band it shares only.
    """
    split = members.select("band", "row", "weight", (F.col("shared") * F.col("weight")).alias("common"), "root")
    counts = split.groupBy("band", "root").agg(F.count("*").alias("c"))
    bands = counts.groupBy("band").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    bands = checkpointed(bands.select("band", F.col("m.root").alias("major"), "n", F.col("n").alias("all"), (F.col("n") - F.col("m.c")).alias("few")))
    split = checkpointed(join_hot(split, bands, ["band"], total).join(rows.where("bag is not null").select("row", "bands"), "row"))
    place = lambda count: F.pmod(F.xxhash64("row"), F.ceil(F.col(count) / GRID)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / GRID).cast("int") - 1))
    kept = ["band", "row", "weight", "common", "root", "major", "bands"]
    x = split.where("root <> major").select(*kept, place("few").alias("i"), every("all").alias("j")).alias("x")
    y = split.select(*kept, place("all").alias("j"), every("few").alias("i")).alias("y")
    enough = F.least(F.col("x.common"), F.col("y.common")) >= (least / (1 + least) * (1 - 1e-9)) * (F.col("x.weight") + F.col("y.weight"))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.row") < F.col("y.row"))
    pairs = x.join(y, same & (F.col("x.root") != F.col("y.root")) & once & enough & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")))
    return pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, keep) for every row of docs: class_id is the least doc_id of its class; keep is true for one row of each.

    Null texts count as empty, and all empty texts are one class; repeated rows
    each get a row; null ids come first; an empty table gives none; other columns
    are left out.
    """
    found = checkpointed(classes(make_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))))
    heads = found.groupBy("class_row").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("order"), "row", "doc_id")).alias("m"), F.count("*").alias("class_size"))
    heads = heads.select("class_row", "m", "class_size", F.col("class_size").alias("n"))
    return join_hot(found, heads, ["class_row"], found.count()).select("doc_id", F.col("m.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("m.row")).alias("keep"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each class: that with the least doc_id. Same cases as report()."""
    chunks = make_chunks(docs)
    found = checkpointed(classes(chunks))
    heads = found.groupBy("class_row").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("order"), "row")).alias("m")).select(F.col("m.row").alias("row"))
    kept = heads.select(F.shiftright("row", 24).alias("chunk"), (F.col("row") % (1 << 24)).cast("int").alias("bin"), F.lit(b"").alias("blob"))
    # Row numbers by chunk: one blob for each would be dear.
    packed = kept.groupBy("chunk").agg(F.collect_list("bin").alias("bins")).select("chunk", F.lit(0).alias("bin"), F.to_json("bins").cast("binary").alias("blob"))

    def run(number, table, blobs):
        import json

        return table.take(pa.array(sorted(k for b in blobs for k in json.loads(b)), pa.int64()))

    return apply_back(chunks, packed, run, docs.schema)
