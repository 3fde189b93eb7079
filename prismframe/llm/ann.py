"""Nearest neighbours by inner product: anisotropic quantisation, scans of four-bit codes, exact scores; cut by bounds.

A sample of at most SAMPLE vectors (by a hash of the id) gives coarse lists
(k-means) and, for every pair of dimensions, a codebook of 16 entries for what the
list's centre leaves over.  Codes and codebooks minimise a score-aware loss: the
part of the error along the vector counts ETA times, since that part moves large
inner products (Guo et al., 2020).  Every row is put into the index.

A query's bar is the product of its last wanted neighbour in the sample: the true
ones are no worse.  It visits the lists that can hold a product as large, by their
centre, greatest distance from it and greatest norm; in a list its products with
the decoded vectors, and the norms of what the codes leave out, tell which vectors
can reach the bar, and these are scored exactly.  So nothing that belongs to the
answer is skipped, however rows and queries lie; what is far away costs nothing.
Small lists are put together into bins; bins and their queries are cut into blocks
of bounded size, so a list with a third of all vectors, or one that every query
visits, is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000
MOST_LISTS = 4096
THRESHOLD = 0.2
NEIGHBOURS = 20
EVERY = 20
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096
#: Products that a step of a scan holds.
STEP = 1 << 21
#: What rounding may move a product by, as a share of the product of the norms (of those in single precision, too).
ROUNDING, ROUNDING_SINGLE = 1e-12, 1e-5


def usable(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector neither zero nor with null or non-finite components."""
    v = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class Index:
    """Centres and codebooks; encode() puts vectors into it."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.half = self.dim + (self.dim % 4 and 4 - self.dim % 4)  # pairs of pairs
        self.eta = max((self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2), 1.0)
        self.centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
        for _ in range(12):
            own = self.nearest(x)
            count = np.bincount(own, minlength=len(self.centres))
            total = np.zeros_like(self.centres)
            np.add.at(total, own, x)
            self.centres[count > 0] = total[count > 0] / count[count > 0, None]
            self.centres[count == 0] = x[rng.integers(0, len(x), (count == 0).sum())]
        own = self.nearest(x)
        left, along = self._left(x, own), self._pad(x / np.linalg.norm(x, axis=1, keepdims=True))
        m = self.half // 2
        self.books = np.stack([left[rng.integers(0, len(x), 16), 2 * k : 2 * k + 2] for k in range(m)])
        for _ in range(6):
            codes = self._codes(left, along)
            error = left - self._decode(codes)
            for k in range(m):
                t, a = left[:, 2 * k : 2 * k + 2], along[:, 2 * k : 2 * k + 2]
                rest = (error * along).sum(1) - (error[:, 2 * k : 2 * k + 2] * a).sum(1) + (t * a).sum(1)
                for c in range(16):
                    s = codes[:, k] == c
                    if s.any():
                        lhs = s.sum() * np.eye(2) + (self.eta - 1) * a[s].T @ a[s]
                        self.books[k, c] = np.linalg.solve(lhs, t[s].sum(0) + (self.eta - 1) * (rest[s, None] * a[s]).sum(0))
                error[:, 2 * k : 2 * k + 2] = t - self.books[k][codes[:, k]]

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.half - x.shape[1])))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: its nearest centre."""
        out = np.empty(len(x), np.int64)
        half = (self.centres**2).sum(1) / 2
        for at in range(0, len(x), 4096):
            out[at : at + 4096] = (x[at : at + 4096] @ self.centres.T - half).argmax(1)
        return out

    def _left(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return self._pad(x - self.centres[own])

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[k][codes[:, k]] for k in range(codes.shape[1])], 1)

    def _codes(self, left: np.ndarray, along: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Nearest entries first; then each in turn is chosen anew by the score-aware loss, the others held."""
        m = self.half // 2
        parts = [left[:, 2 * k : 2 * k + 2] for k in range(m)]
        codes = np.stack([((p[:, None] - self.books[k]) ** 2).sum(2).argmin(1) for k, p in enumerate(parts)], 1)
        error = left - self._decode(codes)
        parallel = (error * along).sum(1)
        for _ in range(rounds):
            for k, p in enumerate(parts):
                a = along[:, 2 * k : 2 * k + 2]
                parallel -= (error[:, 2 * k : 2 * k + 2] * a).sum(1)
                e = p[:, None] - self.books[k]
                loss = (e**2).sum(2) + (self.eta - 1) * (parallel[:, None] + (e * a[:, None]).sum(2)) ** 2
                codes[:, k] = loss.argmin(1)
                error[:, 2 * k : 2 * k + 2] = p - self.books[k][codes[:, k]]
                parallel += (error[:, 2 * k : 2 * k + 2] * a).sum(1)
        return codes

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Codes of four bits, two to a byte."""
        out = np.empty((len(x), self.half // 4), np.uint8)
        for at in range(0, len(x), 2048):
            y = x[at : at + 2048]
            c = self._codes(self._left(y, own[at : at + 2048]), self._pad(y / np.linalg.norm(y, axis=1, keepdims=True)))
            out[at : at + 2048] = c[:, ::2] | c[:, 1::2] << 4
        return out

    def decode(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        c = np.empty((len(codes), self.half // 2), np.uint8)
        c[:, ::2], c[:, 1::2] = codes & 15, codes >> 4
        return self.centres[own] + self._decode(c)[:, : self.dim]


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors, also of those whose squares leave the range of doubles."""
    top = np.abs(x).max(1, initial=0)
    top[top == 0] = 1
    return np.linalg.norm(x / top[:, None], axis=1) * top


def steps(rows: int, width: int):
    """Ranges of rows of so many products that STEP is not passed."""
    each = max(1, STEP // max(width, 1))
    return ((at, min(at + each, rows)) for at in range(0, rows, each))


def bars(ids: np.ndarray, q: np.ndarray, known_ids: np.ndarray, known: np.ndarray, count: int) -> np.ndarray:
    """For each query the count-th largest product with other known vectors, less what rounding may do; -inf if there are fewer."""
    out = np.full(len(q), -np.inf)
    if len(known) < count:
        return out
    far = norms(known).max()
    for a, b in steps(len(q), len(known)):
        s = q[a:b] @ known.T
        s[ids[a:b, None] == known_ids] = -np.inf
        out[a:b] = np.partition(s, -count, axis=1)[:, -count]
    return out - ROUNDING * norms(q) * far


def neighbouring(centres: np.ndarray, rows: np.ndarray | None = None) -> list[int]:
    """An order of the centres in which near ones are near: halved again and again along their widest direction."""
    rows = np.arange(len(centres)) if rows is None else rows
    if len(rows) < 4:
        return rows.tolist()
    x = centres[rows] - centres[rows].mean(0)
    x /= np.abs(x).max() or 1
    rows = rows[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
    return neighbouring(centres, rows[: len(rows) // 2]) + neighbouring(centres, rows[len(rows) // 2 :])


class Lists:
    """What is known of the lists when all rows are placed: how far they reach, and the bin of each."""

    def __init__(self, index: Index, sizes: dict[int, tuple[int, float, float]]):
        n = len(index.centres)
        self.index, self.reach, self.norm, self.bin = index, np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, -1)
        held, bin_ = 0, 0
        for k in neighbouring(index.centres):
            if k in sizes:
                size, self.reach[k], self.norm[k] = sizes[k]
                if held and held + size > BLOCK_VECTORS:
                    held, bin_ = 0, bin_ + 1
                self.bin[k], held = bin_, held + size

    def wanted(self, q: np.ndarray, bar: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which of the lists may hold a vector that reaches the bar, for each query."""
        n, c = norms(q)[:, None], self.index.centres[lists]
        most = np.minimum(q @ c.T + n * self.reach[lists], n * self.norm[lists])
        return most + ROUNDING * n * (norms(c) + self.norm[lists]) >= bar[:, None]


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[Index, np.ndarray, np.ndarray] | None:
    """An index, and ids and vectors of the sample (one for each id); None without vectors."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not got.num_rows:
        return None
    sizes = np.asarray(pa.compute.list_value_length(got.column("vector").combine_chunks()))
    dim = int(np.bincount(sizes).argmax())
    got = got.filter(pa.array(sizes == dim))
    ids, x = np.asarray(got.column("vec_id")), matrix(got.column("vector"), dim)
    total = rows.count()
    index = Index(x, max(1, min(MOST_LISTS, int(total**0.5))))
    once = np.unique(ids, return_index=True)[1]
    return index, ids[once], x[once]


class Block:
    """Vectors of some lists, equal ones once, ready to be scanned."""

    def __init__(self, lists: Lists, ids: np.ndarray, x: np.ndarray, own: np.ndarray, codes: np.ndarray, count: int):
        order = np.lexsort((ids, own))
        ids, x, own, codes = ids[order], x[order], own[order], codes[order]
        _, first, same = np.unique((x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        place = np.empty(len(first), np.int64)
        place[np.argsort(first)] = np.arange(len(first))  # by list again
        first, same = np.sort(first), place[same]
        self.lists, self.x, self.own = lists, x[first], own[first]
        # The least ids of each vector: the count wanted, and the query's own.
        pairs = np.unique(np.column_stack([same, ids]), axis=0)
        begin = np.searchsorted(pairs[:, 0], np.arange(len(first)))
        pairs = pairs[np.arange(len(pairs)) - begin[pairs[:, 0]] <= count]
        self.ids = pairs[:, 1]
        self.begin = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.members = np.diff(self.begin)
        decoded = lists.index.decode(codes[first], self.own)
        self.norm = norms(self.x)
        self.unit = max(np.abs(decoded).max(), np.finfo(float).tiny)
        self.decoded = (decoded / self.unit).astype(np.float32)
        self.error = ((norms(self.x - decoded) + ROUNDING_SINGLE * (self.norm + norms(decoded))) / self.unit).astype(np.float32)
        self.some, at = np.unique(self.own, return_index=True)
        self.column = np.repeat(np.arange(len(self.some)), np.diff(np.append(at, len(self.own))))

    def candidates(self, q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which vectors, which query may have them): by the bounds of lists, then of codes."""
        wanted = self.lists.wanted(q, bar, self.some)
        cols = np.flatnonzero(wanted.any(0)[self.column])
        far = norms(q)
        far[far == 0] = 1
        most = (q / far[:, None]).astype(np.float32) @ self.decoded[cols].T
        most += self.error[cols]
        with np.errstate(over="ignore"):
            reached = most >= (bar / far / self.unit).astype(np.float32)[:, None]
        reached &= wanted[:, self.column[cols]]
        alone = np.where(self.members[cols] == 1, self.ids[self.begin[cols]], -1)
        reached &= ~((alone == q_ids[:, None]) & (self.members[cols] == 1))
        some = reached.any(0)
        return cols[some], reached[:, some]

    def scan(self, q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, count: int):
        """(query's place, vec_id, score) of the best `count` of each query, at least; a step at a time."""
        for a, b in steps(len(q), len(self.x)):
            cols, reached = self.candidates(q_ids[a:b], q[a:b], bar[a:b])
            if not len(cols):
                continue
            s = np.where(reached, q[a:b] @ self.x[cols].T, -np.inf)
            slack = 2 * ROUNDING * norms(q[a:b]) * self.norm[cols].max()
            level = bar[a:b] - slack
            more = np.flatnonzero((s >= level[:, None]).sum(1) > count)
            if len(more):
                level[more] = np.maximum(level[more], np.partition(s[more], -count, axis=1)[:, -count] - slack[more])
            row, col = np.nonzero(reached & (s >= level[:, None]))
            for c, d in steps(len(row), self.x.shape[1]):
                yield self._best(q_ids, q, row[c:d] + a, cols[col[c:d]])

    def _best(self, q_ids: np.ndarray, q: np.ndarray, row: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score, n = (self.x[k] * q[row]).sum(1), self.members[k]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[k], n)
        row, v = np.repeat(row, n), self.ids[at]
        other = v != q_ids[row]
        return row[other], v[other], np.repeat(score, n)[other]


def best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the greatest scores of each row, ties to smaller ids."""
    order = np.lexsort((ids, -scores, row))
    begin = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - begin < count]


def search(table: DataFrame, every: int = EVERY, count: int = NEIGHBOURS, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its nearest other rows by inner product.

    Rows without id take no part; nor do vectors that are null, zero, with null or
    non-finite components, or of another length than most of the sample.  Of
    several rows with one id and vector one counts; ties go to the smaller id.
    Fewer candidates give fewer rows; an empty table gives none.  Other columns are
    left out.  exact: bounds are not used, all lists are visited and every vector is
    scored exactly.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark, rows = table.sparkSession, usable(table)
    got = fit(rows)
    if got is None:
        return spark.createDataFrame([], schema)
    index, known_ids, known = got
    rows = rows.where(F.size("vector") == index.dim)

    def place(batches):
        for b in batches:
            x = matrix(b.column(1), index.dim)
            own = index.nearest(x)
            codes = index.encode(x, own)
            made = [pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms(x - index.centres[own])), pa.array(norms(x))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["vec_id", "vector", "list", "code", "reach", "norm"])

    from .common import checkpointed

    placed = checkpointed(rows.mapInArrow(place, "vec_id long, vector array<double>, list long, code binary, reach double, norm double"))
    # One row for each list, MOST_LISTS at most.
    lists = Lists(index, {r[0]: tuple(r[1:]) for r in placed.groupBy("list").agg(F.count("*"), F.max("reach"), F.max("norm")).collect()})
    bins = int(lists.bin.max()) + 1

    def visit(batches):
        for b in batches:
            ids, q = np.asarray(b.column(0)), matrix(b.column(1), index.dim)
            bar = np.full(len(q), -np.inf) if exact else bars(ids, q, known_ids, known, count)
            there = np.flatnonzero(lists.bin >= 0)
            for c, d in steps(len(q), max(len(there), index.dim * bins)):
                seen = np.zeros((d - c, bins), bool)
                row, col = np.nonzero(lists.wanted(q[c:d], bar[c:d], there))
                seen[row, lists.bin[there[col]]] = True
                row, bin_ = np.nonzero(seen)
                take = pa.array(row + c)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(bar[row + c]), pa.array(bin_)], ["query_id", "query", "bar", "bin"])

    visits = checkpointed(rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(visit, "query_id long, query array<double>, bar double, bin long"))
    placed = placed.join(F.broadcast(spark.createDataFrame(list(enumerate(lists.bin.tolist())), "list long, bin long")), "list")
    # Blocks of both sides. The counts are one row for each bin, MOST_LISTS at most.
    vectors = placed.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    queries = visits.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    sizes = F.broadcast(checkpointed(vectors.join(queries, "bin")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = placed.join(sizes, "bin").select("bin", some("vec_id", "blocks").alias("block"), spread("query_blocks").alias("query_block"), "vec_id", "vector", "list", "code")
    right = visits.join(sizes, "bin").select("bin", spread("blocks").alias("block"), some("query_id", "query_blocks").alias("query_block"), "query_id", "query", "bar")
    none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return none
        codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(a.num_rows, -1)
        block = Block(lists, np.asarray(a.column("vec_id")), matrix(a.column("vector"), index.dim), np.asarray(a.column("list")), codes, count)
        q_ids, q, bar = np.asarray(b.column("query_id")), matrix(b.column("query"), index.dim), np.asarray(b.column("bar"))
        order = np.argsort(index.nearest(q), kind="stable")  # queries of a step want the same lists
        q_ids, q, bar = q_ids[order], q[order], bar[order]
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        done = []
        for part in block.scan(q_ids, q, bar, count):
            # The last query of a part may go on in the next one.
            held = [np.concatenate(c) for c in zip(held, part)]
            top = best(*held, count)
            held = [c[top] for c in held]
            if len(held[0]):
                over = held[0] < held[0][-1]
                done.append([c[over] for c in held])
                held = [c[~over] for c in held]
        row, v, s = (np.concatenate(c) for c in zip(*done, held))
        return pa.table([q_ids[row], v, s], names=["query_id", "vec_id", "score"])

    keys = ["bin", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
