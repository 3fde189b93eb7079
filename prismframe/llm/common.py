"""What the corpus operators share: chunks of documents and a two-way exchange of packed keys.

Many of these operators need one statistic per key (a shingle, an n-gram, a
passage) over the whole corpus, and then need it back beside the text.  One row
per key is too dear: a corpus has nearly as many five-word shingles as words.
So documents are packed into *chunks* of a few MB (one row each, all columns,
compressed), and keys travel as *blobs*: for each chunk and key range, one
sorted array of distinct 64-bit keys.

    chunks --emit--> (bin, chunk, blob) --reduce per bin--> (chunk, blob) --apply--> rows

A chunk reduces its own repeats before anything is shuffled, so a key holds at
most one entry per chunk in its bin, however many rows it has: a hot key cannot
make a hot task.  Nothing is collected to the driver or broadcast, and chunks are
written by checkpoint() to the folder that the cluster shares, so a lost
executor costs only the tasks it ran.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes after which a chunk is closed. One document is never split.
CHUNK_BYTES = 4 << 20
#: Key ranges for each shuffle partition at least, and text bytes whose keys a range holds at most, so that a task's memory does not grow with the input.
BINS_PER_PARTITION, BIN_BYTES = 2, 16 << 20
#: Keys that hold more than one in so many rows of a join are joined by broadcast: there are fewer than that.
HOT_SHARE = 1000
BLOB_SCHEMA = "bin int, chunk long, blob binary"
BACK_SCHEMA = "chunk long, bin int, blob binary"
U64 = np.uint64


# --- session -----------------------------------------------------------------


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by files in spark.checkpoint.dir (own folder only where that is unset)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are checkpointed and no longer held.

    It does so when the JVM collects them; the last job is held until another has run.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bins_for(chunks: DataFrame) -> int:
    """How many key ranges the statistics of these chunks are cut into."""
    spark = chunks.sparkSession
    return max(BINS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), chunks.count() * CHUNK_BYTES // BIN_BYTES)


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """big joined with small, which has a row for each key and in `n` how many rows of big have it.

    Keys of more than total / HOT_SHARE rows are broadcast, so that no task gets
    all rows of one key: of such keys there are at most HOT_SHARE for each `total`
    rows that big has.
    """
    hot, cold = small.where(F.col("n") * HOT_SHARE > total), small.where(F.col("n") * HOT_SHARE <= total)
    # One broadcast for both sides: n is null where the key is not hot.
    both = big.join(F.broadcast(hot), keys, "left")
    rest = both.where("n is null").select(*big.columns).join(cold, keys)
    return both.where("n is not null").unionByName(rest).drop("n")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), so that other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(doc_id):
    """crc32 of the id as text, modulo 5: the folds of the learning operators (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


# --- arrays as bytes ----------------------------------------------------------

_C, _D = None, None


def _zstd():
    global _C, _D
    if _C is None:
        _C, _D = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _C, _D


def squeeze(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as one compressed value. Byte planes let sorted keys and small counts shrink."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return squeeze(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = memoryview(unsqueeze(data))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    head = np.frombuffer(raw[8 : 8 + 24 * n], np.int64).reshape(n, 3)
    out, at = [], 8 + 24 * n
    for kind, size, length in head.tolist():
        planes = np.frombuffer(raw[at : at + size * length], np.uint8).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += size * length
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned values in as few bytes as hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t, m in ((np.uint8, 2**8), (np.uint16, 2**16), (np.uint32, 2**32), (np.uint64, 2**64)) if top < m))


# --- chunks -------------------------------------------------------------------


def _close(batch: pa.RecordBatch | pa.Table, number: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
        w.write(batch)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["chunk", "payload", "n_rows"])


def _text_sizes(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.names.index("text"))), 0))


def _chunker(limit: int):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            ends, start = np.cumsum(_text_sizes(b).astype(np.int64) + 64), 0
            while start < b.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = min(b.num_rows, int(np.searchsorted(ends, before + limit - size, "left")) + 1)
                held.append(b.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= limit:
                    yield _close(pa.Table.from_batches(held).combine_chunks(), (part << 20) + seq)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield _close(pa.Table.from_batches(held).combine_chunks(), (part << 20) + seq)

    return run


def make_chunks(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, payload, n_rows): the rows of docs, with all their columns, packed and written to the checkpoint folder."""
    return checkpointed(docs.mapInArrow(_chunker(limit), "chunk long, payload binary, n_rows long"))


def open_chunk(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


class Texts:
    """The UTF-8 bytes of a chunk's texts, end to end (null: empty)."""

    def __init__(self, column):
        import pyarrow.compute as pc

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n, (_, offsets, data) = len(column), column.buffers()
        o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = raw[o[0] : o[-1]]
        self.offsets = o - o[0]

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Texts:
        """Texts of these bytes."""
        t = cls.__new__(cls)
        t.bytes, t.offsets = raw, offsets
        return t

    def __len__(self):
        return len(self.offsets) - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[raw]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(t: Texts, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not `between` (space and 0x09-0x0D), and for each text its first word's number."""
    raw, n = t.bytes, len(t.bytes)
    inside = np.empty(n + 1, bool)
    np.logical_not(between[raw], out=inside[:n])
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside[:n]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, t.offsets)


def doc_keys(table: pa.Table) -> np.ndarray:
    """doc_id of each row as int64; null ids come before all others."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(table.column("doc_id").cast(pa.int64()), -(2**63)).combine_chunks())


def row_ids(chunk: int, rows: int) -> np.ndarray:
    """A number for each row of a chunk, unique in the table: repeated doc_ids stay apart."""
    return (chunk << 24) + np.arange(rows, dtype=np.int64)


def cut_out(t: Texts, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are not gone, end to end, and each text's first."""
    keep = ~gone
    return t.bytes[keep], np.append(0, np.cumsum(keep))[t.offsets]


def with_texts(table: pa.Table, raw: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """table with new texts (null ones stay null), and n_chars after them where there is such a column."""
    import pyarrow.compute as pc

    old = table.column("text")
    new = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw.tobytes())])
    none = pc.is_null(old).combine_chunks()
    new = pc.if_else(none, pa.scalar(None, pa.large_string()), new)
    out = table.set_column(table.schema.names.index("text"), table.schema.field("text"), new.cast(old.type))
    if "n_chars" in table.column_names:
        kind = table.schema.field("n_chars").type
        count = pc.if_else(none, table.column("n_chars").combine_chunks(), pc.utf8_length(new).cast(kind))
        out = out.set_column(table.schema.names.index("n_chars"), table.schema.field("n_chars"), count)
    return out


def runs_per_text(gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes gone of each text, and the maximal runs they form (a run ends with its text)."""
    n = len(gone)
    sums = np.append(0, np.cumsum(gone, dtype=np.int32))
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = gone[edges]
    starts = np.append(0, np.cumsum(begin, dtype=np.int32))
    return np.diff(sums[offsets]).astype(np.int64), np.diff(starts[offsets]).astype(np.int64)


# --- hashes of strings ---------------------------------------------------------

#: Bytes hashed at a time: what fits the processor's caches, whatever the chunk's size.
HASH_STEP = 1 << 18
#: Strings longer than this are hashed one by one.
LONG_STRING = 64
#: Start and factor of each lane. Fixed, so that every worker agrees.
_LANES = ((U64(0x2D358DCCAA6C78A5), U64(0x9E3779B97F4A7C15)), (U64(0x8BB84B93962EACC9), U64(0xC2B2AE3D27D4EB4F)))
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit; it is one to one."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (starts ascending); both lanes together are 128 bits.

    Eight bytes at a time go through mix(), so no sum or polynomial of the bytes
    decides: strings of one length up to eight bytes never collide, longer ones
    only by chance.
    """
    seed, factor = _LANES[lane]
    out = np.empty(len(starts), U64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(raw) + 1, HASH_STEP)), [0, len(starts)]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        low = int(starts[a])
        part = np.zeros(int(starts[b - 1]) - low + LONG_STRING + 8, np.uint8)
        own = raw[low : low + len(part)]
        part[: len(own)] = own
        words = np.ascontiguousarray(np.ndarray(len(part) - 7, "<u8", part, strides=(1,)))
        at, size = starts[a:b] - low, ends[a:b] - starts[a:b]
        h = size.astype(U64) * factor + seed
        some = np.arange(b - a)
        for k in range(0, LONG_STRING, 8):
            if k:
                some = some[size[some] > k]
                if not len(some):
                    break
            got = words[at[some] + k] & _FIRST_BYTES[np.minimum(size[some] - k, 8)]
            h[some] = mix((h[some] ^ got) * factor)
        for k in np.flatnonzero(size > LONG_STRING).tolist():
            digest = hashlib.blake2b(raw[starts[a + k] : ends[a + k]].tobytes(), digest_size=16).digest()
            h[k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
        out[a:b] = h
    return out


def item_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of items, which are 64-bit hashes themselves; for short runs."""
    seed, factor = _LANES[lane]
    size = ends - starts
    h = size.astype(U64) * factor + seed
    some, k = np.flatnonzero(size > 0), 0
    while len(some):
        h[some] = mix((h[some] ^ items[starts[some] + k]) * factor)
        k += 1
        some = some[size[some] > k]
    return h


def run_hashes(items: np.ndarray, width: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """item_hashes() of all runs of `width` items that lie in one text; firsts: the texts' first items, and the end. Also each run's first item."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for k in range(1, width):
        cut = firsts[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    seed, factor = _LANES[0]
    h = np.full(n, (width * int(factor) + int(seed)) % 2**64, U64)
    for k in range(width):
        h ^= items[k : n + k]
        h *= factor
        h = mix(h)
    at = np.flatnonzero(ok)
    return h[at], at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the items of ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte span (starts ascending) the number of its string, and each string's first span. Bytes decide."""
    import pandas as pd

    code, kinds = pd.factorize(span_hashes(raw, starts, ends))
    first = np.empty(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    size, same = ends - starts, first[code]
    long = np.flatnonzero((size > 8) & (same != np.arange(len(code))))  # the others are equal if hash and size are
    equal = (size == size[same]).all()
    for k in range(0, len(long), HASH_STEP >> 3) if equal else ():
        some = long[k : k + (HASH_STEP >> 3)]
        equal = equal and np.array_equal(raw[ragged(starts[some], size[some])], raw[ragged(starts[same[some]], size[some])])
    if not equal:
        data, seen = raw.tobytes(), {}
        code = np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        first = np.empty(len(seen), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


# --- memory of workers -----------------------------------------------------------

_TRIM: list = []


def give_back() -> None:
    """Gives freed memory back to the system: Spark uses its Python workers again, and they would keep the largest chunk's."""
    if not _TRIM:
        import ctypes

        _TRIM.append(getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0))
    pa.default_memory_pool().release_unused()
    _TRIM[0](0)


# --- the exchange ---------------------------------------------------------------


def cut_bins(keys: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of the equal key ranges in sorted keys."""
    edges = np.array([(b << 64) // bins for b in range(1, bins)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def blob_rows(bins: list[int], chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["bin", "chunk", "blob"])


def by_bin(chunk: int, bins: int, keys: np.ndarray, *payload: np.ndarray, whole: tuple = ()) -> pa.RecordBatch:
    """A row for each key range that has keys (sorted), with the payload arrays that go along, and `whole` arrays uncut."""
    cuts = cut_bins(keys, bins)
    used = np.flatnonzero(np.diff(cuts)).tolist()
    return blob_rows(used, [chunk] * len(used), [pack_arrays(keys[cuts[b] : cuts[b + 1]], *(narrow(p[cuts[b] : cuts[b + 1]]) for p in payload), *whole) for b in used])


def from_least(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as small differences from the least, and the least."""
    low = ids.min() if len(ids) else np.int64(0)
    return (ids.astype(U64) - np.uint64(int(low) % 2**64)), np.array([low], np.int64)


def to_ids(difference: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (difference.astype(U64) + low.view(U64)[0]).view(np.int64)


def emit(chunks: DataFrame, function, schema: str = BLOB_SCHEMA) -> DataFrame:
    """function(chunk number, table) yields record batches of the schema."""

    def run(batches):
        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(1)):
                yield from function(number, open_chunk(payload.as_buffer()))
                give_back()

    return chunks.mapInArrow(run, schema)


def reduce_bins(blobs: DataFrame, function, schema: str = BACK_SCHEMA) -> DataFrame:
    """function(bin, chunk numbers, blobs) gives a table of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        got = function(table.column("bin")[0].as_py(), table.column("chunk").to_pylist(), table.column("blob").to_pylist())
        give_back()
        return (pa.Table.from_batches([got]) if isinstance(got, pa.RecordBatch) else got).cast(out)

    return blobs.groupBy("bin").applyInArrow(run, schema)


def back_rows(chunks: list[int], number: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([number] * len(chunks), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "bin", "blob"])


def apply_back(chunks: DataFrame, back: DataFrame, function, schema) -> DataFrame:
    """function(chunk number, table, blobs) gives a table of the schema; chunks without blobs get an empty list."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        blobs = right.column("blob").to_pylist() if right.num_rows else []
        for number, payload in zip(left.column("chunk").to_pylist(), left.column("payload").combine_chunks() if left.num_rows else []):
            parts.append(function(number, open_chunk(payload.as_buffer()), blobs))
            give_back()
        parts = [pa.Table.from_batches([p]) if isinstance(p, pa.RecordBatch) else p for p in parts]
        return pa.concat_tables([p.cast(out) for p in parts]) if parts else out.empty_table()

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, schema)
