"""A reader for folders of binary chunks as a Spark data source: one partition for each chunk, ids in the order of the index.

A folder has index.json: `chunks` (filename, chunk_size: its items) and `config`
(data_format: a kind for each field; data_spec: their names; compression).  A
chunk, little endian: the count of items n (u4), n + 1 places from the chunk's
begin (u4), then the items: a size for each field (u4), then the fields' bytes.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismframe.sources.packed import open_file

#: Kinds whose bytes are a number or a text; all others stay bytes.
NUMBERS = {"int": np.dtype("<i8"), "float": np.dtype("<f8")}
TYPES = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType()}
#: Bytes of items that are read and turned into one batch.
SLICE = 16 << 20


def field_names(config: dict) -> list[str]:
    """The names in the tree of data_spec, else field_0, field_1, ..."""
    count = len(config["data_format"])
    try:
        node = json.loads(config["data_spec"])[1]
        names = json.loads(node["context"]) if isinstance(node["context"], str) else node["context"]
    except (KeyError, IndexError, TypeError, ValueError):
        names = None
    return [str(n) for n in names] if isinstance(names, list) and len(names) == count else [f"field_{k}" for k in range(count)]


def sizes_of(raw: np.ndarray, places: np.ndarray, fields: int) -> np.ndarray:
    """[items, fields]: the sizes that stand before each item's fields."""
    at = places[:-1, None] + np.arange(4 * fields)
    if len(places) > 1 and (np.any(np.diff(places) < 4 * fields) or places[-1] > len(raw)):
        raise ValueError("places of items")
    sizes = np.ascontiguousarray(raw[at]).view("<u4").astype(np.int64).reshape(-1, fields)
    if np.any(places[:-1] + 4 * fields + sizes.sum(1) > places[1:]):
        raise ValueError("sizes of fields")
    return sizes


def columns_of(raw: np.ndarray, places: np.ndarray, kinds: list[str], wanted: list[int]) -> list[pa.Array]:
    """The wanted fields of the items at places[:-1], which end at places[1:]."""
    sizes = sizes_of(raw, places, len(kinds))
    starts = places[:-1, None] + 4 * len(kinds) + np.cumsum(sizes, 1) - sizes
    out, data = [], raw.tobytes()
    for k in wanted:
        kind, begin, size = kinds[k], starts[:, k], sizes[:, k]
        if kind in NUMBERS:
            if np.any(size < 8):
                raise ValueError(f"size of {kind}")
            out.append(pa.array(np.ascontiguousarray(raw[begin[:, None] + np.arange(8)]).view(NUMBERS[kind]).reshape(-1)))
        else:
            parts = [data[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]
            out.append(pa.array([p.decode() for p in parts], pa.string()) if kind == "str" else pa.array(parts, pa.binary()))
    return out


def encode(items: list[list[bytes]]) -> bytes:
    """The chunk of some items, each a list of its fields' bytes."""
    bodies = [struct.pack(f"<{len(i)}I", *map(len, i)) + b"".join(i) for i in items]
    places = np.cumsum([4 * (len(bodies) + 2), *map(len, bodies)])
    return struct.pack("<I", len(bodies)) + places.astype("<u4").tobytes() + b"".join(bodies)


def unpacked(chunks: DataFrame, content: str, first: str, kinds: dict[str, str]) -> DataFrame:
    """(_idx, fields) of chunks that are bytes in a column; first: the id of a chunk's first item. Null chunks have no items."""
    schema = T.StructType([T.StructField("_idx", T.LongType()), *(T.StructField(n, TYPES.get(k, T.BinaryType())) for n, k in kinds.items())])

    def run(batches):
        for b in batches:
            for data, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is not None:
                    raw = np.frombuffer(data, np.uint8)
                    n = int.from_bytes(data[:4], "little")
                    places = np.frombuffer(data, "<u4", n + 1, 4).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n, dtype=np.int64)), *columns_of(raw, places, list(kinds.values()), list(range(len(kinds))))], ["_idx", *kinds])

    return chunks.select(content, F.col(first).cast("long")).mapInArrow(run, schema)


class Folder:
    def __init__(self, path: str, version: str | None = None):
        self.path = path.rstrip("/")
        with open_file(f"{self.path}/index.json") as f:
            index = json.loads(f.read())
        if version is not None and str(index.get("updated_at")) != version:
            raise ValueError(f"version {index.get('updated_at')}, not {version}")
        config = index.get("config") or {}
        if not config.get("data_format"):
            raise ValueError("no data_format in the index")
        self.kinds, self.names = list(config["data_format"]), field_names(config)
        self.compression = config.get("compression")
        if self.compression not in (None, "zstd"):
            raise ValueError(f"compression {self.compression}")
        self.chunks = [(c["filename"], int(c["chunk_size"])) for c in index.get("chunks") or []]


class Chunk(InputPartition):
    def __init__(self, name: str, first: int, items: int):
        super().__init__(first)
        self.name, self.first, self.items = name, first, items


class _Reader(DataSourceReader):
    def __init__(self, folder: Folder, names: list[str]):
        self.folder, self.names = folder, names

    def partitions(self):
        firsts = np.cumsum([0, *(n for _, n in self.folder.chunks)]).tolist()
        return [Chunk(name, first, n) for (name, n), first in zip(self.folder.chunks, firsts)] or [Chunk("", 0, 0)]

    def read(self, partition: Chunk):
        if not partition.items:
            return
        with open_file(f"{self.folder.path}/{partition.name}") as f:
            if self.folder.compression:
                import zstandard

                f = pa.BufferReader(zstandard.ZstdDecompressor().stream_reader(f).read())
            n = int.from_bytes(f.read_at(4, 0), "little")
            if n != partition.items:
                raise ValueError(f"{partition.name}: {n} items, not {partition.items}")
            places = np.frombuffer(f.read_at(4 * (n + 1), 4), "<u4").astype(np.int64)
            wanted = [self.folder.names.index(c) for c in self.names if c != "_idx"]
            low = 0
            while low < n:
                high = max(low + 1, int(np.searchsorted(places, places[low] + SLICE, "right")) - 1)
                raw = np.frombuffer(f.read_at(int(places[high] - places[low]), int(places[low])), np.uint8)
                found = dict(zip((self.folder.names[k] for k in wanted), columns_of(raw, places[low : high + 1] - places[low], self.folder.kinds, wanted)))
                found["_idx"] = pa.array(np.arange(partition.first + low, partition.first + high, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([found[c] for c in self.names], self.names)
                low = high


class ChunkedSource(DataSource):
    """spark.dataSource.register(ChunkedSource); spark.read.format("chunked").load(folder); option version: what the index must say."""

    @classmethod
    def name(cls) -> str:
        return "chunked"

    def _folder(self) -> Folder:
        return Folder(self.options["path"], self.options.get("version"))

    def schema(self) -> T.StructType:
        f = self._folder()
        return T.StructType([T.StructField("_idx", T.LongType()), *(T.StructField(n, TYPES.get(k, T.BinaryType())) for n, k in zip(f.names, f.kinds))])

    def reader(self, schema):
        return _Reader(self._folder(), [f.name for f in schema])


def identity(path: Column, remote: Column) -> Column:
    """Eight characters for a dataset: of the folder below `chunks` in its local path, else of the hash of its remote address; null with neither."""
    own = F.regexp_extract(path, "(?:^|/)chunks/([^/]+)", 1)
    return F.coalesce(F.when(own != "", F.substring(own, 1, 8)), F.substring(F.md5(remote.cast("binary")), 1, 8))
