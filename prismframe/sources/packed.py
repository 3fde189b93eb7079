"""A reader for packed page files (version 2) as a Spark data source: one partition for each range of samples.

Layout, little endian: header (version u2, fields u2, page size u4, samples u8,
allocation table u8); a descriptor for each field (type u1, name 16 bytes,
arguments 1024 bytes); a row for each sample, its fields aligned in order; pages;
the allocation table (sample u8, place u8, size u8), an entry for each
variable-length field and sample, in the order in which pages were written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismframe.operators.kernels import image_end

#: Field types of the format.
BYTES, INT, FLOAT, JSON, IMAGE = 0, 1, 2, 5, 255
HEADER = np.dtype([("version", "<u2"), ("fields", "<u2"), ("page", "<u4"), ("samples", "<u8"), ("table", "<u8")], align=True)
FIELD = np.dtype([("kind", "<u1"), ("name", "<u1", 16), ("arguments", "<u1", 1024)], align=True)
ENTRY = np.dtype([("sample", "<u8"), ("place", "<u8"), ("size", "<u8")])
ROWS = {IMAGE: np.dtype([("mode", "<u1"), ("width", "<u2"), ("height", "<u2"), ("place", "<u8")]), INT: np.dtype("<i8"), FLOAT: np.dtype("<f8"), BYTES: np.dtype([("place", "<u8"), ("size", "<u8")]), JSON: np.dtype([("place", "<u8"), ("size", "<u8")])}
SQL = {IMAGE: "struct<data:binary,size:bigint,height:int,width:int>", INT: "bigint", FLOAT: "double", BYTES: "binary", JSON: "string"}


def open_file(path: str):
    """A file of any file system that Arrow knows, by its URI, or a local path."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class PackedFile:
    def __init__(self, path: str):
        self.path = path
        with open_file(path) as f:
            self.header = np.frombuffer(f.read_at(HEADER.itemsize, 0), HEADER)[0]
            if self.header["version"] != 2:
                raise ValueError(f"version {self.header['version']}")
            n = int(self.header["fields"])
            fields = np.frombuffer(f.read_at(FIELD.itemsize * n, HEADER.itemsize), FIELD)
        self.names = [bytes(f["name"]).split(b"\0")[0].decode("ascii") for f in fields]
        self.kinds = [int(k) for k in fields["kind"]]
        self.row = np.dtype([(f"f{k}", ROWS.get(x, np.dtype("<u8"))) for k, x in enumerate(self.kinds)], align=True)
        self.start, self.samples = HEADER.itemsize + fields.nbytes, int(self.header["samples"])
        self.variable = [k for k, x in enumerate(self.kinds) if x in (IMAGE, BYTES, JSON)]

    def ends(self) -> dict[int, np.ndarray]:
        """For each variable-length field where its pages' parts end, by sample."""
        with open_file(self.path) as f:
            at = int(self.header["table"])
            table = np.frombuffer(f.read_at((f.size() - at) // ENTRY.itemsize * ENTRY.itemsize, at), ENTRY)
        out = {}
        for at, k in enumerate(self.variable):
            own = table[at :: len(self.variable)]
            own = own[np.argsort(own["sample"], kind="stable")]
            out[k] = (own["place"] + own["size"]).astype(np.int64)
        return out

    def read(self, low: int, high: int, ends: dict[int, np.ndarray], names: list[str]) -> pa.RecordBatch:
        """The samples low to high; ends: of just these."""
        with open_file(self.path) as f:
            rows = np.frombuffer(f.read_at((high - low) * self.row.itemsize, self.start + low * self.row.itemsize), self.row)
            columns = {"_idx": pa.array(np.arange(low, high, dtype=np.int64))}
            for k, (name, kind) in enumerate(zip(self.names, self.kinds)):
                if name not in names:
                    continue
                v = rows[f"f{k}"]
                if kind == IMAGE:
                    data = [f.read_at(e - p, p) for p, e in zip(v["place"].tolist(), ends[k].tolist())]
                    data = [d[: image_end(d)] for d in data]
                    parts = [pa.array(data, pa.binary()), pa.array([len(d) for d in data], pa.int64()), pa.array(v["height"].astype(np.int32)), pa.array(v["width"].astype(np.int32))]
                    columns[name] = pa.StructArray.from_arrays(parts, ["data", "size", "height", "width"])
                elif kind in (BYTES, JSON):
                    data = [f.read_at(n, p) for p, n in zip(v["place"].tolist(), v["size"].tolist())]
                    columns[name] = pa.array([d.rstrip(b"\0").decode() for d in data], pa.string()) if kind == JSON else pa.array(data, pa.binary())
                else:
                    columns[name] = pa.array(np.ascontiguousarray(v))
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


class Range(InputPartition):
    """Samples, and where their parts end: the table of the file is read and sorted once, when the scan is planned."""

    def __init__(self, low: int, high: int, ends: dict[int, np.ndarray]):
        super().__init__((low, high))
        self.low, self.high, self.ends = low, high, ends


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int, names: list[str]):
        self.path, self.step, self.names = path, step, names

    def partitions(self):
        file = PackedFile(self.path)
        ends, n = file.ends() if file.variable else {}, file.samples
        return [Range(k, min(k + self.step, n), {c: e[k : k + self.step] for c, e in ends.items()}) for k in range(0, n, self.step)] or [Range(0, 0, {c: e[:0] for c, e in ends.items()})]

    def read(self, partition: Range):
        yield PackedFile(self.path).read(partition.low, partition.high, partition.ends, self.names)


def sample_info(df: DataFrame, image: str) -> DataFrame:
    """(_idx, size, height, width) of a table of samples."""
    return df.select("_idx", f"{image}.size", f"{image}.height", f"{image}.width")


class PackedSource(DataSource):
    """spark.dataSource.register(PackedSource); spark.read.format("packed").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def _file(self) -> PackedFile:
        return PackedFile(self.options["path"])

    def schema(self) -> str:
        f = self._file()
        return "_idx bigint, " + ", ".join(f"`{n}` {SQL[k]}" for n, k in zip(f.names, f.kinds) if k in SQL)

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("rows", 4096)), [f.name for f in schema])
