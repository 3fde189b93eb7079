"""One way in: a dataset of any kind that a path can be, as a lazy table with `_idx`, its fields and its identity."""

from __future__ import annotations

import hashlib
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.functions.hashing import cache_path, file_hash
from prismframe.operators.loader import Loader, Step
from prismframe.operators.store import Store, tags
from prismframe.sources import chunked, folders, packed, remote


def numbered(files: DataFrame) -> DataFrame:
    """Rows of a Parquet folder with `_idx`: their places, files in the order of their names. Only counts of files are ordered together."""
    if "_idx" in files.columns:
        return files
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = files.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").select((F.col("_start") + F.col("_row")).cast("long").alias("_idx"), *files.columns)


def unpacked(archive: str, cache: str) -> str:
    """The content of an archive, fetched if it lies elsewhere, under cache/hashid/<hash>/; unpacked once, again only if files are missing. The cache must be a folder that all workers see."""
    local = archive
    if "://" in archive:
        system, inner = remote.opened(archive)
        local = str(Path(cache) / "archives" / f"{remote.local_name(archive)}{''.join(Path(inner).suffixes)}")
        size = system.get_file_info(inner).size
        if not Path(local).exists() or Path(local).stat().st_size != size:
            Path(local).parent.mkdir(parents=True, exist_ok=True)
            part = Path(local + ".part")
            with system.open_input_stream(inner, compression=None) as x, open(part, "wb") as y:
                while piece := x.read(remote.PIECE):
                    y.write(piece)
            part.rename(local)
    target = Path(cache) / "hashid" / file_hash(local)
    target.mkdir(parents=True, exist_ok=True)
    return folders.content_root(folders.extract(local, str(target)))


class Dataset:
    """source: a store, a packed file, class folders or an archive of them, a folder of Parquet or of binary chunks.

    pipelines: steps for the whole table, in the order of their names' appearance.
    FileNotFoundError: a local source that is not there; ValueError: one of no known kind.
    """

    def __init__(self, spark: SparkSession, source: str, cache: str | None = None, version: str | None = None, pipelines: dict[str, list[Step]] | None = None):
        self.spark, self.source, self.version, self.pipelines = spark, source, version, pipelines or {}
        if "://" not in source and not Path(source.split("?")[0]).exists():
            raise FileNotFoundError(source)
        self.kind = folders.kind_of(source)
        if self.kind == "unknown" and "://" in source:
            self.kind = "streaming"
        if self.kind == "unknown":
            raise ValueError(f"{source} is of no known kind")
        self.cache = cache or cache_path(hashlib.sha256(source.encode()).hexdigest()[:12])
        self.table = reduce(lambda t, f: f(t), (f for steps in self.pipelines.values() for f in steps), self._read())

    def _read(self) -> DataFrame:
        read = self.spark.read
        if self.kind == "store":
            return Store(self.spark, self.source).rows()
        if self.kind == "packed":
            self.spark.dataSource.register(packed.PackedSource)
            return read.format("packed").load(self.source.split("?")[0])
        if self.kind == "parquet":
            return numbered(read.option("pathGlobFilter", "*.parquet").parquet(self.source))
        if self.kind == "streaming":
            self.spark.dataSource.register(chunked.ChunkedSource)
            return (read.option("version", self.version) if self.version else read).format("chunked").load(self.source)
        return folders.class_folders(self.spark, unpacked(self.source, self.cache) if self.kind == "archive" else self.source)

    @property
    def fields(self) -> dict[str, str]:
        return tags(self.table.schema)

    def __len__(self) -> int:
        return self.table.count()

    def __getitem__(self, at: int) -> Row:
        found = self.table.where(F.col("_idx") == at).first()
        if found is None:
            raise IndexError(at)
        return found

    def identity(self, length: int = 12) -> str:
        """Of the bytes of a local file; else of the source's name and version."""
        if "://" not in self.source and Path(self.source).is_file():
            return file_hash(self.source, length)
        return hashlib.sha256(f"{self.source}:{self.version or ''}".encode()).hexdigest()[:length]

    def store(self, path: str) -> Store:
        """The table as a store: what is there stays, if it is whole."""
        store = Store(self.spark, path)
        return store if store.exists() and not store.problems() else store.build(self.table)

    def loader(self, batch_size: int = 256, **options) -> Loader:
        return Loader(self.table, batch_size, **options)
