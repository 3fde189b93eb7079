"""The columnar store: typed Parquet sorted by `_idx`, a manifest, inverted indexes, checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions.imagebytes import image_format
from prismframe.operators import ordinal

BINARY_TAGS = ("ImageBytes", "HFImageDict", "bytes")


def stored_type(tag: str) -> str:
    """The column type of a field tag: bytes, text, floats as double, all else as bigint."""
    return "binary" if tag in BINARY_TAGS else "string" if tag == "str" else "double" if tag.startswith("float") else "bigint"


def expected_files(field: str, tag: str) -> list[str]:
    return [f"{field}.bin", f"{field}.meta.npy"] if tag in BINARY_TAGS else [f"{field}.bin", f"{field}.offsets.npy"] if tag == "str" else [f"{field}.npy"]


def tags(schema: T.StructType) -> dict[str, str]:
    kind = {"binary": "bytes", "string": "str", "double": "float", "float": "float"}
    return {f.name: kind.get(f.dataType.simpleString(), "int") for f in schema if not f.name.startswith("_")}


def typed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.select("_idx", *[F.col(c).cast(stored_type(t)).alias(c) for c, t in fields.items()])


def pointers(df: DataFrame, field: str, name: str = "ptr") -> DataFrame:
    """Where each row's bytes begin, if rows lay end to end in the order of _idx."""
    return ordinal.prefix_sum(df.withColumn("size", F.octet_length(field).cast("long")), "_idx", "size", name)


def merged(shards: list[DataFrame], starts: list[int]) -> DataFrame:
    """Shards with ids of their own as one table."""
    out = None
    for shard, start in zip(shards, starts):
        part = shard.withColumn("_idx", (F.col("_idx") + start).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifest_path(self) -> str:
        return f"{self.path}/manifest"

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._manifest_path()))

    def wipe(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def build(self, df: DataFrame, fields: dict[str, str] | None = None) -> Store:
        """One pass writes the rows, ranged by _idx so that a row or a range touches few files; then the manifest."""
        fields = fields or tags(df.schema)
        typed(df, fields).repartitionByRange("_idx").sortWithinPartitions("_idx").write.mode("overwrite").parquet(f"{self.path}/rows")
        rows = self.rows()
        binary = [c for c, t in fields.items() if t in BINARY_TAGS]
        found = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.max(F.octet_length(c)), F.lit(0)).alias(c) for c in binary]).first()
        manifest = {"version": 1, "num_samples": found["n"], "fields": {c: {"type": t} | ({"max_size": int(found[c] * 1.2)} if c in binary else {}) for c, t in fields.items()}, "file_sizes": self.listing()}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(self._manifest_path())
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def manifest(self) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(self._manifest_path()).collect()))

    def listing(self) -> dict[str, int]:
        fs, path = self._fs()
        root = path(f"{self.path}/rows")
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(root) if not s.getPath().getName().startswith(("_", "."))} if fs.exists(root) else {}

    def problems(self) -> list[str]:
        """What is missing or has another size than the manifest says; empty if all is well."""
        if not self.exists():
            return ["no manifest"]
        try:
            manifest = self.manifest()
        except ValueError:
            return ["corrupt manifest"]
        have = self.listing()
        return [f"{n}: missing" if n not in have else f"{n}: {have[n]} bytes, not {s}" for n, s in manifest.get("file_sizes", {}).items() if have.get(n) != s]

    def index(self, field: str) -> DataFrame:
        fields = self.manifest()["fields"]
        if fields[field]["type"] in BINARY_TAGS:
            raise ValueError(f"{field} holds bytes")
        return index(self.rows(), field)

    # --- tables beside the rows: saved indexes, planar YUV ---

    def _beside(self, kind: str, field: str = "") -> str:
        return f"{self.path}/{kind}/{field}".rstrip("/")

    def save_index(self, field: str, size: int = 1 << 16) -> DataFrame:
        """index_blocks() of a field, written in the order of values, so that a lookup reads few row groups."""
        if self.manifest()["fields"][field]["type"] in BINARY_TAGS:
            raise ValueError(f"{field} holds bytes")
        index_blocks(self.rows(), field, size).repartitionByRange("value", "block").sortWithinPartitions("value", "block").write.mode("overwrite").parquet(self._beside("index", field))
        return self.saved_index(field)

    def saved_index(self, field: str) -> DataFrame:
        if field not in self.indexes():
            raise KeyError(field)
        return self.spark.read.parquet(self._beside("index", field))

    def indexes(self) -> list[str]:
        """The fields whose indexes were saved whole."""
        fs, path = self._fs()
        root = path(self._beside("index"))
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(p.getName() for p in found if fs.exists(path(p, "_SUCCESS")))

    def image_format(self, field: str) -> str:
        """jpeg, png or other, as of the first image that is there; jpeg where there is none."""
        if self.manifest()["fields"][field]["type"] not in BINARY_TAGS:
            raise KeyError(field)
        first = self.rows().where(F.col(field).isNotNull()).select(image_format(F.col(field)).alias("f")).first()
        return first.f if first else "jpeg"

    def build_yuv(self, field: str = "image") -> DataFrame:
        """(_idx, field, height, width): the images as planar YUV 4:2:0, written once beside the rows; made again only if rows were added or lost."""
        from prismframe.operators.prepare import to_yuv420

        have = self.yuv(field)
        if have is None or have.count() != self.manifest()["num_samples"]:
            sizes = [c for c in ("height", "width") if c in self.rows().columns]
            to_yuv420(field)(self.rows().select("_idx", field, *sizes)).write.mode("overwrite").parquet(self._beside("yuv420", field))
        return self.yuv(field)

    def yuv(self, field: str = "image") -> DataFrame | None:
        """What build_yuv() wrote; null if there is nothing, or not all of it."""
        fs, path = self._fs()
        at = self._beside("yuv420", field)
        return self.spark.read.parquet(at) if fs.exists(path(f"{at}/_SUCCESS")) else None

    def batch(self, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
        return load_batch(self.rows(), ids, fields)


def index(df: DataFrame, field: str) -> DataFrame:
    """(value, rows): the row ids of each value, ascending. A value's rows are one list: for values that very many rows have, index_blocks()."""
    return df.groupBy(F.col(field).alias("value")).agg(F.array_sort(F.collect_list("_idx")).alias("rows"))


def index_blocks(df: DataFrame, field: str, size: int = 1 << 16) -> DataFrame:
    """(value, block, rows): index(), with the rows of a value cut where ids pass a multiple of `size`: no list grows with the table."""
    block = F.floor(F.col("_idx") / size).cast("long")
    return df.groupBy(F.col(field).alias("value"), block.alias("block")).agg(F.array_sort(F.collect_list("_idx")).alias("rows"))


def lookup(df: DataFrame, field: str, values: list) -> DataFrame:
    """(value, _idx) of the rows that have one of some values, without an index of the others."""
    return df.where(F.col(field).isin(*values)).select(F.col(field).alias("value"), "_idx")


def load_batch(rows: DataFrame, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows for a table of (_at, _idx): repeats stay, _at gives the order. Spark broadcasts ids only where statistics show that they are small."""
    unknown = [f for f in fields or [] if f not in rows.columns]
    if unknown:
        raise KeyError(unknown[0])
    return ids.join(rows.select("_idx", *(fields or [c for c in rows.columns if c != "_idx"])), "_idx")


def differing(a: DataFrame, b: DataFrame, field: str, hashed: bool = True) -> DataFrame:
    """(_idx, problem) of rows whose field differs between two tables, or that one lacks."""
    value = (lambda c: F.sha2(c.cast("binary"), 256)) if hashed else (lambda c: c)
    x, y = a.select("_idx", value(F.col(field)).alias("x")), b.select("_idx", value(F.col(field)).alias("y"))
    both = x.withColumn("in_x", F.lit(True)).join(y.withColumn("in_y", F.lit(True)), "_idx", "full_outer")
    return both.where(F.col("in_x").isNull() | F.col("in_y").isNull() | ~F.col("x").eqNullSafe(F.col("y"))).select("_idx", F.when(F.col("in_x").isNull(), "extra").when(F.col("in_y").isNull(), "missing").otherwise("differs").alias("problem"))


def normalization(df: DataFrame, px: str, hw: int, limit: int | None = None) -> DataFrame:
    """(channel, mean, std) over all pixels: sums and squares are added up in partial aggregates; the variance is of the population."""
    rows = df if limit is None else df.where(F.col("_idx") < limit)
    per_row: Column = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.struct(c.alias("c"), F.aggregate(F.slice(F.col(px), c * hw + 1, F.lit(hw)), F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(F.slice(F.col(px), c * hw + 1, F.lit(hw)), F.lit(0.0), lambda a, x: a + x * x).alias("q")))
    sums = rows.select(F.explode(per_row).alias("t")).groupBy(F.col("t.c").cast("long").alias("channel")).agg(F.sum("t.s").alias("s"), F.sum("t.q").alias("q"), (F.count("*") * hw).alias("n"))
    mean = F.col("s") / F.col("n")
    return sums.select("channel", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
