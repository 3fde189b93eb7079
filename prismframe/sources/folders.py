"""Class folders, prepared archives and the kinds of dataset that a path can be."""

from __future__ import annotations

import json
import tarfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.functions.hashing import content_hash

#: Endings of archives, packed files and images.
ARCHIVES = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
PACKED = (".ffcv", ".beton")
IMAGES = (".jpg", ".jpeg", ".png", ".ppm", ".bmp", ".pgm", ".tif", ".tiff", ".webp")
MARKER = ".extraction_complete"


def is_archive(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for e in ARCHIVES:
        out = out | low.endswith(e)
    return out


def is_packed(path: Column) -> Column:
    """By the ending before any ?query; case counts."""
    return F.regexp_replace(path, r"\?.*$", "").rlike(r"\.(ffcv|beton)$")


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """(_idx, image, label, path) of root/<class>/...: label is the class's place among the sorted names; path starts at root's own name.

    Listing and reading are distributed; only the class names, one row each, are ordered together.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    low = F.lower("path")
    image = F.lit(False)
    for e in IMAGES:
        image = image | low.endswith(e)
    name = base.rsplit("/", 1)[-1]
    inner = F.regexp_extract("path", f"/{name}/(.+)$", 1)
    rows = files.where(image).select(F.concat(F.lit(f"{name}/"), inner).alias("path"), F.split(inner, "/")[0].alias("class"), F.col("content").alias("image"))
    labels = rows.select("class").distinct().withColumn("label", F.row_number().over(Window.orderBy("class")).cast("long") - 1)
    out = rows.join(labels, "class")
    within = Window.partitionBy("label").orderBy("path")
    sizes = out.groupBy("label").agg(F.count("*").alias("n"))
    offset = sizes.select("label", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return out.withColumn("_k", F.row_number().over(within) - 1).join(offset, "label").select((F.col("_k") + F.col("before")).cast("long").alias("_idx"), "image", "label", "path")


def struct_images(df: DataFrame, column: str) -> DataFrame:
    """A struct {bytes, path} column as plain bytes."""
    return df.withColumn(column, F.col(column)["bytes"])


def kind_of(path: str) -> str:
    """streaming, parquet, imagefolder, store, archive, packed or unknown, by what lies there."""
    p = path.split("?")[0]
    if p.lower().endswith(ARCHIVES):
        return "archive"
    if p.endswith(PACKED):
        return "packed"
    root = Path(path)
    if not root.is_dir():
        return "unknown"
    if (root / "manifest").exists() or (root / "manifest.json").exists():
        return "store"
    index = root / "index.json"
    if index.exists():
        config = json.loads(index.read_text()).get("config") or {}
        return "parquet" if config.get("item_loader") == "ParquetLoader" or config.get("data_format") is None and not config else "streaming"
    for sub in sorted(x for x in root.iterdir() if x.is_dir())[:3]:
        if any(f.suffix.lower() in IMAGES for f in sorted(sub.iterdir())[:10]):
            return "imagefolder"
    return "unknown"


def extract(archive: str, target: str) -> str:
    """Unpacks once; a marker with the count of files says that it is whole."""
    out = Path(target)
    if not whole(target):
        with tarfile.open(archive) as t:
            t.extractall(out, filter="data")
        (out / MARKER).write_text(str(_files(out)))
    return target


def content_root(target: str) -> str:
    """What was unpacked, without a single folder around all of it."""
    inner = [x for x in Path(target).iterdir() if x.name != MARKER]
    return str(inner[0]) if len(inner) == 1 and inner[0].is_dir() and any(x.is_dir() for x in inner[0].iterdir()) else target


def _files(root: Path) -> int:
    return sum(1 for x in root.rglob("*") if x.is_file() and x.name != MARKER)


def whole(target: str) -> bool:
    mark = Path(target) / MARKER
    try:
        return int(mark.read_text()) == _files(Path(target))
    except (OSError, ValueError):
        return False


def fingerprints(spark: SparkSession, path: str, length: int = 12) -> DataFrame:
    """(path, hash) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", content_hash(F.col("content"), length).alias("hash"))
