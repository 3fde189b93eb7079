"""Identities of datasets, files and folders."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is appended to a file's name for its remembered hash.
SIDECAR = ".sha256"


def content_hash(data: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(data, 256), 1, length)


def hash_in_path(path: Column) -> Column:
    """The 12 hex digits after /hashid/ in a path; null if there are none."""
    got = F.regexp_extract(path, "/hashid/([a-f0-9]{12})/", 1)
    return F.when(got != "", got)


def listing_hash(files: DataFrame, by: list[str], length: int = 12) -> DataFrame:
    """A hash for each folder of (path, mtime, size) rows: of its sorted lines path:mtime:size. A folder's listing is gathered in one row."""
    line = F.concat_ws(":", "path", "mtime", "size")
    return files.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, length).alias("hash"))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What each side lacks, by name: (name, action), action download or upload."""
    down = remote.join(local, "name", "left_anti").select("name", F.lit("download").alias("action"))
    return down.unionByName(local.join(remote, "name", "left_anti").select("name", F.lit("upload").alias("action")))


# --- on the driver: a file, remembered beside it -----------------------------------------


def remembered(path: str) -> str | None:
    """The hash that was saved for a file, if it has not changed since."""
    file, side = Path(path), Path(path + SIDECAR)
    try:
        said, changed = side.read_text().split()
        return said if float(changed) == file.stat().st_mtime else None
    except (OSError, ValueError):
        return None


def remember(path: str, said: str) -> None:
    """Saved where the folder can be written; else forgotten."""
    try:
        Path(path + SIDECAR).write_text(f"{said} {Path(path).stat().st_mtime!r}")
    except OSError:
        pass


def file_hash(path: str, length: int = 12) -> str:
    """The hash of one file's bytes, read once for as long as it does not change."""
    said = remembered(path)
    if said is None or len(said) < length:
        with open(path, "rb") as f:
            said = hashlib.file_digest(f, "sha256").hexdigest()
        remember(path, said)
    return said[:length]


def cache_path(dataset: str, base: str | None = None) -> str:
    """Where what is derived from a dataset with this hash lies."""
    return str(Path(base or Path.home() / ".prismframe") / f"dataset-{dataset}")
