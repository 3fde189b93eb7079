"""Copying folders between file systems: listed on the driver, copied by tasks, each file whole or not at all."""

from __future__ import annotations

import hashlib
import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.functions.hashing import sync_plan

PIECE = 8 << 20
LISTED = "name string, size long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI that Arrow knows or of a local path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    """Whether there is such a file, or such a folder with something in it."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    return info.type == fs.FileType.File or info.type == fs.FileType.Directory and bool(system.get_file_info(fs.FileSelector(inner)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, size) of all files below a folder, names from there; none if it is not there. Hidden names ending in .part are copies that did not end."""
    system, inner = opened(root)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
    rows = [(posixpath.relpath(i.path, inner.rstrip("/")), i.size) for i in found if i.type == fs.FileType.File and not i.path.endswith(".part")]
    return spark.createDataFrame(rows, LISTED)


def copied(files: DataFrame, source: str, target: str, spread: int = 64) -> DataFrame:
    """(name, bytes) of files copied from one folder to another, named by `files`; a task that is run again copies over what is there."""

    def run(batches):
        (a, base), (b, out) = opened(source), opened(target)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name in names:
                to = f"{out.rstrip('/')}/{name}"
                b.create_dir(posixpath.dirname(to), recursive=True)
                part, n = f"{to}.{uuid.uuid4().hex}.part", 0
                with a.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as x, b.open_output_stream(part, compression=None) as y:
                    while piece := x.read(PIECE):
                        y.write(piece)
                        n += len(piece)
                b.move(part, to)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return files.select("name").repartition(spread, "name").mapInArrow(run, "name string, bytes long")


def copy_folder(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copies what the target lacks or has in another size: {files, bytes}. Run again after a failure it goes on from there."""
    there, here = listing(spark, source), listing(spark, target)
    done = copied(there.join(here, ["name", "size"], "left_anti"), source, target).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return done.asDict()


def sync(spark: SparkSession, local: str, remote: str) -> dict[str, dict[str, int]]:
    """Copies to each side the files whose names only the other has: {download, upload}, each {files, bytes}."""
    plan = sync_plan(listing(spark, local), listing(spark, remote)).collect()
    out = {}
    for action, source, target in (("download", remote, local), ("upload", local, remote)):
        names = spark.createDataFrame([(r["name"],) for r in plan if r.action == action], "name string")
        out[action] = copied(names, source, target).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()
    return out


def local_name(remote: str) -> str:
    """A folder name for a remote one, the same at each call: its last part and a hash of the whole."""
    return f"{remote.rstrip('/').rsplit('/', 1)[-1]}-{hashlib.sha256(remote.encode()).hexdigest()[:12]}"
