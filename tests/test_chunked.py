"""Folders of binary chunks: names, kinds, ids, slices, compression, and what is wrong with a folder."""

import hashlib
import json
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from prismframe.sources import chunked


def folder(path, sizes, compression=None, names=("image", "label", "text", "score")):
    """Chunks of so many items; item i is (i bytes, i, text, i / 2)."""
    path.mkdir()
    chunks, at = [], 0
    for k, n in enumerate(sizes):
        data = chunked.encode([[bytes([i % 256]) * i, struct.pack("<q", -i), f"t\u00e9{i}".encode(), struct.pack("<d", i / 2)] for i in range(at, at + n)])
        (path / f"chunk-{k}.bin").write_bytes(zstandard.compress(data) if compression else data)
        chunks.append({"filename": f"chunk-{k}.bin", "chunk_size": n})
        at += n
    spec = json.dumps([1, {"type": "builtins.dict", "context": json.dumps(list(names)), "children_spec": []}])
    (path / "index.json").write_text(json.dumps({"chunks": chunks, "config": {"data_format": ["jpeg", "int", "str", "float"], "data_spec": spec, "compression": compression}, "updated_at": "17"}))
    return str(path)


@pytest.mark.parametrize("compression", [None, "zstd"])
def test_items(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(chunked, "SLICE", 64)
    spark.dataSource.register(chunked.ChunkedSource)
    df = spark.read.format("chunked").option("version", "17").load(folder(tmp_path / "c", [3, 0, 40, 1], compression))
    got = sorted(map(tuple, df.collect()))
    assert got == [(i, bytes([i]) * i, -i, f"t\u00e9{i}", i / 2) for i in range(44)]
    assert df.rdd.getNumPartitions() == 4


def test_slices(tmp_path, monkeypatch):
    monkeypatch.setattr(chunked, "SLICE", 64)
    reader = chunked._Reader(chunked.Folder(folder(tmp_path / "c", [30])), ["label", "_idx"])
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) > 5 and [x for b in batches for x in b.column(1).to_pylist()] == list(range(30))
    assert [x for b in batches for x in b.column(0).to_pylist()] == [-i for i in range(30)]


def test_empty_and_wrong(spark, tmp_path):
    spark.dataSource.register(chunked.ChunkedSource)
    path = folder(tmp_path / "none", [])
    assert spark.read.format("chunked").load(path).collect() == []
    with pytest.raises(ValueError, match="version"):
        chunked.Folder(path, "18")
    (tmp_path / "none" / "index.json").write_text(json.dumps({"chunks": [], "config": {}}))
    with pytest.raises(ValueError, match="data_format"):
        chunked.Folder(path)
    assert chunked.field_names({"data_format": ["int", "str"]}) == ["field_0", "field_1"]
    short = chunked._Reader(chunked.Folder(folder(tmp_path / "short", [2])), ["_idx"])
    (tmp_path / "short" / "chunk-0.bin").write_bytes(chunked.encode([[b"", b"", b"", b""]]))
    with pytest.raises(ValueError, match="1 items"):
        list(short.read(short.partitions()[0]))


def test_identity(spark):
    rows = [("/x/chunks/0123456789ab/17", "s3://b/d"), ("/x/y", "s3://b/d"), ("/x/y", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(chunked.identity(F.col("a"), F.col("b"))).collect()]
    assert got == ["01234567", hashlib.md5(b"s3://b/d").hexdigest()[:8], None, None]
