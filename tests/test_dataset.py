"""Every kind of dataset through one door."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from prismframe.operators.store import Store
from prismframe.sources.dataset import Dataset, numbered
from tests.test_chunked import folder


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, files in {"b": ["x.png"], "a": ["z.jpg", "y.png", "note.txt"]}.items():
        (root / name).mkdir(parents=True)
        for f in files:
            (root / name / f).write_bytes(f"{name}{f}".encode())
    return root


def test_class_folders_and_archives(spark, tmp_path, tree):
    rows = sorted(map(tuple, Dataset(spark, str(tree)).table.drop("path").collect()))
    assert rows == [(0, b"ay.png", 0), (1, b"az.jpg", 0), (2, b"bx.png", 1)]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tree, "tree")
    for source in (str(tmp_path / "t.tar.gz"), f"file://{tmp_path}/t.tar.gz"):
        for _ in range(2):
            d = Dataset(spark, source, cache=str(tmp_path / "cache"))
            assert d.kind == "archive" and sorted(map(tuple, d.table.drop("path").collect())) == rows
    assert len(list((tmp_path / "cache/hashid").iterdir())) == 1 and not list(tmp_path.rglob("*.part"))


def test_chunks_stores_and_loaders(spark, tmp_path):
    d = Dataset(spark, folder(tmp_path / "c", [3, 4]), version="17", pipelines={"label": [lambda t: t.withColumn("label", -F.col("label"))]})
    assert (d.kind, len(d), d[5].label, d.fields["text"]) == ("streaming", 7, 5, "str")
    with pytest.raises(IndexError):
        d[7]
    assert d.identity() != Dataset(spark, str(tmp_path / "c")).identity()
    s = d.store(str(tmp_path / "s"))
    assert s.problems() == [] and d.store(str(tmp_path / "s")).listing() == s.listing()
    again = Dataset(spark, str(tmp_path / "s"))
    assert again.kind == "store" and sorted(r.label for r in again.table.collect()) == list(range(7))
    assert len(again.loader(2)) == 3


def test_parquet_rows_are_numbered(spark, tmp_path):
    root = tmp_path / "p"
    for k, n in enumerate((3, 0, 5)):
        spark.range(10 * k, 10 * k + n).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        part = next((tmp_path / f"w{k}").glob("*.parquet"))
        root.mkdir(exist_ok=True)
        part.rename(root / f"chunk-{k}.parquet")
    (root / "index.json").write_text(json.dumps({"chunks": [], "config": {"item_loader": "ParquetLoader"}}))
    d = Dataset(spark, str(root))
    assert d.kind == "parquet" and sorted(map(tuple, d.table.collect())) == list(enumerate([0, 1, 2, 20, 21, 22, 23, 24]))
    assert numbered(d.table) is d.table


def test_wrong_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Dataset(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        Dataset(spark, str(tmp_path / "empty"))
    assert not Store(spark, str(tmp_path / "empty")).exists()
