"""Stages one by one, each judged on its own input by a plain version of it; and all of them in turn."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from prismframe.llm import secrets, suffixes, toxicity
from prismframe.llm.queries import vocabulary_path
from tests.llm import cases


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def packed_whole(rows, docs, library) -> None:
    """Every id of every document lies in one piece, and windows have no gaps and full or power-of-two lengths."""
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for d, text in docs.items():
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def masked_only_values(before: str, after: str) -> bool:
    """after is before with some stretches replaced by the mask."""
    at = 0
    for k, part in enumerate(after.split(secrets.MASK)):
        found = before.find(part, at)
        if found < 0 or k == 0 and found != 0:
            return False
        at = found + len(part)
    return after.endswith(secrets.MASK) or before.endswith(after.split(secrets.MASK)[-1])


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = by_id(docs)
        before, after = {k: r.text for k, r in rows.items()}, {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            score = {k: cases.toxicity_score(t, model) for k, t in before.items() if len(t or "") < 20_000}
            cut = {k: model.thresholds.get(rows[k].lang or "", model.threshold) for k in score}
            assert all((score[k] < cut[k]) == (k in after) for k in score if abs(score[k] - cut[k]) > 1e-4)
        if name in ("toxicity", "near_duplicates"):
            assert set(after) < set(before) and all(before[k] == t for k, t in after.items())
        else:
            assert set(after) == set(before)
        if name == "near_duplicates":
            assert set(after) == {h for _, h in cases.near_classes(list(before.items()), 5, 0.8)}
        if name == "repeats":
            assert after == cases.without_windows(list(before.items()), suffixes.DEPTH)
        if name == "secrets":
            assert all(not secrets.find(t) for t in after.values())
            assert all(masked_only_values(before[k], t) if secrets.MASK in t else t == before[k] for k, t in after.items())
        docs = out
    packed_whole(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), after, Tokenizer.from_file(vocabulary_path()))


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_run_on_awkward_and_empty_tables(spark, tmp_path, kind):
    from tokenizers import Tokenizer

    rows = cases.awkward() if kind == "awkward" else []
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, 1, int(k % 9 == 0)) for k in range(60)] + [(None, None, 1), (3, 1, None)] if rows else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in cases.SCHEMA.split(", ")]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == bool(rows)
    last = {r.doc_id: r.text for r in docs.collect()}
    if rows:
        assert len(last) == docs.count()  # the rows that come twice are one
        packed_whole(got, last, Tokenizer.from_file(vocabulary_path()))
