"""The operators over whole corpora against plain versions, on awkward tables and on the smallest documents."""

from __future__ import annotations

import numpy as np
import pytest

from prismframe.llm import common, lm, neardup, spans, suffixes
from tests.llm import cases


@pytest.fixture(scope="module", params=["awkward", "documents", "empty"])
def table(request, spark, sf):
    if request.param == "documents":
        return spark.read.parquet(f"{sf}/documents.parquet")
    rows = cases.awkward() if request.param == "awkward" else []
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3)


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Many chunks, so that matches cross them."""
    real = common.make_chunks
    for m in (lm, neardup, spans, suffixes):
        monkeypatch.setattr(m, "make_chunks", lambda docs, limit=20_000: real(docs, limit))


def pairs(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_sentence_spans(table):
    got = sorted((cases.key(r.doc_id), r.n_sentences, r.n_removed, r.kept_sha256) for r in spans.report(table).collect())
    assert got == cases.spans(pairs(table), spans.SPAN, spans.LONG)


def test_suffix_windows(table):
    got = sorted((cases.key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(table).collect())
    assert got == cases.windows(pairs(table), suffixes.DEPTH)


def test_hot_digits_give_the_same(table, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "WINDOWS", 500)
    got = sorted((cases.key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(table).collect())
    assert got == cases.windows(pairs(table), suffixes.DEPTH)


def test_language_model(table):
    got = sorted((cases.key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.report(table).collect())
    want = cases.language_model(pairs(table), lm.PRIOR)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) <= 2e-6 * max(1, abs(b)) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


def test_near_duplicates(table):
    rows = neardup.report(table).collect()
    assert sorted((cases.key(r.doc_id), cases.key(r.class_id)) for r in rows) == cases.near_classes(pairs(table), neardup.WORDS, neardup.SIMILARITY)
    heads = [r for r in rows if r.keep]
    assert len(heads) == len({r.class_id for r in rows}) and all(r.doc_id == r.class_id for r in heads)


def test_rewriting_keeps_rows_and_columns(table):
    for f in (spans.deduplicate, suffixes.deduplicate):
        out = f(table)
        assert out.columns == table.columns and [x.dataType for x in out.schema] == [x.dataType for x in table.schema]
        rows = out.collect()
        assert len(rows) == table.count() and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        assert sum(r.text is None for r in rows) == table.where("text is null").count()
    kept = neardup.deduplicate(table).collect()
    assert len(kept) == sum(r.keep for r in neardup.report(table).collect())


def test_thue_morse_words_are_not_one(spark):
    """Words on which sums modulo powers of two collide, in every operator that hashes words."""
    from tests.llm.test_rows import thue_morse

    a, b = thue_morse(2048)
    rows = [(0, f"{a} x. {a} y. {a} z."), (1, f"{b} x. {b} y. {b} z."), (2, f"{a} x. {a} y. {a} z."), (3, f"{a} {b} {a} {a} {a} x y"), (4, f"{b} {b} {a} {a} {a} x y")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_sentences, r.n_removed, r.kept_sha256) for r in spans.report(table).collect())
    assert got == cases.spans(rows, spans.SPAN, spans.LONG) and [g[2] for g in got] == [0, 0, 3, 0, 0]
    got = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.report(table).collect())
    assert got == [(w[0], w[3], *w[5:]) for w in cases.language_model(rows, lm.PRIOR)]
    assert sorted((r.doc_id, r.class_id) for r in neardup.report(table).collect()) == cases.near_classes(rows, neardup.WORDS, neardup.SIMILARITY)


def test_bands_of_unlike_texts_are_paired_in_blocks(spark, monkeypatch):
    """A band that every text shares, most of them in one class: all other pairs come up once."""
    monkeypatch.setattr(neardup, "GRID", 3)
    members = spark.createDataFrame([(7, k, 1.0, 1.0, 0 if k < 20 else k) for k in range(31)], "band long, row long, shared double, weight double, root long")
    rows = spark.createDataFrame([(k, [7], b"x") for k in range(31)], "row long, bands array<long>, bag binary")
    got = sorted((r.a, r.b) for r in neardup._unlike(members, rows, 31, 0.8).collect())
    assert got == sorted((a, b) for b in range(31) for a in range(b) if b >= 20)


def test_large_group_of_near_copies_is_one_class(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[: 5 * k % 290] + [f"x{k}"] + words[5 * k % 290 + 1 :])) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in neardup.report(table).collect()} == {0}


def test_automaton_beats_unigrams_on_held_out_texts(spark, sf):
    r = lm.report(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_pairs_of_a_large_group_are_verified_together(monkeypatch):
    """Links as similarity() finds them, over several blocks, and far sooner than pair by pair."""
    from time import process_time

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
    df = rng.integers(2, 90, len(keys))
    bags = {}
    for k in range(160):
        own = np.sort(rng.choice(len(keys), 1 + k if k < 4 else 600, replace=False))
        if k % 10 == 5:  # equal but for counts
            own = np.arange(500)
        bags[k * 7] = common.pack_arrays(keys[own], common.narrow(rng.integers(1, 3, len(own))), common.narrow(df[own]))
    a, b = np.triu_indices(160, 1)
    a, b = a * 7, b * 7
    began = process_time()
    plain = np.array([neardup.similarity(common.unpack_arrays(bags[x]), common.unpack_arrays(bags[y]), 1000) for x, y in zip(a.tolist(), b.tolist())])
    plain_s, began = process_time() - began, process_time()
    for least in (0.5, 0.6, float(np.median(plain))):
        assert (neardup.linked(a, b, bags, 1000, least) == (plain >= least)).all()
    assert process_time() - began < plain_s  # three times over
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    some = rng.random(len(a)) < 0.1
    assert (neardup.linked(a[some], b[some], bags, 1000, 0.6) == (plain[some] >= 0.6)).all()
    assert len(neardup.linked(a[:0], b[:0], bags, 1000, 0.6)) == 0
