"""Repeated passages in text without punctuation, at any offset."""

import random

import numpy as np
import pyarrow as pa

from prismframe.llm import spans
from prismframe.llm.queries import op2_sentence_spans


def removed(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return {r.doc_id: r for r in op2_sentence_spans(spark, str(path)).collect()}


def test_passages_without_punctuation_are_caught_at_any_offset(spark, tmp_path):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    texts = []
    for _ in range(150):
        passage = [word() for _ in range(51)]
        for _ in range(2):
            texts.append(" ".join([word() for _ in range(r.randint(0, 40))] + passage + [word() for _ in range(r.randint(0, 40))]))
    texts += [" ".join(["no"] * 80 + [word() for _ in range(60)]) for _ in range(2)]
    # 25 words are no passage.
    short = [word() for _ in range(25)]
    texts += [" ".join([word() for _ in range(40)] + short + [word() for _ in range(40)]) for _ in range(2)]
    rows = removed(spark, tmp_path, texts)
    assert all(rows[k].n_removed == 0 for k in range(0, 300, 2))
    assert all(rows[k].n_bytes_removed >= 30 * 9 for k in range(1, 300, 2))
    assert rows[300].n_removed > 0 and rows[301].n_bytes_removed > rows[300].n_bytes_removed - 240
    assert rows[302].n_removed == rows[303].n_removed == 0


def test_cuts_by_content_leave_short_sentences_alone():
    t = spans.Texts(pa.array(["One two. Three four! Five six? Seven", None, "", "a\nb\nc"]))
    for a, b in zip(spans.sentences(t, True), spans.sentences(t, False)):
        assert np.array_equal(np.array(a), np.array(b))
