"""The operators that look at one row at a time."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prismframe.llm import ann, bpe, common, flac, packing, secrets, toxicity
from prismframe.llm.queries import vocabulary_path
from tests.llm import cases


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(cases.awkward(), cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_trie_encodes_as_the_library(library):
    r, e = random.Random(1), bpe.encoder(vocabulary_path())
    letters = "abcthe  ein \n\t'sé日本🙂0123!?.,%$<|endoftext|>"
    words = [t.decode("utf-8", "ignore") for t in e.v.token]
    texts = ["", "x <|endoftext|> y<|endoftext|>", "it's we're '''s 's", "a" * 700, " " * 40, *("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)), *("".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(2000))]
    ids, firsts = e.ids(pa.array(texts, pa.large_string()))
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == want
    assert e.decode(ids, firsts) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_encode_rows(table, library):
    rows = bpe.encode(table, vocabulary_path()).collect()
    text = collections.Counter((r.doc_id, r.text or "") for r in table.collect())
    assert collections.Counter((r.doc_id, r.decoded) for r in rows) == text
    digests = bpe.digest(table, vocabulary_path()).collect()
    assert sorted(hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in rows) == sorted(r.ids_sha256 for r in digests)


def test_packing_holds_every_id_once(table, library):
    rows = packing.pack(table, vocabulary_path()).collect()
    want = sorted((r.doc_id is not None, r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in table.select("doc_id", "text").where("doc_id is not null and doc_id <> 4").collect())
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for _, d, ids in want:
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_plan_and_groups():
    r = random.Random(0)
    for _ in range(100):
        sizes = [r.choice([1, 5, 300, 2048, 2049, r.randint(1, 9000)]) for _ in range(r.randint(0, 40))]
        windows = packing.plan(sizes)
        totals = [sum(n for _, _, n in w) for w in windows]
        assert sum(totals) == sum(sizes) and all(t == 2048 or t & (t - 1) == 0 for t in totals)
        groups = collections.Counter()
        for g, t in zip(packing.step_groups(totals), totals):
            groups[g] += t
        if len(groups) > 1:
            assert max(groups.values()) - min(groups.values()) <= 2048


def plain_finds(t: str):
    out = []
    for k, (p, n, g) in enumerate(((r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m.group(g)) >= n]
    return sorted(out)


TOKEN = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def test_base_finds(spark):
    r = random.Random(4)
    parts = ["password", "Secret", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "deadbeef", "é", "x", "/+_-", "%", "\\u0041", "&#65;", "\n"]
    texts = [None, "", TOKEN, *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(300))]
    rows = secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        want = plain_finds(texts[row.doc_id] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(filter(None, said.split(","))) <= set(row.spans.split(","))


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: urllib.parse.quote(s),
    lambda s: urllib.parse.quote(urllib.parse.quote(base64.b64encode(zlib.compress(s.encode())).decode())),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
])
def test_layers_are_unwrapped_to_their_place(wrap):
    body = wrap(TOKEN * 2)
    text = f"é before {body} after"
    _, every, layers, unfinished = secrets.scan(text)
    assert layers > 1 and not unfinished and any(k == 0 for _, _, k, _ in every)
    assert all(9 <= a < b <= 9 + len(body) for a, b, _, _ in every)
    left = secrets.masked(text)
    assert left.startswith("é before ") and left.endswith(" after") and not secrets.scan(left)[1]


def test_worth_misses_nothing():
    r = random.Random(9)
    texts = ["".join(r.choice("ab01 =:%&\\xAKIu{}+/") for _ in range(r.randint(0, 60))) for _ in range(500)]
    flags = secrets.worth(flac.Texts(pa.array(texts)))
    assert all(secrets.scan(t) == ([], [], 1, False) for t, f in zip(texts, flags) if not f)


def test_redaction_keeps_rows(table):
    out = secrets.redact(table)
    assert out.columns == table.columns and out.count() == table.count()


def test_flac_round_trip_and_checks(table):
    r = random.Random(3)
    texts = ["", "a", "é" * 100, None, "a" * 5000, "\0", "".join(chr(r.randint(0, 255)) for _ in range(9000)), "".join(r.choice("ab") for _ in range(7000)), "the quick brown fox " * 300]
    payload, firsts = flac.payloads(flac.Texts(pa.array(texts, pa.string())))
    media = flac.encode(payload, firsts)
    back = flac.decode(media)
    assert back == [payload[a:b].tobytes() for a, b in zip(firsts, firsts[1:])]
    for m, b in zip(media[:5], back):
        assert (flac.decode_stream(m).astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == b
    for place in (-1, -9, 60):
        bad = bytearray(media[8])
        bad[place] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    rows = flac.report(table).collect()
    want = {}
    for x in table.collect():
        raw = (x.text or "").encode()
        want[x.doc_id] = (len(raw), hashlib.sha256(raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))).hexdigest())
    assert all((x.n_bytes, x.payload_sha256) == want[x.doc_id] for x in rows) and len(rows) == table.count()
    blocks = flac.pcm_blocks(flac.store(table)).where("doc_id = 0").orderBy("block").collect()
    assert hashlib.sha256(b"".join(bytes(b.pcm) for b in blocks)).hexdigest() == want[0][1] and [b.first_sample for b in blocks] == [flac.BLOCK * k for k in range(len(blocks))]


def test_toxicity_learns_and_stays_in_range(spark, sf):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        words = [r.choice(vocabulary) for _ in range(60)]
        if bad:
            words[r.randrange(60)] = "zzzvile" + r.choice("abc")
        rows.append((k, " ".join(words), "en" if k % 2 else "de"))
        labels.append((k, int(bad)))
    rows += [(5000, None, None), (5001, "", "en"), (None, "text", "fr"), rows[3]]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.95 * len(held)
    assert toxicity.classify(docs.limit(0), marks.limit(0)).count() == 0
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and 600 <= kept.count() <= 760


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 20))
    x[100:400] = x[100]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 20, 1), (2040, [float("nan")] * 20, 1), (2060, [None] + [1.0] * 19, 1), (None, [1.0] * 20, 1), (40, x[40].tolist(), 2)]
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(1500), -s))[:20]
        hit += len(set(top) & {v for v, _, _ in found})
        assert [k for _, _, k in found] == list(range(1, 21)) and all(abs(s[v] - t) < 1e-9 for v, t, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit >= 0.9 * 20 * len(got)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def thue_morse(n: int) -> tuple[str, str]:
    """A word on which sums modulo powers of two collide, and its complement."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart_by_their_bytes(library):
    texts = [w for n in (1024, 2048, 4096) for w in thue_morse(n)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for e in (bpe.encoder(vocabulary_path()), packing.library_encoder(vocabulary_path())):
        ids, firsts = e.ids(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == want


@pytest.mark.parametrize("make", [bpe.Encoder, packing.LibraryEncoder])
def test_words_met_lately_are_not_encoded_again(make, library, monkeypatch):
    e, asked = make(vocabulary_path()), []
    monkeypatch.setattr(bpe, "CACHE_WORDS", 60)
    monkeypatch.setattr(e, "fresh", lambda words, fresh=e.fresh: asked.extend(words) or fresh(words))
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03}")
    for k in range(12):
        text = "".join(f" {name(x)}" for x in [*range(20), *range(20 + 10 * k, 30 + 10 * k)])
        assert e.ids(pa.array([text], pa.large_string()))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(e.cache) <= 60
    assert len(asked) == len(set(asked)) == 140
    asked.clear()
    e.ids(pa.array([f" {name(25)}"], pa.large_string()))
    assert asked == [f" {name(25)}".encode()]  # not met for longest, so gone


def test_only_late_characters_take_the_whole_library(library):
    e, asked = packing.LibraryEncoder(vocabulary_path()), []

    class Watched:
        model = library.model

        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return library.encode_batch_fast(words, **options)

    e.library = Watched()
    late = [0x500, 0x558, 0x58B, 0x208F, 0x65E5, 0xA7CE, 0x1F642, 0x323B0]  # some of a later Unicode than the library's
    texts = [f"{x}{chr(c)}{y}" for c in [*range(0x500), *late] for x, y in (("a", "b c"), ("1", "2"), (" ", "a"), ("", "! d"))]
    ids, firsts = e.ids(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert asked and all(max(map(ord, w)) >= 0x500 for w in asked)


def test_distinct_spans_when_hashes_collide(monkeypatch):
    raw = np.frombuffer(b"one two one three two one", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 18, 22]), np.array([3, 7, 11, 17, 21, 25])
    want = [0, 1, 0, 2, 1, 0]
    assert common.distinct_spans(raw, starts, ends)[0].tolist() == want
    monkeypatch.setattr(common, "span_hashes", lambda *a: np.ones(6, np.uint64))
    code, first = common.distinct_spans(raw, starts, ends)
    assert code.tolist() == want and first.tolist() == [0, 1, 3]


def test_toxicity_beside_a_column_of_the_same_name(spark):
    rows = [(k, "vile word " * 20 if k % 3 == 0 else "kind text " * 20, 0.5, "x") for k in range(200)] + [(200, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity_score double, score_of_text string")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {r.doc_id % 3 for r in kept.where("doc_id < 200").collect()} == {1, 2} and kept.where("doc_id = 200 and text is null").count() == 1
    assert toxicity.drop_toxic(docs.limit(0), marks).count() == 0


def test_long_labelled_texts_are_shortened_over_their_whole_length():
    text = " ".join(f"w{k}" for k in range(20_000))
    short = toxicity.shortened(pa.array([text, "A b", "", None]), 4096)
    words = short[0].split()
    assert len(words) == 4096 and words[0] == b"w0" and words[-1] == b"w19999" and short[1:] == [b"a b", b"", b""]


def test_scores_against_plain_loops(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 12))) for _ in range(200)]
    rows = [(k, " ".join([r.choice(vocabulary) for _ in range(r.randint(1, 40))] + (["Vileness!"] if k % 3 == 0 else ["né"])), "en") for k in range(200)] + [(200, "", None), (201, None, "en"), (202, "x" * 30_000 + " vile " * 5000, "de")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {x.doc_id: x.score_of_text for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    kept = {x.doc_id for x in toxicity.score(docs, model, docs.columns, limit="lang").collect()}
    for k, text, lang in rows:
        assert abs(got[k] - cases.toxicity_score(text, model)) < 1e-4
        assert (k in kept) == (got[k] < model.thresholds.get(lang or "", model.threshold))
    # What stands beside a text has no say in its score.
    alone = {x.doc_id: x.score_of_text for k in (1, 7, 200) for x in toxicity.score(docs.where(f"doc_id = {k}"), model, ["doc_id"]).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in alone.items())


def test_every_column_of_the_media_report(table):
    rows = flac.report(table).collect()
    media = collections.Counter((x.doc_id, len(x.media), hashlib.sha256(x.media).hexdigest()) for x in flac.store(table).collect())
    assert collections.Counter((x.doc_id, x.media_bytes, x.media_sha256) for x in rows) == media
    want = collections.Counter()
    for x in table.collect():
        raw = (x.text or "").encode()
        payload = raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))
        s = [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(s, s[1:]))
        said = f"{len(s)}:{sum(s)}:{sum(b * b for b in s)}:{turns}:{min(s)}:{max(s)}"
        want[x.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), said] += 1
    assert collections.Counter((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.feature) for x in rows) == want


def test_row_wise_operators_on_an_empty_table(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    path = vocabulary_path()
    for out in (secrets.report(none), secrets.redact(none), packing.pack(none, path), bpe.encode(none, path), bpe.digest(none, path), flac.store(none), flac.report(none), flac.pcm_blocks(flac.store(none))):
        assert out.collect() == []


def test_row_wise_operators_on_clashing_columns(spark):
    """Columns named as the operators' own, of other types, do no harm."""
    rows = [(k, f"text {k} with password = abcdefghijkl{k}", "n", 1.5, "s", [1], "m") for k in range(5)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, spans string, ids array<int>, media string")
    plain, path = clash.select("doc_id", "text"), vocabulary_path()
    for f in (secrets.report, flac.report, flac.store, lambda t: bpe.digest(t, path), lambda t: bpe.encode(t, path), lambda t: packing.pack(t, path).drop("sequence_id", "step_group")):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(plain).collect()))
    assert secrets.redact(clash).drop("text").collect() == clash.drop("text").collect()
    marks = spark.createDataFrame([(k, k % 2, "x") for k in range(5)], "doc_id long, toxic int, text string")
    assert toxicity.classify(clash, marks).count() == 5


def test_neighbours_beside_clashing_columns(spark):
    x = np.random.default_rng(5).normal(size=(60, 8))
    rows = [(k, v.tolist(), "l", "c", 1, 2.0, "q") for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, code string, rank int, score double, query_id string")
    got = collections.defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in (0, 20, 40):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == np.argsort(-s)[:20].tolist()


def test_neighbours_end_to_end_recall(spark, sf):
    """Against brute force over the whole table of the next size."""
    table = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    found = collections.defaultdict(set)
    for r in ann.search(table).collect():
        found[r.query_id].add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        hit, total = hit + len(found[ids[q]] & set(top.tolist())), total + 20
    assert hit >= 0.95 * total
    assert {(r.query_id, r.vec_id) for r in ann.search(table.where("vec_id < 400"), exact=True).collect()} == {(int(ids[q]), int(v)) for q in np.flatnonzero((ids % 20 == 0) & (ids < 400)) for v in brute(ids, x, q, ids < 400)}


def test_neighbours_of_any_rows_are_the_true_ones(spark, monkeypatch):
    """Near copies that share a code, queries unlike the other rows, a few long vectors; a sample of a tenth and blocks of a few rows: as by brute force."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(3000, 16)))
    x[1000:2000] = unit(x[7] + 1e-4 * rng.normal(size=(1000, 16)))
    x[2000:] = unit(x[:10][rng.integers(0, 10, 1000)] + 0.1 * rng.normal(size=(1000, 16)))
    x[2001:2981:70] *= 50
    x[2500:2560] = x[2500]
    x[::40] = unit(rng.normal(size=(75, 16)))
    ids, fit = np.arange(3000), ann.fit
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "fit", lambda rows: fit(rows, 300))
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 500)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    got = collections.defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((ids, -s))[:20]
        assert found == list(zip(top.tolist(), s[top].tolist()))


def brute(ids, x, q, some):
    s = np.where(some, x @ x[q], -np.inf)
    s[q] = -np.inf
    return ids[np.lexsort((ids, -s))[:20]]


def test_every_word_of_every_labelled_row_is_learnt_from(spark):
    """A word that only the places between a long text's evenly spaced stretches have still counts."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows = []
    for k in range(800):
        words = [r.choice(vocabulary) for _ in range(4200)]
        if k % 3 == 0:
            words[64] = "zzzvile"
        rows.append((k, " ".join(words)))
    assert b"zzzvile" not in toxicity.shortened(pa.array([rows[0][1]]), 4096)[0]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(800)], "doc_id long, toxic int")
    held = [x for x in toxicity.classify(docs, marks).collect() if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 3 == 0) for x in held) >= 0.9 * len(held)


def test_toxicity_of_many_shards(spark, monkeypatch):
    """All labelled rows are in one shard each; what a few shards only have seen is learnt, and the model comes out alike each time."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(k, " ".join([r.choice(vocabulary) for _ in range(40)] + (["zzzvile" + r.choice("abcd")] if k % 4 == 0 else [])), "en") for k in range(3000)] + [(10_000 + k, "x y z", "en") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(3000)], "doc_id long, toxic int")
    wanted = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(3000))
    models = []
    for shard, piece in ((200_000, 300_000), (200_000, 30_000)):  # as dealt at first, and merged
        monkeypatch.setattr(toxicity, "SHARD_BYTES", shard)
        monkeypatch.setattr(toxicity, "PIECE_BYTES", piece)
        got = toxicity.shards_of(docs, marks).collect()
        assert sum(x.n for x in got) == wanted and 2 <= len(got) <= 4 and len({x.shard for x in got}) == len(got)
        assert sum(len(toxicity._unpacked(bytes(x.blob))[0]) for x in got) == wanted
        held = [x for x in toxicity.classify(docs, marks).collect() if x.held_out and x.doc_id < 3000]
        assert sum(x.predicted == int(x.doc_id % 4 == 0) for x in held) >= 0.95 * len(held)
        models.append(toxicity.fit(docs, marks))
    again = toxicity.fit(docs.repartition(3), marks)
    assert (again.table == models[1].table).all() and (again.weights == models[1].weights).all()


def test_thresholds_are_of_all_rows_kept_from_training(spark):
    """Against plain loops over every such row, with labels that are often wrong and more rows of a class than were once sampled."""
    r = random.Random(9)
    rows, labels = [], []
    for k in range(9000):
        bad = r.random() < 0.3
        rows.append((k, " ".join(r.choice("abcdefgh") * 3 for _ in range(5)) + (" vile" if bad != (r.random() < 0.15) else ""), ("en", "de", None)[k % 3] if k % 100 else "rare"))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert set(model.thresholds) == {"en", "de", ""}
    scores = {x.doc_id: x.score_of_text for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [k for k in range(9000) if zlib.crc32(str(k).encode()) % 5 and zlib.crc32(b"thresholds %d" % k) % 5 == 0]
    for lang, cut in [*model.thresholds.items(), (..., model.threshold)]:
        own = [(scores[k], labels[k][1]) for k in held if lang is ... or (rows[k][2] or "") == lang]
        f1 = lambda c: 2 * sum(y for s, y in own if s >= c) / (sum(s >= c for s, _ in own) + sum(y for _, y in own))
        tried = [f1(c) for c in sorted({s for s, _ in own}) if toxicity.THRESHOLDS[0] <= c <= toxicity.THRESHOLDS[1]] + [f1(c) for c in toxicity.THRESHOLDS]
        assert f1(cut) >= max(tried) - 1e-3
    cells = [np.array(x) for x in ([5, 3, 4, 2], [5, 2, 1, 0], [0.9, 0.6, 0.4, 0.1], [0.95, 0.7, 0.5, 0.2])]
    assert abs(toxicity.best_threshold(*cells) - 0.55) < 1e-12  # F1 14/16 there, 10/13 and 16/20 beside it
