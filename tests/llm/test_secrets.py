"""Secrets in layers that stand at awkward places."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from prismframe.llm import secrets

TOKEN = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("before", ["", "x", "data/", "key_", "id-", "https://x.io/get/", "a/b_c-d/"])
@pytest.mark.parametrize("behind", ["", "/", "/raw", "_v2", "-old-1"])
def test_base64_glued_to_a_path_or_a_key(pack, before, behind):
    # Without padding, as in paths.
    body = base64.b64encode(pack(f"{TOKEN} of é".encode())).decode().rstrip("=")
    text = f"é before {before}{body}{behind} after"
    at = 9 + len(before)
    every = secrets.scan(text)[1]
    assert any(k == 0 and a < at + len(body) and b > at for a, b, k, _ in every)
    left = secrets.masked(text)
    assert left.startswith("é before ") and left.endswith(" after") and body not in left and not secrets.scan(left)[1]


def words(n):
    return " ".join(f"w{k * 7919 % 100003}" for k in range(n))


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_inflated_data_are_scanned_to_their_end(pack):
    # More than 8 MB and 32 times the text, with the secret last.
    big = pack((" " * 10_000_000 + "é" * 1_000_001 + TOKEN).encode())
    for data in (big, pack(words(2_000_000).encode() + TOKEN.encode())):
        text = f"before {base64.b64encode(data).decode()} after"
        _, every, _, unfinished = secrets.scan(text)
        assert not unfinished and any(k == 0 for _, _, k, _ in every)
    assert secrets.masked(f"before {base64.b64encode(big).decode()} after") == f"before {secrets.MASK} after"


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_later_members_and_later_blobs(pack):
    members = base64.b64encode(pack(b"nothing here, ") + pack(TOKEN.encode())).decode()
    assert any(k == 0 for _, _, k, _ in secrets.scan(members)[1])
    bomb = base64.b64encode(pack(b"a " * 6_000_000)).decode()
    _, every, _, unfinished = secrets.scan(f"{bomb} {base64.b64encode(pack(TOKEN.encode())).decode()}")
    assert not unfinished and any(k == 0 for _, _, k, _ in every)


@pytest.mark.parametrize("cut", [3 << 20, (2 << 20) - 30, (2 << 20) + 10, (4 << 20) - 70])
def test_nested_runs_over_the_border_of_a_piece(cut):
    inner = base64.b64encode(("x" * 300_000 + TOKEN).encode()).decode()
    text = base64.b64encode(zlib.compress((words(cut // 6)[:cut] + " " + inner + " " + words(10)).encode())).decode()
    assert any(k == 0 for _, _, k, _ in secrets.scan(text)[1])


def test_what_is_not_scanned_to_its_end_is_said_and_masked(monkeypatch):
    body = base64.b64encode(zlib.compress(words(20_000).encode())).decode()
    short = f"before {body[: len(body) // 2]} after"
    assert secrets.scan(short)[3] and secrets.masked(short) == f"before {secrets.MASK} after"
    assert not secrets.scan(body)[3]
    monkeypatch.setattr(secrets, "LAYER_CHARS", 50_000)
    assert secrets.scan(body)[3] and secrets.masked(f"before {body} after") == f"before {secrets.MASK} after"


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("width", [20, 64, 76])
@pytest.mark.parametrize("line", ["\n", "\r\n", "\\n", "\\r\\n", "\\\n", "\n    ", "\n> "])
def test_wrapped_base64(pack, width, line):
    body = base64.b64encode(pack(("secrets " + words(60) + " é " + TOKEN + " end").encode())).decode()
    body = line.join(body[k : k + width] for k in range(0, len(body), width))
    text = f"é before\n\n{body} after"
    _, every, _, unfinished = secrets.scan(text)
    assert not unfinished and any(k == 0 for _, _, k, _ in every) and all(10 <= a < b <= 10 + len(body) for a, b, _, _ in every)
    left = secrets.masked(text)
    assert left.startswith("é before\n\n") and left.endswith(" after") and not secrets.scan(left)[1]
    if pack is bytes:  # only the secret's own place
        a, b = min(a for a, _, k, _ in every if k == 0), max(b for _, b, k, _ in every if k == 0)
        assert text[a:b] in body and 4 * 40 // 3 < len(text[a:b].replace(line, "")) < 80
        assert left.count(secrets.MASK) == 1


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("escape", ["\\x{:02x}", "\\u{:04x}", "\\u00{:02X}", "&#{};", "\\u{{{:x}}}"])
def test_compressed_bytes_as_escapes(pack, escape):
    body = "".join(escape.format(b) for b in pack(TOKEN.encode()))
    text = f"before {body} after"
    _, every, _, unfinished = secrets.scan(text)
    assert not unfinished and any(k == 0 for _, _, k, _ in every)
    assert secrets.masked(text) == f"before {secrets.MASK} after"


@pytest.mark.parametrize("outer", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("inner", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_in_compressed(outer, inner):
    for data in (outer(inner(TOKEN.encode())), outer(outer(inner(TOKEN.encode()))), outer(inner(b"first ") + inner(TOKEN.encode())), outer(inner(words(300_000).encode() + TOKEN.encode()))):
        text = f"before {base64.b64encode(data).decode()} after"
        _, every, _, unfinished = secrets.scan(text)
        assert not unfinished and any(k == 0 for _, _, k, _ in every)
    cut = outer(inner(random.Random(1).randbytes(1_200_000))[:-60])
    assert secrets.scan(base64.b64encode(cut).decode())[3]


def test_text_that_looks_compressed_and_layers_without_end(monkeypatch):
    text = base64.b64encode(zlib.compress(b"x^ is no header: " + TOKEN.encode())).decode()
    assert any(k == 0 for _, _, k, _ in secrets.scan(text)[1]) and not secrets.scan(text)[3]
    data = TOKEN.encode()
    for _ in range(8):
        data = gzip.compress(data)
    text = base64.b64encode(data).decode()
    assert any(k == 0 for _, _, k, _ in secrets.scan(text)[1])
    monkeypatch.setattr(secrets, "DEEPEST", 4)
    assert secrets.scan(text)[3]


def test_pairs_of_escapes_are_one_character():
    for pair in ("\\ud83d\\ude00", "&#xd83d;&#xde00;"):
        layer = next(secrets.unwrap_escapes(secrets.Layer(f"é {pair}! \\u0041", None, None), secrets.Work()))
        assert layer.text == "é 😀! A" and layer.span(2, 3) == (2, 2 + len(pair))
    lone = "\\ud83d x \\ude00 \\u0041"
    assert next(secrets.unwrap_escapes(secrets.Layer(lone, None, None), secrets.Work())).text == "\\ud83d x \\ude00 A"
