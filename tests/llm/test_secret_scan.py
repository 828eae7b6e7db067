import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import secret_scan as s

SECRET = "password=Hunter2xyz99"


def spans(text):
    return {(s.KINDS[k], text[a:b]) for a, k, b in s.scan(text)[1]}


def brute(text):
    """The contract, read plainly."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "API_KEY", "apikey", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123abcdef", "zz", " ", "\n", "é", "a" * 14, "%41", "ſecret"]), max_size=14))
def test_base_spans_are_the_contract(parts):
    text = "".join(parts)
    base, every, _ = s.scan(text)
    assert base == brute(text)
    assert set(base) <= set(every)


def test_encoded_secrets_map_to_their_run():
    for run in (
        "/files/" + base64.b64encode(f"say {SECRET} now!".encode()).decode() + "/x",
        base64.b64encode(f"say {SECRET} now".encode()).decode(),
        base64.b64encode(gzip.compress(f"say {SECRET} now".encode())).decode(),
        base64.b64encode(base64.b64encode(zlib.compress(f"say {SECRET} now".encode()))).decode(),
    ):
        text = f"αβ before {run} after"
        found = [text[a:b] for a, k, b in s.scan(text)[1] if k == 0]
        assert found and all(f in run for f in found)


def test_percent_and_unicode_map_to_characters():
    quoted = "".join(f"%{b:02X}" for b in SECRET.encode())
    assert ("assign", quoted) in spans(f"x=1&y {quoted} z")
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert ("assign", escaped) in spans(f"say {escaped} now")
    mixed = urllib.parse.quote(escaped)
    assert any(k == "assign" for k, _ in spans(mixed))


def test_percent_encoded_in_part_after_blanks():
    assert ("assign", 'password": "%48unter2xyz99') in spans('{"password": "%48unter2xyz99"}')
    assert ("assign", "secret = abc%64ef123") in spans("say secret = abc%64ef123 now")
    assert ("assign", "secret%20=%20abcdef123") in spans("say secret%20=%20abcdef123 now")


def test_layers_that_are_not_plain_text():
    assert ("assign", "token=%61bcdef123") in spans("https://x/?n=Jos%E9&token=%61bcdef123")
    for data in (
        f"say {SECRET} now".encode("utf-16"),
        f"say é {SECRET} α".encode("utf-16-be"),
        b"x" + f"say {SECRET}".encode("utf-16-le"),
        bytes(range(256)) + SECRET.encode() + bytes(range(255, 127, -1)),
        gzip.compress(bytes(200) + b"\xff\xfe" + SECRET.encode() + bytes(200)),
    ):
        run = base64.b64encode(data).decode()
        found = [run[a:b] for a, k, b in s.scan(run)[1] if k == 0]
        assert len(found) == 1
        assert data[:2] == b"\x1f\x8b" or len(found[0]) <= 2.7 * len(SECRET) + 8


def test_one_character_for_each_odd_byte():
    data = "é".encode() + b"\xe9\xff" + "😀z".encode() + b"\xe2\x82"
    at = s.np.arange(len(data))
    text, low, high = s._characters(data, at, at + 1)
    assert text == "é\ufffd\ufffd😀z\ufffd\ufffd"
    assert low.tolist() == [0, 2, 3, 4, 8, 9, 10] and high.tolist() == [2, 3, 4, 8, 9, 10, 11]


NOISE = "".join(random.Random(3).choices("ghijklmnopq ", k=3000)).encode()
PACK = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress}


def wrapped(data, width, end="\n"):
    digits = base64.b64encode(data).decode()
    return end.join(digits[k : k + width] for k in range(0, len(digits), width))


@pytest.mark.parametrize("width, end", [(76, "\r\n"), (64, "\n"), (64, "\n  ")])
def test_base64_in_lines(width, end):
    for shift in range(0, 60, 7):
        run = wrapped(b"x" * shift + "é ".encode() * 9 + SECRET.encode() + b" so" * 40, width, end)
        for text in (f"-----BEGIN KEY-----\n{run}\n-----END KEY-----", f"a file:\n\n{run}\n\nRegards"):
            found = [text[a:b] for a, k, b in s.scan(text)[1] if k == 0]
            assert any(SECRET.encode() in base64.b64decode(re.sub(r"\s", "", f) + "===") and f in run for f in found), text


@pytest.mark.parametrize("name", PACK)
def test_streams_are_read_to_their_ends(name):
    pack, data = PACK[name], NOISE + SECRET.encode()
    for run in (wrapped(pack(data), 76), base64.b64encode(pack(NOISE) + pack(data)).decode(), wrapped(pack(data), 64) + "\nRegards"):
        _, every, unopened = s.scan(run)
        assert [k for _, k, _ in every if k == 0] and not unopened
    cut = base64.b64encode(pack(data)[:-40]).decode()
    assert s.scan(cut)[2] == 1
    assert s.scan(wrapped(pack(data)[:-40], 76))[2] == 1


def test_what_can_be_read_of_a_cut_stream_is_scanned():
    packed = gzip.compress(SECRET.encode() + b" " + NOISE * 9)
    _, every, unopened = s.scan(base64.b64encode(packed[: len(packed) // 2]).decode())
    assert any(k == 0 for _, k, _ in every) and unopened == 1


def test_cycles_end():
    assert s.scan("%2525252525" * 50 + "%41" * 9)[2] == 0
    assert s.scan("\\u005cu005c" * 40)[2] == 0


def test_swelling_streams_are_reported(monkeypatch):
    monkeypatch.setattr(s, "MAX_LAYER_BYTES", 1000)
    assert s.scan(base64.b64encode(gzip.compress(b"a" * 5000)).decode())[2] == 1


def test_swelling_streams_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(s, "MAX_LAYER_BYTES", 1000)
    inner = base64.b64encode(SECRET.encode())
    for pack in (gzip.compress, zstandard.compress, bz2.compress):
        for n in (0, 970, 990, 1000, 1740, 4980):
            for secret in (SECRET.encode(), inner):
                run = base64.b64encode(pack(b" " * n + secret + b" " * 3000)).decode()
                _, every, unopened = s.scan(f"a {run} b")
                assert every == [(2, 0, 2 + len(run.rstrip("=")))] or every == [(2, 0, 2 + len(run))]
                assert unopened == 1


def test_cut_streams_inside_a_whole_one_count():
    cut = base64.b64encode(gzip.compress(NOISE)[:-40])
    assert s.scan(base64.b64encode(gzip.compress(b"a " + cut)).decode())[2] == 1


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, SECRET, "x"), (3, SECRET, "x"), (None, "no", "x")], "doc_id long, text string, spans string")
    rows = s.secrets(docs).collect()
    assert sorted((str(r.doc_id), len(r.base)) for r in rows) == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", 0)]
    assert s.secrets(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(3, f"é {SECRET}"), (4, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in s.op1_secret_scan(spark, str(tmp_path)).collect()}
    assert rows[3].spans == "assign:2:23" and rows[3].base_sha256 == hashlib.sha256(b"assign:2:23").hexdigest() and rows[3].n_assign == 1
    assert rows[4].spans == "" and rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def _sixty_four(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "wrap",
    [
        lambda x: _sixty_four(gzip.compress(gzip.compress(x))),
        lambda x: _sixty_four(zlib.compress(zlib.compress(x))),
        lambda x: _sixty_four(gzip.compress(zlib.compress(bz2.compress(x)))),
        lambda x: _sixty_four(lzma.compress(lzma.compress(x) + b"more")),
        lambda x: _sixty_four(gzip.compress(b"first") + gzip.compress(x)),
        lambda x: _sixty_four(b"head " + gzip.compress(x)),
        lambda x: _sixty_four(_sixty_four(gzip.compress(gzip.compress(x))).encode()),
        lambda x: _sixty_four(gzip.compress(_sixty_four(gzip.compress(x)).encode())),
        lambda x: "".join(f"%{b:02x}" for b in gzip.compress(zlib.compress(x))),
        lambda x: "".join(f"\\x{b:02X}" for b in bz2.compress(x)),
        lambda x: "".join(f"\\u{b:04x}" for b in gzip.compress(x)),
    ],
)
def test_layers_of_bytes(wrap):
    run = wrap(b"password = hunter2hunter2 " + bytes(range(97, 122)) * 9)
    base, every, unopened = s.scan(f"see: {run} .")
    assert base == [] and unopened == 0
    assert (5, 0, 5 + len(run)) in every or any(5 <= a < b <= 5 + len(run) and k == 0 for a, k, b in every)


def test_streams_that_hold_themselves_end():
    data = gzip.compress(b"token=abcdef123456")
    for _ in range(30):
        data = gzip.compress(data)
    assert any(k == 0 for _, k, _ in s.scan(_sixty_four(data))[1])


def test_long_texts():
    text = "word " * 300_000 + "secret=abcdef999 " + "%7a" * 50_000 + " end"
    base, every, _ = s.scan(text)
    assert base == [(1_500_000, 0, 1_500_016)] == every
