"""Compressed forms among other bytes against a naive recursive decoder; base64 of any line width."""

import base64
import bz2
import gzip
import lzma
import random
import time
import zlib

import pytest
import zstandard

from rulegrain.llm import secret_scan as ss

SECRET = "password=hunter2hunter2"
PACKS = [gzip.compress, bz2.compress, lzma.compress, zlib.compress, zstandard.ZstdCompressor().compress]


def opened(data):
    """What one compressed form at the beginning gives, how many bytes it takes, and whether it ended."""
    d = zstandard.ZstdDecompressor().decompressobj() if data[:4] == b"\x28\xb5\x2f\xfd" else bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor() if data[:1] == b"\xfd" else zlib.decompressobj(47)
    try:
        made = d.decompress(data)
    except Exception:
        return b"", 0, False
    return made, len(data) - len(d.unused_data), d.eof


def naive(data):
    """All texts in bytes: whole layers, recursively, without windows or streams."""
    out, begin, i = [], 0, 0
    while m := ss.PACKED.search(data, i):
        at = end = m.start()
        content, broken = b"", False
        while True:
            rest = data[end:].lstrip(b"\0") if end > at else data[end:]
            if not ss.PACKED.match(rest):
                break
            made, used, ended = opened(rest)
            if not ended:
                content, broken = content + made, bool(made)
                end = len(data) - len(rest) if made else end
                break
            content, end = content + made, len(data) - len(rest) + used
        if end > at:
            out.append(data[begin:at])
            begin = end
        if content:
            out += naive(content)
        i = end + broken if end > at else at + 1
    out.append(data[begin:])
    return [t if isinstance(t, str) else t.decode("utf-8", "replace") for t in out if t]


def nest(rng, cuts, depth=0):
    """Texts and forms, in forms; either forms may follow each other, or the last one may be cut (else its text would go on in the next form's)."""
    parts = []
    for _ in range(rng.randint(1, 12 if depth < 2 else 3)):
        kind = rng.random()
        if kind < 0.5 and depth < 4:
            parts += [rng.choice(PACKS)(nest(rng, cuts, depth + 1)), b"\r\n" * cuts]
        elif kind < 0.6:
            parts.append(bytes(rng.randint(1, 5)))
        else:
            parts.append(rng.choice([b"\n", b"endstream\nstream\r\n", b"2x^2 + x^", SECRET.encode() + b" ", "é ü ".encode(), b"word " * rng.randint(1, 40)]))
    if cuts and rng.random() < 0.3:
        cut = zlib.compress(rng.randbytes(3000).hex().encode())
        parts.append(cut[: rng.randint(500, len(cut) - 1)])
    return b"".join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_nests_are_a_naive_decoders(seed, monkeypatch):
    data = nest(random.Random(seed), seed % 2)
    if seed % 3 == 0:  # small pieces, as long streams have
        monkeypatch.setattr(ss, "PIECE", 700)
    assert set(ss._texts(data)) == set(naive(data))
    told = {k for k, *_ in ss.scan(base64.b64encode(data).decode())[1]}
    assert ("assign" in told) == any(SECRET in t for t in naive(data))


def test_many_streams_take_linear_time():
    seconds = {}
    for k in (100, 400):
        streams = [zlib.compress(f"{i} password=hunter2hunter{i:04d} end".encode()) for i in range(k)]
        pdf = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\nstream\r\n" % i + x + b"\r\nendstream\n" for i, x in enumerate(streams))
        for data, n in ((b"\n".join(streams), k), (pdf, k), (gzip.compress(pdf), 1)):
            text = "data:application/pdf;base64," + base64.b64encode(data).decode()
            start = time.perf_counter()
            spans = ss.scan(text)[1]
            seconds[k] = max(seconds.get(k, 0), time.perf_counter() - start)
            assert len(spans) == n and {s[0] for s in spans} == {"assign"}
    assert seconds[400] < 3


def test_spans_are_of_the_own_stream():
    head, middle = b"%PDF\nstream\n" + zlib.compress(b"nothing here") + b"\nstream\n", zlib.compress(SECRET.encode())
    data = head + middle + b"\nendstream " + b"tail " * 30
    text = "see " + base64.b64encode(data).decode()
    ((kind, start, end),) = ss.scan(text)[1]
    assert kind == "assign" and start == 4 + 8 * len(head) // 6 and end == 4 + (8 * (len(head) + len(middle)) - 1) // 6 + 1
    clean = ss.redact(text, [(kind, start, end)])
    assert not ss.scan(clean)[1]


def test_forms_that_break_off():
    whole = zlib.compress(random.Random(1).randbytes(4000).hex().encode() + SECRET.encode() + random.Random(2).randbytes(4000).hex().encode())
    inner = gzip.compress(SECRET.encode())
    for data in (whole[: len(whole) * 3 // 4], whole[: len(whole) * 3 // 4] + b"\xff" * 50 + inner, b"x\x9c\xff\xff" + inner, gzip.compress(whole[: len(whole) * 3 // 4])):
        assert any(SECRET in t for t in ss._texts(data))
    # stored blocks hold the next form, and all break off
    nested = b"".join(b"x\x01\x00" + n.to_bytes(2, "little") + (n ^ 0xFFFF).to_bytes(2, "little") for n in range(65535, 65535 - 7 * 24, -7)) + SECRET.encode()
    start = time.perf_counter()
    assert ss.scan(base64.b64encode(nested).decode())[1]
    assert time.perf_counter() - start < 5


def test_broken_forms_beyond_what_is_held(monkeypatch):
    monkeypatch.setattr(ss, "KEPT", 5000)
    cut = zlib.compress(random.Random(3).randbytes(40_000))[:-9000]
    data = b"one " + cut + b"\xff" * 40 + gzip.compress(b"two " + cut) + b" three " + gzip.compress(SECRET.encode())
    assert any(SECRET in t for t in ss._texts(data))


def test_what_unpacks_to_itself_ends():
    """A nest around a layer that is there again and again."""
    data = SECRET.encode()
    for _ in range(40):
        data = gzip.compress(data, mtime=0)
    assert any(SECRET in t for t in ss._texts(data))


@pytest.mark.parametrize("width", [16, 37, 48, 57, 60, 64, 76, 80, 100])
@pytest.mark.parametrize("indent", ["", "  ", "\t\t"])
def test_lines_of_any_width(width, indent):
    for data in (("a " * 60 + SECRET + " b c " * 30).encode(), gzip.compress((random.Random(1).randbytes(300).hex() + SECRET).encode())):
        raw = base64.b64encode(data).decode()
        for first in (0, 9):
            lines = [raw[:first]] * (first > 0) + [raw[i : i + width] for i in range(first, len(raw), width)]
            for end in ("\n", "\r\n", " \n"):
                text = "key: |" + end + "".join(indent + line + end for line in lines) + "prose follows here"
                spans = ss.scan(text)[1]
                assert any(k == "assign" for k, *_ in spans)
                assert not any(k == "assign" for k, *_ in ss.scan(ss.redact(text, spans))[1])


def test_wrapped_run_over_a_windows_end():
    inner = base64.b64encode(random.Random(4).randbytes(200_000) + f" {SECRET} ".encode()).decode()
    wrapped = "".join("  " + inner[i : i + 57] + "\r\n" for i in range(0, len(inner), 57)).encode()
    filled = b"x y\n" * ((ss.WINDOW - len(wrapped) // 2) // 4)
    text = base64.b64encode(gzip.compress(filled + wrapped + b"more")).decode()
    assert ss.scan(f"see {text}")[1] == [("assign", 4, 4 + len(text))]
