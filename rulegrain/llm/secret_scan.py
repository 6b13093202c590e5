"""Secret scans by a recursive decoding worklist.

Every text is scanned as it stands; then each encoded stretch in it (percent escapes, Unicode escapes,
base64, compressed bytes in any of these) opens a layer, which is scanned and searched for layers in turn,
until nothing new appears. Escapes of all kinds in a text are decoded in one layer. A layer whose text was
opened before from the same stretch, by whatever way, isn't opened again: that ends cycles too. Each layer
knows which of its parent's characters every character came from, so spans are told in the outer text.

Layers are opened depth first, and decompressed bytes are read as streams: in windows, and what is encoded
beyond a window's end is read on from the stream. So memory holds a window for each layer of a nest.
A compressed form anywhere in bytes is read to its own end, while the bytes around it pass; they go on behind
it. So the bytes of a blob are read once for each nest that they are in, however many forms are in them.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

KINDS = ("assign", "access", "hex")
# The patterns that the operator's contract states.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 and more, as runs are longest
LEAST = {"assign": 8, "access": 16}
WORDS = ("passw", "secret", "token", "apikey", "api_key")

ESCAPE = re.compile(
    r"(?:%[0-9A-Fa-f]{2})+|%u[0-9A-Fa-f]{4}|(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
)
ESCAPED_BYTES = re.compile(ESCAPE.pattern.encode())
#: One escape of a run.
UNIT = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|.+", re.DOTALL)
#: What begins an escape, and an escape's longest form: one that gives a beginning again, as in %2525252541, is decoded on at once.
BEGINNINGS, LONGEST = "%\\&", 11
#: A run of the alphabet, and what goes on with it on the lines below, indented or not; padding ends the last.
RUN, LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}+"), re.compile(r"[A-Za-z0-9+/_-]+")
GOES_ON = re.compile(r"(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
#: A shorter run at the end of the line above.
ABOVE = re.compile(r"([A-Za-z0-9+/_-]+)[ \t]*\r?\n[ \t]*\Z")
LINE_END = re.compile(rb"[ \t]*\r?\n[ \t]*")
#: A run has this many characters at least.
LEAST_RUN = 16
#: How far above a run's first line the end of a shorter one is looked for: that one, and blanks around the line's end.
NEAR = 64
OTHER = re.compile(rb"[^A-Za-z0-9+/]")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{16}")
#: Beginnings of compressed forms, and ASCII as UTF-16, anywhere in bytes.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
WIDE = re.compile(rb"(?:[\t\n\r -~]\0){8,}")
#: Decompressed text is scanned in windows of this many bytes, which overlap.
WINDOW, OVERLAP = 2 << 20, 1 << 16
#: Bytes that show a compressed form, that a decompressor is fed at once, and that it gives at once.
HEAD, FED, PIECE = 10, 4096, 1 << 20
#: Bytes of a form that are held in case it breaks off; longer ones are read again from their stream.
KEPT = 4 << 20
#: From this depth on, a nest's layers are compared with those around them, as some unpack to themselves.
DEEP = 8


Source = Callable[[], Iterator[bytes]]


@dataclass
class Layer:
    """text, and for runs of its characters (from at[i]) the parent's stretch (start[i], end[i]); a run of the same length is verbatim.

    A text that goes on beyond its end has the stream that it is cut from: it is size bytes of it, from begin.
    """

    text: str
    parent: Layer | None = None
    source: Source | None = None
    begin: int = 0
    size: int = 0
    at: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    changed: list[bool] = field(default_factory=list)

    def add(self, at: int, start: int, end: int, changed: bool) -> None:
        self.at.append(at)
        self.start.append(start)
        self.end.append(end)
        self.changed.append(changed)

    def up(self, start: int, end: int) -> tuple[int, int, bool]:
        """The parent's stretch under start:end, and whether any of it was decoded."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.start[i] if self.changed[i] else self.start[i] + start - self.at[i]
        last = self.end[j] if self.changed[j] else self.start[j] + end - self.at[j]
        return first, last, i != j or self.changed[i] or any(self.changed[i : j + 1])

    def root(self, start: int, end: int) -> tuple[int, int, bool]:
        layer, decoded = self, False
        while layer.parent is not None:
            start, end, d = layer.up(start, end)
            decoded |= d
            layer = layer.parent
        return start, end, decoded


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Base matches of a text: kind, start, end."""
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _opener(head: bytes):
    """A decompressor for what begins with head."""
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor() if head[:1] == b"\xfd" else zlib.decompressobj(47)


def _made(opened, data: bytes) -> Iterator[bytes]:
    """What a decompressor makes of a small piece of data; at most PIECE at once where its library can be told."""
    if isinstance(opened, bz2.BZ2Decompressor | lzma.LZMADecompressor):
        yield opened.decompress(data, PIECE)
        while not opened.eof and not opened.needs_input:
            yield opened.decompress(b"", PIECE)
    elif isinstance(opened, type(zlib.decompressobj())):
        full = True
        while not opened.eof and (data or full):
            made = opened.decompress(data, PIECE)
            data, full = opened.unconsumed_tail, len(made) == PIECE
            yield made
    else:
        yield opened.decompress(data)


def _hopeless(head: bytes) -> bool:
    """Whether a form's first bytes are an error before they give anything."""
    try:
        any(_made(_opener(head), head))
    except Exception:  # noqa: BLE001  each library has errors of its own
        return True
    return False


class Reader:
    """A stream whose bytes can be given back; at is the place of the next one."""

    def __init__(self, stream: Iterator[bytes], at: int = 0):
        self.stream, self.at = stream, at
        self.parts: list[tuple[bytes, int]] = []

    def take(self, most: int) -> bytes:
        """Some bytes; none at the end."""
        while not self.parts:
            if (piece := next(self.stream, None)) is None:
                return b""
            if piece:
                self.parts.append((piece, 0))
        piece, begin = self.parts.pop()
        out = piece[begin : begin + most]
        if begin + most < len(piece):
            self.parts.append((piece, begin + most))
        self.at += len(out)
        return out

    def give(self, data: bytes) -> None:
        if data:
            self.parts.append((bytes(data), 0))
            self.at -= len(data)


class Member:
    """A compressed form where a reader stands, and those right behind it, which are one text with it.

    When content() has ended, the reader is behind all forms that ended well. A form that broke off counts with
    what it gave; broken tells that the reader is at its beginning again, or should be, where again is set.
    """

    def __init__(self, reader: Reader):
        self.reader, self.broken, self.again = reader, False, None
        self.log, self.whole = bytearray(), True
        self.digest = hashlib.sha256()

    def _more(self) -> bytes:
        data = b""
        while len(data) < FED and (piece := self.reader.take(FED - len(data))):
            data += piece
        self.digest.update(data)
        self.whole &= len(self.log) + len(data) <= KEPT
        self.log = self.log + data if self.whole else bytearray()
        return data

    def _back(self, begin: int, skip: int = 0) -> None:
        if self.whole:
            self.reader.give(self.log[skip:])
        else:
            self.again = begin + skip

    def content(self) -> Iterator[bytes]:
        first = True
        while True:
            begin = self.reader.at
            self.log, self.whole, self.digest = bytearray(), True, hashlib.sha256()
            data = self._more()
            if not first:
                while data and not data.strip(b"\0") and (more := self._more()):
                    data = more
                data = data.lstrip(b"\0")
            padding = len(self.log) - len(data) if self.whole else 0
            if not PACKED.match(data):
                self._back(begin)
                return
            opened, given = _opener(data), False
            try:
                while data and not opened.eof:
                    for made in _made(opened, data):
                        if made:
                            given = True
                            yield made
                    if not opened.eof:
                        data = self._more()
                ended = opened.eof
            except Exception:  # noqa: BLE001  each library has errors of its own; broken data ends here
                ended = False
            if not ended:
                self.broken = given
                self._back(begin, padding if given else 0)
                return
            self.reader.give(opened.unused_data)
            first = False


@dataclass
class Child:
    """A compressed form at a place of a stream: the stream of its content, and its end, if it ended well, once the walk has gone on."""

    at: int
    source: Source
    content: Iterator[bytes]
    end: int | None = None


@dataclass
class Text:
    """A window of a stream's bytes outside of compressed forms; last: it doesn't go on."""

    text: str
    source: Source
    begin: int
    size: int
    last: bool


def _content(source: Source, at: int) -> Iterator[bytes]:
    return Member(Reader(_from(source, at), at)).content()


def walk(source: Source, stream: Iterator[bytes], broken: set[bytes]) -> Iterator[Text | Child]:
    """Texts and compressed forms of a stream, which may be read in between or not.

    broken: digests of forms that broke off, as far as they went; what is inside of such a form may be in its text
    and in its bytes, and is opened once.
    """
    reader = Reader(stream)
    held, base, searched, ended = bytearray(), 0, 0, False
    while not ended:
        data = reader.take(PIECE)
        ended = not data
        held += data
        while found := PACKED.search(held, searched):
            i = found.start()
            if _hopeless(bytes(held[i : i + FED])):
                searched = i + 1
                continue
            at, behind, ended = base + i, len(held) - i, False
            reader.give(held[i:])
            del held[i:]
            if broken:
                tried = Member(reader)
                for _ in tried.content():
                    pass
                stands = reader.at if tried.again is None else tried.again
                known = tried.broken and stands == at and tried.digest.digest() in broken
                if reader.at != at or tried.again is not None:
                    reader = Reader(_from(source, at), at)
                if known:
                    held += reader.take(behind)
                    searched = i + 1
                    continue
            member = Member(reader)
            content = member.content()
            if (first := next(content, None)) is not None:
                child = Child(at, partial(_content, source, at), chain([first], content))
                yield child
                for _ in content:
                    pass
                child.end = None if member.broken else reader.at
            if member.broken:
                broken.add(member.digest.digest())
            if member.again is not None:
                reader = Reader(_from(source, member.again), member.again)
            if reader.at > at:
                if held:
                    yield Text(held.decode("utf-8", "replace"), source, base, len(held), True)
                held, base, searched = bytearray(), reader.at, 0
            if member.broken or reader.at == at:
                searched = len(held) + 1
                held += reader.take(max(behind, 1))
        searched = max(searched, len(held) - HEAD + 1)
        while len(held) > WINDOW:
            yield Text(held[:WINDOW].decode("utf-8", "replace"), source, base, WINDOW, False)
            step = WINDOW - OVERLAP
            del held[:step]
            base, searched = base + step, max(0, searched - step)
    if held:
        yield Text(held.decode("utf-8", "replace"), source, base, len(held), True)


def _digest(stream: Iterator[bytes]) -> bytes:
    mark = hashlib.sha256()
    for piece in stream:
        mark.update(piece)
    return mark.digest()


def _pieces(source: Source) -> Iterator[Text]:
    """Texts in a stream and in all compressed forms of it, depth first."""
    broken: set[bytes] = set()
    todo, marks = [walk(source, source(), broken)], [b""]
    while todo:
        if (piece := next(todo[-1], None)) is None:
            todo.pop()
            marks.pop()
        elif isinstance(piece, Text):
            yield piece
        else:
            mark = _digest(piece.source()) if len(todo) >= DEEP else b""
            if not mark or mark not in marks:
                todo.append(walk(piece.source, piece.content, broken))
                marks.append(mark)


def _forms(source: Source, until: int) -> Iterator[Child]:
    """The outermost compressed forms of a stream that begin before until, with their ends."""
    last = None
    for piece in walk(source, source(), set()):
        if last is not None:
            yield last
            last = None
        if isinstance(piece, Child):
            if piece.at >= until:
                return
            last = piece
    if last is not None:
        yield last


def _from(source: Source, begin: int) -> Iterator[bytes]:
    """A stream's bytes from begin on."""
    for piece in source():
        if begin < len(piece):
            yield piece[begin:] if begin else piece
        begin = max(0, begin - len(piece))


def _texts(data: bytes) -> Iterator[str]:
    """Texts in bytes of a compressed form, window by window."""
    return (piece.text for piece in _pieces(lambda: iter([data])))


def _blocks(parent: Layer, source: Source, until: int, places: Callable[[int, int | None], tuple[int, int]]) -> Iterator[tuple[Layer, int]]:
    """Layers of the compressed forms in bytes that begin before until, and where these begin; all their characters come from the form's whole stretch."""
    for form in _forms(source, until):
        start, end = places(form.at, form.end)
        for piece in _pieces(form.source):
            if piece.text:
                layer = Layer(piece.text, parent, None if piece.last else piece.source, piece.begin, piece.size)
                layer.add(0, start, end, True)
                yield layer, form.at


def _rest(parent: Layer, start: int, decoded: Callable[[Source, int], Iterator[bytes]], data: bytes) -> Source:
    """The bytes that an encoded run up to the end of parent's text gives, read on from its stream; data is what its text gives."""
    if parent.source is None:
        return lambda: iter([data])
    source = partial(decoded, parent.source, parent.begin + parent.size - (len(parent.text) - start))
    return source if Reader(source()).take(HEAD)[:HEAD] == data[:HEAD] else lambda: iter([data])


def _unescaped(source: Source, begin: int) -> Iterator[bytes]:
    """A stream from begin with its escapes decoded."""
    rest = b""
    for piece in _from(source, begin):
        rest += piece
        cut = max(rest.rfind(c.encode(), len(rest) - LONGEST) for c in BEGINNINGS)
        cut = len(rest) if cut < 0 else cut
        yield ESCAPED_BYTES.sub(_escaped_bytes, rest[:cut])
        rest = rest[cut:]
    yield ESCAPED_BYTES.sub(_escaped_bytes, rest)


def _escaped_bytes(m: re.Match) -> bytes:
    run = m[0].decode()
    return _raw(run) or "".join(c for c, _ in _escaped(run)).encode()


def _raw(run: str) -> bytes:
    """The bytes of a run of escapes of bytes; none of another run."""
    return bytes.fromhex(run.replace("%", "").replace("\\x", "")) if run[0] == "%" and run[1] != "u" or run[:2] == "\\x" else b""


def _unbased(source: Source, begin: int, skip: int) -> Iterator[bytes]:
    """The bytes of a stream's base64 run from begin, over its lines, without its first skip characters."""
    held, rest = b"", b""
    for piece in chain(_from(source, begin), [b"."]):  # what is no line's end ends the run
        rest += piece
        cut = len(rest.rstrip(b" \t\r\n"))
        now, rest = LINE_END.sub(b"", rest[:cut]), rest[cut:]
        held += now.replace(b"-", b"+").replace(b"_", b"/")
        drop, skip = min(skip, len(held)), skip - min(skip, len(held))
        end = OTHER.search(held, drop)
        held = held[drop : end.start() if end else len(held)]
        if end:
            break
        whole = len(held) // 4 * 4
        yield base64.b64decode(held[:whole])
        held = held[whole:]
    held = held[: len(held) - (len(held) % 4 == 1)]
    yield base64.b64decode(held + b"=" * (-len(held) % 4))


def _chars(data: bytes) -> Iterator[tuple[str, int]]:
    """Characters of bytes as UTF-8, with their bytes' number; a byte that isn't UTF-8 stands for its code point."""
    i = 0
    while i < len(data):
        b = data[i]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
        try:
            c = data[i : i + n].decode()
        except UnicodeDecodeError:
            c, n = chr(b), 1
        yield c[0], n
        i += n


def _point(n: int) -> str:
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def _escaped(run: str) -> Iterator[tuple[str, int]]:
    """Characters of one match of PERCENT or ESCAPE, with the source characters each takes."""
    if run[0] == "%" and run[1] != "u":
        yield from ((c, 3 * n) for c, n in _chars(bytes.fromhex(run.replace("%", ""))))
    elif run[:2] == "\\x":
        yield from ((c, 4 * n) for c, n in _chars(bytes.fromhex(run.replace("\\x", ""))))
    elif run[:2] in ("%u", "\\u") and run[2] != "{":
        units = [int(x, 16) for x in run.replace("%u", "\\u").split("\\u")[1:]]
        i = 0
        while i < len(units):
            if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                yield chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00), 12
                i += 2
            else:
                yield _point(units[i]), 6
                i += 1
    elif run[:2] == "&#":
        yield _point(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])), len(run)
    else:
        yield _point(int(run[2:].strip("{}"), 16)), len(run)


def _beginning(run: str) -> str:
    """The one character that an escape stands for, if it begins an escape; else nothing."""
    c = next(_escaped(run))[0] if run else ""
    return c if c in BEGINNINGS else ""


def _in_place(parent: Layer) -> Iterator[Layer]:
    """The text with all its escapes decoded; and layers of compressed bytes among them.

    An escape that gives the beginning of another one, which plain characters after it complete, is decoded
    on until it doesn't: a chain of them is one layer, however long. No pattern has their characters.
    """
    text, layer, out, size, last = parent.text, Layer("", parent), [], 0, 0
    while m := ESCAPE.search(text, last):
        run, at, end = m[0], m.start(), m.end()
        if PACKED.search(data := _raw(run)):
            unit, begin = 3 if run[0] == "%" else 4, at
            whole = _rest(parent, at, _unescaped, data) if end == len(text) else partial(iter, [data])
            places = lambda a, b: (begin + unit * a, min(end, begin + unit * b) if b else end)  # noqa: B023, E731
            yield from (layer for layer, _ in _blocks(parent, whole, len(data), places))
        if at > last:
            layer.add(size, last, at, False)
            out.append(text[last:at])
            size += at - last
        for c, n in _escaped(run):
            if c in BEGINNINGS and at + n == end:
                while (more := ESCAPE.match(c + text[end : end + LONGEST])) and (new := _beginning(unit := UNIT.match(more[0])[0])):
                    c, n, end = new, n + len(unit) - 1, end + len(unit) - 1
            layer.add(size, at, at + n, True)
            out.append(c)
            size, at = size + 1, at + n
        last = end
    if out:
        if last < len(text):
            layer.add(size, last, len(text), False)
            out.append(text[last:])
        layer.text = "".join(out)
        if parent.source is not None:
            layer.source, layer.size = partial(_unescaped, parent.source, parent.begin), len(layer.text.encode("utf-8", "replace"))
        yield layer


class Encoded(Layer):
    """A layer whose character i is width bytes of a base64 run, the first of them at byte; places are the parent's places of the run's characters."""

    def __init__(self, text: str, parent: Layer, places: Sequence[int], byte: int, width: int, source: Source | None = None):
        super().__init__(text, parent, source, 0, len(text))
        self.places, self.byte, self.width = places, byte, width

    def up(self, start: int, end: int) -> tuple[int, int, bool]:
        first, last = self.byte + start * self.width, self.byte + end * self.width
        return self.places[8 * first // 6], self.places[(8 * last - 1) // 6] + 1, True


def promising(text: str) -> bool:
    """Whether a text has a match, or something encoded."""
    return next(matches(text), None) is not None or any(x.search(text) for x in (ESCAPE, LONG_RUN))


def runs(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Base64 runs of a text: start, end (with padding), and the stretches of their lines.

    Lines of one width that stand below each other are one run, whose first line may have more or less and whose
    last one has no more; its first and last lines are also runs of their own, as they may be prose.
    """
    last = 0
    while m := RUN.search(text, last):
        begin, end = m.start(), GOES_ON.match(text, m.end()).end()
        indent = len(text[last:begin]) - len(text[last:begin].rstrip(" \t")) if begin and text[begin - 1] in " \t" else 0
        if begin - indent > last and text[begin - indent - 1] == "\n" and (above := ABOVE.search(text, max(last, begin - indent - NEAR), begin)):
            begin = above.start(1)
        lines = [x.span() for x in LINE.finditer(text, begin, end)]
        last = end
        wide = [b - a for a, b in lines]
        alone, i = set(range(len(lines))), 0
        while i + 1 < len(lines):
            j = i + 2
            while j < len(lines) and wide[j] == wide[i + 1]:
                j += 1
            j += j < len(lines) and wide[j] < wide[i + 1]
            if max(wide[i : i + 2]) < LEAST_RUN:
                i += 1
                continue
            yield lines[i][0], end if j == len(lines) else lines[j - 1][1], lines[i:j]
            alone -= set(range(i + 1, j - 1))
            i = j
        for k in sorted(alone):
            if wide[k] >= LEAST_RUN:
                yield lines[k][0], end if k == len(lines) - 1 else lines[k][1], [lines[k]]


def _base64(parent: Layer) -> Iterator[Layer]:
    """Layers of base64 runs. What stands next to a run may be of its alphabet and part of it, so it is decoded at all four alignments.

    Of the first alignment, all text is a layer. Of the others, and of bytes that aren't UTF-8, what is promising is.
    """
    text = parent.text
    for begin, stop, lines in runs(text):
        body = "".join(text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
        places = range(*lines[0]) if len(lines) == 1 else [i for a, b in lines for i in range(a, b)]
        for skip in range(min(4, len(body) - LEAST_RUN + 1)):
            n = len(body) - skip
            n -= n % 4 == 1  # one character is no byte
            data = base64.b64decode(body[skip : skip + n] + "=" * (-n % 4))
            here = places[skip:]
            goes_on = parent.source is not None and stop == len(text)
            stream = _rest(parent, begin, partial(_unbased, skip=skip), data) if goes_on else None
            covered = False
            if PACKED.search(data):

                def stretch(a: int, b: int | None) -> tuple[int, int]:
                    return here[8 * a // 6], stop if b is None or b >= len(data) else here[(8 * b - 1) // 6] + 1  # noqa: B023

                for layer, at in _blocks(parent, stream or partial(iter, [data]), len(data), stretch):
                    covered |= at == 0 and layer.end[0] == stop
                    if at == skip == 0 or promising(layer.text):
                        yield layer
            if covered:
                continue
            wide = skip == 0 and len(data) % 2 == 0 and data[1::2].count(0) * 10 >= len(data[1::2]) * 9
            code = "utf-16-le" if wide and _text(data, "utf-16-le") is not None else "utf-8"
            if code == "utf-8" and b"\0" in data:
                for w in WIDE.finditer(data):
                    if promising(inner := w[0].decode("utf-16-le")):
                        yield Encoded(inner, parent, here, w.start(), 2)
            inner = _text(data, code)
            shown = data.decode("latin-1") if inner is None else inner
            if (skip or inner is None) and not promising(shown):
                continue
            if code == "utf-8" and len(shown) == len(data):
                yield Encoded(shown, parent, here, 0, 1, stream)
                continue
            layer, byte = Layer(shown, parent, stream if code == "utf-8" else None, 0, len(data)), 0
            for i, c in enumerate(shown):
                k = len(c.encode(code))
                layer.add(i, here[8 * byte // 6], here[(8 * (byte + k) - 1) // 6] + 1, True)
                byte += k
            yield layer


def _text(data: bytes, code: str) -> str | None:
    try:
        return data.decode(code)
    except UnicodeDecodeError:
        return None


def layers(parent: Layer) -> Iterator[Layer]:
    """What is encoded in a layer, one step down."""
    text = parent.text
    if ("%" in text or "\\" in text or "&#" in text) and ESCAPE.search(text):
        yield from _in_place(parent)
    if LONG_RUN.search(text):
        yield from _base64(parent)


def _mark(layer: Layer) -> tuple[bytes, int, int]:
    """What tells whether a layer was opened before: its text, and the stretch that it came from."""
    begin, end, _ = layer.root(0, len(layer.text))
    return hashlib.sha256(layer.text.encode("utf-8", "replace")).digest(), begin, end


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, all spans (both sorted by start, kind, end), and the number of layers that were opened."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(matches(text or ""), key=order)
    found, opened = set(base), 0
    seen: set[tuple[bytes, int, int]] = set()
    todo = [layers(Layer(text or ""))]  # the way down to the layer that is scanned now
    while todo:
        if (layer := next(todo[-1], None)) is None:
            todo.pop()
            continue
        if not layer.text or (mark := _mark(layer)) in seen:
            continue
        seen.add(mark)
        opened += 1
        for kind, start, end in matches(layer.text):
            start, end, decoded = layer.root(start, end)
            if decoded:
                found.add((kind, start, end))
        todo.append(layers(layer))
    return base, sorted(found, key=order), opened


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with every stretch that spans cover replaced by mark."""
    out, last, open_end = [], 0, -1
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= open_end:
            out += [text[last:start], mark] if start >= last else []
        open_end = max(open_end, end)
        last = open_end
    return "".join([*out, text[last:]])


RESULT = "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string, n_layers: bigint, redacted: string>"
ARROW = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("redacted", pa.string())])


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(text: Column | str, with_redacted: bool = True) -> Column:
    """Arrow function: counts, spans and the redacted text of a text column (null text: empty, redacted null)."""

    @F.arrow_udf(RESULT)
    def run(batch: pa.Array) -> pa.Array:
        rows = []
        for t in batch.to_pylist():
            base, spans, opened = scan(t)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            new = None if t is None or not with_redacted else redact(t, spans) if spans else t
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), opened, new))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], fields=list(ARROW))

    return run(text)


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_layers for each row of docs.

    Nulls: a null text counts as empty, a null key is passed on. Repeated rows give equal results. Other
    columns are not read. An empty table gives an empty result. Texts are scanned whole; decompressed layers
    are read as streams, a window at a time, so memory doesn't grow with what they unpack to. spans holds the base spans and those of all
    layers, told once each, by start, kind and end in code points of the text.
    """
    ready(docs.sparkSession)
    done = docs.select(F.col(key), secrets(F.col(text), with_redacted=False).alias("_s"))
    return done.select(key, "_s.n_assign", "_s.n_access", "_s.n_hex", "_s.base_sha256", "_s.spans", "_s.n_layers")
