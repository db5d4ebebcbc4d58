r"""Secret scans through nested encodings.

Each text starts a worklist of layers. A layer is scanned, then unwrapped: URL and Unicode escapes
(percent, backslash, character references) are undone in place; base64 runs become layers of
their own at each of the four alignments, and so does what gzip or zlib members in them hold, and the members in those. In
such layers every byte that no pattern has is a line end, so that a stray byte costs nothing. New layers join the worklist until
none is left. Every layer carries a map from its characters to the root's, so that whatever is
found is reported as a span of code points in the root text. What comes out of a packed member has one span, so it needs no
map, and is inflated, decoded and searched in steps: memory does not grow with it but for stretches without a line end. A layer is entered once for each
content and map: the same content at another place of the root is a layer of its own.

Escapes that make up new escapes (``%252541``, ``&amp;#37;41``) are undone in the same pass over the text, however
deeply they are nested: a text of n characters costs one layer, not n. Base64 is read on across line
breaks. Data of two-byte characters are read without their zero bytes, too.

Null text is empty: no findings. Repeated rows are scanned each. Long texts are scanned whole. Only the text
column is read, so other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import by_row

KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: What may start an escape.
STARTERS = "%\\&"
STARTER = re.compile(r"[%\\&]")
#: An escape at the end of a text, and the characters it may end with.
ESCAPE = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(quot|apos|amp|lt|gt|equals|colon);)\Z")
CLOSERS = frozenset("0123456789abcdefABCDEF;}")
#: Characters of the longest escape.
REACH = 12
#: No match is shorter than 12 characters, so no base64 of one is shorter than 16 signs.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 broken over lines of 20 signs or more; the last line may be shorter.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+(?:\r?\n|\\r\\n|\\n)[ \t]*+)+[A-Za-z0-9+/_-]+={0,2}")
BREAKS = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*|=+\Z")

#: Bytes that stand in no pattern and no encoding become line ends: no match crosses one.
PLAIN = bytes(k if k in b"+/_.=- \"':\\{}&#;%" or k < 128 and chr(k).isalnum() else 10 for k in range(256))
#: No match and no encoding of one is shorter than 12 characters.
STRETCH = re.compile(rb"[^\n]{12,}")
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")

#: Inflated data is read in steps of STEP bytes and scanned in pieces of about PIECE bytes, cut at line ends.
#: LONGEST bytes without any are cut all the same, and the pieces then overlap by half.
STEP, PIECE, LONGEST = 1 << 20, 1 << 22, 1 << 26
#: First bytes by which a member is told from those it lies in.
HEAD = 64


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; character k stands for root characters first[k] to last[k] (exclusive)."""

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        self.text, self.first, self.last = text, first, last

    @classmethod
    def flat(cls, text: str, a: int, b: int) -> "Layer":
        """A text all of which stands for root characters a to b."""
        return cls(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))

    def is_flat(self) -> bool:
        return self.first is not None and len(self.text) > 1 and not self.first.strides[0]

    def key(self) -> bytes:
        """Equal for layers of equal content and map."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for spots in (self.first, self.last):
            if spots is not None:
                digest.update(b"|" + (spots if spots.strides[0] else spots[:1]).tobytes())
        return digest.digest()

    def root(self, start: int, end: int) -> tuple[int, int]:
        if self.first is None:
            return start, end
        return int(self.first[start:end].min()), int(self.last[start:end].max())


def unescaped(m: re.Match) -> str | None:
    """The character of an escape; a sign that no pattern has for bytes beyond ASCII; None if it is no character."""
    if m[1]:
        return chr(int(m[1], 16)) if int(m[1], 16) < 128 else "\ufffd"
    if m[8]:
        return html.unescape(m[0])
    point = int(m[7]) if m[7] else int(m[2] or m[3] or m[4] or m[5] or m[6], 16)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None


def undone(layer: Layer) -> Layer | None:
    """The layer with its escapes undone to the last, in one pass; None if there are none.

    What has been read is a stack of characters; whenever its end is an escape, the character meant takes its
    place and is looked at in turn.
    """
    text, changed, k, parts, flat = layer.text, False, 0, [], layer.is_flat()
    chars, begins, ends, starters = [], [], [], []
    while True:
        if not starters or len(chars) - starters[-1] > REACH:  # nothing is open: on to what may start an escape
            m = STARTER.search(text, k)
            stop = m.start() if m else len(text)
            parts += [("".join(chars), begins, ends), (text[k:stop], *(((), ()) if flat else (np.arange(k, stop), np.arange(k + 1, stop + 1))))]
            chars, begins, ends, starters, k = [], [], [], [], stop
        if k == len(text):
            break
        c, a = text[k], k
        k += 1
        while True:
            if c in STARTERS:
                starters.append(len(chars))
            chars.append(c)
            begins.append(a)
            ends.append(k)
            if c not in CLOSERS or not starters or len(chars) - starters[-1] > REACH:
                break
            m = ESCAPE.match("".join(chars[starters[-1] :]))
            new = unescaped(m) if m else None
            if new is None:
                break
            spot = starters.pop()
            c, a, changed = new, begins[spot], True
            del chars[spot:], begins[spot:], ends[spot:]
    parts.append(("".join(chars), begins, ends))
    if not changed:
        return None
    text = "".join(x for x, _, _ in parts)
    if flat:
        return Layer.flat(text, int(layer.first[0]), int(layer.last[0]))
    begin, end = (np.concatenate([np.asarray(x[n], np.int64) for x in parts]) for n in (1, 2))
    return Layer(text, begin, end) if layer.first is None else Layer(text, layer.first[begin], layer.last[end - 1])


def inflated(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """(content, end of the last whole member so far) of the gzip or zlib members that follow each other from ``at``, in steps."""
    end = at
    while PACKED.match(data, at):
        unpack, rest, out = zlib.decompressobj(47), memoryview(data)[at:], b""
        while not unpack.eof:
            before = unpack.copy()
            try:
                out = unpack.decompress(rest, STEP)
            except zlib.error:  # what comes before the fault counts
                try:
                    for k in range(len(rest)):
                        yield before.decompress(rest[k : k + 1]), end
                except zlib.error:
                    return
            rest = memoryview(unpack.unconsumed_tail)
            if not out and not rest and not unpack.eof:
                return
            yield out, end
        end = at = len(data) - len(unpack.unused_data)
        yield b"", end


class Unpacker:
    """Takes bytes in steps and gives their plain text in pieces that no match crosses, with that of the packed members in them.

    ``heads`` are the first bytes of the members that this one lies in: a member that begins like one of them would never end.
    """

    def __init__(self, heads: tuple[bytes, ...] = ()) -> None:
        self.heads, self.live, self.tail, self.held = heads, [], b"", b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        for member in self.live:
            yield from member.feed(data)
        window = self.tail + data
        for m in PACKED.finditer(window):
            head = window[m.start() : m.start() + HEAD]
            if m.end() > len(self.tail) and head not in self.heads:  # one within the tail was found before
                self.live.append(Member((*self.heads, head) if len(head) == HEAD else self.heads))
                yield from self.live[-1].feed(window[m.start() :])
        self.live = [x for x in self.live if not x.over]
        self.tail = window[-2:]
        self.held += data.translate(PLAIN)
        if len(self.held) >= PIECE:
            cut = self.held.rfind(b"\n") + 1
            if cut:
                yield self.held[:cut]
                self.held = self.held[cut:]
            elif len(self.held) >= LONGEST:
                yield self.held
                self.held = self.held[len(self.held) // 2 :]

    def close(self) -> Iterator[bytes]:
        for member in self.live:
            yield from member.inside.close()
        yield self.held
        self.live, self.held = [], b""


class Member:
    """A packed member inside other data, which is fed on from its start and may turn out to be none."""

    def __init__(self, heads: tuple[bytes, ...]) -> None:
        self.unpack, self.inside, self.over = zlib.decompressobj(47), Unpacker(heads), False

    def feed(self, data: bytes) -> Iterator[bytes]:
        rest = data
        while rest and not self.over:
            before = self.unpack.copy()
            try:
                out, rest = self.unpack.decompress(rest, STEP), self.unpack.unconsumed_tail
                yield from self.inside.feed(out)
                self.over = self.unpack.eof
            except zlib.error:
                self.over = True
                yield from self.inside.feed(up_to_fault(before, rest))
        if self.over:
            yield from self.inside.close()


def up_to_fault(unpack: "zlib._Decompress", data: bytes) -> bytes:
    """What comes before a fault counts: at most what a window of bytes gives."""
    out = []
    try:
        for k in range(len(data)):
            out.append(unpack.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def pieces(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What ``inflated`` yields, as plain text in pieces, and the end of the last whole member so far."""
    unpacker, end = Unpacker((data[at : at + HEAD],)), at
    for out, end in inflated(data, at):
        for piece in unpacker.feed(out):
            yield piece, end
    for piece in unpacker.close():
        yield piece, end


def flat_layers(layer: "Layer") -> Iterator["Layer"]:
    """The base64 runs of a layer of one span, decoded in steps at all four alignments."""
    text, span = layer.text, (int(layer.first[0]), int(layer.last[0]))
    bodies = (m[0].rstrip("=") for m in BASE64.finditer(text))
    if "\n" in text or "\\n" in text:
        bodies = chain(bodies, (BREAKS.sub("", m[0]) for m in WRAPPED.finditer(text)))
    for body in bodies:
        for skip in range(min(4, len(body) - 15)):
            views = [Unpacker(), Unpacker(), Unpacker()]  # all bytes, and of two-byte characters the first and the second ones
            for piece in decoded(body, skip, views):
                if STRETCH.search(piece):
                    yield Layer.flat(piece.decode("ascii"), *span)


def decoded(body: str, skip: int, views: list[Unpacker]) -> Iterator[bytes]:
    end = len(body) - ((len(body) - skip) % 4 == 1)
    for k in range(skip, end, STEP):
        token = body[k : min(k + STEP, end)].translate({45: 43, 95: 47})
        data = base64.b64decode(token + "=" * (-len(token) % 4))
        yield from views[0].feed(data)
        if 3 * data.count(0) > len(data):
            yield from views[1].feed(data[0::2])
            yield from views[2].feed(data[1::2])
    for view in views:
        yield from view.close()


def blobs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs, without line breaks, and where their signs stand."""
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=")
        yield body, np.arange(m.start(), m.start() + len(body))
    for m in WRAPPED.finditer(text):
        keep = np.ones(len(m[0]), bool)
        for gap in BREAKS.finditer(m[0]):
            keep[gap.start() : gap.end()] = False
        yield BREAKS.sub("", m[0]), m.start() + np.flatnonzero(keep)


def unbase64(layer: Layer) -> Iterator[Layer]:
    """Layers of the base64 runs, at all four alignments: other text may stand right before or after a blob."""
    if layer.is_flat():
        yield from flat_layers(layer)
        return
    for body, spots in blobs(layer.text):
        body = body.translate({45: 43, 95: 47})
        end = int(spots[-1]) + 1
        for skip in range(4):
            token, spot = body[skip:], spots[skip:]
            if len(token) % 4 == 1:
                token, spot = token[:-1], spot[:-1]
            if len(token) < 16:
                continue
            data = base64.b64decode(token + "=" * (-len(token) % 4))
            plain, at = data.translate(PLAIN), 0
            while packed := PACKED.search(data, at):
                at, stop = packed.start(), packed.start()
                for piece, stop in pieces(data, at):
                    a, b = layer.root(int(spot[at // 3 * 4]), end)
                    if STRETCH.search(piece):
                        yield Layer.flat(piece.decode("ascii"), a, b)
                plain = plain[:at] + b"\n" * (stop - at) + plain[stop:] if stop > at else plain
                at = max(stop, at + 2)
            k = np.arange(len(plain))
            views = [(plain, k)]
            if 3 * data.count(0) > len(data):  # two-byte characters
                views += [(plain[0::2], k[0::2]), (plain[1::2], k[1::2])]
            for view, k in views:
                if STRETCH.search(view):
                    first, last = spot[k // 3 * 4], spot[np.minimum((k // 3 + 1) * 4, len(spot)) - 1] + 1
                    if layer.first is not None:
                        first, last = layer.first[first], layer.last[last - 1]
                    yield Layer(view.decode("ascii"), first, last)


def nested(layer: Layer) -> Iterator[Layer]:
    if any(c in layer.text for c in STARTERS) and (new := undone(layer)):
        yield new
    yield from unbase64(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base matches, all matches (each (start, kind, end), sorted) and the number of layers."""
    base = base_matches(text)
    found, work, seen, layers = set(base), [iter([Layer(text)])], set(), 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        if layers:
            found |= {((span := layer.root(a, b))[0], kind, span[1]) for a, kind, b in base_matches(layer.text)}
        layers += 1
        work.append(nested(layer))
    return base, sorted(found), layers


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base counts by kind, the digest of the base spans, all spans, and layers read."""

    def one(content: str | None) -> tuple:
        base, found, layers = scan(content or "")
        kinds = [k for _, k, _ in base]
        return *(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), layers

    made = by_row(lambda: one, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint")
    return docs.select("doc_id", made(F.col(text).cast("string")).alias("__made")).select("doc_id", "__made.*")


def mask(text: str | None, sign: str = "[SECRET]") -> str | None:
    """The text with every found span replaced; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets masked in the text column; all other columns and rows stay."""
    masked = F.pandas_udf(lambda s: s.map(mask, na_action="ignore"), "string")
    return docs.withColumn(text, masked(F.col(text)))
