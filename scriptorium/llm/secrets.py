"""Secret scans that unwrap nested encodings layer by layer."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import lean, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more: a shorter run has no later start that is longer
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Characters of two bytes, of which one is 0.
WIDE = re.compile(r"(?:[^\0]\0){6,}|(?:\0[^\0]){6,}")
#: Runs of base64, also over single line breaks with blanks around them.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++|[A-Za-z0-9+/_-]{16,}+)={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LEAST_RUN = 16
STANDARD = str.maketrans("-_", "+/")
PACKED = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>\x78[\x01\x5e\x9c\xda])|(?P<bzip2>BZh[1-9])|(?P<xz>\xfd7zXZ\x00)")
#: How such a start looks in a text of decoded bytes: bytes that aren't UTF-8 stand for themselves, as one character each or as half a pair.
PACKED_TEXT = re.compile("\x1f[\x8b\udc8b]\x08|x[\x01^\x9c\xda\udc9c\udcda\u0680-\u06bf]|BZh[1-9]|[\xfd\udcfd]7zXZ\0")
ODD_PAIRS, HIGH_BYTES = re.compile("[\ud800-\udc7f\udd00-\udfff]"), re.compile("[\x80-\xff]")
ENGINES = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
#: What unpacks to more bytes is scanned in blocks of so many, each of which repeats the last half of the one before.
MOST_BYTES = 64 << 20
#: Bytes that go to a decompressor and come from it at a time: what came of the feeds before one with an error is kept.
FEED, PIECE = 1 << 12, 1 << 20

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that are too short dropped; starts and ends in code points."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


@dataclass
class Places:
    """Which root characters those of a decoded text come from, by segments: 24 bytes each, however long.

    A segment starts at character at[k]; its characters are root characters from starts[k] on, one by one, or (where ends[k]
    isn't negative) all of it was decoded from starts[k] up to ends[k].
    """

    at: array
    starts: array
    ends: array

    @classmethod
    def none(cls) -> Places:
        return cls(array("q"), array("q"), array("q"))

    def add(self, at: int, start: int, end: int = -1) -> None:
        self.at.append(at)
        self.starts.append(start)
        self.ends.append(end)

    def copy(self, into: Places, a: int, b: int, at: int) -> None:
        """Adds the segments of characters a up to b, which stand at ``at`` there."""
        if a == b:
            return
        for k in range(bisect_right(self.at, a) - 1, bisect_left(self.at, b)):
            inside = max(a - self.at[k], 0)
            into.add(at + max(self.at[k] - a, 0), self.starts[k] + (inside if self.ends[k] < 0 else 0), self.ends[k])

    def root(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.starts[i] + (start - self.at[i] if self.ends[i] < 0 else 0)
        return first, self.starts[j] + end - self.at[j] if self.ends[j] < 0 else self.ends[j]


@dataclass
class Layer:
    """A decoded text and where it comes from (None: it is the root); ``raw`` if its bytes haven't been looked at for compressed ones."""

    text: str
    places: Places | None
    raw: bool = False

    def root(self, start: int, end: int) -> tuple[int, int]:
        return self.places.root(start, end) if self.places else (start, end)


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def rebuilt(layer: Layer, parts: Iterable[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer | None:
    """The layer with runs [a, b) replaced by characters, each with its own part of the run; None without runs."""
    text: list[str] = []
    places, had = Places.none(), layer.places or Places(array("q", [0]), array("q", [0]), array("q", [-1]))
    at = size = 0
    for a, b, chars in parts:
        text.append(layer.text[at:a])
        had.copy(places, at, a, size)
        size += a - at
        for c, x, y in chars:
            text.append(c)
            places.add(size, *layer.root(x, y))
            size += 1
        at = b
    if not at:
        return None
    text.append(layer.text[at:])
    had.copy(places, at, len(layer.text), size)
    return Layer("".join(text), places, True)


def url_layer(layer: Layer) -> Layer | None:
    def parts() -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
        for m in URL.finditer(layer.text) if "%" in layer.text else ():
            chars, at = [], m.start()
            for c in bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape"):
                n = 3 * len(c.encode(errors="surrogateescape"))
                chars.append((c, at, at + n))
                at += n
            yield *m.span(), chars

    return rebuilt(layer, parts())


def unicode_layer(layer: Layer) -> Layer | None:
    def parts() -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
        for m in ESCAPES.finditer(layer.text) if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text else ():
            high, low, decimal = m[2], m[3], m[9]
            if high:
                point = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00
            else:
                point = int(decimal) if decimal else int(next(x for x in m.groups() if x), 16)
            if point < 0x110000 and not 0xD800 <= point < 0xE000:
                yield *m.span(), [(chr(point), *m.span())]

    return rebuilt(layer, parts())


def wide_layer(layer: Layer) -> Layer | None:
    """Without the zeros of characters of two bytes."""

    def parts() -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
        for m in WIDE.finditer(layer.text) if "\0" in layer.text else ():
            own = slice(m.start() + (m[0][0] == "\0"), m.end(), 2)
            yield *m.span(), [(c, m.start() + 2 * i, m.start() + 2 * i + 2) for i, c in enumerate(layer.text[own])]

    return rebuilt(layer, parts())


class Members:
    """What one compressed member after another unpacks to, from a place of the data on; then where the last whole one ends."""

    def __init__(self, data: bytes, at: int):
        self.data, self.end = data, at

    def __iter__(self) -> Iterator[bytes]:
        while m := PACKED.match(self.data, self.end):
            engine, whole = ENGINES[m.lastgroup](), False
            for start in range(self.end, len(self.data), FEED):
                feed = self.data[start : start + FEED]
                stop = start + len(feed)
                try:
                    while True:
                        out = engine.decompress(feed, PIECE)
                        feed = getattr(engine, "unconsumed_tail", b"")
                        if out:
                            yield out
                        whole = engine.eof
                        if whole or not feed and len(out) < PIECE:
                            break
                except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
                    return
                if whole:
                    self.end = stop - len(engine.unused_data)
                    break
            if not whole:
                return


def blocks(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The pieces joined, as one block or else as blocks of MOST_BYTES that overlap by half; whether a block goes beyond the first."""
    held, late = bytearray(), False
    for piece in pieces:
        held += piece
        while len(held) > MOST_BYTES:
            yield bytes(held[:MOST_BYTES]), late
            del held[: MOST_BYTES // 2]
            late = True
    if held:
        yield bytes(held), late


def unpacked(data: bytes, above: frozenset[bytes] = frozenset()) -> Iterator[tuple[bytes, bool, bool]]:
    """The data, and what each compressed stream anywhere in them unpacks to, and so on.

    With whether it was compressed, and whether it is the second block of an oversize one (so that each counts once).
    """
    yield data, bool(above), False
    key = hashlib.blake2b(data, digest_size=16).digest()
    if key in above:
        return
    at = 0
    while m := PACKED.search(data, at):
        members, n = Members(data, m.start()), 0
        for block, late in blocks(members):
            n += late
            for k, (x, _, over) in enumerate(unpacked(block, above | {key})):
                yield x, True, over or k == 0 and late and n == 1
        at = max(members.end, m.start() + 1)


def runs(text: str) -> Iterator[list[int] | range]:
    """The places of the base64 characters of each run of a line, and of each run over line breaks."""
    for m in BASE64.finditer(text):
        lines = [range(*x.span()) for x in LINE.finditer(text, *m.span())]
        yield from (x for x in lines if len(x) >= LEAST_RUN)
        if len(lines) > 1 and sum(map(len, lines)) >= LEAST_RUN:
            yield [i for x in lines for i in x]


def base64_layers(layer: Layer) -> Iterator[tuple[Layer | None, bool]]:
    """A layer for each run whose bytes, as they are or decompressed, are readable or hold anything; whether it is the
    second block of an oversize one, then also without a layer.

    A run is decoded from each of its first four characters, as what stands in front may not belong to it.
    """
    for places in runs(layer.text):
        run = (layer.text[places.start : places.stop] if isinstance(places, range) else "".join([layer.text[i] for i in places])).translate(STANDARD)
        for phase in range(4):
            own = run[phase:]
            own = own[: len(own) - (len(own) % 4 == 1)]
            for data, packed, over in unpacked(base64.b64decode(own + "=" * (-len(own) % 4))):
                text = data.decode(errors="surrogateescape")  # a byte that isn't UTF-8 is a character of its own
                if len(text) < 6 or not (worth(text) or (packed or not phase) and readable(text)):
                    if over:
                        yield None, True
                    continue
                found, at = Places.none(), 0
                if packed:  # all of it comes from all of the run
                    found.add(0, *layer.root(places[phase], places[-1] + 1))
                    yield Layer(text, found), over
                    continue
                for i, c in enumerate(text):
                    n = len(c.encode(errors="surrogateescape"))
                    found.add(i, *layer.root(places[phase + at * 8 // 6], places[phase - (-(at + n) * 8 // 6) - 1] + 1))
                    at += n
                yield Layer(text, found), over


def packed_layers(layer: Layer) -> Iterator[tuple[Layer | None, bool]]:
    """A layer for each text that a compressed stream in the layer's bytes unpacks to: as they were escaped in UTF-8, or one byte a character."""
    forms = []
    if not PACKED_TEXT.search(layer.text):
        return
    if not ODD_PAIRS.search(layer.text):
        forms.append(("utf-8", layer.text.encode("utf-8", "surrogateescape")))
    if HIGH_BYTES.search(layer.text) and max(layer.text) <= "\xff":
        forms.append(("latin-1", layer.text.encode("latin-1")))
    for code, data in forms:
        at = 0
        while m := PACKED.search(data, at):
            members = Members(data, m.start())
            if not sum(map(len, members)):
                at = m.start() + 1
                continue
            at = members.end if members.end > m.start() else len(data)  # a stream that doesn't end takes all that is left
            first, last = (len(data[:k].decode(code, "surrogateescape")) for k in (m.start(), at))
            for block, packed, over in unpacked(data[m.start() : at]):
                text = block.decode(errors="surrogateescape")
                if packed and (worth(text) or readable(text)):
                    found = Places.none()
                    found.add(0, *layer.root(first, last))
                    yield Layer(text, found), over
                elif over:
                    yield None, True


BLANKS = str.maketrans("", "", "\t\n\r")


def readable(text: str) -> bool:
    return text.translate(BLANKS).isprintable()


def worth(text: str) -> bool:
    """Whether a scan or a decoder finds anything in the text: else it is no layer, however it was come by."""
    return bool(base_spans(text) or URL.search(text) or ESCAPES.search(text) or "\0" in text and WIDE.search(text) or next(runs(text), None))


def unwrapped(layer: Layer) -> Iterator[tuple[Layer | None, bool]]:
    yield url_layer(layer), False
    yield unicode_layer(layer), False
    yield wide_layer(layer), False
    yield from base64_layers(layer)
    if layer.raw:
        yield from packed_layers(layer)


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans; all spans, those of decoded layers mapped to the text; number of layers; those of more than MOST_BYTES.

    Each layer is scanned and unwrapped by each decoder, and so is what comes out, one at a time, until nothing new
    does. A layer equal to one above it is a cycle and is left out; one that was met before at the same place (by
    another order of decoders) isn't done twice.
    """
    base = base_spans(text)
    spans = set(base)
    above = [digest(text)]
    path, work, met, layers, large = set(above), [unwrapped(Layer(text, None))], set(), 0, 0
    while work:
        layer, over = next(work[-1], (None, None))
        if over is None:
            work.pop()
            path.discard(above.pop())
            continue
        large += over
        if layer is None:
            continue
        key = digest(layer.text)
        place = (key, *layer.root(0, len(layer.text))) if layer.text else (key, 0, 0)
        if key in path or place in met:
            continue
        met.add(place)
        layers += 1
        spans |= {(kind, *layer.root(s, e)) for kind, s, e in base_spans(layer.text)}
        work.append(unwrapped(layer))
        above.append(key)
        path.add(key)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(spans, key=order), layers, large


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_oversize bigint"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans, n_layers, n_oversize.

    Null text counts as empty: no spans, the digest of the empty string. Rows that repeat an id each give a row.
    Other columns are ignored, whatever their names. A map over whole texts without a shuffle.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                base, every, layers, large = scan(text or "")
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, large))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(compute), f"doc_id {dict(docs.dtypes)[id_col]}, {SCHEMA}")
