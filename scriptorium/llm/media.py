"""Interleaved document sequences of text and media, with payloads in a store that digests resolve."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BlobReader, BlobWriter, WorkFolder, lean, partitions, salted_lookup, slices

#: Payloads are padded to a multiple of this; it is also an image's width, in pixels of one byte.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A file of media files is closed when it has so many bytes.
FILE_BYTES = 64 << 20
#: So many digests a task remembers, so as not to store a payload twice; repeats beyond that only cost space.
KNOWN = 100_000
SEQUENCE = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
SKIPPED = ("script", "style", "head", "template")
BLOCKS = frozenset("p div li ul ol table tr td th h1 h2 h3 h4 h5 h6 article section figure blockquote pre br hr nav header footer".split())
MEDIA = ("img", "audio", "video", "source", "embed")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The bytes as the samples of an 8-bit grey image, WIDTH pixels wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered, 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples, one row per line, of an 8-bit grey image without row filters; checks every chunk's sum."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, packed = 8, (0, 0), b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk's check sum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey images are read")
            shape = height, width
        elif kind == b"IDAT":
            packed += body
        at += n + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't read")
    return lines[:, 1:]


class SequenceParser(HTMLParser):
    """Collects text and media references in their order; a figure's caption, or else the alt text, goes with its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipped = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skipped += 1
        if tag in BLOCKS:
            self.flush()
        own = dict(attrs)
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA and own.get("src"):
            self.flush()
            item = {"kind": "image" if tag == "img" else tag, "text": None, "ref": own["src"], "caption": own.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag == "figcaption" and self.caption is not None:
            for item in self.figure or ():
                item["caption"] = "".join(self.caption).strip()
            self.caption = None
        if tag == "figure":
            self.figure = None
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skipped:
            self.text.append(data)


def sequence(page: str) -> list[dict]:
    parser = SequenceParser()
    parser.feed(page)
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def parse_sequences(pages: DataFrame, html_col: str = "html", into: str = "sequence") -> DataFrame:
    """Adds the ordered sequence of text and media references of each page; null HTML gives an empty sequence."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "ref", "caption"))]))
        for part in slices(batches, html_col):
            found = pa.array([sequence(x or "") for x in part.column(html_col).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), found], [*rest, into])

    rest = [c for c in pages.columns if c != html_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)
    return pages.mapInArrow(lean(parse), f"{fields}, {into} {SEQUENCE}")


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 appended up to a positive multiple of WIDTH; the length before."""
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0"), len(data)


def caption_of(text: str) -> str:
    return " ".join(text[:200].split()[:4])


def page_of(text: str, digest: str) -> str:
    """An HTML page that has the text's first line, then a figure of the stored payload, then the rest."""
    first, _, rest = text.partition("\n")
    e = html.escape
    return f'<article><p>{e(first)}</p><figure><img src="urn:sha256:{digest}"><figcaption>{e(caption_of(text))}</figcaption></figure><p>{e(rest)}</p></article>'


REFS = {"doc_id": None, "n_bytes": pa.int64(), "position": pa.int32(), "caption": pa.string(), "ref": pa.string(), "path": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def store_references(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """A row per media reference of each document's page: doc_id, n_bytes, position, caption, ref (the digest), and where the media file is.

    Media files are put one after another into files below ``folder``; a task stores a payload once. Pages are made,
    parsed and let go one by one, so that a task holds a slice of texts and the narrow rows of it.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, int, int]] = {}
        writer = None
        for part in slices(batches, "text"):
            places, rows = [], []
            for i, text in enumerate(t or "" for t in part.column("text").to_pylist()):
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    writer = writer or BlobWriter(folder, ".media")
                    image = to_png(payload)
                    known[digest] = writer.uri, writer.write(image), len(image)
                for item in sequence(page_of(text, digest)):
                    if item["ref"] is not None:
                        places.append(i)
                        rows.append((n, item["position"], item["caption"], item["ref"].rpartition(":")[2], *known[digest]))
            if writer and writer.size >= FILE_BYTES:
                writer.close()
                writer = None
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(places, pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate([*REFS.values()][1:]))], list(REFS))
        if writer:
            writer.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(store), f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes bigint, position int, caption string, ref string, path string, offset bigint, length bigint")


FOUND = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "stats": pa.string()}


def features(image: bytes) -> tuple:
    """Of a stored media file: its payload's size, digest and tail sum, its own size and digest, and statistics of its samples."""
    samples = from_png(image)
    payload = samples.tobytes()
    part = np.bincount(samples.ravel() >> 5, minlength=8) / max(samples.size, 1)
    stats = f"grey8 {samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} sd={samples.std():.4f} histogram={'/'.join(f'{x:.4f}' for x in part)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), stats


def read_media(media: DataFrame, n_tasks: int) -> DataFrame:
    """digest and features of each stored media file; tasks read ranges of whole files in their order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for path, offset, length in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                    if reader is None or reader.uri != path:
                        if reader:
                            reader.close()
                        reader = BlobReader(path)
                    rows.append(features(reader.read(offset, length)))
                yield pa.RecordBatch.from_arrays([part.column("ref"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(FOUND.values()))], ["ref", *FOUND])
        if reader:
            reader.close()

    ordered = media.repartition(n_tasks, "path").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(lean(read), "ref string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, stats string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text becomes an HTML page with a reference, by digest, to a figure whose samples are the text's bytes;
    pages are parsed into ordered sequences, and their references are resolved by a join on the digest. Only
    narrow rows are shuffled: each distinct media file is read and described once, and the references of a
    payload that many documents share are spread over salted sub-keys. Media files take one copy of the
    distinct texts, compressed, in the shared folder.

    Null text counts as empty: 64 bytes 0. Rows that repeat an id each give a row. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = WorkFolder(spark, "media")
    refs = work.table(store_references(docs, work.folder("files"), id_col, text_col), "refs")
    places = refs.groupBy("ref").agg(F.min(F.struct("path", "offset", "length")).alias("place")).select("ref", "place.*")
    found = work.table(read_media(places, partitions(spark)), "features")
    work.drop("files")
    joined = salted_lookup(refs.select("doc_id", "n_bytes", "position", "caption", "ref"), found, ["ref"], F.col("doc_id"), used_only=True)
    whole = F.when(F.col("payload_sha256") == F.col("ref"), F.col("payload_sha256")).otherwise(F.raise_error(F.lit("a payload read back differs from its reference")))
    feature = F.concat_ws(" ", F.concat(F.lit("position="), "position"), F.concat(F.lit("caption="), F.to_json(F.struct("caption"))), "stats")
    result = joined.select("doc_id", "n_bytes", "payload_bytes", whole.alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
    result = work.table(result, "result")
    work.drop("refs", "features")
    return result
