"""WARC records in ZIP packages: written per partition, read back by directory, index and byte ranges."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BlobReader, BlobWriter, WorkFolder, lean, partitions, salted_lookup, slices

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its records take so many bytes; a reading task gets ranges of about BLOCK_BYTES.
PACKAGE_BYTES, BLOCK_BYTES = 64 << 20, 2 << 20
#: Of equal payloads at least this long only one is stored.
LEAST_REVISIT = 1000
BIG = 0xFFFFFFFF
DATE = "2000-01-01T00:00:00Z"


# Records


def clean(url: object) -> str:
    """A URL as header fields and index keys have it; the index entry keeps it as it was."""
    return quote(str(url), safe="/:?#[]@!$&'()*+,;=%~-._")


def name_of(page_id: object) -> str:
    """A record's name; a page without an id has the empty name."""
    return "<urn:page:>" if page_id is None else f"<urn:page:id={quote(str(page_id), safe='')}>"


def record(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A record as a gzip member of its own. A revisit has the payload's length and digest but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": name_of(page_id), "WARC-Date": DATE, "WARC-Target-URI": None if url is None else clean(url),
        "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response",
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name_of(refers_to)}
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(head.encode() + block + b"\r\n\r\n") + engine.flush()


@dataclass
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes

    def page(self, field: str) -> str | None:
        value = self.fields.get(field, "")
        return unquote(value[len("<urn:page:id=") : -1]) if value.startswith("<urn:page:id=") else None


def headers(text: bytes) -> dict[str, str]:
    return {k: v.strip() for k, _, v in (x.partition(":") for x in text.decode().split("\r\n")[1:])}


def parse_record(member: bytes) -> Record:
    """Reads one gzip member; checks the block's length and a stored payload's digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record starts here")
    fields = headers(head)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("a payload differs from its digest")
    return Record(fields, headers(http), payload)


# Packages


class PackageWriter:
    """A ZIP file of two stored members, records and their index, written front to back.

    The sizes follow a member (flag bit 3). ZIP64 fields are written where a value needs them, or always.
    """

    def __init__(self, folder: str, zip64: bool = False):
        self.out, self.zip64, self.directory, self.lines = BlobWriter(folder, ".wacz"), zip64, b"", []
        self.uri = self.out.uri
        self._open(ARCHIVE)

    def _open(self, name: str) -> None:
        self.name, self.crc = name.encode(), 0
        self.at = self.out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 8, 0, 0, 33, 0, 0, 0, len(self.name), 0) + self.name)
        self.start = self.out.size

    def _write(self, data: bytes) -> int:
        self.crc = zlib.crc32(data, self.crc)
        return self.out.write(data) - self.start

    def _close(self) -> None:
        size = self.out.size - self.start
        big = self.zip64 or size >= BIG or self.at >= BIG
        self.out.write(struct.pack("<4sIQQ" if size >= BIG else "<4sIII", b"PK\7\x08", self.crc, size, size))
        extra = struct.pack("<HHQQQ", 1, 24, size, size, self.at) if big else b""
        short, at = (BIG, BIG) if big else (size, self.at)
        self.directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 8, 0, 0, 33, self.crc, short, short, len(self.name), len(extra), 0, 0, 0, 0, at) + self.name + extra

    def add(self, member: bytes, page_id: object, url: str | None) -> None:
        offset = self._write(member)
        entry = {"url": url, "page": None if page_id is None else str(page_id), "offset": offset, "length": len(member)}
        self.lines.append(f"{clean(url)} {DATE} {json.dumps(entry)}\n")

    def close(self) -> None:
        self._close()
        self._open(INDEX)
        self._write("".join(self.lines).encode())
        self._close()
        at, n = self.out.write(self.directory), len(self.directory)
        big = self.zip64 or at >= BIG
        if big:
            end = self.out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 2, 2, n, at))
            self.out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, *((0xFFFF, 0xFFFF, BIG, BIG) if big else (2, 2, n, at)), 0))
        self.out.close()


@dataclass
class Member:
    method: int
    start: int
    size: int


def directory(reader: BlobReader) -> dict[str, Member]:
    """Members by name, from the central directory at the end of a ZIP file, ZIP64 or not; nothing is extracted."""
    size = reader.size()
    tail_at = max(0, size - 22 - 0xFFFF - 20)
    tail = reader.read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, length, at, _ = struct.unpack_from("<4sHHHHIIH", tail, end)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", tail, end - 12)
        found = struct.unpack("<4sQHHIIQQQQ", reader.read(where, 56))
        if found[0] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, at = found[7:10]
    entries, members, pos = reader.read(at, length), {}, 0
    for _ in range(count):
        sig, _, _, _, method, _, _, _, packed, plain, n, m, k, _, _, _, local = struct.unpack_from("<4sHHHHHHIIIHHHHHII", entries, pos)
        if sig != b"PK\1\2":
            raise ValueError("no entry of a central directory")
        name, extra = entries[pos + 46 : pos + 46 + n].decode(), entries[pos + 46 + n : pos + 46 + n + m]
        while len(extra) >= 4:
            kind, size_ = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: of size, packed size, place, those that don't fit above, in this order
                wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, 4))
                plain, packed, local = (next(wide) if x == BIG else x for x in (plain, packed, local))
            extra = extra[4 + size_ :]
        head = reader.read(local, 30)
        start = local + 30 + sum(struct.unpack_from("<HH", head, 26))
        members[name] = Member(method, start, packed)
        pos += 46 + n + m + k
    return members


def blocks(reader: BlobReader) -> Iterator[tuple[int, list[dict]]]:
    """Ranges of about BLOCK_BYTES of the stored archive: where each starts, and its records' index entries."""
    members = directory(reader)
    for name in (ARCHIVE, INDEX):
        if name not in members or members[name].method:
            raise ValueError(f"{name} isn't stored in {reader.uri}")
    index, at = members[INDEX], members[ARCHIVE].start
    entries = sorted((json.loads(x.split(" ", 2)[2]) for x in reader.read(index.start, index.size).decode("utf-8", "surrogatepass").splitlines()), key=lambda e: e["offset"])
    held: list[dict] = []
    for entry in entries:
        end = held[-1]["offset"] + held[-1]["length"] if held else 0
        if held and (entry["offset"] != end or end + entry["length"] - held[0]["offset"] > BLOCK_BYTES):
            yield at + held[0]["offset"], held
            held = []
        held.append(entry)
    if held:
        yield at + held[0]["offset"], held


# Tables


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record for each row of page_id, url, html, refers_to (null: a response); gives the packages: path, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([writer.uri]), pa.array([len(writer.lines)], pa.int64())], ["path", "records"])

        for part in slices(batches, "html"):
            for page_id, url, text, revisit, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
                writer = writer or PackageWriter(folder, zip64)
                writer.add(record("revisit" if revisit else "response", page_id, url, (text or "").encode("utf-8", "surrogatepass"), refers_to), page_id, url)
                if writer.out.size >= package_bytes:
                    yield done()
                    writer = None
        if writer:
            yield done()

    return pages.select("page_id", "url", "html", "revisit", "refers_to").mapInArrow(lean(write), "path string, records bigint")


RANGES = {"path": pa.string(), "start": pa.int64(), "lengths": pa.list_(pa.int64()), "pages": pa.list_(pa.string()), "urls": pa.list_(pa.string())}


def locate(packages: DataFrame) -> DataFrame:
    """path, start, and per record length, page and url, of each block of records, from the packages' directories and indexes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reader = BlobReader(path)
                found = list(blocks(reader))
                reader.close()
                rows = [(path, start, *([e[k] for e in entries] for k in ("length", "page", "url"))) for start, entries in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(RANGES.values())], list(RANGES))

    return packages.select("path").mapInArrow(lean(find), "path string, start bigint, lengths array<bigint>, pages array<string>, urls array<string>")


def read_records(ranges: DataFrame, with_html: bool = False) -> DataFrame:
    """A row per record, read by range: page, url (as the index has them), record_type, refers_to, payload_bytes, payload_digest (and html).

    A response's payload is held against its digest; a revisit has none, and gives what its header says.
    """
    names = {"page": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"html": pa.string()} if with_html else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths, pages, urls in zip(*(batch.column(c).to_pylist() for c in RANGES), strict=True):
                reader = BlobReader(path)
                data, at, rows = reader.read(start, sum(lengths)), 0, []
                reader.close()
                for n, page, url in zip(lengths, pages, urls, strict=True):
                    r = parse_record(data[at : at + n])
                    at += n
                    if r.page("WARC-Record-ID") != page:
                        raise ValueError(f"a record isn't the one that the index of {path} tells")
                    digest = base64.b32decode(r.fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                    row = (page, url, r.fields["WARC-Type"], r.page("WARC-Refers-To"), int(r.http["Content-Length"]), digest)
                    rows.append((*row, r.payload.decode("utf-8", "surrogatepass")) if with_html else row)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(names.values())], list(names))

    kinds = {pa.string(): "string", pa.int64(): "bigint"}
    return ranges.mapInArrow(lean(read), ", ".join(f"{k} {kinds[t]}" for k, t in names.items()))


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, revisit, refers_to: of equal payloads of ``least`` bytes or more the largest page_id is the response.

    Groups of equal payloads are found on digests alone, with partial sums before the shuffle; the pages then look
    up groups of two or more over salted sub-keys.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("_key", F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256))))
    groups = rows.filter("_key IS NOT NULL").groupBy("_key").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    found = salted_lookup(rows, groups, ["_key"], F.struct("page_id", "url"))
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")), F.col("_first"))
    return found.select("page_id", "url", "html", refers_to.isNotNull().alias("revisit"), refers_to.alias("refers_to"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page, read back from packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Ids and URLs come back as they were, whatever characters they have. Null html is an empty payload, a null url is left out. A null id never becomes the response of a group that
    has others. Rows that repeat an id each get a record; those with the id that stays are all responses. An
    empty table gives no package and an empty result. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    work = WorkFolder(spark, "warc")
    kind = dict(pages.dtypes)[id_col]
    packages = work.table(write_packages(revisits(pages, id_col, url_col, html_col), work.folder("packages")), "manifest")
    ranges = work.table(locate(packages.repartition(partitions(spark))), "ranges")
    found = work.table(read_records(ranges.repartition(partitions(spark))), "records")
    work.drop("packages", "manifest", "ranges")
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
