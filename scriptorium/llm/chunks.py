"""Chunks of documents in shared files, and key exchanges between them.

A chunk is a file of some megabytes of documents. An operator makes 64-bit keys of a chunk's words; each chunk
sends every key once, in sorted blocks dealt by key range, and gets back one answer per key in the same order.
So a key that a third of all documents hold reaches its task once per chunk, or with many chunks once per salt;
a key costs 8 bytes in the shuffle, and texts are never shuffled: tasks read a chunk again from its file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BlobReader, BlobWriter, WorkFolder, lean, partitions, relax, slices

CHUNK_BYTES = 2 << 20
#: A key range has about so many bytes of keys; so many chunks' keys meet at a time, see :func:`answer`.
RANGE_BYTES, MEETING_CHUNKS = 32 << 20, 4096
#: A null id stands behind all others.
LAST = np.iinfo(np.int64).max
WORD_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def write_chunks(docs: DataFrame, folder: str, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes ids (whole numbers; null: LAST) and texts (null: empty) to chunk files, see :func:`write_rows`."""
    ids = F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(LAST)))
    return write_rows(docs.select(ids.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), folder, chunk_bytes)


def write_rows(rows: DataFrame, folder: str, chunk_bytes: int) -> DataFrame:
    """Writes rows of doc_id and text to chunk files; a row per chunk: chunk, rows, bytes of text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            out, sink = BlobWriter(folder, ".chunk"), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                for part in held:
                    stream.write_batch(pa.RecordBatch.from_arrays(list(part.columns), schema=part.schema))
            out.write(sink.getvalue())
            out.close()
            columns = {"chunk": pa.array([out.uri]), "rows": pa.array([sum(x.num_rows for x in held)], pa.int64()), "bytes": pa.array([size], pa.int64())}
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for part in slices(batches, "text", chunk_bytes):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py()
            if held and size + more > chunk_bytes:
                yield done()
                held, size = [], 0
            held.append(part)
            size += more
        if held:
            yield done()

    return rows.mapInArrow(lean(write), "chunk string, rows bigint, bytes bigint")


def read_chunk(uri: str) -> pa.Table:
    reader = BlobReader(uri)
    data = reader.read(0, reader.size())
    reader.close()
    return pa.ipc.open_stream(data).read_all()


class Words:
    """The words of some texts, all in one row: two hashes of each, and where each text's words start."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        words = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
        if not real.all():  # a text without words has one empty word here
            offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
            words = words.filter(pa.array(real))
        coded = words.dictionary_encode() if len(words) else None
        if coded is None:
            self.hashes = np.zeros((0, 2), np.uint64)
        else:
            own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.binary()).to_pylist())), np.uint64).reshape(-1, 2)
            self.hashes = own[coded.indices.to_numpy(zero_copy_only=False)]
        self.starts = offsets

    def windows(self, length: int, lane: int) -> np.ndarray:
        """A hash of the words i up to i + length at each i; those across texts mean nothing."""
        column = self.hashes[:, lane]
        n = max(0, len(column) - length + 1)
        out = np.zeros(n, np.uint64)
        for k in range(length):
            out = out * WORD_SEEDS[lane] + column[k : k + n]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(n_ranges: int) -> np.ndarray:
    """Lower bounds of equal ranges of the 64-bit numbers."""
    return np.array([(i << 64) // n_ranges for i in range(n_ranges)], np.uint64)


BLOCK_SCHEMA = "pid int, chunk string, data binary"


def key_blocks(keys: np.ndarray, chunk: str, n_ranges: int, *values: np.ndarray) -> pa.RecordBatch:
    """Sorted unique keys, with values in their order, cut by key range: pid, chunk, data (keys, then each value)."""
    cuts = np.append(np.searchsorted(keys, edges(n_ranges)), len(keys))
    rows = [(p, b"".join(x[a:b].tobytes() for x in (keys, *values))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.string()), pa.array([d for _, d in rows], pa.binary())], ["pid", "chunk", "data"])


@dataclass(frozen=True)
class Exchange:
    """How keys are dealt out: by so many ranges, and the chunks of a range by so many salts."""

    ranges: int
    salts: int


def exchange(manifest: DataFrame, share: float, meeting: int = MEETING_CHUNKS) -> Exchange:
    """By what was written: ``share`` is the most bytes of keys per byte of text that are expected. Ranges grow with the data."""
    found = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("chunks")).first()
    return Exchange(max(2 * partitions(manifest.sparkSession), -(-int(found["bytes"] * share) // RANGE_BYTES)), max(1, -(-found["chunks"] // meeting)))


def columns_of(data: list[bytes], kinds: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """The columns of some blocks, one behind another, and the blocks' numbers of entries."""
    sizes = [len(d) // sum(np.dtype(k).itemsize for k in kinds) for d in data]
    columns, at = [], [0] * len(data)
    for k in kinds:
        columns.append(np.concatenate([np.frombuffer(d, k, n, a) for d, n, a in zip(data, sizes, at, strict=True)]) if data else np.zeros(0, k))
        at = [a + n * np.dtype(k).itemsize for a, n in zip(at, sizes, strict=True)]
    return columns, sizes


Combine = Callable[..., tuple[np.ndarray, tuple[np.ndarray, ...]]]


def last(*columns: np.ndarray) -> np.ndarray:
    return columns[-1]


def answer(blocks: DataFrame, kinds: list[str], combine: Combine, work: WorkFolder, salts: int = 1, tell: Callable[..., np.ndarray] = last) -> DataFrame:
    """Answers all blocks of a key range: pid, chunk, data.

    ``kinds`` are the numpy types of keys and values. ``combine(*columns)`` gives each entry's place among the distinct
    keys, and the columns of those, of which ``tell`` makes the answers; it must also take columns that it gave. With more than one salt a
    range's chunks are first combined by salt, then the salts, so that a key which all chunks have never meets more
    than a salt's chunks, or the salts, in a task.
    """

    def block(pid: object, chunk: str, data: np.ndarray) -> dict:
        return {"pid": pid, "chunk": chunk, "data": data.tobytes()}

    schema = pa.schema([("pid", pa.int32()), ("chunk", pa.string()), ("data", pa.binary())])

    def replied(table: pa.Table, kinds: list[str]) -> pa.Table:
        columns, sizes = columns_of(table.column("data").to_pylist(), kinds)
        back, out = combine(*columns)
        parts = np.split(tell(*out)[back], np.cumsum(sizes)[:-1])
        done = pa.Table.from_pylist([block(p, c, x) for p, c, x in zip(table.column("pid").to_pylist(), table.column("chunk").to_pylist(), parts, strict=True)], schema)
        relax()
        return done

    if salts == 1:
        return blocks.groupBy("pid").applyInArrow(lambda t: replied(t, kinds), BLOCK_SCHEMA)
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("string").alias("salt")
    asked = work.table(blocks.select("*", salt), f"salted-{uuid.uuid4().hex}")
    none = combine(*(np.zeros(0, k) for k in kinds))[1]
    inner, kind = [c.dtype.str for c in none], tell(*none).dtype

    def combined(table: pa.Table) -> pa.Table:
        out = combine(*columns_of(table.column("data").to_pylist(), kinds)[0])[1]
        return pa.Table.from_pylist([{"pid": table.column("pid")[0].as_py(), "chunk": table.column("salt")[0].as_py(), "data": b"".join(c.tobytes() for c in out)}], schema)

    between = asked.groupBy("pid", "salt").applyInArrow(combined, BLOCK_SCHEMA).groupBy("pid").applyInArrow(lambda t: replied(t, inner), BLOCK_SCHEMA)

    def spread(table: pa.Table) -> pa.Table:
        told = table.filter(pc.is_null(table.column("chunk"))).column("data").to_pylist()[0]
        own = table.filter(pc.is_valid(table.column("chunk")))
        columns, sizes = columns_of(own.column("data").to_pylist(), kinds)
        back, out = combine(*columns)
        parts = np.split(np.frombuffer(told, kind)[back], np.cumsum(sizes)[:-1])
        return pa.Table.from_pylist([block(p, c, x) for p, c, x in zip(own.column("pid").to_pylist(), own.column("chunk").to_pylist(), parts, strict=True)], schema)

    both = asked.unionByName(between.select("pid", F.lit(None).cast("string").alias("chunk"), "data", F.col("chunk").alias("salt")))
    return both.groupBy("pid", "salt").applyInArrow(spread, BLOCK_SCHEMA)


def repeated(keys: np.ndarray, again: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For answer(): whether a key was sent by two chunks or more."""
    own, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    flags = count > 1
    if again is not None:
        flags |= np.bincount(back, again, len(own)) > 0
    return back, (own, flags)


def replies(table: pa.Table, kind: str) -> np.ndarray:
    """A chunk's answers in the order of its keys."""
    order = np.argsort(table.column("pid").to_numpy(), kind="stable")
    data = table.column("data").to_pylist()
    return np.concatenate([np.frombuffer(data[i], kind) for i in order]) if len(order) else np.zeros(0, kind)


def unique_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted unique keys, the place of each key among them, and which occur more than once."""
    own, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return own, back, count > 1
