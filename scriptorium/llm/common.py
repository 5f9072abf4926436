"""Helpers shared by the training-data operators: work folders, shared files, batch slicing, salted lookups."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.work import WorkFolder, shared_root

__all__ = ["BlobReader", "BlobWriter", "WorkFolder", "ascii_lower", "free_name", "give_back", "lean", "partitions", "relax", "salted_lookup", "shared_root", "slices"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of every contract: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 1 << 20


class BlobWriter:
    """One new file below a folder of the shared root, written front to back by one task attempt."""

    def __init__(self, folder: str, suffix: str = ".bin"):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"  # no other attempt's name; only names in committed rows are read
        system, path = pafs.FileSystem.from_uri(self.uri)
        self.stream, self.size = system.open_output_stream(path), 0

    def write(self, data: bytes) -> int:
        """Appends (bytes or a buffer), and tells where the data start."""
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.stream.close()


class BlobReader:
    """Range reads of a file in the shared root."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.uri, self.file = uri, system.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{self.uri}: {len(data)} of {length} bytes at {offset}")
        return data

    def close(self) -> None:
        self.file.close()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each has about ``most`` bytes of ``text`` at most, one row at least."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n) + 64
        if start < batch.num_rows:
            yield batch.slice(start)


@lru_cache(maxsize=1)
def trimmer() -> Callable[[int], int] | None:
    """The C library's function that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Python workers outlive tasks: what a task has freed goes back to the system, so that the next tasks find it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := trimmer():
        trim(0)


#: Groups of a task between which memory is given back.
GROUPS = 16
_groups = 0


def relax() -> None:
    """At the end of a group: gives memory back now and then, as that takes time itself."""
    global _groups
    _groups += 1
    if _groups % GROUPS == 0:
        pa.default_memory_pool().release_unused()
        if trim := trimmer():
            trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives memory back at its end."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it, whatever its case."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Where all characters are ASCII, lower() does just that and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(rows: DataFrame, entries: DataFrame, key: list[str], spread: Column, salts: int = 32, used_only: bool = False) -> DataFrame:
    """Left join of ``rows`` with ``entries`` (one per key) in which no key's rows meet in one task.

    ``spread`` (a stable column of ``rows``) deals each key's rows over ``salts`` sub-keys, and each entry is
    repeated once per salt: keep entries to those that several rows need. With ``used_only``, for entries that are
    as many as the rows, an entry is repeated only for the salts that its rows have, so that there never are more
    than rows. Otherwise entries are shuffled whatever their files' size: the planner does not count the repeats, and
    would send 32 times what it takes for small through the driver.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    if used_only:
        right = left.select(*key, "_salt").distinct().join(entries, key)
    else:
        right = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*key, "_salt"], "left").drop("_salt")
