"""Removal of long passages that repeat across documents, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import chunks as C
from scriptorium.llm.common import WorkFolder, lean, partitions, relax

WINDOW = 13
#: Positions i with i mod PERIOD in COVER. For any two positions i and j some shift d < PERIOD has both i + d and
#: j + d among them, so that two equal windows share an anchor of WINDOW - PERIOD + 1 words at the same place.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of anchor keys per byte of text, where words and blanks take three bytes or more on average.
KEY_SHARE = 8 * len(COVER) / PERIOD / 3


class Chunk:
    """Anchors and windows of a chunk's documents."""

    def __init__(self, uri: str):
        self.table = C.read_chunk(uri)
        self.words = C.Words(self.table.column("text"))
        self.starts = self.words.starts
        self.ids = self.table.column("doc_id").to_numpy()
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        place = np.arange(len(self.doc)) - self.starts[:-1][self.doc]
        left = self.starts[1:][self.doc] - np.arange(len(self.doc))
        long = np.diff(self.starts)[self.doc] >= WINDOW
        #: Where anchors start, and where a whole window may.
        self.anchors = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= ANCHOR) & long)
        self.open = left >= WINDOW
        self.anchor_keys, self.anchor_back, self.anchor_again = C.unique_keys(self.words.windows(ANCHOR, 0)[self.anchors])

    def candidates(self, flags: np.ndarray) -> np.ndarray:
        """Starts of the windows that have an anchor which occurs elsewhere: each anchor is extended both ways."""
        found = self.anchors[(flags | self.anchor_again)[self.anchor_back]]
        first = np.maximum(found - (PERIOD - 1), self.starts[:-1][self.doc[found]])
        return np.flatnonzero(covered(first, found + 1, len(self.doc)) & self.open)

    def window_keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """96 bits of each distinct window's hash (as two columns), the least id of the chunk that has it, each start's place among them."""
        a, b = (self.words.windows(WINDOW, lane)[starts] for lane in (0, 1))
        back, own = least_ids(a, (b >> np.uint64(32)).astype(np.uint32), self.ids[self.doc[starts]])
        return *own, back


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges at least."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def least_ids(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For C.answer(): each key's least id."""
    order = np.lexsort((ids, b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return back, (x[new], y[new], ids[order][new])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, the words joined by a space).

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id; windows are
    those of the input. First each chunk asks which of its anchors (at cover positions only) occur elsewhere;
    then, for the windows around such anchors alone, for the least id that has the window, compared by 96 bits of
    hash. Both questions are key exchanges, see :mod:`chunks`. Documents stay where they are.

    Ids are whole numbers below 2^63 - 1; a null id stands behind all others, and rows that repeat an id never remove each
    other's words. Null text has no words. Texts of less than 13 words are kept. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    work = WorkFolder(docs.sparkSession, "substrings")
    tasks = partitions(docs.sparkSession)
    written = work.table(C.write_chunks(docs, work.folder("chunks"), id_col, text_col), "manifest")
    manifest, deal = written.select("chunk"), C.exchange(written, KEY_SHARE)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("chunk").to_pylist():
                yield C.key_blocks(Chunk(uri).anchor_keys, uri, deal.ranges)

    def windows(table: pa.Table) -> pa.Table:
        uri = table.column("chunk")[0].as_py()
        chunk = Chunk(uri)
        a, b, ids, _ = chunk.window_keys(chunk.candidates(C.replies(table, "?")))
        out = pa.Table.from_batches([C.key_blocks(a, uri, deal.ranges, b, ids)])
        relax()
        return out

    fields = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text

    def removed(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("chunk")[0].as_py())
        kind = table.column("kind").to_numpy()
        starts = chunk.candidates(C.replies(table.filter(pa.array(kind == 1)), "?"))
        *_, back = chunk.window_keys(starts)
        least = C.replies(table.filter(pa.array(kind == 2)), "<i8")
        gone = starts[least[back] < chunk.ids[chunk.doc[starts]]] if len(starts) else starts
        drop = covered(gone, gone + WINDOW, len(chunk.doc))
        counts = np.concatenate([[0], np.cumsum(drop)])
        n_removed = counts[chunk.starts[1:]] - counts[chunk.starts[:-1]]
        kept, sha = [], []
        for i, text in enumerate(chunk.table.column("text").to_pylist()):
            words = text.encode().split()
            if n_removed[i]:
                mask = drop[chunk.starts[i] : chunk.starts[i + 1]]
                words = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
            data = b" ".join(words)
            sha.append(hashlib.sha256(data).hexdigest())
            if with_text:
                kept.append(data.decode())
        columns = {"doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.ids == C.LAST), "n_words": np.diff(chunk.starts), "n_removed": n_removed.astype(np.int64), "kept_sha256": pa.array(sha, pa.string())}
        relax()
        return pa.table(columns | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    # Chunks are few bytes here but much work: dealt out by number, or adaptive execution would join them to a few tasks.
    asked = manifest.repartition(tasks).mapInArrow(lean(anchors), C.BLOCK_SCHEMA)
    flags = work.table(C.answer(asked, ["<u8"], C.repeated, work, deal.salts), "flags")
    asked = flags.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(windows, C.BLOCK_SCHEMA)
    least = work.table(C.answer(asked, ["<u8", "<u4", "<i8"], least_ids, work, deal.salts), "least")
    told = (
        flags.withColumn("kind", F.lit(1))
        .unionByName(least.withColumn("kind", F.lit(2)))
        .unionByName(manifest.select(F.lit(-1).alias("pid"), "chunk", F.lit(b"").alias("data"), F.lit(0).alias("kind")))
    )
    result = work.table(told.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(removed, fields), "result")
    work.drop("chunks", "flags", "least", "manifest")
    return result
