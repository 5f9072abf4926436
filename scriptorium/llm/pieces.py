"""SentencePiece encoding and decoding over one table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import chunks as C
from scriptorium.llm.common import WorkFolder, lean, partitions, relax

#: A run of white-space markers and what follows up to the next one; no piece crosses such a chunk's end.
WORD = re.compile("▁+[^▁]*")
MARK, LINE_BYTE = "▁", "<0x0A>"
#: Bytes of text that send their distinct words together; bytes of words per byte of text at most.
CHUNK_BYTES, WORD_SHARE = 8 << 20, 1.0
#: Words that a task segments at a time; bytes of text of a chunk that it puts together at a time.
BATCH, PART_BYTES = 20_000, 2 << 20
CODEC = "zstd"
BLANK = pa.scalar(" ", pa.large_string())


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + n]
        at += n


#: Numbers of the model's normalizer message and of its fields.
NORMALIZER, CHARACTER_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPES = 3, 2, 3, 4, 5


class Model:
    """A model whose chunks can be segmented one by one.

    That is exact for a model with these properties, which are read from it: white space is escaped by a marker, one
    marker is put before the text, the normalizer has no character map and keeps all spaces, and no piece has a marker
    behind another character. Then no merge can cross from one chunk to the next. If besides no piece has a line
    break, chunks end before line breaks, too.

    Keys: a word stands for itself behind a marker; a key that starts with a marker is spelt out; one that starts with
    a line break has no marker.
    """

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in self.names):
            raise ValueError("a piece of this model crosses a white-space marker")
        spec = dict(fields(next(v for k, v in fields(self.model.serialized_model_proto()) if k == NORMALIZER)))
        if spec.get(CHARACTER_MAP) or not spec.get(DUMMY_PREFIX, 1) or spec.get(EXTRA_SPACES, 1) or not spec.get(ESCAPES, 1):
            raise ValueError("this model's normalizer changes texts")
        self.eos, self.marker = self.model.eos_id(), self.model.piece_to_id(MARK)
        self.breaks = not any("\n" in p for p in self.names)
        self.kind = np.uint16 if len(self.names) <= 1 << 16 else np.uint32

    def plain(self, texts: pa.Array) -> pa.Array:
        """Whether a text's keys are what stands between its spaces."""
        spaced = pc.replace_substring(texts, "\n", " \n")
        odd = pc.match_substring(spaced, "  ")
        for test in (pc.match_substring(spaced, MARK), pc.starts_with(spaced, " "), pc.ends_with(spaced, " "), pc.equal(pc.binary_length(spaced), 0)):
            odd = pc.or_(odd, test)
        return pc.invert(odd) if self.breaks else pa.array(np.zeros(len(texts), bool))

    def keys(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The keys of all texts in their order, and where each text's start."""
        plain = self.plain(texts)
        if pc.all(plain).as_py():
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            own = [t.replace("\n", " \n").split(" ") if p else self.odd_keys(t) for t, p in zip(texts.to_pylist(), plain.to_pylist(), strict=True)]
            lists = pa.array(own, pa.list_(pa.large_string()))
        return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def odd_keys(self, text: str) -> list[str]:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, keys: list[str]) -> Iterator[tuple[list[int], str | None]]:
        """Of each key: its ids, and the decoded form if it differs from the key's own."""
        ids = self.model.encode([k[1:] if k[0] == MARK else k for k in keys], num_threads=1)
        odd = []
        for i, key in enumerate(keys):
            if key[0] == "\n":
                ids[i] = ids[i][1:]  # without the marker before the line break
            elif key == MARK:
                ids[i] = [self.marker]
            if key[0] == MARK or "".join([self.names[x] for x in ids[i]]) != (LINE_BYTE + key[1:] if key[0] == "\n" else MARK + key):
                odd.append(i)
        # decode() drops the space of a leading marker; each chunk gets one more in front to lose.
        backs = dict(zip(odd, self.model.decode([[self.marker, *ids[i]] for i in odd], num_threads=1) if odd else [], strict=True))
        for i, key in enumerate(keys):
            back = backs.get(i)
            yield ids[i], None if back is None or back == own_form(key) else back


def own_form(key: str) -> str:
    """What a key decodes to unless its pieces say otherwise."""
    return key if key[0] in "\n▁" else f" {key}"


@lru_cache(maxsize=2)
def model_of(file: str) -> Model:
    """One per worker; it has nothing that grows."""
    return Model(file)


# Blocks: a range's words of a chunk, and what is answered to them


def pack(*parts: bytes | np.ndarray) -> bytes:
    """Parts with their lengths, compressed together."""
    data = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    whole = np.array([len(data), *map(len, data)], np.int64).tobytes() + b"".join(data)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, CODEC, asbytes=True)


def unpack(block: bytes) -> list[bytes]:
    whole = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), CODEC, asbytes=True)
    n = int(np.frombuffer(whole, np.int64, 1)[0])
    cuts = np.cumsum([8 * (n + 1), *np.frombuffer(whole, np.int64, n, 8)])
    return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def parts_of(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of strings, one behind another."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.diff(ends).astype(np.uint32), words.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if len(words) else b""


def dealt(words: pa.Array, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by key range, then as they sort, and where each range starts."""
    pid = np.array([*map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_pylist())], np.uint64) % np.uint64(ranges)
    order = pc.sort_indices(pa.table({"p": pid, "w": words}), [("p", "ascending"), ("w", "ascending")]).to_numpy()
    return order, np.searchsorted(pid[order], np.arange(ranges + 1, dtype=np.uint64))


def chunk_keys(uri: str, model: Model, ranges: int) -> tuple[pa.Table, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """A chunk's documents, their keys as places among the distinct ones, where each document's start, and the distinct ones as they are sent."""
    docs = C.read_chunk(uri)
    found, starts = model.keys(docs.column("text").combine_chunks().cast(pa.large_string()))
    coded = found.dictionary_encode()
    order, cuts = dealt(coded.dictionary, ranges)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return docs, pa.array(place[coded.indices.to_numpy(zero_copy_only=False)]), starts, coded.dictionary.take(pa.array(order)), cuts


def segmented(blocks: list[bytes], model: Model) -> list[bytes]:
    """Segments each distinct word of a range once; answers each block: numbers of ids, ids, places and forms of odd ones."""
    asked = [strings(np.frombuffer(lengths, np.uint32), data) for lengths, data in map(unpack, blocks)]
    coded = pa.concat_arrays(asked).dictionary_encode()
    counts, ids, odd = [], [], {}
    for at in range(0, len(coded.dictionary), BATCH):
        for i, (own, back) in enumerate(model.segment(coded.dictionary.slice(at, BATCH).to_pylist()), at):
            counts.append(len(own))
            ids.append(np.array(own, model.kind))
            if back is not None:
                odd[i] = back
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.array(np.concatenate(ids)))
    where, out = coded.indices.to_numpy(), []
    strange = np.zeros(len(counts), bool)
    strange[[*odd]] = True
    for a, n in zip(np.cumsum([0, *map(len, asked)]), map(len, asked), strict=False):
        own = where[a : a + n]
        some = np.flatnonzero(strange[own])
        out.append(pack(np.array(counts, np.uint32)[own], lists.take(pa.array(own)).flatten().to_numpy(), some.astype(np.uint32), *parts_of(pa.array([odd[i] for i in own[some].tolist()], pa.large_string()))))
    return out


def told(blocks: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """A chunk's answers, in the order of its words: numbers of ids, ids, and the forms of odd words by place."""
    counts, ids, odd, at = [np.zeros(0, np.uint32)], [np.zeros(0, model.kind)], {}, 0
    for block in blocks:
        own, flat, some, lengths, data = unpack(block)
        counts.append(np.frombuffer(own, np.uint32))
        ids.append(np.frombuffer(flat, model.kind))
        odd |= dict(zip((np.frombuffer(some, np.uint32).astype(np.int64) + at).tolist(), strings(np.frombuffer(lengths, np.uint32), data).to_pylist(), strict=True))
        at += len(counts[-1])
    return np.concatenate(counts).astype(np.int64), np.concatenate(ids), odd


def joined(docs: DataFrame, model_file: str, id_col: str, text_col: str, chunk_bytes: int, schema: str, finish: Callable[..., pa.Table]) -> DataFrame:
    """The rows that ``finish`` makes of parts of chunks: doc_id, texts, keys by document, all words, their ids and odd forms."""
    work, tasks = WorkFolder(docs.sparkSession, "pieces"), partitions(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    written = work.table(C.write_rows(rows, work.folder("chunks"), chunk_bytes), "manifest")
    deal = C.exchange(written, WORD_SHARE)
    manifest = written.select("chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("chunk").to_pylist():
                *_, words, cuts = chunk_keys(uri, model_of(model_file), deal.ranges)
                some = np.flatnonzero(np.diff(cuts))
                data = [pack(*parts_of(words.slice(int(cuts[p]), int(cuts[p + 1] - cuts[p])))) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([uri] * len(some), pa.string()), pa.array(data, pa.binary())], ["pid", "chunk", "data"])

    def segment(table: pa.Table) -> pa.Table:
        out = segmented(table.column("data").to_pylist(), model_of(model_file))
        relax()
        return pa.table({"pid": table.column("pid"), "chunk": table.column("chunk"), "data": pa.array(out, pa.binary())})

    def finished(table: pa.Table) -> pa.Table:
        model = model_of(model_file)
        texts, keys, starts, words, _ = chunk_keys(table.column("chunk")[0].as_py(), model, deal.ranges)
        answers = table.filter(pc.greater_equal(table.column("pid"), 0)).sort_by("pid")
        counts, ids, odd = told(answers.column("data").to_pylist(), model)
        ends = np.concatenate([[0], np.cumsum(counts)])
        sizes, out, a = pc.binary_length(texts.column("text")).to_numpy(), [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), PART_BYTES, side="right")) + a)
            out.append(finish(texts.slice(a, b - a), keys.slice(starts[a], starts[b] - starts[a]), starts[a : b + 1] - starts[a], words, (ends, ids, odd)))
            a = b
        relax()
        return pa.concat_tables(out)

    # Chunks are few bytes here but much work: dealt out by number, or adaptive execution would join them to a few tasks.
    asked = manifest.repartition(tasks).mapInArrow(lean(ask), C.BLOCK_SCHEMA)
    answers = asked.groupBy("pid").applyInArrow(segment, C.BLOCK_SCHEMA)
    both = answers.unionByName(manifest.select(F.lit(-1).alias("pid"), "chunk", F.lit(b"").alias("data")))
    result = work.table(both.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(finished, f"doc_id {kind}, {schema}"), "result")
    work.drop("chunks", "manifest")
    return result


def decoded(texts: pa.Array, keys: pa.Array, starts: np.ndarray, words: pa.Array, odd: dict[int, str]) -> Iterator[str]:
    """What decode() makes of each text's ids: the text, but for odd words."""
    strange = np.isin(keys.to_numpy(), np.array([*odd], np.int64)) if odd else np.zeros(len(keys), bool)
    counts = np.concatenate([[0], np.cumsum(strange)])
    some = counts[starts[1:]] > counts[starts[:-1]]
    for text, a, b, rare in zip(texts.to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), some.tolist(), strict=True):
        if rare:
            own = keys.slice(a, b - a)
            forms = words.take(own).to_pylist()
            yield "".join([odd[i] if i in odd else own_form(w) for i, w in zip(own.to_pylist(), forms, strict=True)])[1:]
        else:
            yield text


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids array<int> with the end id, decoded string; see :func:`token_digests`."""
    eos = model_of(model_file).eos

    def finish(part: pa.Table, keys: pa.Array, starts: np.ndarray, words: pa.Array, table: tuple) -> pa.Table:
        ends, ids, odd = table
        places = keys.to_numpy()
        own = [np.concatenate([*(ids[ends[i] : ends[i + 1]] for i in places[a:b]), [eos]]).astype(np.int32) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        back = decoded(part.column("text"), keys, starts, words, odd)
        return pa.table({"doc_id": part.column("doc_id"), "ids": pa.array(own, pa.list_(pa.int32())), "decoded": pa.array(list(back), pa.string())})

    return joined(docs, model_file, id_col, text_col, chunk_bytes, "ids array<int>, decoded string", finish)


def token_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Documents are put into chunk files. Each chunk sends its distinct marked words, once each, to the tasks of their
    key ranges; there every distinct word of the corpus is segmented once, and the ids go back to the chunks that have
    it, which put them together by position. Texts are not shuffled; a word costs a few bytes per chunk that has it.

    Null text counts as empty: the end id alone. Rows that repeat an id each give a row, null ids too. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    eos = model_of(model_file).eos
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def finish(part: pa.Table, keys: pa.Array, starts: np.ndarray, words: pa.Array, table: tuple) -> pa.Table:
        ends, ids, odd = table
        used = pc.unique(keys)
        decimals = pa.array([str(i) for i in range(len(model_of(model_file).names))], pa.large_string())
        lists = pa.LargeListArray.from_arrays(ends, pa.array(ids)).take(used)
        names = pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, decimals.take(lists.flatten())), BLANK)
        each = names.take(pc.index_in(keys, used))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(starts, each), BLANK).to_pylist()
        sums = np.concatenate([[0], np.cumsum(np.diff(ends)[keys.to_numpy()])])
        back = decoded(part.column("text"), keys, starts, words, odd)
        return pa.table({
            "doc_id": part.column("doc_id"), "n_tokens": pa.array(sums[starts[1:]] - sums[starts[:-1]] + 1, pa.int64()),
            "ids_sha256": pa.array([sha(f"{t} {eos}" if t else str(eos)) for t in texts], pa.string()), "decoded_sha256": pa.array([sha(t) for t in back], pa.string()),
        })

    return joined(docs, model_file, id_col, text_col, chunk_bytes, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", finish)
