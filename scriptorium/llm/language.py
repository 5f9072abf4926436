"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import lean, slices

#: Length of all vectors: the likeness of unrelated texts has a standard deviation of 1 / sqrt(DIMENSIONS), here 1/64.
DIMENSIONS = 4096
#: Letter ids take so many bits of an n-gram's code; three of them and the document's number fill 64 bits.
BITS, DOCS = 18, 1000
#: Distinct n-grams whose vectors are held at a time; those whose counts, or likenesses to profiles, a task holds.
BLOCK, HELD = 1024, 1 << 18
UNDETERMINED = "und"
#: What bounds the vectors that the driver collects and tasks get: 32 MB.
MOST_LANGUAGES = 1000


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter's id, 0 for all that isn't a letter; by id: the code point of the lower-case letter."""
    points = [i for i in range(0x110000) if chr(i).isalpha()]
    lower = {i: ord(low) if len(low := chr(i).lower()) == 1 else i for i in points}
    kinds = sorted(set(lower.values()))
    ids = np.zeros(0x110000, np.uint32)
    at = {c: k + 1 for k, c in enumerate(kinds)}
    ids[points] = [at[lower[i]] for i in points]
    return ids, np.array([0, *kinds])


@lru_cache(maxsize=4096)
def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """A random vector of -1 and 1, the same in every process."""
    bits = np.random.Generator(np.random.Philox(key=[int(letters()[1][letter]), 20_011])).integers(0, 2, dimensions, dtype=np.int8)
    return (2 * bits - 1).astype(np.float32)


def gram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Binds three letters: the product of their vectors, rotated by two, one and no places."""
    mask = (1 << BITS) - 1
    out = np.ones((len(codes), dimensions), np.float32)
    for place in (2, 1, 0):
        own, back = np.unique((codes >> np.uint64(BITS * place)) & np.uint64(mask), return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(x), dimensions), place) for x in own])[back]
    return out


def trigrams(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per (group, trigram): group, code, count; sorted by group, then code.

    Each text counts as if a blank stood at both its ends, and runs of what aren't letters as one blank, so that a
    text's trigrams are the same wherever it stands among others. A group is a document or all documents of a language.
    """
    points = np.frombuffer("".join([f"\n{t}\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = letters()[0][points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    blank = ids == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    ids, doc = ids[keep].astype(np.uint64), doc[keep]
    inner = doc[2:] == doc[:-2]
    code = ((ids[:-2] << np.uint64(2 * BITS)) | (ids[1:-1] << np.uint64(BITS)) | ids[2:])[inner]
    full, count = np.unique((groups[doc[2:][inner]].astype(np.uint64) << np.uint64(3 * BITS)) | code, return_counts=True)
    return (full >> np.uint64(3 * BITS)).astype(np.int64), full & np.uint64((1 << 3 * BITS) - 1), count


def bundle(texts: list[str], groups: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
    """Per group the sum of its trigrams' vectors; exact."""
    return bundled(*trigrams(texts, groups), n_groups, dimensions)


def bundled(group: np.ndarray, code: np.ndarray, count: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
    """Whole numbers: exact in any order of the rows, in 32-bit floats as long as a group has few enough trigrams in a block."""
    out = np.zeros((n_groups, dimensions), np.float64)
    own, back, times = np.unique(code, return_inverse=True, return_counts=True)
    place = np.empty(len(own), np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(own))  # frequent ones share a block
    names = np.empty_like(own)
    names[place] = own
    back = place[back]
    for start in range(0, len(own), BLOCK):
        vectors = gram_vectors(names[start : start + BLOCK], dimensions)
        inside = (back >= start) & (back < start + BLOCK) if len(own) > BLOCK else np.ones(len(back), bool)
        g, b, c = group[inside], back[inside] - start, count[inside]
        edges = np.searchsorted(g, np.arange(n_groups + 1))
        for k in range(n_groups):
            lo, hi = edges[k], edges[k + 1]
            if hi > lo:
                kind = np.float32 if c[lo:hi].sum() < 1 << 24 else np.float64
                out[k] += c[lo:hi].astype(kind) @ vectors[b[lo:hi]].astype(kind, copy=False)
    return out


def scale(dimensions: int) -> float:
    """Prototypes are whole numbers of this part of 1: products with vectors of -1 and 1 stay below 2^24, exact in 32-bit floats."""
    return 2.0 ** (23 - (dimensions - 1).bit_length() // 2 - (dimensions - 1).bit_length() % 2)


@dataclass
class Profiles:
    """Prototypes of the languages: rows of unit length, as whole numbers of 1 / scale(dimensions)."""

    languages: list[str]
    vectors: np.ndarray

    @classmethod
    def of(cls, sums: dict[str, np.ndarray], dimensions: int) -> Profiles:
        names = sorted(sums)
        rows = [np.round(sums[x] / max(np.linalg.norm(sums[x]), 1e-9) * scale(dimensions)) for x in names]
        return cls(names, np.array(rows, np.float32).reshape(len(names), dimensions))

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """By trigram (sorted, distinct): its vector times each profile, whole numbers. A task computes them once for each, or anew when it holds too many."""
        known, rows = self.__dict__.get("held", (np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))))
        new = np.setdiff1d(codes, known, assume_unique=True)
        if len(new):
            if len(known) + len(new) > HELD:
                known, rows, new = known[:0], rows[:0], codes
            own = [(gram_vectors(new[at : at + BLOCK], self.vectors.shape[1]) @ self.vectors.T).astype(np.float64) for at in range(0, len(new), BLOCK)]
            known, rows = np.concatenate([known, new]), np.concatenate([rows, *own])
            order = np.argsort(known)
            known, rows = known[order], rows[order]
            self.__dict__["held"] = known, rows
        return rows[np.searchsorted(known, codes)]

    def measured(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        """Per text: language, likeness to its profile (the text's length is taken from its counts), distinct trigrams.

        All sums are of whole numbers, so that equal texts have equal likenesses in whatever batch they are.
        """
        doc, code, count = trigrams(texts, np.arange(len(texts)))
        distinct = np.bincount(doc, minlength=len(texts)).tolist()
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), distinct
        own, back = np.unique(code, return_inverse=True)
        parts = self.parts(own)
        sums = np.stack([np.bincount(doc, count * parts[back, k], len(texts)) for k in range(len(self.languages))], axis=1)
        one = scale(self.vectors.shape[1]) * self.vectors.shape[1] ** 0.5
        cosine = sums / one / np.maximum(np.sqrt(np.bincount(doc, count.astype(float) ** 2, len(texts))), 1e-9)[:, None]
        has = [any(map(str.isalpha, t)) for t in texts]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)], distinct

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self.measured(texts)[:2]


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def learn(docs: DataFrame, text_col: str, lang_col: str, train: Column, dimensions: int = DIMENSIONS, most: int = MOST_LANGUAGES) -> Profiles:
    """Bundles, over all rows where ``train`` holds, each language's trigrams.

    Each task sends one partial vector per language, of whole numbers, so that sums don't depend on the order;
    what reaches the driver, and then the tasks, is one vector per language. More than ``most`` labels are an error.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> None:
            for x, (code, count) in held.items():
                sums[x] = sums.get(x, 0) + bundled(np.zeros(len(code), np.int64), code, count, 1, dimensions)[0]
            held.clear()

        for part in slices(batches, "text"):
            langs = part.column("lang").to_pylist()
            own = sorted(set(langs))
            for at in range(0, len(own), DOCS):
                some = {x: k for k, x in enumerate(own[at : at + DOCS])}
                rows = [(t, some[x]) for t, x in zip(part.column("text").to_pylist(), langs, strict=True) if x in some]
                group, code, count = trigrams([t for t, _ in rows], np.array([k for _, k in rows]))
                edges = np.searchsorted(group, np.arange(len(some) + 1))
                for x, k in some.items():
                    inside = slice(edges[k], edges[k + 1])
                    had = held.get(x, (code[:0], count[:0]))
                    codes, back = np.unique(np.concatenate([had[0], code[inside]]), return_inverse=True)
                    held[x] = codes, np.bincount(back, np.concatenate([had[1], count[inside]]), len(codes))
                if sum(len(c) for c, _ in held.values()) > HELD:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = (
        rows.mapInArrow(lean(partial), "lang string, vector array<double>")
        .select("lang", F.posexplode("vector"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("value"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vector"))  # as many as there are dimensions
        .limit(most + 1)
        .collect()
    )
    if len(sums) > most:
        raise ValueError(f"more than {most} languages: is {lang_col} the right column?")
    return Profiles.of({r["lang"]: np.array(r["vector"]) for r in sums}, dimensions)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns of ``keep``, per document: one map, the text is the only input of a prediction.

    Null text, or text without a letter: ``und`` and score 0, as for all rows if nothing was learned.
    """
    from pyspark.sql import types as T

    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    fields += [rows.schema[c] for c in keep]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for at in range(0, part.num_rows, DOCS):
                own = part.slice(at, DOCS)
                langs, scores = profiles.predict([t or "" for t in own.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *(own.column(c) for c in keep)], ["doc_id", "lang_pred", "score", *keep])

    return rows.mapInArrow(lean(label), T.StructType(fields))


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str, least: float, few: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and is as like its predicted language as ``least``.

    A text of fewer than ``few`` distinct trigrams is too short to judge, and kept if it has a letter.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            for at in range(0, part.num_rows, DOCS):
                own = part.slice(at, DOCS)
                found = profiles.measured([t or "" for t in own.column(text_col).to_pylist()])
                yield own.filter(pa.array([x != UNDETERMINED and (s >= least or n < few) for x, s, n in zip(*found, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(choose), docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from documents whose crc32(doc_id) modulo 3 isn't 1 and that have text and lang; predicts all from
    their whole texts. A null id is never held out. Rows that repeat an id each give a row. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    held_out = F.coalesce(remainder(F.col(id_col), 3) == 1, F.lit(False))
    profiles = learn(docs, text_col, lang_col, ~held_out)
    return predict(docs, profiles, id_col, text_col).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def crc(value: object) -> int:
    """What remainder() takes the modulus of, for tests."""
    return zlib.crc32(str(value).encode())
