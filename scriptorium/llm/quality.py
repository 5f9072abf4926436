"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in turn, add up to one lookup table per feature (and per chosen pair
of features); a document's score is the sum of its bins' entries through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import lean, slices
from scriptorium.llm.language import remainder

#: At most so many labelled rows, the first by hash of their id, are used to fit the model.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "marks", "exclamations", "bars", "commas_stops",
    "line_length", "distinct_words", "distinct_lines", "non_ascii_letters", "other", "repeated_marks",
)
UPPER, LOWER, DIGIT, SPACE, LINE, MARK, EXCLAIM, BAR, STOP, HIGH_LETTER, REST = range(11)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character class by code point."""
    out = np.full(0x110000, REST, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = (UPPER if c.isupper() else LOWER) if i < 128 else HIGH_LETTER
    out[48:58] = DIGIT
    out[[9, 11, 12, 13, 32]] = SPACE
    out[10] = LINE
    for kind, marks in ((MARK, "#$%&*@^~<>{}[]\\=_+/"), (EXCLAIM, "!?"), (BAR, "|"), (STOP, ".,;:")):
        out[[ord(c) for c in marks]] = kind
    return out


def features(texts: list[str]) -> np.ndarray:
    """One row per text, columns as FEATURES; all from the whole text alone."""
    n, lengths = len(texts), np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    ends = np.cumsum(lengths + 1)
    doc = np.repeat(np.arange(n), lengths + 1)
    real = np.ones(len(points), bool)
    real[ends - 1] = False
    counts = np.bincount(doc[real] * 11 + kind[real], minlength=11 * n).reshape(n, 11).astype(float)
    marked = ((kind == MARK) | (kind == EXCLAIM)) & real
    again = marked[1:] & marked[:-1] & (points[1:] == points[:-1])
    repeated = np.bincount(doc[1:][again], minlength=n)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], float)
    n_distinct = np.array([len(set(w)) for w in words], float)
    lines = [t.split("\n") for t in texts]
    chars, letters = np.maximum(lengths, 1), np.maximum(counts[:, UPPER] + counts[:, LOWER] + counts[:, HIGH_LETTER], 1)
    some = np.maximum(n_words, 1)
    return np.column_stack([
        np.log1p(lengths), np.log1p(n_words), (lengths - counts[:, SPACE] - counts[:, LINE]) / some, counts[:, UPPER] / letters, counts[:, DIGIT] / chars,
        counts[:, MARK] / some, counts[:, EXCLAIM] / some, counts[:, BAR] / some, counts[:, STOP] / some,
        lengths / np.array([len(x) for x in lines], float), n_distinct / some, np.array([len(set(x)) / len(x) for x in lines]),
        counts[:, HIGH_LETTER] / letters, counts[:, REST] / chars, repeated / some,
    ])


@dataclass
class AdditiveModel:
    """intercept + a table per feature + a table per pair of features; ``edges`` are the bins' upper bounds."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for j, table in enumerate(self.single):
            out += table[bins[:, j]]
        for (i, j), table in self.pairs.items():
            out += table[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def tree(gradient: np.ndarray, weight: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """A tree over the bins of one feature, as the value of each bin: each split takes the best Newton gain."""
    total_g, total_w = gradient.sum(), weight.sum()
    if depth and len(gradient) > 1:
        g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        gain = g**2 / (w + ridge) + (total_g - g) ** 2 / (total_w - w + ridge) - total_g**2 / (total_w + ridge)
        gain[(w < least) | (total_w - w < least)] = -1
        if gain.max() > 1e-9:
            cut = int(gain.argmax()) + 1
            return np.concatenate([tree(gradient[:cut], weight[:cut], depth - 1, least, ridge), tree(gradient[cut:], weight[cut:], depth - 1, least, ridge)])
    return np.full(len(gradient), total_g / (total_w + ridge))


def pair_tree(gradient: np.ndarray, weight: np.ndarray, least: float, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut of either feature, giving four leaves over the grid of a pair, and its gain."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def leaves(s: np.ndarray) -> list[np.ndarray]:
        inner, right, low = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
        return [inner, right - inner, low - inner, s[-1, -1] - right - low + inner]

    gs, ws = leaves(g), leaves(w)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, ws, strict=True))
    gain = np.where(np.minimum.reduce(ws) < least, -1, gain)
    if not gain.size or gain.max() <= 0:
        return np.zeros_like(gradient), 0.0
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    a, b, c, d = (x[i, j] / (y[i, j] + ridge) for x, y in zip(gs, ws, strict=True))
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = a, b, c, d
    return out, float(gain.max() - g[-1, -1] ** 2 / (w[-1, -1] + ridge))


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 48, rounds: int = 100, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, least: float = 0.5, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets one shallow tree on the present residuals.

    Then the pairs that explain most of what is left are chosen and boosted the same way. Without rows the score
    is 0.5; with one label only, the intercept alone decides.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.array([]) for j in range(len(FEATURES))]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(edges, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges])
    if len(set(y.tolist())) < 2:
        return model
    bins, raw = model.bins(x), np.full(len(x), model.intercept)
    sizes = [len(t) for t in model.single]

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, size in enumerate(sizes):
            g, w = residuals()
            step = rate * tree(np.bincount(bins[:, j], g, size), np.bincount(bins[:, j], w, size), 2, least, ridge)
            model.single[j] += step
            raw = raw + step[bins[:, j]]
    grids = {(i, j): (bins[:, i] * sizes[j] + bins[:, j], (sizes[i], sizes[j])) for i, j in combinations(range(len(sizes)), 2)}

    def grown(pair: tuple[int, int], g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        cell, shape = grids[pair]
        size = shape[0] * shape[1]
        return pair_tree(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, w, size).reshape(shape), least / 100, ridge)

    g, w = residuals()
    strength = {p: grown(p, g, w)[1] for p in grids}
    chosen = sorted(p for p in sorted(strength, key=lambda p: (-strength[p], p))[:n_pairs] if strength[p] > 0)
    model.pairs = {p: np.zeros(grids[p][1]) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            step = rate * grown(p, *residuals())[0]
            model.pairs[p] += step
            raw = raw + step.ravel()[grids[p][0]]
    return model


def document_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = features([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(compute), f"doc_id {dict(docs.dtypes)[id_col]}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits on at most ``most`` labelled rows whose crc32(doc_id) modulo 5 isn't 0.

    They are the first by hash of the id, so that the choice doesn't depend on order or partitions. Of several
    labels of an id the least counts. The sample's ids (two numbers a row, ``most`` rows at most) are broadcast.
    """
    one = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).filter((remainder(F.col("_id"), 5) != 0) & F.col("_label").isNotNull())
    chosen = one.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")
    # An id that several rows have counts once, by its least features: at most ``most`` rows, whatever the order.
    one = document_features(sample, "doc_id", "text").groupBy("doc_id").agg(F.min("x").alias("x"))
    found = one.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "x", "_label").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["_label"].to_numpy(float))


def score_documents(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one map, the text is the only input of a score."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = features([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(compute), f"doc_id {dict(docs.dtypes)[id_col]}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text is scored as empty text. A null id is never held out. Rows that repeat an id each give a row.
    Without labelled rows all scores are 0.5. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    return score_documents(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
