"""Comparison of text versions: fidelity, retention, alignment, similarity search."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyarrow import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.functions import text as X
from scriptorium.operators import measures as M
from scriptorium.work import WorkFolder

#: Stop words, negations and patterns of protected spans.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to",
    "was", "were", "will", "with", "you", "your", "we", "our", "they", "them", "i", "me",
)
NEGATIONS = ("no", "not", "never", "none", "without", "cannot", "cant", "wont", "isnt", "arent", "wasnt", "werent", "dont", "doesnt", "didnt")
PROTECTED = {
    "urls": r"(?i)https?://[^\s)\]}>\"']+",
    "emails": r"(?i)[A-Z0-9][A-Z0-9._%-]{0,30}@[A-Z0-9][A-Z0-9.-]{0,30}\.[A-Z]{2,10}",
    "code": r"```[\s\S]*?```|`[^`]+`",
    "markdown": r"#{1,6}\s+\S+|\*\*[^*]{1,200}\*\*|\[[^\]]{1,200}\]\([^)]{1,200}\)",
    "tokens": r"\b(?:sk-[A-Za-z0-9_-]{8,}|[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[A-Fa-f0-9]{32,})\b",
}
NUMBER = r"[-+]?\d+(?:[.,:]\d+)*(?:%|x|×)?"
ENTITY = r"\b[A-Z][\p{L}\p{N}&.-]*(?:\s+[A-Z][\p{L}\p{N}&.-]*){0,3}"
#: Weights of the fidelity score, and what lost protected spans cost.
WEIGHTS = {"unigram": 0.28, "bigram": 0.14, "keywords": 0.22, "length": 0.08, "sentences": 0.06, "entities": 0.10, "numbers": 0.08, "negation": 0.04}
PROTECTED_COST = 0.12


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def closeness(a: Column, b: Column) -> Column:
    """Smaller over larger of two counts; 1 if both are 0."""
    return F.when(F.greatest(a, b) > 0, F.try_divide(F.least(a, b), F.greatest(a, b))).otherwise(F.lit(1.0))


def top_keywords(tokens: Column, k: int) -> Column:
    """The k most frequent tokens; ties by length, longer first, then by name."""

    @F.pandas_udf("array<string>")
    def top(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: [t for t, _ in heapq.nsmallest(k, Counter(x).items(), key=lambda c: (-c[1], -len(c[0]), c[0]))] if x is not None else [])

    return top(tokens)


def fidelity(pairs: DataFrame, a: str = "original", b: str = "rewritten") -> DataFrame:
    """Adds parts, score (0 to 100), verdict and warnings of a rewritten text against its original."""
    stop, negative = A.literal(STOPWORDS), A.literal(NEGATIONS)
    out = pairs
    for side, name in (("a", a), ("b", b)):
        text = F.coalesce(F.col(name), F.lit(""))
        out = out.withColumn(f"_t{side}", S.content_tokens(text, stop)).withColumn(f"_n{side}", extract(text, NUMBER)).withColumn(f"_e{side}", F.slice(F.filter(extract(text, ENTITY), lambda x: ~F.array_contains(stop, F.lower(x))), 1, 32))
        out = out.withColumn(f"_w{side}", F.greatest(F.size(S.blank_words(text)), F.lit(1))).withColumn(f"_s{side}", F.greatest(F.size(S.sentences_linear(text)), F.lit(1))).withColumn(f"_g{side}", S.ngrams(F.col(f"_t{side}"), 2))
        out = out.withColumn(f"_c{side}", F.size(F.filter(f"_t{side}", lambda x: F.array_contains(negative, x))))
        for kind, pattern in PROTECTED.items():
            out = out.withColumn(f"_p{side}_{kind}", F.transform(extract(text, pattern), F.lower))
    out = out.withColumn("_k", top_keywords(F.col("_ta"), 24))

    def kept(x: str, y: str) -> Column:
        return M.recalled(F.col(x), F.col(y))

    for side in "ab":
        out = out.withColumn(f"_e{side}", F.transform(f"_e{side}", F.lower)).withColumn(f"_n{side}", F.transform(f"_n{side}", F.lower))
    out = out.withColumn("_protected", F.least(*[kept(f"_pa_{k}", f"_pb_{k}") for k in PROTECTED]))
    parts = {
        "unigram": X.term_cosine(F.col("_ta"), F.col("_tb")), "bigram": X.term_cosine(F.col("_ga"), F.col("_gb")), "keywords": kept("_k", "_tb"),
        "length": closeness(F.col("_wa"), F.col("_wb")), "sentences": closeness(F.col("_sa"), F.col("_sb")),
        "entities": kept("_ea", "_eb"), "numbers": kept("_na", "_nb"), "negation": closeness(F.col("_ca"), F.col("_cb")),
    }
    for k, v in parts.items():
        out = out.withColumn(k, F.round(v, 9))
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) - (1 - F.col("_protected")) * PROTECTED_COST
    out = out.withColumn("score", X.clamp(F.floor(F.round(score * 100, 6) + 0.5)).cast("int"))
    tests = {
        "keywords": F.col("keywords") < 0.55, "length": F.col("length") < 0.55, "sentences": F.col("sentences") < 0.5, "phrases": (F.col("bigram") < 0.15) & (F.col("_wa") > 30),
        "entities": F.col("entities") < 0.8, "numbers": F.col("numbers") < 1, "negation": F.col("negation") < 1, **{k: kept(f"_pa_{k}", f"_pb_{k}") < 1 for k in PROTECTED},
    }
    warnings = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    verdict = F.when(F.col("score") >= 74, "preserved").when(F.col("score") >= 58, "review").otherwise("drift")
    return out.select(*pairs.columns, *parts, "score", verdict.alias("verdict"), warnings.alias("warnings"))


def measured_retention(a: str, b: str) -> tuple[float, float, float]:
    """Jaccard similarity of two texts' words and of their bigrams, and the closeness of their numbers of words."""
    x, y = M.WORD.findall(a.lower()), M.WORD.findall(b.lower())

    def alike(p: set, q: set) -> float:
        common = len(p & q)
        return common / (len(p) + len(q) - common) if p or q else 1.0

    return alike(set(x), set(y)), alike(set(M.grams(x, 2)), set(M.grams(y, 2))), min(len(x), len(y)) / max(len(x), len(y)) if x or y else 1.0


def retention(pairs: DataFrame, a: str = "original", b: str = "rewritten", least: float = 0.5) -> DataFrame:
    """Token, bigram and length retention; falls back to the original, with reasons joined by +, if any is too low."""
    names = ("tokens", "bigrams", "length")
    out = M.mapped(pairs, names, (), measured_retention, F.col(a), F.col(b)).select(*pairs.columns, *(F.round(f"_m.{c}", 9).alias(c) for c in names))
    reasons = F.concat_ws("+", F.array_compact(F.array(*[F.when(F.col(c) < least, F.lit(c)) for c in names])))
    return out.select(*pairs.columns, *names, reasons.alias("reasons"), F.when(reasons == "", F.col(b)).otherwise(F.col(a)).alias("chosen"))


def semantic(pairs: DataFrame, first: Column, second: Column, least: float = 0.85) -> DataFrame:
    """0.6 of one similarity and 0.4 of the other, and whether that is ``least`` or more. Models that give them are the caller's."""
    like = F.round(0.6 * first + 0.4 * second, 9)
    return pairs.withColumn("similarity", like).withColumn("passed", F.col("similarity") >= least)


def aligned_sentences(left: DataFrame, right: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Sentences of two versions side by side by position; what one lacks is null."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.posexplode(S.sentences_before_capital(F.col(text_col))).alias("pos", name))

    return rows(left, "before").join(rows(right, "after"), [key, "pos"], "full")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by key: the new row's values where it has them."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full")
    return joined.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns))


def unit_rows(vectors) -> np.ndarray:
    """Vectors as rows of length 1."""
    out = np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if len(out) else out


def best_of(like: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, ties by id: all that reach the k-th greatest are sorted, no others."""
    some = np.arange(len(like)) if len(like) <= k else np.flatnonzero(like >= np.partition(like, len(like) - k)[len(like) - k])
    return some[np.lexsort((ids[some], -like[some]))[:k]]


def nearest(queries: DataFrame, items: DataFrame, id_col: str, vector_col: str, k: int, block: int = 1024, least: float | None = None) -> DataFrame:
    """The k items most like each query by cosine (at least ``least`` if given), ties by id: an exact scan by blocks of queries.

    Queries are written to the shared folder, and tasks read them block by block: each block meets each partition of
    items as a matrix product, and leaves k items per query there, so that no pairs are shuffled beyond those.
    """
    spark = items.sparkSession
    folder = WorkFolder(spark, "nearest")
    folder.table(queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")), "queries")
    path = f"{folder.path}/queries"

    def scan(batches):
        system, root = pafs.FileSystem.from_uri(path)
        for part in batches:
            own, ids = unit_rows(part[vector_col].tolist()), part[id_col].to_numpy(np.int64)
            for asked in dataset.dataset(root, filesystem=system, format="parquet").to_batches(batch_size=block):
                names = asked.column("id").to_numpy()
                rows = []
                for q, row in zip(names.tolist(), np.round(unit_rows(asked.column("v").to_pylist()) @ own.T, 9), strict=True) if asked.num_rows and len(own) else ():
                    row[ids == q] = -2.0
                    rows += [(q, int(ids[i]), float(row[i])) for i in best_of(row, ids, k) if row[i] > -2 and (least is None or row[i] >= least)]
                yield pd.DataFrame(rows, columns=["query", "item", "similarity"]).astype({"query": "int64", "item": "int64", "similarity": "float64"})

    pairs = items.select(id_col, vector_col).mapInPandas(scan, "query bigint, item bigint, similarity double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def stepwise_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from left to right as SQL adds, so that the last digit is the same."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def best_answers(asked: np.ndarray, asked_ids: np.ndarray, known: np.ndarray, known_ids: np.ndarray, least: float, pairs: int = 16384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``asked`` the row of ``known`` with another id that is most like it, ties by id: places of both, similarities of 9 digits.

    A matrix product finds the rows that come within 1e-8 of the best; these alone are compared exactly.
    """
    norms, others = np.sqrt(stepwise_dot(asked, asked)), np.sqrt(stepwise_dot(known, known))
    like = (asked / np.where(norms > 0, norms, 1.0)[:, None]) @ (known / np.where(others > 0, others, 1.0)[:, None]).T
    like[np.isnan(like) | (asked_ids[:, None] == known_ids[None, :])] = -np.inf
    i, j = np.nonzero(like >= np.maximum(like.max(axis=1), least)[:, None] - 1e-8)
    del like
    whole = norms[i] * others[j]
    dots = np.concatenate([np.zeros(0), *(stepwise_dot(asked[i[k : k + pairs]], known[j[k : k + pairs]]) for k in range(0, len(i), pairs))])
    scaled = np.where(whole > 0, dots / np.where(whole > 0, whole, 1.0), 0.0) * 1e9
    part = np.trunc(scaled)
    exact = (part + np.copysign(np.abs(scaled - part) >= 0.5, scaled)) / 1e9
    i, j, exact = (x[exact >= least] for x in (i, j, exact))
    order = np.lexsort((np.unique(known_ids, return_inverse=True)[1][j], -exact, i))
    first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
    return i[first], j[first], exact[first]


def two_of_each(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the two least ids of each distinct row: a query's answer is among them, whatever its own id."""
    same = np.unique(rows.view(np.uint64), axis=0, return_inverse=True)[1].ravel() if rows.shape[1] else np.zeros(len(rows), np.int64)
    rank = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((rank, same))
    order = order[(np.diff(same[order], prepend=-1) != 0) | (np.diff(rank[order], prepend=-1) != 0)]
    group = same[order]
    return order[(np.arange(len(order)) < 2) | (group != np.roll(group, 2))]


def next_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The next batches, until there are ``rows`` rows."""
    got = 0
    while got < rows and (batch := next(batches, None)) is not None:
        got += batch.num_rows
        yield batch


def cached_answers(queries: DataFrame, entries: DataFrame, id_col: str, vector_col: str, options: Sequence[str], now: Column, least: float = 0.95, block: int = 256, chunk: int = 8192) -> DataFrame:
    """Of the unexpired entries with the query's options, the most alike one, if it is ``least`` or more; ties by id.

    ``entries`` has an ``expires`` column. Entries are dealt out by range of options and id, queries written in order of
    options to the shared folder: each chunk of entries reads the queries of its range, and blocks of queries meet the
    entries of their options as a matrix product. A row per query and chunk is shuffled. Vectors that are null or have
    nulls, and null options, answer nothing.
    """
    spark = entries.sparkSession
    v = F.col(vector_col)
    usable = [F.col(c).isNotNull() for c in (id_col, vector_col, *options)]

    def keyed(rows: DataFrame) -> DataFrame:
        for c in (*usable, ~F.exists(v, lambda x: x.isNull())):
            rows = rows.filter(c)
        return rows.select(F.to_json(F.array(*(F.col(o).cast("string") for o in options), F.size(v).cast("string"))).alias("key"), F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))

    q, e = keyed(queries), keyed(entries.filter(F.col("expires") > now))
    folder = WorkFolder(spark, "cached")
    folder.table(q.sort("key", "id"), "queries")
    path = f"{folder.path}/queries"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = T.StructType([T.StructField("query", q.schema["id"].dataType), T.StructField("entry", e.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])

    def by_key(rows: pa.Table) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        """The rows of each key: their ids, once for Arrow and once for NumPy, and vectors."""
        rows = rows.combine_chunks()
        for key in pc.unique(rows["key"]).to_pylist():
            own = rows.filter(pc.equal(rows["key"], key))
            ids = own["id"].combine_chunks()
            yield key, ids, ids.to_numpy(zero_copy_only=False), pc.list_flatten(own["v"]).to_numpy().reshape(len(own), -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)
        asked = dataset.dataset(root, filesystem=system, format="parquet")
        while held := list(next_batches(batches, chunk)):
            known = {}
            for key, ids, names, rows in by_key(pa.Table.from_batches(held)):
                some = two_of_each(rows, names)
                known[key] = ids.take(pa.array(some)), names[some], rows[some]
            within = (dataset.field("key") >= min(known)) & (dataset.field("key") <= max(known)) if known else None
            for batch in asked.to_batches(batch_size=block, filter=within) if known else ():
                for key, ids, names, rows in by_key(pa.Table.from_batches([batch])) if batch.num_rows else ():
                    if key in known:
                        i, j, like = best_answers(rows, names, known[key][2], known[key][1], least)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), known[key][0].take(pa.array(j)), pa.array(like)], names=["query", "entry", "similarity"])

    pairs = e.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(scan, schema)
    return pairs.groupBy("query").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("entry").alias("entry"))).alias("_b")).select("query", "_b.entry", (-F.col("_b.s")).alias("similarity"))
