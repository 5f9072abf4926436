"""A corpus pipeline: each stage applies one training-data operator to all that the stage before it kept.

Part of subpackage llm. A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup, language, mixing, ngram_join, pieces
from scriptorium.llm.common import WorkFolder, free_name
from scriptorium.llm.queries import piece_model
from scriptorium.session import prepare

#: Documents whose text is less like its language's profile than this are rejected, as are those without letters: four
#: standard deviations of what unrelated texts have by chance.
LEAST_LIKENESS = 4 / language.DIMENSIONS**0.5
#: Texts of fewer distinct trigrams are too short to judge, and stay.
FEW_TRIGRAMS = 20


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; the text alone decides. Null texts and those without a letter go."""
    prepare(spark)
    train = F.coalesce(language.remainder(F.col("doc_id"), 3) != 1, F.lit(True))
    profiles = language.learn(docs, "text", "lang", train)
    if not profiles.languages:  # nothing to learn from: no ground to reject anything
        return docs
    return language.keep_known(docs, profiles, "text", LEAST_LIKENESS, FEW_TRIGRAMS)


#: Folders of the stage before; see :func:`keyed`.
SERVED: list[WorkFolder] = []


def keyed(spark: SparkSession, docs: DataFrame, stage: str) -> tuple[DataFrame, str, WorkFolder]:
    """The rows with a number of their own each, written so that it stays, and its column: ids may be null and rows may repeat.

    What an earlier stage wrote so goes now: a stage's result is written before the next one begins.
    """
    while SERVED:
        SERVED.pop().drop("keyed", "kept")
    row, work = free_name(docs, "_row"), WorkFolder(spark, stage)
    SERVED.append(work)
    return work.table(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row, work


def one_of_each(docs: DataFrame, row: str, groups: DataFrame, last: bool, work: WorkFolder) -> DataFrame:
    """Of each group of rows (row, group) the one with the largest or the least doc_id; one without an id only if all are."""
    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).join(groups, "row")
    without = F.col("id").isNull()
    best = F.max(F.struct(~without, "id", "row")) if last else F.min(F.struct(without, "id", "row"))
    kept = work.table(rows.groupBy("group").agg(best.alias("best")).select(F.col("best.row").alias(row)), "kept")
    return docs.join(kept.hint("merge"), row, "left_semi").drop(row)  # the same plan at every size: numbers of rows grow with the documents


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts one row, with the largest doc_id; null texts count as empty. All columns stay as they are."""
    rows, row, work = keyed(spark, docs, "exact")
    found = exact_dedup.exact_dedup(rows, row)
    return one_of_each(rows, row, found.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), last=True, work=work).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more) one row, with the least doc_id.

    Texts without words are near to none and all stay.
    """
    rows, row, work = keyed(spark, docs, "near")
    found = ngram_join.jaccard_components(rows, row, length=5, percent=80)
    return one_of_each(rows, row, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), last=False, work=work).select(*columns(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows so that sources have their target weights; a null source is a source of its own."""
    rows, row, _ = keyed(spark, docs, "mix")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))  # in the order of ids, those without last
    mixed = mixing.mix_sources(rows.select(key.alias("key"), "text", "source"), "key").filter("copies > 0")
    times = free_name(rows, "_times")
    copies = mixed.select(F.col("doc_id.row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(times))
    return rows.join(copies.hint("merge"), row).withColumn(times, F.explode(times)).select(*columns(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256 per row."""
    return pieces.token_digests(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mix),
    ("sentencepiece", piece_ids),
]

#: Language ID, the sampling of language profiles and SentencePiece are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what a stage leaves is dropped once the next has read it."""
    work = WorkFolder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
