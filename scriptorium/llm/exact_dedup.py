"""Exact deduplication with skew-safe combining, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WorkFolder, ascii_lower, salted_lookup


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Each map task first keeps one row per text (the
    partial aggregation), then (digest, salt) groups are merged, then the salts' winners are combined; the
    text itself is a grouping key at each of these stages, so equal digests alone never merge two texts. A
    hot text reaches a merge as one row per map task, and the last combine as one row per salt. Only the
    narrow (id, digest) rows are then matched with groups of two or more, over salted sub-keys.

    A null text counts as empty. A null id never wins over another; in a group of null ids only, keep_id is
    null and the rows are kept. Rows that repeat an id and text count in group_size and are all marked alike.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    merged = (
        rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    winners = merged.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    # Texts that share a SHA-256 digest would need the text in the key; the check, of all digests, makes that visible.
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint")
    groups = (
        winners.groupBy("_digest")
        .agg(F.max("_keep").alias("_keep"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_texts"))
        .select("_digest", "_keep", F.when(F.col("_texts") > 1, clash).otherwise(F.col("_size")).alias("_size"))
        .filter("_size > 1")
    )
    narrow = WorkFolder(docs.sparkSession, "exact-dedup").table(rows.select("_id", "_digest"), "digests")
    matched = salted_lookup(narrow, groups, ["_digest"], F.col("_id"), salts, used_only=True)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return matched.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
