"""Mixing sources to target weights by systematic sampling over distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD, WorkFolder, partitions
from scriptorium.operators.ranking import ranked

#: Local row numbers take the low bits of monotonically_increasing_id(), the partition the rest.
LOCAL_BITS = 33
#: More sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    capped: set[int] = set()
    while True:
        rest = sum(sizes) - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = [float(most * n) if i in capped else rest * w / weight for i, (n, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i, x in enumerate(share) if i not in capped and x > most * sizes[i]}
        if not over:
            return share
        capped |= over


def target_table(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """_source, source_size, target of a table of sources and sizes, as :func:`targets` has them, without a list of all sources.

    Weights go by a source's place among all. In rounds, sums over all sources tell what a unit of weight gets; those that
    would have more than they may are capped, which raises it for the rest, until none is.
    """
    rows = ranked(sources, [F.col("_source").asc_nulls_last()], "_place")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights)).cast("int"))
    rows = WorkFolder(sources.sparkSession, "targets").table(rows.select("_source", F.col("size").alias("source_size"), weight.cast("bigint").alias("_w")), "sources")
    capped, held = F.lit(False), -1
    while True:
        found = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(capped, most * F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0)).alias("weight"), F.count_if(capped).alias("capped"),
        ).first()
        rest, weight_left = found["all"] - found["held"], max(found["weight"], 1)
        share = (F.lit(rest) * F.col("_w")).cast("double") / F.lit(float(weight_left))
        if found["capped"] == held:  # no more than in the round before
            return rows.select("_source", "source_size", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))
        held = found["capped"]
        capped = capped | (share > most * F.col("source_size"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Every document of a source has target / source_size expected copies. Documents are put in one total order
    (source, size, id) by range partitioning, which splits a hot source over many tasks; a prefix sum over the
    small (partition, source) counts gives each row its rank in its source, hence its prefix sum of expected
    copies. With one offset per source, drawn by hash of its name, a document is emitted once per integer
    boundary its interval crosses. Ordered by size, such a sample takes of each size its share, so that the
    words taken come within about one document of the target. Nothing depends on how rows are partitioned.

    Null text: size 0. Null source: a source of its own, last. Rows that repeat an id each count. A source of
    size 0 takes nothing. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = WorkFolder(spark, "mixing")
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    # Rows that share source, size and id are told apart by where they stand, so that they too can be dealt out; which is which doesn't show.
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words.alias("_size"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col("_source").asc_nulls_last(), F.col("_size"), F.col("_id").asc_nulls_last(), F.col("_tie")]
    ordered = work.table(
        narrow.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("_tie").withColumn("_place", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_place", LOCAL_BITS).alias("_part")
    runs = work.table(
        ordered.groupBy("_source", part).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"), F.sum("_size").alias("_words")),
        "runs",
    )
    sources = work.table(runs.groupBy("_source").agg(F.sum("_words").alias("size")), "sources")
    plan = target_table(sources, weights, most)
    before = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("r")
    small = sources.count() <= BROADCAST_SOURCES  # then runs, too: at most one per source and partition boundary
    starts = starts.join(F.broadcast(plan.alias("p")) if small else plan.alias("p"), F.col("r._source").eqNullSafe(F.col("p._source"))).select(
        F.col("r._source").alias("_s"), "_part", "_first", "_before", "source_size", "target"
    )
    placed = ordered.withColumn("_part_", part).join(
        F.broadcast(starts) if small else starts, (F.col("_part_") == F.col("_part")) & F.col("_source").eqNullSafe(F.col("_s"))
    )
    rank = F.col("_before") + F.col("_place") - F.col("_first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.coalesce(F.col("_source").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.least(F.floor((rank + 1) * F.col("_rate") + offset) - F.floor(rank * F.col("_rate") + offset), F.lit(most)).cast("bigint")
    return (
        placed.withColumn("_rate", rate)
        .withColumn("copies", copies)
        .select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies")
    )
