"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.work import WorkFolder

#: Local row numbers take the low bits of monotonically_increasing_id(), the partition the rest.
LOCAL_BITS = 33


def ranked(rows: DataFrame, order: Sequence[Column], rank: str = "_rank", whole: str | None = None, by: Sequence[str] = (), total: str | None = None, running: str | None = None) -> DataFrame:
    """Adds each row's place, from 0, in the order (of its group); with ``whole`` the number of rows, too.

    With ``total``, a column of numbers, ``running`` is its sum over the rows before. Rows are dealt out by range, which
    splits a large group over many tasks, and are written so that they stay where they are; a row per task and group
    then tells where each part starts. Only these rows meet in a window, as many as there are partitions and groups.
    """
    keys = [*(F.col(c) for c in by), *order]
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    parts = WorkFolder(spark, "ranked").table(dealt.withColumn("_at", F.monotonically_increasing_id()), "parts")
    sums = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *([F.sum(total).alias("_sum")] if total else [])]
    sizes = parts.groupBy(*by, F.shiftright("_at", LOCAL_BITS).alias("_part")).agg(*sums)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_whole", F.sum("_n").over(W.partitionBy(*by)))
    if total:
        starts = starts.withColumn("_sums", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    starts = starts.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("_part").alias("_p"), "_first", "_before", "_whole", *(["_sums"] if total else []))
    same = F.shiftright("_at", LOCAL_BITS) == F.col("_p")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    placed = parts.join(F.broadcast(starts) if not by else starts, same).withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first"))
    if whole:
        placed = placed.withColumn(whole, F.col("_whole"))
    if total and running:
        local = W.partitionBy("_p", *names.values()).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        placed = placed.withColumn(running, F.col("_sums") + F.coalesce(F.sum(total).over(local), F.lit(0)))
    return placed.drop("_at", "_p", "_first", "_before", "_whole", "_sums", *names.values())


def every_kth(rows: DataFrame, order: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows k, 2k, ... of each group's order."""
    return ranked(rows, [F.col(order)], "_rank", by=by).filter((F.col("_rank") + 1) % max(k, 1) == 0).drop("_rank")
