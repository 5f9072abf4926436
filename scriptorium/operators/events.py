"""Rollups, retention and limits over event streams, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators.ranking import ranked


def summary(events: DataFrame, value: str = "value", by: tuple[str, ...] = (), share: int = 95) -> DataFrame:
    """Runs, total, mean and nearest-rank percentile, null values skipped; most runs first, then the largest total.

    The percentile is the row at its rank in a sort by range, so that no task holds a group's values.
    """
    own = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count(value).alias("measured"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 5).alias("total"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 5).alias("mean")
    )
    placed = ranked(events.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), [F.col("_v")], "_rank", "_all", by=by)
    at = placed.filter(F.col("_rank") == F.floor((F.col("_all") * share + 99) / 100) - 1).select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_v").alias(f"p{share}"))
    if not by:
        return own.join(F.broadcast(at), F.lit(True), "left")  # one row each
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return own.join(at, same, "left").drop(*(f"_b{i}" for i in range(len(by)))).orderBy(F.desc("runs"), F.desc("total"))


def daily(events: DataFrame, ts: str = "ts", value: str = "value", by: tuple[str, ...] = (), days: int | None = None, today: Column | None = None) -> DataFrame:
    """Per UTC day (and group), of the last ``days`` days up to ``today`` (the current date) if given."""
    rows = events.withColumn("day", F.to_date(ts))
    if days is not None:
        rows = rows.filter(F.col("day") > F.date_sub(F.current_date() if today is None else today, days))
    return rows.groupBy("day", *by).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum(value), 5).alias("total"), F.round(F.avg(value), 5).alias("mean"))


def cached(events: DataFrame, key: str, ts: str, now: Column, ttl_seconds: int, most: int) -> DataFrame:
    """Z3: what a cache holds at ``now``: each key's latest entry that isn't older than its time to live, the ``most`` latest of them.

    Entries are summed up per key before the shuffle; ``most`` is the cache's own bound, so that what is kept is small.
    """
    at = F.col(ts).cast("timestamp")
    last = events.filter(at <= now).groupBy(key).agg(F.max(at).alias("stored"), F.count(F.lit(1)).alias("entries")).filter(F.unix_micros(now) - F.unix_micros("stored") < ttl_seconds * 1_000_000)
    return last.orderBy(F.desc("stored"), key).limit(most)


def recent(events: DataFrame, keep: int, by: str, order: list[Column]) -> DataFrame:
    """The last ``keep`` rows of each group."""
    return events.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions: a new one starts after a gap; start, end and count of each."""
    w = W.partitionBy(by).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    marked = events.select(by, ts, new.alias("_new")).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def limited(events: DataFrame, key: str, ts: str, order: str, most: int, window_ms: int) -> DataFrame:
    """Per key a fixed window anchored at its first event lets ``most`` through; allowed and remaining per event.

    A window's end depends on the event that opened it, so a key's events are read in their order by one task,
    batch by batch with two numbers of state: memory doesn't grow with a key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, ends = None, 0, 0
        for part in batches:
            allowed, left = [], []
            for k, t in zip(part[key], part["_ms"], strict=True):
                if k != now or t >= ends:
                    now, count, ends = k, 0, t + window_ms
                ok = count < most
                count += ok
                allowed.append(ok)
                left.append(most - count)
            yield part.drop(columns="_ms").assign(allowed=allowed, remaining=left)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    ordered = events.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, "_ms", order)
    return ordered.mapInPandas(run, f"{fields}, allowed boolean, remaining int")
