"""Queries on the event table, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import events as E
from scriptorium.plans.documents import table
from scriptorium.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _summary(by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}count(*) AS runs, count(value) AS measured, round(coalesce(sum(value), 0.0), 5) AS total, round(coalesce(avg(value), 0.0), 5) AS mean, quantile_disc(value, 0.95) AS p95 FROM events {'GROUP BY ' + by if by else ''}"


@query(_summary())
def a11_summary(spark, sf_dir):
    return E.summary(table(spark, sf_dir, "events"))


@query(_summary("event_type"))
def a12_breakdown(spark, sf_dir):
    return E.summary(table(spark, sf_dir, "events"), by=("event_type",))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS runs, round(sum(value), 5) AS total, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2")
def a13_daily(spark, sf_dir):
    return E.daily(table(spark, sf_dir, "events"), by=("event_type",))


@query("WITH e AS (SELECT *, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER () AS last FROM events) SELECT day, event_type, count(*) AS runs, round(sum(value), 5) AS total, round(avg(value), 5) AS mean FROM e WHERE day > last - 7 GROUP BY 1, 2")
def a13_last_week(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    last = rows.agg(F.max(F.to_date("ts"))).first()[0]
    return E.daily(rows, by=("event_type",), days=7, today=F.lit(last))


@query(
    """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS stored, count(*) AS entries FROM events GROUP BY user_id) SELECT user_id, epoch_us(stored) AS stored, entries FROM l, n WHERE epoch_us(now) - epoch_us(stored) < 172800000000 ORDER BY l.stored DESC, user_id LIMIT 25"""
)
def z3_cached(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts")
    now = rows.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return E.cached(rows, "user_id", "ts", F.lit(now), 172_800, 25).select("user_id", F.unix_micros("stored").alias("stored"), "entries")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def w8_recent(spark, sf_dir):
    return E.recent(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 3, "user_id", [F.desc("ts"), F.desc("event_id")])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 86400000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session"""
)
def sessions(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 86400)


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
r AS (SELECT event_id, user_id, ts, n, ms + 86400000 AS ends, 1 AS used, true AS allowed FROM e WHERE n = 1 UNION ALL
SELECT e.event_id, e.user_id, e.ts, e.n, CASE WHEN e.ms >= r.ends THEN e.ms + 86400000 ELSE r.ends END, CASE WHEN e.ms >= r.ends THEN 1 WHEN r.used < 3 THEN r.used + 1 ELSE r.used END, e.ms >= r.ends OR r.used < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, ts, allowed, CAST(3 - used AS INTEGER) AS remaining FROM r"""
)
def z1_rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return E.limited(rows, "user_id", "ts", "event_id", 3, 86_400_000)


@query("SELECT event_id, round(ceil(value * 1.35::DOUBLE) / 1000.0::DOUBLE * CASE event_type WHEN 'click' THEN 0.005::DOUBLE WHEN 'purchase' THEN 0.006 ELSE 0.0015 END, 9) AS cost, abs(value - 50) * 2 AS sure, CASE WHEN abs(value - 50) * 2 >= 75 THEN 'high' WHEN abs(value - 50) * 2 >= 45 THEN 'medium' ELSE 'low' END AS band FROM events")
def x20_x21_cost(spark, sf_dir):
    sure, band = X.confidence(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", X.run_cost(F.col("value"), F.col("event_type"), {"click": 0.005, "purchase": 0.006}, 0.0015, digits=9).alias("cost"), sure.alias("sure"), band.alias("band"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS runs, round(sum(value), 5) AS total FROM events GROUP BY 1, 2")
def z5_streaming_daily(spark, sf_dir):
    """The daily rollup as a stream over the table's files, run to the end of the input."""
    return streams.run_to_end(streams.daily_rollup(streams.read_table(spark, f"{sf_dir}/events.parquet")), "complete").select(F.to_date("day").alias("day"), "event_type", "runs", F.round("total", 5).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events GROUP BY event_id, user_id, event_type")
def z4_streaming_dedupe(spark, sf_dir):
    """Events read as a stream with each event given twice, and kept once."""
    rows = streams.read_table(spark, f"{sf_dir}/events.parquet")
    return streams.run_to_end(streams.deduplicated(rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy"), "event_id"), "append").select("event_id", "user_id", "event_type")
