"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.work import WorkFolder


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream; its schema is read from it."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString()) if single else reader.parquet(path)


def daily_rollup(events: DataFrame, ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """Runs and total per day and type; days older than the watermark are dropped from state."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return rows.groupBy(F.window("_ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "runs", "total")


def windowed(events: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Sliding windows."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return rows.groupBy(F.window("_ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("runs")).select("w.start", "w.end", "runs")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """The first event of a key; keys are forgotten once the watermark is past them."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark([key])


def limited(events: DataFrame, key: str, ts: str, most: int, window_ms: int, delay: str = "1 minute") -> DataFrame:
    """A fixed window per key anchored at its first event; state goes when the watermark is past the window."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, ends = state.get if state.exists else (0, 0)
        for part in parts:
            out = []
            for t in part.sort_values("ms")["ms"]:
                if t >= ends:
                    count, ends = 0, int(t) + window_ms
                out.append((k[0], int(t), count < most, max(most - count - 1, 0)))
                count += count < most
            yield pd.DataFrame(out, columns=["key", "ms", "allowed", "remaining"])
        state.update((count, ends))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("_ts")).withColumn("ms", F.unix_millis("_ts")).withWatermark("_ts", delay)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ms bigint, allowed boolean, remaining int", "count int, ends bigint", "append", GroupStateTimeout.EventTimeTimeout)


def frames(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Complete frames, which end in a blank line, of text that comes in pieces; the rest stays in state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else ""
        for part in parts:
            *done, rest = (rest + "".join(part["text"])).split("\n\n")
            yield pd.DataFrame({"key": [k[0]] * len(done), "frame": done})
        state.update((rest,))

    rows = chunks.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, frame string", "rest string", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all input there is, and reads its result: files below the shared root, written by the executors.

    A stream in complete mode writes its whole result at each end of a batch; the last one counts.
    """
    spark = stream.sparkSession
    work = WorkFolder(spark, "stream")
    out, checkpoint = f"{work.path}/out", f"{work.path}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
