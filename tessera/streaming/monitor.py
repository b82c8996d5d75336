"""Run monitoring and sessions on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON log as a stream."""
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts per window and event type; rows later than ``late`` are dropped."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ev.groupBy(F.window("ts", every).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def trailing_counts(events: DataFrame, rows: int = 100) -> DataFrame:
    """Per run, a ring buffer of the last ``rows`` event types: n seen, share of errors."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ring = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for pdf in frames:
            for e in pdf.sort_values(["ts", "event_id"])["event"]:
                seen, ring = seen + 1, [*ring[1 - rows :], e] if rows > 1 else [e]
        state.update((seen, ring))
        yield pd.DataFrame({"run": [key[0]], "seen": [seen], "errors": [sum(e == "error" for e in ring) / max(1, len(ring))]})

    return events.groupBy("run").applyInPandasWithState(
        step, "run long, seen long, errors double", "seen long, ring array<string>", "update", GroupStateTimeout.NoTimeout
    )


def stalled(events: DataFrame, minutes: int = 15) -> DataFrame:
    """A row for each run that is silent for so long, by processing time."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "seen": [n]})
        else:
            n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
            state.update((n,))
            state.setTimeoutDuration(minutes * 60_000)

    return events.groupBy("run").applyInPandasWithState(step, "run long, seen long", "seen long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def evict(entries: list[str], budget: int) -> list[str]:
    """A session's entries after eviction: oldest first while, joined by blank lines, they
    are over the budget; a lone one keeps its tail."""
    while len(entries) > 1 and sum(map(len, entries)) + 2 * (len(entries) - 1) > budget:
        entries = entries[1:]
    return [entries[0][-budget:]] if len(entries) == 1 and len(entries[0]) > budget else entries


def session_memory(turns: DataFrame, budget: int = 12_000) -> DataFrame:
    """Per session (conv_id) the entries that fit the character budget, as state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for pdf in frames:
            for t in pdf.sort_values("turn")["text"]:
                kept = evict([*kept, t], budget)
        state.update((kept,))
        yield pd.DataFrame({"conv_id": [key[0]], "entries": [len(kept)], "chars": [sum(map(len, kept))]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, entries int, chars int", "kept array<string>", "update", GroupStateTimeout.NoTimeout)


def keyed_sink(keys: list[str], path: str):
    """A foreachBatch writer that keeps a key once over all batches: rows whose key an earlier
    batch has written are dropped, and a replayed batch overwrites its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        new, spark = df.dropDuplicates(keys), df.sparkSession
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            done = spark.read.schema(df.schema).option("basePath", path).parquet(f"{path}/batch=*").where(F.col("_metadata.file_path").rlike("/batch=[0-9]+/"))
            earlier = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long") < batch
            new = new.join(done.where(earlier).select(*keys).distinct(), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
