"""Event streams: windows with watermarks, sessions, and rate limits by state.

A stream is read from files and run until all that is there has been taken
(``availableNow``); results go to files in the shared folder. What a watermark
has not closed yet is not in the result, as in any append stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.session import own_dir


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The events of a folder as a stream, with ``ts`` in UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and give what it wrote."""
    spark = stream.sparkSession
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Counts and sums by kind in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """Sessions of users, closed by a gap."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def consume(stamps: list[float], level: float, last: float | None, rate: float, capacity: float) -> tuple[list[bool], float, float | None]:
    """A token bucket: whether each event, in order of time, is let through."""
    out = []
    for t in stamps:
        if last is not None:
            level = min(capacity, level + (t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(level >= 1)
        level -= out[-1]
    return out, level, last


_LIMITED = "event_id long, user_id long, allowed boolean"


def rate_limited(events: DataFrame, rate: float, capacity: float) -> DataFrame:
    """Each event with whether its user's bucket allowed it; works on a stream,
    with the level of the bucket as state, and on a table."""
    if not events.isStreaming:
        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
            ok, _, _ = consume([t.timestamp() for t in pdf["ts"]], capacity, None, rate, capacity)
            return pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "allowed": ok})

        return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandas(batch, _LIMITED)

    def step(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        ok, level, last = consume([t.timestamp() for t in pdf["ts"]], level, last, rate, capacity)
        state.update((float(level), last))
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "allowed": ok})

    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(
        step, _LIMITED, "level double, last double", "append", GroupStateTimeout.NoTimeout)
