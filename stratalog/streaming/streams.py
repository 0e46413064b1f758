"""The catalog's growth as streams: discovery, deduplication, sessions, journals, drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import SESSION_STALE, metadata_equal


def discover(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as they appear; the limit is the source's back-pressure."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def dedup_chunks(refs: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first reference to each chunk; state older than the watermark goes."""
    return refs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["chunk_id"])


def session_windows(beats: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "45 minutes", delay: str = "0 seconds") -> DataFrame:
    """Sessions that end after a gap, by event time."""
    w = beats.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w"))
    return w.agg(F.count("*").alias("beats"), F.min(time).alias("registered"), F.max(time).alias("last_refresh")).drop("w")


def session_state(beats: DataFrame, seconds: int = SESSION_STALE) -> DataFrame:
    """(user_id, beats, last_refresh, event): a row when a session is registered, and one when it goes stale, by keyed state and event-time timeouts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "beats": [n], "last_refresh": [pd.Timestamp(last, unit="us")], "event": ["stale"]})
            return
        n, last = state.getOption or (0, 0)
        new = n == 0
        for f in frames:
            n += len(f)
            last = max(last, int(f.ts.max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if new:
            yield pd.DataFrame({"user_id": [key[0]], "beats": [n], "last_refresh": [pd.Timestamp(last, unit="us")], "event": ["registered"]})

    return beats.select("user_id", "ts").withWatermark("ts", "0 seconds").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, beats bigint, last_refresh timestamp, event string", "n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


#: Seconds after its first blob at which an open pack is flushed.
PACK_AGE = 300


def pack_ages(blobs: DataFrame, seconds: int = PACK_AGE, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(user_id, began, blobs): packs closed by age, whether a later blob comes or only the time passes; began in microseconds."""
    limit = seconds * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, n = state.getOption or (0, 0)
        done = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [k[0]], "began": [began], "blobs": [n]})
            return
        times = sorted(t for f in frames for t in (f.ts.astype("datetime64[us]").astype("int64")).tolist())
        for t in times:
            if n and t - began > limit:
                done.append((k[0], began, n))
                n = 0
            if not n:
                began = t
            n += 1
        state.update((began, n))
        state.setTimeoutTimestamp(max((began + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "began", "blobs"])

    rows = blobs.select(F.col(key).alias("user_id"), F.col(time).alias("ts")).withWatermark("ts", "0 seconds")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, began bigint, blobs bigint", "began bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def journal(stream: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame, int], None] | None = None):
    """Write each micro-batch under its number, so that one that is replayed after a crash replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if apply is not None:
            apply(batch, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def drifted(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files read whole, and those that changed while they were read, which go to a side output."""
    same = metadata_equal("before_", "after_")
    return reads.where(same), reads.where(~same)


def drain(writer) -> None:
    """Run a stream until its present input is used up."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
