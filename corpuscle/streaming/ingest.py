"""Structured Streaming: documents to chunks as they arrive, and a rate limit that remembers what it let through."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunking import OVERLAP, SIZE, chunk


def chunk_stream(spark: SparkSession, source: str, schema: T.StructType, stem: Column, target: str, checkpoint: str, size: int = SIZE, overlap: int = OVERLAP, pattern: str | None = None) -> None:
    """Chunks all files that are new since the last call and appends them to ``target``; the checkpoint is the resume state."""
    reader = spark.readStream.schema(schema).format("parquet")
    docs = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(source)
    query = chunk(docs, stem, size, overlap).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _allow(kept: list[float], at: float, limit: int, window: float) -> tuple[bool, int, list[float]]:
    kept = [t for t in kept if t > at - window]
    if len(kept) >= limit:
        return False, int(window - (at - kept[0])), kept
    return True, 0, [*kept, at]


def rate_limited(events: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """(user_id, event_id, ts, allowed, retry_after) of a finished log; what is rejected doesn't count against later events.

    Whether an event counts depends on earlier decisions, so each client's events are folded in order. State is
    carried from batch to batch of a sorted partition, so a client with very many events takes no more memory than others.
    """
    kind = events.schema["ts"].dataType.simpleString()
    ordered = events.select("user_id", "event_id", F.col("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, []
        for batch in batches:
            allowed, retry = [], []
            for u, at in zip(batch["user_id"], batch["at"]):
                if u != user:
                    user, kept = u, []
                ok, wait, kept = _allow(kept, at / 1e6, limit, window)
                allowed.append(ok)
                retry.append(wait)
            yield batch[["user_id", "event_id", "ts"]].assign(allowed=allowed, retry_after=retry)

    return ordered.mapInPandas(fold, f"user_id long, event_id long, ts {kind}, allowed boolean, retry_after int")


def rate_limited_stream(events: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """The same on a stream of events, with the accepted times of each client as state that runs out after the window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches, state: GroupState):
        kept = list(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:
                batch = batch.sort_values(["ts", "event_id"])
                allowed, retry = [], []
                for at in batch["ts"]:
                    ok, wait, kept = _allow(kept, at.timestamp(), limit, window)
                    allowed.append(ok)
                    retry.append(wait)
                yield batch[["user_id", "event_id", "ts"]].assign(allowed=allowed, retry_after=retry)
            state.update((kept,))
            state.setTimeoutDuration(int(window * 1000))
        else:
            state.remove()

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, ts timestamp, allowed boolean, retry_after int", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
