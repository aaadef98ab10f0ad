"""A rate limit over an unordered stream: events wait until no earlier one can come, and are then decided in order.

Clients are dealt out to shards by a hash. Each shard has two states: events that wait, and the times of those let through that
are still in their client's window; both are kept in lists, so that a batch costs a few calls of the state store a shard, and none
a client. A timer on event time stands at the shard's earliest waiting event. When the watermark has passed it, all events up to
the watermark are decided, each client's in the order of time and id, so batches may bring events in any order within the delay.
A shard that has been quiet for a window after its last event has no state left.

An event that comes after the watermark has passed its time is late: Spark leaves it out, so it gets no decision and counts
against nothing; ``numRowsDroppedByWatermark`` in the query's progress says how many were. Events later than the watermark
wait for it, at the end of a stream too; ``closing`` is a row that brings it on. Events without a time or client get no
decision either. Memory of a task: the events of one shard that come within the delay, and what its shards decide in a batch.
A batch in which events of a shard are due writes those that wait there again; more ``shards`` make both less.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import _allow

EVENT = "user_id long, event_id long, ts timestamp"
DECIDED = f"{EVENT}, allowed boolean, retry_after int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Shards of clients; a stream that has begun keeps the number it began with.
SHARDS = 1024
#: Events in one value of a state or one row of the result, at most.
PART = 10_000


def _columns(rows: Iterator[tuple]) -> Iterator[tuple[list, ...]]:
    """Rows as lists of their columns, some at a time."""
    rows = iter(rows)
    while part := list(islice(rows, PART)):
        yield tuple(map(list, zip(*part)))


def _place(event: tuple) -> tuple:
    """By client, time and id; events without an id come first."""
    user, at, event_id = event
    return user, at, event_id is not None, event_id or 0


class InOrder(StatefulProcessor):
    """Decides the events of a shard's clients in the order of their times."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "users array<long>, ats array<long>, events array<long>")
        self.kept = handle.getValueState("kept", "users array<long>, times array<double>")

    def _wake(self, at: int) -> None:
        """One timer a shard: the earliest."""
        timers = list(self.handle.listTimers())
        ms = at // 1000
        if not timers or ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = []
        for new in _columns((r["user_id"], r["at"], r["event_id"]) for r in rows if r["user_id"] is not None):
            self.waiting.appendValue(new)
            first.append(min(new[1]))
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for part in self.waiting.get():
            for x in zip(*part):
                (due if x[1] <= passed else later).append(x)
        due.sort(key=_place)
        times: dict[int, list[float]] = {}
        for user, t in zip(*self.kept.get()) if self.kept.exists() else ():
            times.setdefault(user, []).append(t)

        def decided() -> Iterator[tuple]:
            for user, at, event in due:
                allowed, retry, times[user] = _allow(times.get(user, []), at / 1e6, self.limit, self.window)
                yield user, event, at, allowed, retry

        for users, events, ats, allowed, retry in _columns(decided()):
            yield Row(user_id=users, event_id=events, at=ats, allowed=allowed, retry_after=retry)
        still = [(user, t) for user, kept in times.items() for t in kept if t > passed / 1e6 - self.window]
        if later:
            self.waiting.put(list(_columns(later)))
        elif due:
            self.waiting.clear()
        if still:
            self.kept.update(tuple(map(list, zip(*still))))
        elif self.kept.exists():
            self.kept.clear()
        # wakes for the next event, or to forget the last time in a window
        if later:
            self.handle.registerTimer(min(at for _, at, _ in later) // 1000)
        elif still:
            self.handle.registerTimer(int((max(t for _, t in still) + self.window) * 1000) + 1)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, limit: int = 60, window: float = 60.0, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """(user_id, event_id, ts, allowed, retry_after) of a stream, as ``ingest.rate_limited`` gives for the finished log.

    ``delay`` is how far behind the latest event one may come. The query needs ``rocks``.
    """
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", delay)
    rows = rows.withColumns({"at": F.unix_micros("ts"), "shard": F.pmod(F.xxhash64("user_id"), F.lit(shards))})
    columns = ("user_id", "event_id", "at", "allowed", "retry_after")
    decided = "user_id array<long>, event_id array<long>, at array<long>, allowed array<boolean>, retry_after array<int>"
    out = rows.groupBy("shard").transformWithState(InOrder(limit, window), decided, "append", "EventTime")
    out = out.select(F.inline(F.arrays_zip(*columns)))
    return out.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "allowed", "retry_after")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def closing(spark: SparkSession, last, delay: str, window: float) -> DataFrame:
    """A row of no client, later than ``last`` by the delay and the window: what waits is decided once it has come."""
    row = spark.createDataFrame([(None, None, last)], EVENT)
    return row.withColumn("ts", F.expr(f"ts + interval {delay} + make_interval(0, 0, 0, 0, 0, 0, {window} + 1)"))


def decide(spark: SparkSession, source: str, target: str, checkpoint: str, limit: int, window: float, delay: str) -> StreamingQuery:
    """Takes all events that are new in ``source`` since the last call and appends what is decided to ``target``.

    The checkpoint has the state between calls. Gives the finished query.
    """
    stream = spark.readStream.schema(EVENT).parquet(source)
    with rocks(spark):
        query = in_order(stream, limit, window, delay).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query
