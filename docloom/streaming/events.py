"""Event-time streams over the event table: windows, sessions, deduplication, and job state with timers.

Each function takes a streaming or a batch frame; on a batch frame it gives the result that the stream has in the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.jobs import COMPLETED, FAILED, LEASE, PROCESSING, Job

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream over the event files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling or sliding windows; later events than the watermark are dropped by a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user without a gap."""
    rows = _timed(events, late).where(F.col("user_id").isNotNull()).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


class JobProcessor(StatefulProcessor):
    """The job state of operators.jobs, kept for each job; a timer expires leases in event time and emits the state when it changes."""

    FIELDS = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("attempts", T.IntegerType()), ("deadline", T.DoubleType()), ("n_events", T.LongType()), ("n_ignored", T.LongType()), ("n_expired", T.LongType()))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", self.FIELDS)

    def _load(self) -> Job:
        return Job(*self.state.get()) if self.state.exists() else Job()

    def _emit(self, key, job: Job) -> Iterator[pd.DataFrame]:
        self.state.update(job.row())
        yield pd.DataFrame([(key[0], job.status, job.attempts, job.n_events)], columns=["job_id", "status", "attempts", "n_events"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        job = self._load()
        batch = pd.concat(list(rows))
        for at, event in batch.sort_values(["at", "event_id"])[["at", "event"]].itertuples(index=False):
            job.apply(at, event)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if job.status == PROCESSING:
            self.handle.registerTimer(int(job.deadline * 1000))
        yield from self._emit(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        job = self._load()
        if job.status == PROCESSING:
            job.n_expired += 1
            job.fail()
        yield from self._emit(key, job)

    def close(self) -> None:
        pass


__all__ = ["COMPLETED", "EVENTS", "FAILED", "LEASE", "JobProcessor", "deduplicated", "event_stream", "sessions", "windowed"]
