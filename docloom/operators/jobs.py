"""Job state over ordered events: assignment with leases, submission, failure, attempts; progress and liveness.

The state of a job depends on its own events in their order, so a job is the unit of grouping. The fold over a job's events is made in batches of a grouped map: events
come sorted and the state is a few fields, so a job of any number of events needs the memory of one batch.

Rules: `view` assigns a pending job and starts its lease; `click` extends the lease; `purchase` completes a job that is processing; `error` counts a failed attempt,
after the third of which the job has failed; `signup` creates it anew unless it is completed. A lease that has run out at the next event counts as a failed attempt. Events after completion are ignored.
Null job ids are left out; events at the same time are ordered by their id; repeated events by id count once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds of a lease, attempts of a job.
LEASE, ATTEMPTS = 600.0, 3
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"
STATE = "job_id long, status string, attempts int, deadline double, n_events long, n_ignored long, n_expired long"


class Job:
    """The state of one job."""

    __slots__ = ("status", "attempts", "deadline", "n_events", "n_ignored", "n_expired")

    def __init__(self, status=PENDING, attempts=0, deadline=0.0, n_events=0, n_ignored=0, n_expired=0):
        self.status, self.attempts, self.deadline = status, attempts, deadline
        self.n_events, self.n_ignored, self.n_expired = n_events, n_ignored, n_expired

    def fail(self) -> None:
        self.attempts += 1
        self.status = FAILED if self.attempts >= ATTEMPTS else PENDING

    def apply(self, at: float, event: str) -> None:
        self.n_events += 1
        if self.status == PROCESSING and at > self.deadline:
            self.n_expired += 1
            self.fail()
        if self.status in (COMPLETED, FAILED):
            self.n_ignored += 1
        elif event == "view" and self.status == PENDING:
            self.status, self.deadline = PROCESSING, at + LEASE
        elif event == "click" and self.status == PROCESSING:
            self.deadline = at + LEASE
        elif event == "purchase" and self.status == PROCESSING:
            self.status = COMPLETED
        elif event == "error" and self.status == PROCESSING:
            self.fail()
        elif event == "signup":
            self.status, self.attempts = PENDING, 0
        else:
            self.n_ignored += 1

    def row(self) -> tuple:
        return self.status, self.attempts, self.deadline, self.n_events, self.n_ignored, self.n_expired


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, at, event_id, event) from the event table; a user stands for a job."""
    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return rows.select(F.col("user_id").alias("job_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id", F.col("event_type").alias("event")).dropDuplicates(["event_id"])


def job_states(rows: DataFrame) -> DataFrame:
    """The final state of every job. Jobs are hashed to partitions, sorted there, and folded row by row while batches pass."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, Job()
        for batch in batches:
            done = []
            for key, at, event in zip(batch["job_id"], batch["at"], batch["event"]):
                if key != job:
                    if job is not None:
                        done.append((job, *state.row()))
                    job, state = key, Job()
                state.apply(at, event)
            yield pd.DataFrame(done, columns=[c.split()[0] for c in STATE.split(", ")])
        if job is not None:
            yield pd.DataFrame([(job, *state.row())], columns=[c.split()[0] for c in STATE.split(", ")])

    return rows.repartition("job_id").sortWithinPartitions("job_id", "at", "event_id").mapInPandas(fold, STATE)


def progress(states: DataFrame, groups: int = 10) -> DataFrame:
    """(book, total, completed, failed, percent, status): jobs by book, which is the remainder of the job's id."""
    rows = states.groupBy((F.col("job_id") % groups).alias("book")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == COMPLETED).alias("completed"), F.count_if(F.col("status") == FAILED).alias("failed"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("completed") == F.col("total"), "completed").otherwise("running")
    return rows.withColumn("percent", F.floor(F.col("completed") / F.greatest(F.col("total"), F.lit(1)) * 100)).withColumn("status", status)


def liveness(events: DataFrame, silence: float = 60.0) -> DataFrame:
    """(worker_id, last_seen, online): workers by their last event against the last event of all."""
    seen = events.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("worker_id")).agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6).alias("last_seen"))
    now = seen.agg(F.max("last_seen").alias("_now"))
    return seen.join(now).select("worker_id", F.round("last_seen", 3).alias("last_seen"), ((F.col("_now") - F.col("last_seen")) <= silence).alias("online"))
