"""Attempts of jobs as a state machine over a stream: pending, running, retrying, done, failed.

Events (job_id, at, event_id, kind) start an attempt, end it well (`ok`) or badly (`error`). A running attempt that shows
no sign of life for `timeout` expires, by a timer in event time where no later event tells. What failed or expired is
retried, `limit` attempts in all. A finished job stays finished, whatever comes late. State is one row per unfinished or
finished job; of a batch, a task holds one job's events, which are taken in order of time and event_id.

Edge cases: a second start while an attempt runs is a sign of life; ok and error without a running attempt are ignored,
as are unknown kinds and events without a time or a job; repeated events change nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PENDING, RUNNING, RETRYING, DONE, FAILED = "pending", "running", "retrying", "done", "failed"
LOG = "job_id string, seq int, status string, attempt int, at_ms long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Job:
    status: str = PENDING
    attempt: int = 0
    deadline: int = 0
    seq: int = 0


def ended(job: Job, limit: int) -> Job:
    """After an attempt that failed or expired."""
    return replace(job, status=FAILED if job.attempt >= limit else RETRYING)


def expired(job: Job, now: int, limit: int) -> Job:
    return ended(job, limit) if job.status == RUNNING and now > job.deadline else job


def after(job: Job, kind: str, at: int, timeout: int, limit: int) -> Job:
    """The job after an event, times in milliseconds."""
    job = expired(job, at, limit)
    if kind == "start" and job.status in (PENDING, RETRYING):
        return replace(job, status=RUNNING, attempt=job.attempt + 1, deadline=at + timeout)
    if kind == "start" and job.status == RUNNING:
        return replace(job, deadline=max(job.deadline, at + timeout))
    if kind == "ok" and job.status == RUNNING:
        return replace(job, status=DONE)
    return ended(job, limit) if kind == "error" and job.status == RUNNING else job


class Attempts(StatefulProcessor):
    def __init__(self, timeout: int, limit: int):
        self.timeout, self.limit = timeout, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempt int, deadline long, seq int")

    def moved(self, key: tuple, old: Job | None, new: Job, at: int) -> Iterator[Row]:
        """The log row of a change, if there is one."""
        if old is None or new.status != old.status or new.attempt != old.attempt:
            yield Row(job_id=key[0], seq=new.seq, status=new.status, attempt=new.attempt, at_ms=at)

    def kept(self, job: Job) -> None:
        self.state.update((job.status, job.attempt, job.deadline, job.seq))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.status == RUNNING:
            self.handle.registerTimer(job.deadline + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job = Job(*self.state.get()) if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r.at_ms, r.event_id)):
            if job is None:
                yield from self.moved(key, None, job := Job(), r.at_ms)
            gone = expired(job, r.at_ms, self.limit)  # a change of its own before the event's
            for new in (gone, after(gone, r.kind, r.at_ms, self.timeout, self.limit)):
                changed = (new.status, new.attempt) != (job.status, job.attempt)
                new = replace(new, seq=job.seq + changed)
                yield from self.moved(key, job, new, r.at_ms)
                job = new
        if job is not None:
            self.kept(job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job = Job(*self.state.get()) if self.state.exists() else Job()
        now = expiredTimerInfo.getExpiryTimeInMs()
        new = expired(job, now, self.limit)
        if new != job:
            new = replace(new, seq=job.seq + 1)
            yield from self.moved(key, job, new, now)
            self.state.update((new.status, new.attempt, new.deadline, new.seq))


def attempt_log(events: DataFrame, timeout_ms: int, limit: int = 3, late: str = "10 minutes") -> DataFrame:
    """Changes of jobs (see LOG) from a stream of events: job_id, at (timestamp), event_id, kind."""
    rows = events.where("job_id is not null and at is not null").withWatermark("at", late)
    rows = rows.select(F.col("job_id").cast("string"), "at", F.unix_millis("at").alias("at_ms"), "event_id", F.coalesce("kind", F.lit("")).alias("kind"))
    return rows.groupBy("job_id").transformWithState(Attempts(timeout_ms, limit), LOG, "Append", "EventTime")


def run_attempts(log: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over all that is there, into a table of changes; goes on from the checkpoint when it is run again."""
    spark = log.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # what transformWithState needs; the stream keeps it
    try:
        query = log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()


def last_states(spark: SparkSession, path: str) -> DataFrame:
    """job_id, status, attempt: where each job stands."""
    rows = spark.read.schema(LOG).parquet(path)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "attempt"), "seq").alias("s")).select("job_id", "s.status", "s.attempt")
