"""Job events: an append-only log (job, ts, id, type, ...) and what it says. Windows are by job and in its order, so the events of one job (at
most those of `JOB_TTL`) are sorted in one task; nothing else is bound to a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEPALIVE_S, IDLE_S, JOB_TTL, POLLS = 15, 300, "24 hours", 15


def sequence_events(events: DataFrame) -> DataFrame:
    """With sequence: 0-based and gap-free in each job."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("job").orderBy("ts", "id")) - 1)


def replay_events(sequenced: DataFrame, after: str | None) -> DataFrame:
    """Events from a sequence number on (itself included); what isn't a number of 0 or more counts as 0."""
    try:
        n = max(0, int(after))
    except (TypeError, ValueError):
        n = 0
    return sequenced.where(F.col("sequence") >= n)


def job_snapshot(events: DataFrame) -> DataFrame:
    """Per job: state, done, total (links), completed (files), failed, created_at, updated_at. events: type (progress, complete, error), status
    (success, failed), file_count, total."""
    success = F.col("status") == "success"
    state = F.max_by(F.when(F.col("type") == "complete", "complete").when(F.col("type") == "error", "failed").otherwise("running"), F.struct("ts", "id"))
    g = events.groupBy("job").agg(
        F.bool_or(F.col("type").isin("complete", "error")).alias("done"), state.alias("state"), F.max("total").alias("total"), F.coalesce(F.sum(F.when(success, F.col("file_count"))), F.lit(0)).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )
    return g


def terminal_jobs(events: DataFrame) -> DataFrame:
    """Jobs whose stream has ended: complete if a complete event came (also with failed items), else failed."""
    g = events.groupBy("job").agg(F.bool_or(F.col("type") == "complete").alias("c"), F.bool_or(F.col("type") == "error").alias("e"))
    return g.where("c or e").select("job", F.when(F.col("c"), "complete").otherwise("failed").alias("state"))


def silent_gaps(events: DataFrame, seconds: float = KEEPALIVE_S) -> DataFrame:
    """Gaps longer than this between events of a job: job, id (of the later event), gap (seconds)."""
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(Window.partitionBy("job").orderBy("ts", "id"))
    return events.withColumn("gap", gap).where(F.col("gap") > seconds).select("job", "id", "gap")


def idle_timeouts(events: DataFrame, gap: str = f"{IDLE_S} seconds") -> DataFrame:
    """Spells of activity that end after an idle gap: job, first_ts, last_ts, n."""
    g = events.groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return g.drop("w")


def expired_jobs(snapshots: DataFrame, as_of, ttl: str = JOB_TTL) -> DataFrame:
    """Finished and untouched for ttl; unfinished ones never expire."""
    return snapshots.where(F.col("done") & (F.col("updated_at") < as_of - F.expr(f"interval {ttl}")))


def empty_poll_stop(seen: DataFrame, limit: int = POLLS) -> DataFrame:
    """Per feed the first poll that is the limit-th in a row without a new id. seen: feed, poll, id (null: nothing)."""
    first = F.min("poll").over(Window.partitionBy("feed", "id"))
    polls = seen.withColumn("new", F.col("id").isNotNull() & (F.col("poll") == first)).groupBy("feed", "poll").agg(F.bool_or("new").alias("new"))
    w = Window.partitionBy("feed").orderBy("poll")
    polls = polls.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    empty = F.count_if(~F.col("new")).over(Window.partitionBy("feed", "run").orderBy("poll"))
    return polls.withColumn("empty", empty).where(F.col("empty") == limit).groupBy("feed").agg(F.min("poll").alias("stop_poll"))


def emit_progress_events(events: DataFrame, columns: list[str]) -> DataFrame:
    """Events as JSON payloads, framed for an event stream."""
    return events.select("job", "id", F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("payload"))
