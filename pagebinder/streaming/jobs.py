"""Streams over job events and pages. State is bounded: by watermarks where rows carry a time, by timers or TTL elsewhere; rows later than a
watermark are dropped. Where order counts, a processor holds what one trigger brings of one key, in a few small columns: sources bound that by
maxFilesPerTrigger or maxBytesPerTrigger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import extract
from ..sources.store import KeyedStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedupe_ids(stream: DataFrame, key: str, ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Each id once, as it arrives, within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_job_snapshots(stream: DataFrame) -> DataFrame:
    """Live snapshot per job, in update mode; the columns of operators.jobs.job_snapshot that a stream can keep."""
    success = F.col("status") == "success"
    return stream.groupBy("job").agg(
        F.bool_or(F.col("type").isin("complete", "error")).alias("done"), F.max("total").alias("total"), F.coalesce(F.sum(F.when(success, F.col("file_count"))), F.lit(0)).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )


def stream_idle_sessions(stream: DataFrame, gap: str = "300 seconds", watermark: str = "1 hour") -> DataFrame:
    """Spells of activity of a job that an idle gap has closed, in append mode."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("w")


class _Streaks(StatefulProcessor):
    """State: the failures in a row of a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("pos")  # what one trigger brings of one batch
        n = self.streak.get()[0] if self.streak.exists() else 0
        before = []
        for outcome in pdf["outcome"]:
            before.append(n)
            n = 0 if outcome == "ok" else n + (outcome == "failed")
        self.streak.update((n,))
        delay = 2.0 + 3.0 * (pdf["kind"] == "thread").to_numpy() + pd.Series(before).mul(10).clip(upper=120).to_numpy()
        yield pd.DataFrame({"batch": key[0], "pos": pdf["pos"].to_numpy(), "streak": before, "delay": delay})

    def close(self) -> None:
        pass


def stream_failure_streaks(stream: DataFrame) -> DataFrame:
    """Streak before each item and the delay that follows (without that of first items). Needs the RocksDB state store."""
    return stream.groupBy("batch").transformWithStateInPandas(_Streaks(), "batch long, pos long, streak int, delay double", "append", "none")


class _Polls(StatefulProcessor):
    """State: ids seen (for a while) and the empty polls in a row of a feed."""

    def __init__(self, limit: int, ttl_ms: int):
        self.limit, self.ttl = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id long", "there boolean", ttlDurationMs=self.ttl)
        self.empty = handle.getValueState("empty", "n int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        pdf = pdf[pdf["poll"].notna().to_numpy()]
        known = self.empty.exists()  # a feed without it has no ids either
        n, stopped = self.empty.get() if known else (0, False)
        filled = pdf["id"].notna().to_numpy()
        ids, which = np.unique(pdf["id"].to_numpy()[filled].astype("int64"), return_inverse=True)
        first = np.full(len(ids), np.iinfo("int64").max)  # the poll that brings each id first
        np.minimum.at(first, which, pdf["poll"].to_numpy()[filled].astype("int64"))
        new = np.array([not known or not self.seen.containsKey((i,)) for i in ids.tolist()], bool)
        for i in ids[new].tolist():
            self.seen.updateValue((i,), (True,))
        polls = np.unique(pdf["poll"].to_numpy().astype("int64"))
        at = np.arange(len(polls))
        last = np.maximum.accumulate(np.where(np.isin(polls, first[new]), at, -1))  # the last poll with a new id
        empty = np.where(last < 0, n + at + 1, at - last)
        if not stopped and (hits := polls[empty == self.limit]).size:
            stopped = True
            yield pd.DataFrame({"feed": [key[0]], "stop_poll": hits[:1]})
        n = int(empty[-1]) if empty.size else n
        self.empty.update((n, stopped))

    def close(self) -> None:
        pass


def stream_empty_poll_stop(stream: DataFrame, limit: int = 15, ttl_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Per feed the first poll that is the limit-th in a row without a new id."""
    return stream.groupBy("feed").transformWithStateInPandas(_Polls(limit, ttl_ms), "feed long, stop_poll long", "append", "ProcessingTime")


class _Finished(StatefulProcessor):
    """State: the last event of a job, dropped a while after its last update."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "done boolean, n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, n = self.last.get() if self.last.exists() else (False, 0)
        for pdf in rows:
            n += len(pdf)
            done = done or bool(pdf["type"].isin(["complete", "error"]).any())
        self.last.update((done, n))
        yield pd.DataFrame({"job": [key[0]], "done": [done], "n": [n]})

    def close(self) -> None:
        pass


def stream_job_ttl(stream: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Jobs' progress with state that expires ttl after the last update: job, done, n, a row per job and trigger."""
    return stream.groupBy("job").transformWithStateInPandas(_Finished(ttl_ms), "job long, done boolean, n long", "update", "ProcessingTime")


def article_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, ["session_id", "url"])


def stream_extract_articles(stream: DataFrame, store: str, checkpoint: str, session_id: int = 0, **kw):
    """Pages that arrive as files to articles in article_store(store): the last batch with a url wins, in a batch the largest page_id. Restarts
    continue, and a batch that is repeated changes nothing. kw: as extract_articles has them."""

    def write(batch: DataFrame, number: int) -> None:
        articles = extract.extract_articles(batch, **kw).withColumnsRenamed({"source_url": "url"}).withColumn("session_id", F.lit(session_id))
        article_store(batch.sparkSession, store).upsert(articles, number, [F.desc("page_id")])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(spark: SparkSession, out: DataFrame, path: str, mode: str = "append", once: bool = False) -> DataFrame:
    """Runs a stream over what is there now, with the RocksDB state store, and returns what it wrote. In update mode each trigger's rows carry its number, `trigger`.
    once: a single trigger; streams with processing-time state would otherwise go on with empty ones."""
    when = {"once": True} if once else {"availableNow": True}
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        _started(out, path, mode, when).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema if mode == "append" else out.schema.add("trigger", "long")).option("recursiveFileLookup", True).parquet(path)


def _started(out: DataFrame, path: str, mode: str, when: dict):
    if mode == "append":
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(**when).start(path)
    else:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(**when).foreachBatch(lambda b, n: b.withColumn("trigger", F.lit(n)).write.mode("overwrite").parquet(f"{path}/part={n}")).start()
    return q
