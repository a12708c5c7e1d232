"""Attempts at links and what follows from them: retries, streaks, delays, summaries. items: batch, pos, kind, outcome (ok, failed or
unsupported), url, error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds.
RETRY = {"article": [15, 30, 60], "media": [30, 60, 120]}
JITTER = {"article": 5, "media": 10}
LIMITS = {"article": 120, "scrape": 1800, "media": 14400, "post_video": 300}


def progress_rows(items: DataFrame) -> DataFrame:
    """current, total and percent (rounded half up) of each item of its batch."""
    w = Window.partitionBy("batch")
    current, total = F.row_number().over(w.orderBy("pos")), F.count("*").over(w)
    return items.withColumns({"current": current, "total": total}).withColumn("percent", F.round(F.col("current") * 100 / F.col("total")).cast("int"))


def fold_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Per link: succeeded, tries (up to the first success), the last error where none succeeded. attempts: attempt, ok, error."""
    ok = F.bool_or("ok")
    return attempts.groupBy(*keys).agg(ok.alias("succeeded"), F.coalesce(F.min(F.when(F.col("ok"), F.col("attempt"))), F.max("attempt")).alias("tries"), F.when(~ok, F.max_by("error", "attempt")).alias("error"))


def retry_schedule(attempts: DataFrame, kind: str = "article", seed: int | None = None) -> DataFrame:
    """Seconds to wait before the next try of a failed attempt (from 1); null after a success or the last. A seed adds jitter."""
    waits = F.array(*[F.lit(x).cast("double") for x in RETRY[kind]])
    wait = F.when(~F.col("ok"), F.get(waits, F.col("attempt") - 1))
    return attempts.withColumn("wait", wait if seed is None else wait + F.rand(seed) * JITTER[kind])


def failure_streaks(items: DataFrame) -> DataFrame:
    """With streak: failures in a row just before each item; unsupported items change nothing."""
    w = Window.partitionBy("batch").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("_run", F.coalesce(F.sum((F.col("outcome") == "ok").cast("int")).over(before), F.lit(0)))
    failed = F.sum((F.col("outcome") == "failed").cast("int"))
    # failures since the last success: all before, less those before the run began
    rows = rows.withColumn("_f", F.coalesce(failed.over(before), F.lit(0)))
    return rows.withColumn("streak", (F.col("_f") - F.min("_f").over(Window.partitionBy("batch", "_run"))).cast("int")).drop("_run", "_f")


def pacing_delay(items: DataFrame, path: str = "article", seed: int | None = None) -> DataFrame:
    """Seconds to wait before each item (0 before the first). path: article, media or simple; a seed adds jitter."""
    rows = failure_streaks(items) if "streak" not in items.columns else items
    streak, thread = F.col("streak"), F.col("kind") == "thread"
    spread = F.lit(0.0) if seed is None else F.rand(seed)
    delay = {
        "article": 2 + 2 * spread + F.when(thread, 3).otherwise(0) + F.least(10 * streak, F.lit(120)),
        "media": 3 + 5 * spread + 15 * streak,
        "simple": F.when(thread, 2).otherwise(0),
    }[path]
    first = F.row_number().over(Window.partitionBy("batch").orderBy("pos")) == 1
    return rows.withColumn("delay", F.when(first, 0.0).otherwise(delay.cast("double")))


def batch_summary(items: DataFrame) -> DataFrame:
    """Per batch the counts by each definition in use: rows, rows that succeeded, distinct links that succeeded, files, failed."""
    ok = F.col("outcome") == "ok"
    return items.groupBy("batch").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_distinct(F.when(ok, F.col("url"))).alias("succeeded_urls"),
        F.coalesce(F.sum(F.when(ok, F.col("files"))), F.lit(0)).alias("succeeded_files"), F.count_if(~ok).alias("failed"),
    )


def error_report(items: DataFrame) -> DataFrame:
    """Per batch with failures: a line for each, in order, as one text; so a batch, one list that a user sent, must fit a row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "error"))), lambda x: F.concat(F.lit("- "), x["url"], F.lit(": "), x["error"]))
    return items.where("outcome <> 'ok'").groupBy("batch").agg(F.array_join(lines, "\n").alias("report"))


def all_failed_batches(items: DataFrame) -> DataFrame:
    return items.groupBy("batch").agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") != "ok").alias("errors")).where("ok = 0 and errors > 0").select("batch", "errors")


def timed_out_attempts(attempts: DataFrame, seconds: Column) -> DataFrame:
    """Attempts that took longer than their kind may, with the error."""
    limits = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    limit = limits[F.col("kind")]
    return attempts.withColumn("seconds", seconds).where(F.col("seconds") > limit).withColumn("error", F.concat(F.lit("Fetch timed out after "), limit.cast("string"), F.lit("s")))


def log_event_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("event", "level").agg(F.count("*").alias("n"))
