"""Text files as numbered lines. Files are read by byte ranges, so one needn't fit a row or a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import scratch

#: Byte ranges whose table (a path and three numbers each) is broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 100_000


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, line_no (from 1 in the file), n (from 1 over all files by path), line (without its line feed). Lines are written once, with the byte range they were
    read from, and ranges' counts are summed: in a file by its ranges, over files in one small window of a row for each range. A
    range's lines are told apart by the number Spark gives rows as it reads them, which rises without gaps in a range. Empty files have no lines; a feed
    at the end of a file begins no line; compressed files are one range."""
    reader = spark.read.option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    kept = scratch(spark, "lines")
    raw.write.parquet(kept)
    rows = spark.read.schema(raw.schema).parquet(kept)
    ranges = rows.groupBy("file", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "_range", "_first", before(Window.partitionBy("file").orderBy("_range")).alias("_in_file"), before(Window.orderBy("file", "_range")).alias("_in_all"))
    if rows.select("file", "_range").distinct().count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    at = F.col("_id") - F.col("_first") + 1
    return rows.join(ranges, ["file", "_range"]).select("file", (at + F.col("_in_file")).alias("line_no"), (at + F.col("_in_all")).alias("n"), "line")


def read_stderr_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, line_no, line, level (error, warning or other) of a tool's error output; blank lines are dropped but counted."""
    line = F.regexp_replace("line", r"\r$", "")
    level = F.when(line.startswith("ERROR:"), "error").when(line.startswith("WARNING:"), "warning").otherwise("other")
    return read_lines(spark, path, glob).select("file", "line_no", line.alias("line"), level.alias("level")).where(F.trim("line") != "")
