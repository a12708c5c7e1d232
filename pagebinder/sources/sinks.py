"""Writers. Each writes once per task and is committed by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, spark.checkpoint.dir. Only a local session may go without that setting, and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """A folder of scratch() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_bundles(parts: DataFrame, path: str) -> None:
    """One folder per bundle with the HTML of its parts; parts are rows, so a document is one row's text."""
    parts.select(F.regexp_replace("html", r"\n", " ").alias("value"), "bundle", "part").write.partitionBy("bundle", "part").text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle, part, html as written."""
    return spark.read.text(path).select(F.col("bundle").cast("long").alias("bundle"), F.col("part").cast("int").alias("part"), F.replace("value", F.lit(" "), F.lit("\n")).alias("html"))


def bundles_round_trip(parts: DataFrame) -> DataFrame:
    path = scratch(parts.sparkSession, "bundles")
    write_bundles(parts, path)
    n = F.size(F.split("html", '<h1 class="title">')) - 1
    return read_bundles(parts.sparkSession, path).select("bundle", "part", n.cast("long").alias("n_articles"))
