"""Readers of the raw layers. Schemas are declared; rows that don't parse become nulls, never failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored page snapshots: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_link_lists(df: DataFrame, list_id: str, text: str, trim: bool = True) -> DataFrame:
    """Newline-separated lists -> list_id, pos (from 1, of lines that aren't blank), line. trim=False keeps lines as they are."""
    lines = F.split(F.col(text), "\n")
    lines = F.transform(lines, lambda x: F.trim(x)) if trim else lines
    kept = F.filter(lines, lambda x: F.trim(x) != "")
    return df.select(list_id, F.posexplode(kept).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


LOG = "event string, level string, timestamp string, filename string, func_name string, lineno int"


def read_json_logs(df: DataFrame, line: str) -> DataFrame:
    """JSON log lines: the fixed columns, and what else they hold as a map of text (`rest`)."""
    fixed = [c.split()[0] for c in LOG.split(", ")]
    parsed = df.withColumn("_f", F.from_json(line, LOG)).withColumn("_m", F.from_json(line, "map<string,string>"))
    rest = F.map_filter("_m", lambda k, v: ~k.isin(fixed))
    return parsed.select(*[c for c in df.columns if c != line], *[F.col(f"_f.{c}").alias(c) for c in fixed], rest.alias("rest"))


def read_artifact_inventory(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """name, mtime, size of the files of a folder; their contents are not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder).select("path", "modificationTime", "length")
    return inventory_rows(listing, extension)


def inventory_rows(listing: DataFrame, extension: str) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return listing.where(F.col("path").endswith(extension)).select(name.alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


LIKED = "items array<struct<id:string,snippet:struct<title:string,channelTitle:string>>>, nextPageToken string"


def read_liked_pages(pages: DataFrame, feed: str = "feed") -> DataFrame:
    """Item rows of API pages (feed, page, body) in page order."""
    return pages.select(feed, "page", F.posexplode(F.from_json("body", LIKED)["items"]).alias("pos", "i")).select(feed, "page", "pos", "i.id", F.col("i.snippet.title").alias("title"), F.col("i.snippet.channelTitle").alias("channel"))


def read_playlist_meta(df: DataFrame, body: str) -> DataFrame:
    """Probe bodies with title, playlist_count, n_entries and the number of entries (null without a list)."""
    meta = F.from_json(body, "title string, playlist_count int, n_entries int")
    return df.withColumn("_m", meta).select(*df.columns, "_m.*", F.json_array_length(F.get_json_object(body, "$.entries")).alias("entries"))


ARTICLE = "title string, author string, content string, published_at string, source_url string, source_type string, url string"


def read_article_store(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Saved articles, a JSON file each, or a line each; times that don't parse are null. Files that begin with _ are not read."""
    return spark.read.schema(ARTICLE).option("multiLine", not lines).json(folder).withColumn("published_at", F.col("published_at").try_cast("timestamp"))


META = "urls array<string>, total int, status string, created_at string, updated_at string"


def read_session_meta(df: DataFrame, session: str, body: str) -> DataFrame:
    """Session documents (session, body); malformed ones are rows of nulls."""
    return df.select(F.col(session).alias("session_id"), F.from_json(body, META).alias("m")).select("session_id", "m.*")
