"""Resumable sessions: what is listed, saved, left and stale. Joins are by (session, url key); nothing is gathered beyond a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_key

TTL = "7 days"


def session_urls(sessions: DataFrame) -> DataFrame:
    """session_id, pos, url; duplicates stay."""
    return sessions.select("session_id", F.posexplode("urls").alias("pos", "url"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_articles(saved: DataFrame, arriving: DataFrame, arrival: list[str]) -> DataFrame:
    """The article store after a batch: the last write of a (session, url) wins. Both carry session_id, url and the same columns."""
    new = latest(arriving.withColumn("url_key", url_key(F.col("url"))), ["session_id", "url_key"], [F.desc(c) for c in arrival])
    old = saved.withColumn("url_key", url_key(F.col("url"))).join(new.select("session_id", "url_key"), ["session_id", "url_key"], "left_anti")
    return old.unionByName(new)


def upsert_session_status(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """meta and changes: session_id, urls, status, updated_at. A change sets status and time and keeps the list; unknown sessions are added."""
    b = changes.select("session_id", F.col("status").alias("s"), F.col("updated_at").alias("u"), F.col("urls").alias("l"))
    return meta.join(b, "session_id", "full_outer").select("session_id", F.coalesce("urls", "l").alias("urls"), F.coalesce("s", "status").alias("status"), F.coalesce("u", "updated_at").alias("updated_at"))


def remaining_urls(listed: DataFrame, saved: DataFrame) -> DataFrame:
    return listed.join(saved.select("session_id", "url"), ["session_id", "url"], "left_anti")


def resumed_urls(listed: DataFrame, saved: DataFrame) -> DataFrame:
    """Listed links that need no fetch, with the saved title."""
    titles = saved.select("session_id", "url", F.col("title"))
    return listed.join(titles, ["session_id", "url"]).withColumns({"status": F.lit("success"), "resumed": F.lit(True)})


def title_lookup(processed: DataFrame, saved: DataFrame) -> DataFrame:
    return processed.join(saved.select("session_id", "url", "title"), ["session_id", "url"], "left").withColumn("title", F.coalesce("title", F.lit("")))


def session_list(meta: DataFrame, saved: DataFrame) -> DataFrame:
    """All sessions known by meta or by saved articles, by falling id: total, saved, status, updated_at."""
    n = saved.groupBy("session_id").agg(F.count("*").alias("saved"))
    rows = meta.join(n, "session_id", "full_outer")
    size = F.when(F.col("urls").isNotNull(), F.size("urls"))
    return rows.select("session_id", F.coalesce(size, F.lit(0)).alias("total"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("status", F.lit("unknown")).alias("status"), "updated_at").orderBy(F.desc("session_id"))


def session_detail(meta: DataFrame, saved: DataFrame) -> DataFrame:
    """Per session: total, saved_urls, remaining (arrays in list order); the total is that of saved ones only without a list."""
    listed = session_urls(meta)
    have = saved.select("session_id", "url").distinct().withColumn("have", F.lit(True))
    rows = listed.join(have, ["session_id", "url"], "full_outer")
    kept = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "url")))), lambda x: x["url"])
    g = rows.groupBy("session_id").agg(F.count("pos").alias("listed"), F.count_if(F.col("have")).alias("n_saved"), kept(F.col("have") & F.col("pos").isNotNull()).alias("saved_urls"), kept(F.col("have").isNull()).alias("remaining"))
    return g.select("session_id", F.when(F.col("listed") > 0, F.col("listed")).otherwise(F.col("n_saved")).alias("total"), "saved_urls", "remaining")


def session_bundle(listed: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved articles of sessions in list order, once each, ready for bundling: bundle, pos and the saved columns. Sessions without any have a
    row with status empty."""
    order = listed.groupBy("session_id", "url").agg(F.min("pos").alias("pos"))
    rows = order.join(saved, ["session_id", "url"]).withColumn("status", F.lit("ok"))
    empty = listed.select("session_id").distinct().join(rows.select("session_id"), "session_id", "left_anti").withColumn("status", F.lit("empty"))
    return rows.unionByName(empty, allowMissingColumns=True).withColumnRenamed("session_id", "bundle")


def session_status(log: DataFrame) -> DataFrame:
    """The last status of each session; log: session_id, status, updated_at, seq."""
    return log.groupBy("session_id").agg(F.max_by("status", F.struct("updated_at", "seq")).alias("status"), F.max("updated_at").alias("updated_at"))


def stale_sessions(meta: DataFrame, as_of: Column, ttl: str = TTL) -> DataFrame:
    """Sessions last touched more than ttl before as_of. updated_at is text; without any, the folder's time counts; unreadable text keeps a session."""
    at = F.when(F.coalesce("updated_at", F.lit("")) == "", F.col("dir_mtime")).otherwise(F.try_to_timestamp("updated_at"))
    return meta.where(at < as_of - F.expr(f"interval {ttl}"))


def purge_expired(rows: DataFrame, expired: DataFrame, key: str) -> DataFrame:
    return rows.join(expired.select(key), key, "left_anti")
