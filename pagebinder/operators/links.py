"""Routing of lists of links. A list is (batch, pos, url); batches are grouped, never gathered whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls



def _web(pages: DataFrame) -> DataFrame:
    from .extract import extract_articles

    return extract_articles(pages)


#: Registered sources in order of priority: name, predicate over a url column, and the job that turns its pages into articles (None: its
#: pages come another way, as threads do).
_sources: list[tuple] = [("thread", urls.is_thread, None), ("web", urls.is_web, _web)]


def register_source(name, predicate, extract=None, first: bool = False) -> None:
    """Adds a source: predicate(url column) -> boolean column; extract(DataFrame) -> DataFrame of articles."""
    unregister_source(name)
    _sources.insert(0 if first else len(_sources), (name, predicate, extract))


def unregister_source(name: str) -> None:
    _sources[:] = [s for s in _sources if s[0] != name]


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url)
    return df.withColumns({"scheme": urls.scheme(u), "authority": urls.authority(u), "path": urls.path(u), "query": urls.query(u)})


def filter_web_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(urls.is_web(F.col(url)))


def filter_thread_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(urls.is_thread(F.col(url)))


def thread_url_ids(df: DataFrame, url: str = "url") -> DataFrame:
    """Of thread links: user, post id, and the name of a post's media file (null for long-form posts)."""
    u = F.col(url)
    out = filter_thread_urls(df, url).withColumns({"user": F.regexp_extract(u, urls.THREAD, 1), "post_id": F.regexp_extract(u, urls.THREAD, 2)})
    return out.withColumn("media_file", F.when(u.rlike(urls.THREAD_STATUS), F.concat("user", F.lit("_"), "post_id", F.lit(".mp4"))))


def route_links(df: DataFrame, url: str = "url") -> DataFrame:
    """With the name of the first registered source that takes the link, else null."""
    rule = F.lit(None).cast("string")
    for name, predicate, _ in reversed(_sources):
        rule = F.when(predicate(F.col(url)), name).otherwise(rule)
    return df.withColumn("route", rule)


def extract_routed(pages: DataFrame, url: str = "url", **instead) -> DataFrame:
    """Articles of pages (page_id, url, html), each by the job of the first registered source that takes its link; route tells which. Pages of
    links that none takes, and of sources without a job, are rows that failed. instead: jobs by the source's name, in place of registered ones."""
    routed = route_links(pages, url)
    jobs = {name: instead.get(name, extract) for name, _, extract in _sources if extract}
    rest = routed.where(~F.coalesce(F.col("route").isin(*jobs), F.lit(False)))
    error = F.when(F.col("route").isNull(), "Unsupported URL").otherwise("This source has no pages to extract")
    out = rest.select("page_id", F.col(url).alias("source_url"), "route", F.lit("failed").alias("status"), error.alias("error"))
    for name, extract in jobs.items():
        out = extract(routed.where(F.col("route") == name).drop("route")).withColumn("route", F.lit(name)).unionByName(out, allowMissingColumns=True)
    return out


def route_batches_strict(df: DataFrame) -> DataFrame:
    """Per batch: accepted, and the unsupported links in order. One bad link rejects the batch. These links are one text: a list that a user sent must fit a row."""
    bad = F.array_sort(F.collect_list(F.when(F.col("route").isNull(), F.struct("pos", "url"))))
    return route_links(df).groupBy("batch").agg(F.every(F.col("route").isNotNull()).alias("accepted"), F.array_join(F.transform(bad, lambda x: x["url"]), ", ").alias("unsupported"))


def route_batches_lenient(df: DataFrame) -> DataFrame:
    """Links with status: unsupported ones have failed, with an error; the others are pending."""
    none = F.col("route").isNull()
    return route_links(df).withColumns({"status": F.when(none, "failed").otherwise("pending"), "error": F.when(none, "Unsupported URL")})


# Messages of the two endpoints.
_NO_CREDENTIAL = {"simple": "Twitter URLs require cookies to be configured", "stream": "Twitter cookies not configured"}


def gate_credentials(df: DataFrame, has_credential: str = "has_credential", endpoint: str = "simple") -> DataFrame:
    """Per batch: rejected if a thread link is there without a credential, with the endpoint's message."""
    lacks = F.coalesce(F.bool_or((F.col("route") == "thread") & ~F.col(has_credential)), F.lit(False))
    out = route_links(df).groupBy("batch").agg(lacks.alias("rejected"))
    return out.withColumn("message", F.when(F.col("rejected"), _NO_CREDENTIAL[endpoint]))


def classify_media_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("kind", urls.media_kind(F.col(url)))


def normalize_scheme(df: DataFrame, url: str = "url") -> DataFrame:
    """http becomes https on thread links."""
    u = F.col(url)
    return df.withColumn(url, F.when(urls.is_thread(u), F.regexp_replace(u, "^http://", "https://")).otherwise(u))


def build_canonical_urls(df: DataFrame, author: str, post_id: str, video_id: str) -> DataFrame:
    return df.withColumns({"post_url": F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), post_id), "watch_url": F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)})


def artifact_name_policy(df: DataFrame, name: str = "name", mode: str = "mode") -> DataFrame:
    """Verdict of each artifact name: invalid_name (separators, dots only, another prefix), wrong_extension, ok."""
    n, m = F.col(name), F.col(mode)
    bad = n.rlike(r"[/\\]") | n.isin("", ".", "..") | ((m == "video") & ~n.startswith("youtube_video_"))
    right = F.when(m == "mp3", n.endswith(".mp3")).when(m == "video", n.endswith(".mp4")).otherwise(False)
    return df.withColumn("verdict", F.when(bad, "invalid_name").when(~right, "wrong_extension").otherwise("ok"))
