"""Parts of addresses and what they say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts.
POST_HOSTS = ["twitter.com", "www.twitter.com", "x.com", "www.x.com"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "www.music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com"]
SHORT_HOSTS = ["youtu.be", "www.youtu.be"]

THREAD = r"^https?://(?:www\.)?(?:twitter\.com|x\.com)/(\w+)/(?:status|article)/(\d+)"
THREAD_STATUS = r"^https?://(?:www\.)?(?:twitter\.com|x\.com)/(\w+)/status/(\d+)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host and port as written; parse_url would drop the port and reject spaces."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, "" without one."""
    return F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]*)", 1)


def is_web(url: Column) -> Column:
    host = F.lower(authority(url))
    return scheme(url).isin("http", "https") & (host != "") & ~host.isin(POST_HOSTS)


def is_thread(url: Column) -> Column:
    return url.rlike(THREAD)


def route(url: Column) -> Column:
    """The first source whose predicate holds; null if none does."""
    return F.when(is_thread(url), "thread").when(is_web(url), "web")


def media_kind(url: Column) -> Column:
    """video, playlist or null."""
    host, at = F.lower(authority(url)), path(url)
    parts = F.filter(F.split(at, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    known = scheme(url).isin("http", "https")
    return (
        F.when(known & host.isin(SHORT_HOSTS) & (F.size(parts) > 0), "video")
        .when(~known | ~host.isin(VIDEO_HOSTS), None)
        .when(at.isin("/playlist", "/watch") & (parameter(url, "list") != ""), "playlist")
        .when((at == "/watch") & (parameter(url, "v") != ""), "video")
        .when(first.isin("shorts", "live", "embed") & second.isNotNull(), "video")
    )


def url_key(url: Column) -> Column:
    """The key under which an article of this address is stored."""
    return F.substring(F.sha2(url, 256), 1, 16)
