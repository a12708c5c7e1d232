"""Link routing over links that are derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import links as ops
from .base import Tables, query

#: A link per event; the text is the same in Spark and DuckDB.
LINK = """CASE event_id % 9 WHEN 0 THEN concat('https://x.com/user', user_id, '/status/', event_id)
WHEN 1 THEN concat('http://www.twitter.com/user', user_id, '/article/', event_id, '?s=20') WHEN 2 THEN concat('https://x.com/user', user_id)
WHEN 3 THEN concat('https://blog.example.com:8080/post/', event_id, '?p=', user_id, '#top') WHEN 4 THEN concat('https://www.youtube.com/watch?v=v', event_id)
WHEN 5 THEN concat('https://music.youtube.com/watch?v=v', event_id, '&list=PL', user_id) WHEN 6 THEN concat('https://youtu.be/', event_id)
WHEN 7 THEN concat('ftp://files.example.com/', event_id) ELSE concat('http://x.com/user', user_id, '/status/', event_id, '/photo/1') END"""
_CTE0 = "WITH l AS (SELECT user_id AS batch, event_id AS pos, {} AS url FROM events)"
_CTE = _CTE0.format(LINK)
_THREAD = r"regexp_matches(url, '^https?://(www\.)?(twitter\.com|x\.com)/[0-9A-Za-z_]+/(status|article)/[0-9]+')"
_AUTH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_WEB = f"(regexp_matches(url, '^https?://[^/?#]') AND lower({_AUTH}) NOT IN ('twitter.com', 'www.twitter.com', 'x.com', 'www.x.com'))"
_ROUTE = f"CASE WHEN {_THREAD} THEN 'thread' WHEN {_WEB} THEN 'web' END"


def links(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), F.expr(LINK).alias("url"))


@query("url_parts", rf"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, {_AUTH} AS authority,
regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages""")
def _(t):
    return ops.url_parts(t.pages).select("page_id", "scheme", "authority", "path", "query")


@query("filter_web_urls", f"{_CTE} SELECT batch, pos, url FROM l WHERE {_WEB}")
def _(t):
    return ops.filter_web_urls(links(t))


@query("filter_thread_urls", f"{_CTE} SELECT batch, pos, url FROM l WHERE {_THREAD}")
def _(t):
    return ops.filter_thread_urls(links(t))


_P = r"^https?://(?:www\.)?(?:twitter\.com|x\.com)/(\w+)/"


@query("thread_url_ids", rf"""{_CTE} SELECT batch, pos, url, regexp_extract(url, '{_P}(?:status|article)/(\d+)', 1) AS "user", regexp_extract(url, '{_P}(?:status|article)/(\d+)', 2) AS post_id,
CASE WHEN regexp_matches(url, '{_P}status/\d+') THEN concat(regexp_extract(url, '{_P}status/(\d+)', 1), '_', regexp_extract(url, '{_P}status/(\d+)', 2), '.mp4') END AS media_file FROM l WHERE {_THREAD}""")
def _(t):
    return ops.thread_url_ids(links(t))


@query("route_links", f"{_CTE} SELECT batch, pos, url, {_ROUTE} AS route FROM l")
def _(t):
    return ops.route_links(links(t))


@query("route_batches_strict", f"""{_CTE0.format("CASE WHEN event_id % 9 = 2 AND user_id % 2 = 1 THEN 'https://e.example/' ELSE " + LINK + " END")} SELECT batch, bool_and(({_ROUTE}) IS NOT NULL) AS accepted,
coalesce(string_agg(CASE WHEN ({_ROUTE}) IS NULL THEN url END, ', ' ORDER BY pos), '') AS unsupported FROM l GROUP BY batch""")
def _(t):
    mended = F.when(F.expr("pos % 9 = 2 and batch % 2 = 1"), "https://e.example/").otherwise(F.col("url"))
    return ops.route_batches_strict(links(t).withColumn("url", mended))


@query("route_batches_lenient", f"""{_CTE} SELECT batch, pos, url, {_ROUTE} AS route, CASE WHEN ({_ROUTE}) IS NULL THEN 'failed' ELSE 'pending' END AS status,
CASE WHEN ({_ROUTE}) IS NULL THEN 'Unsupported URL' END AS error FROM l""")
def _(t):
    return ops.route_batches_lenient(links(t))


@query("gate_credentials", f"""{_CTE} SELECT batch, bool_or({_THREAD} AND batch % 3 <> 0) AS rejected,
CASE WHEN bool_or({_THREAD} AND batch % 3 <> 0) THEN 'Twitter URLs require cookies to be configured' END AS message FROM l GROUP BY batch""")
def _(t):
    return ops.gate_credentials(links(t).withColumn("has_credential", F.col("batch") % 3 == 0))


@query("classify_media_urls", f"""{_CTE} SELECT batch, pos, url, CASE pos % 9 WHEN 4 THEN 'video' WHEN 5 THEN 'playlist' WHEN 6 THEN 'video' END AS kind FROM l""")
def _(t):
    return ops.classify_media_urls(links(t))


@query("normalize_scheme", f"{_CTE} SELECT batch, pos, CASE WHEN {_THREAD} THEN regexp_replace(url, '^http://', 'https://') ELSE url END AS url FROM l")
def _(t):
    return ops.normalize_scheme(links(t))


@query("build_canonical_urls", "SELECT event_id, concat('https://x.com/user', user_id, '/status/', event_id) AS post_url, concat('https://www.youtube.com/watch?v=', event_id) AS watch_url FROM events")
def _(t):
    df = t.events.withColumn("author", F.concat(F.lit("user"), "user_id"))
    return ops.build_canonical_urls(df, "author", "event_id", "event_id").select("event_id", "post_url", "watch_url")


_NAME = """CASE p_partkey % 6 WHEN 0 THEN concat('youtube_video_', p_partkey, '.mp4') WHEN 1 THEN concat('youtube_mp3_', p_partkey, '.mp3') WHEN 2 THEN concat('../', p_name, '.mp4')
WHEN 3 THEN concat(p_name, '.mp3') WHEN 4 THEN concat('youtube_video_', p_partkey, '.exe') ELSE '..' END"""
_MODE = "CASE WHEN p_partkey % 6 IN (1, 3) THEN 'mp3' ELSE 'video' END"


@query("artifact_name_policy", f"""WITH n AS (SELECT p_partkey, {_NAME} AS name, {_MODE} AS mode FROM part)
SELECT p_partkey, name, mode, CASE p_partkey % 6 WHEN 2 THEN 'invalid_name' WHEN 5 THEN 'invalid_name' WHEN 4 THEN 'wrong_extension' ELSE 'ok' END AS verdict FROM n""")
def _(t):
    return ops.artifact_name_policy(t.part.select("p_partkey", F.expr(_NAME).alias("name"), F.expr(_MODE).alias("mode")))


@query("url_keys", "SELECT page_id, substr(sha256(url), 1, 16) AS url_key FROM pages")
def _(t):
    return t.pages.select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@query("read_link_lists", r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS pos, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE trim(x) <> ''""")
def _(t):
    from ..sources.readers import read_link_lists

    return read_link_lists(t.documents, "doc_id", "text").select("doc_id", "pos", "line")
