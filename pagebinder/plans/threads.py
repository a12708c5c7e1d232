"""Threads from conversations, bundles from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as m
from ..operators import bundles, threads
from .base import query

_POSTS = """p AS (SELECT conv_id AS thread, turn AS pos, concat(CASE WHEN turn % 4 = 2 THEN upper(role) ELSE role END, conv_id % 7) AS author, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('Name of ', role) END AS display_name,
CASE WHEN turn % 5 = 3 THEN '' ELSE coalesce(text, '') END AS content, turn % 2 = 1 AS has_image FROM conversations)"""
_NAME = "CASE WHEN trim(display_name) = '' THEN author ELSE display_name END"
_IMG = "CASE WHEN has_image THEN concat('https://pbs.twimg.com/media/', thread, '-', pos, '?name=large') END"
_MAIN = f"""{_POSTS}, f AS (SELECT *, min(pos) OVER (PARTITION BY thread) AS first FROM p), mp AS (SELECT * FROM f WHERE pos = first)"""


def posts(t):
    c = t.conversations
    author = F.concat(F.when(F.col("turn") % 4 == 2, F.upper("role")).otherwise(F.col("role")), (F.col("conv_id") % 7).cast("string"))
    image = F.concat(F.lit("https://pbs.twimg.com/media/"), "conv_id", F.lit("-"), "turn", F.lit("?name=small"))
    images = F.when(F.col("turn") % 2 == 1, F.array(image, F.lit("https://other.example.com/x?name=small"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), author.alias("author"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("Name of "), "role")).alias("display_name"),
        F.when(F.col("turn") % 5 == 3, "").otherwise(F.coalesce("text", F.lit(""))).alias("content"), threads.upgrade_image_urls(images).alias("images"), F.lit(False).alias("focal"),
    )


@query("split_main_replies", f"WITH {_MAIN} SELECT thread, pos, pos = first AS is_main, pos > first AS is_reply FROM f")
def _(t):
    return threads.split_main_replies(posts(t)).select("thread", "pos", "is_main", "is_reply")


@query("filter_empty_replies", f"WITH {_MAIN} SELECT thread, pos FROM f WHERE pos = first OR content <> '' OR has_image")
def _(t):
    return threads.filter_empty_replies(threads.split_main_replies(posts(t))).select("thread", "pos")


@query("flag_op_replies", f"WITH {_MAIN} SELECT f.thread, f.pos, f.pos > f.first AND lower(f.author) = lower(mp.author) AS is_op FROM f JOIN mp USING (thread)")
def _(t):
    return threads.flag_op_replies(threads.split_main_replies(posts(t))).select("thread", "pos", "is_op")


@query("author_from_href", "SELECT conv_id, turn, concat(role, conv_id) AS author, CASE WHEN turn % 2 = 0 THEN concat(role, conv_id) ELSE 'Shown' END AS display_name FROM conversations")
def _(t):
    href = F.concat(F.lit("https://x.com/"), "role", F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, "/").otherwise("/status/1"))
    author = threads.author_from_href(href)
    return t.conversations.select("conv_id", "turn", author.alias("author"), threads.display_name(F.when(F.col("turn") % 2 == 0, "").otherwise("Shown"), author).alias("display_name"))


@query("upgrade_image_urls", f"WITH {_POSTS} SELECT thread, pos, {_IMG} AS image FROM p WHERE has_image")
def _(t):
    return posts(t).select("thread", "pos", F.explode("images").alias("image"))


_FIG = """CASE WHEN has_image THEN concat('<div class="tweet-images"><img src="https://pbs.twimg.com/media/', thread, '-', pos, '?name=large" alt="Tweet image"></div>') ELSE '' END"""


@query("render_images", f"WITH {_POSTS} SELECT thread, pos, {_FIG} AS html FROM p")
def _(t):
    return posts(t).select("thread", "pos", threads.render_images(F.col("images")).alias("html"))


_LINE = r"regexp_replace(replace(content, chr(10), ' '), '^\s+|\s+$', '', 'g')"
_TITLE = f"CASE WHEN content = '' THEN concat('Tweet by @', author) WHEN length({_LINE}) <= 100 THEN {_LINE} ELSE concat(substr({_LINE}, 1, 97), '...') END"


@query("derive_title", f"WITH {_POSTS} SELECT thread, pos, CASE WHEN pos % 6 = 5 THEN 'Long form' WHEN pos % 6 = 4 THEN 'A page' ELSE {_TITLE} END AS title FROM p")
def _(t):
    article, page = F.when(F.col("pos") % 6 == 5, " Long form "), F.when(F.col("pos") % 6 == 4, "A page / X")
    return posts(t).select("thread", "pos", threads.derive_title(article, page, F.col("content"), F.col("author")).alias("title"))


_SPAN = f"""concat('<span class="displayname">', {_NAME}, '</span><span class="username">@', author, '</span>')"""
_BODY = f"""concat('<div class="tweet-content"><p>', content, '</p></div>', {_FIG})"""


@query("assemble_threads", f"""WITH {_MAIN},
r AS (SELECT f.*, lower(f.author) = lower(mp.author) AS is_op FROM f JOIN mp USING (thread) WHERE f.pos > f.first AND (f.content <> '' OR f.has_image)),
rs AS (SELECT thread, count(*) AS n, concat('<div class="replies-section"><h2 class="replies-header">Replies</h2>', string_agg(concat(CASE WHEN is_op THEN '<div class="tweet reply op-reply">' ELSE '<div class="tweet reply">' END, {_SPAN},
  CASE WHEN is_op THEN '<span class="op-badge">OP</span>' ELSE '' END, {_BODY}, '</div>'), '' ORDER BY pos), '</div>') AS html FROM r GROUP BY thread)
SELECT thread, CASE WHEN thread % 5 = 0 THEN 'Essay' ELSE {_TITLE} END AS title, author, CASE WHEN thread % 5 = 0 THEN concat('<article class="twitter-article"><h1>Essay</h1>', {_SPAN}, '<span class="date">2024-01-02 03:04</span><div class="article-content">', content, '</div></article>')
  ELSE concat('<div class="tweet main-tweet">', {_SPAN}, '<span class="date">2024-01-02 03:04</span>', {_BODY}, '</div>', coalesce(html, '')) END AS content,
TIMESTAMP '2024-01-02 03:04:05' AS published_at, concat('https://x.com/i/status/', thread) AS source_url, CASE WHEN thread % 5 = 0 THEN 'twitter_article' ELSE 'twitter' END AS source_type, CAST(coalesce(n, 0) AS INTEGER) AS n_replies
FROM mp LEFT JOIN rs USING (thread)""")
def _(t):
    long_form = F.col("thread") % 5 == 0
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    return threads.assemble_threads(posts(t), F.concat(F.lit("https://x.com/i/status/"), "thread"), long_form, at, F.when(long_form, "Essay"))


@query("preview_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", threads.preview_text(F.col("text")).alias("preview"))


@query("dedupe_bookmarks", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, min(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    rows = t.events.select(F.from_json("props", "k int")["k"].alias("k"), "event_id")
    return threads.dedupe_bookmarks(rows, "k", ["event_id"])


# --- bundles: 120 documents each ---

_ART = """a AS (SELECT doc_id // 120 AS bundle, doc_id AS pos, substr(coalesce(text, ''), 1, 60) AS title, source AS author, coalesce(text, '') AS content, concat('https://e.example/', doc_id) AS source_url FROM documents)"""
_FOLD = r"regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')"


def _slug(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
    return f"coalesce(nullif(regexp_replace(substr({s}, 1, 80), '-+$', ''), ''), 'article')"


def articles(t):
    return t.documents.select(
        F.expr("doc_id div 120").alias("bundle"), F.col("doc_id").alias("pos"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.col("source").alias("author"), F.coalesce("text", F.lit("")).alias("content"),
        F.lit("2024-05-06 07:08:00").cast("timestamp").alias("published_at"), F.concat(F.lit("https://e.example/"), "doc_id").alias("source_url"), F.lit("web").alias("source_type"),
    )


@query("bundle_size_gate", f"WITH {_ART} SELECT bundle, count(*) AS n_articles, CAST(sum(strlen(content)) AS BIGINT) AS total_bytes, CAST(200000 AS BIGINT) AS max_bytes, sum(strlen(content)) <= 200000 AS accepted FROM a GROUP BY bundle")
def _(t):
    return bundles.bundle_size_gate(articles(t), 200_000)


@query("slugify_titles", f"SELECT doc_id, {_slug('text')} AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", m.slug(F.col("text")).alias("slug"))


_MANY = "concat(arg_min(title, pos), '-and-', count(*) - 1, '-more')"


@query("bundle_names", f"WITH {_ART}, n AS (SELECT bundle, CASE WHEN count(*) > 1 THEN {_MANY} ELSE min(title) END AS x FROM a GROUP BY bundle) SELECT bundle, concat({_slug('x')}, '_20240506.pdf') AS filename FROM n")
def _(t):
    return bundles.bundle_names(articles(t), "20240506")


_PART = f"""{_ART}, n AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY pos) - 1 AS k FROM a), ap AS (SELECT *, CAST(k // 50 + 1 AS INTEGER) AS part, CAST(k % 50 + 1 AS INTEGER) AS place FROM n)"""


@query("assign_parts", f"WITH {_PART} SELECT bundle, pos, part, place FROM ap")
def _(t):
    return bundles.assign_parts(articles(t)).select("bundle", "pos", "part", "place")


_SECTION = """concat(CASE WHEN place > 1 THEN '<article style="page-break-before: always;">' ELSE '<article >' END, '<h1 class="title">', title, '</h1><span class="author">By @', author, '</span><span class="date">May 06, 2024 at 07:08</span><span class="source">Source: web</span><main class="content">',
regexp_replace(content, '</?[a-zA-Z][a-zA-Z0-9]*:[^>]*>', '', 'g'), '</main><p class="source-url">Original: <a href="', source_url, '">', source_url, '</a></p></article>')"""


@query("render_parts", f"""WITH {_PART} SELECT bundle, part, CAST(count(*) AS INTEGER) AS n_articles, concat('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>', arg_min(title, place),
CASE WHEN count(*) > 1 THEN concat(' (+', count(*) - 1, ' more)') ELSE '' END, '</title></head><body>', string_agg({_SECTION}, chr(10) ORDER BY place), '</body></html>') AS html FROM ap GROUP BY bundle, part""")
def _(t):
    return bundles.render_parts(articles(t))


@query("render_isolated", f"""WITH {_PART}, o AS (SELECT ap.*, coalesce(l.toxic, 0) = 0 AS ok FROM ap LEFT JOIN labels l ON l.doc_id = ap.pos), g AS (SELECT *, count_if(NOT ok) OVER (PARTITION BY bundle, part) AS n_failed, count_if(ok) OVER (PARTITION BY bundle, part) AS n_ok FROM o)
SELECT bundle, part, 0 AS sub, CASE WHEN n_failed = 0 THEN count(*) ELSE 0 END AS n_articles, n_failed FROM g WHERE n_failed = 0 OR n_ok = 0 GROUP BY bundle, part, n_failed
UNION ALL SELECT bundle, part, place, 1, n_failed FROM g WHERE n_failed > 0 AND ok""")
def _(t):
    bad = t.labels.where("toxic = 1").select(F.col("doc_id").alias("pos"), F.lit(False).alias("ok")).distinct()
    return bundles.render_isolated(articles(t).join(bad, "pos", "left").withColumn("ok", F.coalesce("ok", F.lit(True))))


@query("merge_parts", f"WITH {_PART} SELECT bundle, pos, part, CAST(k + 1 AS INTEGER) AS sequence FROM ap")
def _(t):
    return bundles.merge_parts(articles(t)).select("bundle", "pos", "part", "sequence")


@query("write_bundles", f"WITH {_PART} SELECT bundle, part, count(*) AS n_articles FROM ap GROUP BY ALL")
def _(t):
    from ..sources import sinks

    return sinks.bundles_round_trip(bundles.render_parts(articles(t)))
