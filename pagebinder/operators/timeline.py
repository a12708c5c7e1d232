"""Timeline API bodies to bookmark records. The schema is declared; what is missing in a body is empty, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .threads import preview_text

_URLS = "struct<urls:array<struct<expanded_url:string>>>"
_LEGACY = f"struct<full_text:string,created_at:string,entities:{_URLS},extended_entities:struct<media:array<struct<type:string>>>>"
_USER = "struct<user_results:struct<result:struct<legacy:struct<screen_name:string,name:string>>>>"
_NOTE = f"struct<note_tweet_results:struct<result:struct<text:string,entity_set:{_URLS}>>>"
_QUOTED = f"struct<result:struct<__typename:string,rest_id:string,legacy:{_LEGACY},tweet:struct<legacy:{_LEGACY}>>>"
_POST = f"__typename:string,rest_id:string,core:{_USER},legacy:{_LEGACY},note_tweet:{_NOTE},quoted_status_result:{_QUOTED}"
_RESULT = f"struct<{_POST},tweet:struct<{_POST}>>"
_ITEM = f"struct<itemType:string,__typename:string,tweet_results:struct<result:{_RESULT}>>"
_HELD = f"array<struct<item:struct<itemContent:{_ITEM}>>>"
_ENTRY = f"struct<content:struct<entryType:string,__typename:string,itemContent:{_ITEM},items:{_HELD}>>"
_LINE = f"struct<timeline:struct<instructions:array<struct<type:string,entries:array<{_ENTRY}>,moduleItems:{_HELD}>>>>"
BODY = f"struct<data:struct<bookmark_timeline_v2:{_LINE},bookmark_timeline:{_LINE}>>"

ON_SITE = r"^https?://(?:www\.)?(?:twitter\.com|x\.com)/"
LONG_FORM = r"^https?://(?:www\.)?(?:twitter\.com|x\.com)/\w+/article/"


def read_timeline_pages(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, i (instruction), j (entry), kind, items (the item contents of the entry): of both kinds of instructions; the newer body wins."""
    parsed = F.from_json(body, BODY)["data"]
    line = F.coalesce(parsed["bookmark_timeline_v2"], parsed["bookmark_timeline"])["timeline"]["instructions"]
    rows = df.select(key, F.posexplode(line).alias("i", "x"))
    held = lambda a: F.transform(a, lambda z: z["item"]["itemContent"])
    entries = rows.select(key, "i", F.posexplode("x.entries").alias("j", "e"))
    kind = F.coalesce(F.nullif("e.content.entryType", F.lit("")), F.col("e.content.__typename"), F.lit(""))
    entries = entries.select(key, "i", "j", kind.alias("kind"), F.when(kind == "TimelineTimelineItem", F.array("e.content.itemContent")).when(kind == "TimelineTimelineModule", held(F.col("e.content.items"))).alias("items"))
    added = rows.where("x.moduleItems is not null").select(key, "i", F.posexplode(F.transform(held(F.col("x.moduleItems")), lambda z: F.array(z))).alias("j", "items")).withColumn("kind", F.lit("AddToModule"))
    return entries.unionByName(added).where("items is not null")


def unwrapped(result: Column) -> Column:
    """The post inside a visibility wrapper; null for tombstones and posts without an id."""
    inner = result["tweet"]
    fields = ["__typename", "rest_id", "core", "legacy", "note_tweet", "quoted_status_result"]
    post = F.struct(*[F.when(result["__typename"] == "TweetWithVisibilityResults", inner[f]).otherwise(result[f]).alias(f) for f in fields])
    gone = F.coalesce(result["__typename"], F.lit("")) == "TweetTombstone"
    return F.when(~gone & (F.coalesce(post["rest_id"], F.lit("")) != ""), post)


def flatten_timeline(entries: DataFrame) -> DataFrame:
    """Entries with `post`: of modules the first item that is a post."""
    posts = F.transform("items", lambda c: F.when(F.coalesce(F.nullif(c["itemType"], F.lit("")), c["__typename"]) == "TimelineTweet", unwrapped(c["tweet_results"]["result"])))
    return entries.withColumn("post", F.get(F.filter(posts, lambda p: p.isNotNull()), F.lit(0))).where("post is not null").drop("items")


def choose_text(plain: Column, note: Column) -> Column:
    plain, note = F.coalesce(plain, F.lit("")), F.coalesce(note, F.lit(""))
    return F.when(F.length(note) > F.length(plain), note).otherwise(plain)


def external_link_filter(links: Column) -> Column:
    """Expanded links off the site, and long-form ones on it."""
    return F.filter(links, lambda u: u.isNotNull() & (u != "") & (u.rlike(LONG_FORM) | ~u.rlike(ON_SITE)))


def _expanded(entities: Column) -> Column:
    return F.coalesce(F.transform(entities["urls"], lambda u: u["expanded_url"]), F.array().cast("array<string>"))


def collect_links(post: Column) -> Column:
    """Links of the post, its note and what it quotes, in order, once each."""
    quoted = F.coalesce(post["quoted_status_result"]["result"]["legacy"], post["quoted_status_result"]["result"]["tweet"]["legacy"])
    note = post["note_tweet"]["note_tweet_results"]["result"]["entity_set"]
    return F.array_distinct(external_link_filter(F.concat(_expanded(post["legacy"]["entities"]), _expanded(note), _expanded(quoted["entities"]))))


def flag_video(post: Column) -> Column:
    quoted = post["quoted_status_result"]["result"]
    inner = F.when(F.coalesce(quoted["__typename"], F.lit("")) != "TweetTombstone", F.coalesce(quoted["legacy"], quoted["tweet"]["legacy"]))
    has = lambda legacy: F.coalesce(F.exists(legacy["extended_entities"]["media"], lambda m: m["type"].isin("video", "animated_gif")), F.lit(False))
    return has(post["legacy"]) | has(inner)


def reformat_post_time(text: Column) -> Column:
    """"Mon Jan 02 03:04:05 +0000 2024" as ISO text; what can't be read stays as it is."""
    turned = F.regexp_replace(text, r"^\w{3} (\w{3}) (\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4}) (\d{4})$", "$5 $1 $2 $3 $4")
    at = F.try_to_timestamp(turned, F.lit("yyyy MMM dd HH:mm:ss Z"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss+00:00"), text)


def bookmark_records(df: DataFrame, key: str, body: str) -> DataFrame:
    """The whole job: key, i, j and the record's columns."""
    p = F.col("post")
    user = p["core"]["user_results"]["result"]["legacy"]
    author = F.coalesce(user["screen_name"], F.lit(""))
    links = collect_links(p)
    rows = flatten_timeline(read_timeline_pages(df, key, body))
    return rows.select(
        key, "i", "j", p["rest_id"].alias("tweet_id"), F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), p["rest_id"]).alias("tweet_url"), author.alias("author"), F.coalesce(user["name"], F.lit("")).alias("display_name"),
        preview_text(choose_text(p["legacy"]["full_text"], p["note_tweet"]["note_tweet_results"]["result"]["text"])).alias("text_preview"), links.alias("article_urls"), F.exists(links, lambda u: u.rlike(LONG_FORM)).alias("is_article"),
        flag_video(p).alias("has_video"), reformat_post_time(p["legacy"]["created_at"]).alias("bookmarked_at"),
    )
