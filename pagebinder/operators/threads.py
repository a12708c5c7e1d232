"""Posts and threads. posts: thread, pos, author, display_name, content, images array, focal, plus per-thread columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TITLE_LENGTH = 100
PREVIEW_LENGTH = 200
IMAGE_HOST = "pbs.twimg.com/media"  # fixed value: where posts' images are


def preview_text(text: Column) -> Column:
    return F.when(F.length(text) > PREVIEW_LENGTH, F.concat(F.left(text, F.lit(PREVIEW_LENGTH)), F.lit("..."))).otherwise(text)


def author_from_href(href: Column) -> Column:
    """First path segment of a profile link."""
    return F.split_part(F.regexp_replace(F.regexp_replace(href, r"^https?://[^/]*", ""), "^/+|/+$", ""), F.lit("/"), F.lit(1))


def display_name(name: Column, author: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), author)


def upgrade_image_urls(images: Column, only_host: bool = True) -> Column:
    """Images in large size; of posts, those of the image host only."""
    kept = F.filter(images, lambda s: s.contains(IMAGE_HOST)) if only_host else images
    return F.transform(kept, lambda s: F.regexp_replace(s, r"name=\w+", "name=large"))


def render_images(images: Column) -> Column:
    figures = F.transform(images, lambda s: F.concat(F.lit('<img src="'), s, F.lit('" alt="Tweet image">')))
    return F.when(F.size(images) > 0, F.concat(F.lit('<div class="tweet-images">'), F.array_join(figures, ""), F.lit("</div>"))).otherwise("")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def derive_title(article_title: Column, page_title: Column, content: Column, author: Column) -> Column:
    """The article's title, the page's, the start of the text or the author."""
    line = _stripped(F.replace(content, F.lit("\n"), F.lit(" ")))
    short = F.when(F.length(line) <= TITLE_LENGTH, line).otherwise(F.concat(F.left(line, F.lit(TITLE_LENGTH - 3)), F.lit("...")))
    some = lambda c: F.nullif(_stripped(c), F.lit(""))
    return F.coalesce(some(article_title), some(F.regexp_replace(page_title, " / X$", "")), F.when(content != "", short), F.concat(F.lit("Tweet by @"), author))


def split_main_replies(posts: DataFrame) -> DataFrame:
    """With is_main (the focal post, else the first) and is_reply (all but the first)."""
    thread = Window.partitionBy("thread")
    main = F.min(F.struct((~F.coalesce("focal", F.lit(False))).alias("later"), "pos")).over(thread)["pos"]
    return posts.withColumn("is_main", F.col("pos") == main).withColumn("is_reply", F.col("pos") > F.min("pos").over(thread))


def filter_empty_replies(posts: DataFrame) -> DataFrame:
    """Without replies that have neither text nor images."""
    return posts.where(~F.col("is_reply") | F.col("is_main") | (F.coalesce("content", F.lit("")) != "") | (F.size("images") > 0))


def flag_op_replies(posts: DataFrame) -> DataFrame:
    """is_op: a reply by the main post's author, in any case."""
    main = F.max(F.when(F.col("is_main"), F.lower("author"))).over(Window.partitionBy("thread"))
    return posts.withColumn("is_op", F.col("is_reply") & F.coalesce(F.lower("author") == main, F.lit(False)))


def assemble_threads(posts: DataFrame, url: Column, article: Column, at: Column, title: Column) -> DataFrame:
    """One article per thread. url, article (is it long-form), at (time or null) and title (or null) are columns of the main post.
    A thread's posts are one page's, so a group is bounded."""
    rows = flag_op_replies(filter_empty_replies(split_main_replies(posts.withColumns({"_url": url, "_article": article, "_at": at, "_title": title}))))
    post = F.struct("author", "display_name", "content", "images", "_url", "_article", "_at", "_title")
    reply = F.when(F.col("is_reply") & ~F.col("is_main"), F.struct("pos", "author", "display_name", "content", "images", "is_op"))
    g = rows.groupBy("thread").agg(F.max(F.when(F.col("is_main"), post)).alias("m"), F.array_sort(F.collect_list(reply)).alias("r"))
    main = F.col("m")
    date = F.coalesce(F.date_format(main["_at"], "yyyy-MM-dd HH:mm"), F.lit(""))
    name = F.coalesce(derive_title(main["_title"], F.lit(""), main["content"], main["author"]))
    head = lambda p: F.concat(F.lit('<span class="displayname">'), display_name(p["display_name"], p["author"]), F.lit('</span><span class="username">@'), p["author"], F.lit("</span>"))
    dated = F.concat(F.lit('<span class="date">'), date, F.lit("</span>"))
    long_form = F.concat(F.lit('<article class="twitter-article"><h1>'), name, F.lit("</h1>"), head(main), dated, F.lit('<div class="article-content">'), main["content"], F.lit("</div></article>"))
    body = lambda p: F.concat(F.lit('<div class="tweet-content"><p>'), p["content"], F.lit("</p></div>"), render_images(p["images"]))
    one = F.concat(F.lit('<div class="tweet main-tweet">'), head(main), dated, body(main), F.lit("</div>"))
    badge = lambda p: F.when(p["is_op"], '<span class="op-badge">OP</span>').otherwise("")
    replies = F.transform("r", lambda p: F.concat(F.when(p["is_op"], '<div class="tweet reply op-reply">').otherwise('<div class="tweet reply">'), head(p), badge(p), body(p), F.lit("</div>")))
    section = F.when(F.size("r") > 0, F.concat(F.lit('<div class="replies-section"><h2 class="replies-header">Replies</h2>'), F.array_join(replies, ""), F.lit("</div>"))).otherwise("")
    content = F.when(main["_article"], long_form).otherwise(F.concat(one, section))
    kind = F.when(main["_article"], "twitter_article").otherwise("twitter")
    return g.select("thread", name.alias("title"), main["author"].alias("author"), content.alias("content"), main["_at"].alias("published_at"), main["_url"].alias("source_url"), kind.alias("source_type"), F.size("r").alias("n_replies"))


def dedupe_bookmarks(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The first arrival of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*arrival))).where("_n = 1").drop("_n")


