"""Bundles of articles: articles carry bundle, pos, title, author, content, published_at, source_url, source_type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as m

MAX_BYTES = 500_000_000
PART = 50


def bundle_size_gate(articles: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Per bundle: n_articles, total_bytes, max_bytes, accepted."""
    g = articles.groupBy("bundle").agg(F.count("*").alias("n_articles"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).cast("long").alias("total_bytes"))
    return g.withColumns({"max_bytes": F.lit(limit).cast("long"), "accepted": F.col("total_bytes") <= limit})


def slugify_titles(df: DataFrame, title: str = "title") -> DataFrame:
    return df.withColumn("slug", m.slug(F.col(title)))


def bundle_names(articles: DataFrame, day: str) -> DataFrame:
    """Per bundle its file name; day: yyyyMMdd, of the run."""
    g = articles.groupBy("bundle").agg(F.min_by("title", "pos").alias("t"), F.count("*").alias("n"))
    many = F.concat("t", F.lit("-and-"), (F.col("n") - 1).cast("string"), F.lit("-more"))
    return g.select("bundle", F.concat(m.slug(F.when(F.col("n") > 1, many).otherwise(F.col("t"))), F.lit(f"_{day}.pdf")).alias("filename"))


def assign_parts(articles: DataFrame, size: int = PART) -> DataFrame:
    """With part (from 1) and place in the part (from 1), in order."""
    n = F.row_number().over(Window.partitionBy("bundle").orderBy("pos"))
    rows = articles.withColumn("_n", n)
    return rows.withColumns({"part": F.ceil(F.col("_n") / size).cast("int"), "place": ((F.col("_n") - 1) % size + 1).cast("int")}).drop("_n")


def _section(row: Column) -> Column:
    date = F.coalesce(F.date_format(row["published_at"], "MMMM dd, yyyy 'at' HH:mm"), F.lit(""))
    lit = F.lit
    return F.concat(
        F.when(row["place"] > 1, '<article style="page-break-before: always;">').otherwise("<article >"), lit('<h1 class="title">'), row["title"], lit('</h1><span class="author">By @'), row["author"],
        lit('</span><span class="date">'), date, lit('</span><span class="source">Source: '), row["source_type"], lit('</span><main class="content">'), m.without_namespaced_tags(row["content"]),
        lit('</main><p class="source-url">Original: <a href="'), row["source_url"], lit('">'), row["source_url"], lit("</a></p></article>"),
    )


def render_parts(articles: DataFrame, size: int = PART, keys: tuple[str, ...] = ("bundle", "part")) -> DataFrame:
    """Per part of at most `size` articles one HTML document: keys, n_articles, html. Every article but the part's first starts a page."""
    rows = assign_parts(articles, size) if "part" not in articles.columns else articles
    rows = rows.select(*keys, F.struct("place", "title", "author", "content", "published_at", "source_url", "source_type").alias("a"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("a.place").alias("place"), F.col("a.title").alias("title"), _section(F.col("a")).alias("html")))).alias("s"))
    first, n = F.get("s", F.lit(0))["title"], F.size("s")
    title = F.when(n == 1, first).otherwise(F.concat(first, F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)")))
    html = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>'), title, F.lit("</title></head><body>"), F.array_join(F.transform("s", lambda x: x["html"]), "\n"), F.lit("</body></html>"))
    return g.select(*keys, n.alias("n_articles"), html.alias("html"))


def render_isolated(articles: DataFrame, ok: str = "ok", size: int = PART) -> DataFrame:
    """Parts in which every article is ok stay whole; of others each ok article is a sub-part of its own and the rest are counted: bundle,
    part, sub, n_articles, n_failed. A part of failures only has a row with n_articles 0."""
    rows = assign_parts(articles, size)
    failed = F.count_if(~F.col(ok)).over(Window.partitionBy("bundle", "part"))
    rows = rows.withColumn("n_failed", failed).withColumn("sub", F.when(F.col("n_failed") == 0, 0).when(F.col(ok), F.col("place")))
    g = rows.groupBy("bundle", "part", "sub", "n_failed").agg(F.count("*").alias("n"))
    alone = Window.partitionBy("bundle", "part")
    g = g.withColumn("_subs", F.count("sub").over(alone)).where("sub is not null or _subs = 0")
    return g.select("bundle", "part", F.coalesce("sub", F.lit(0)).cast("int").alias("sub"), F.when(F.col("sub").isNotNull(), F.col("n")).otherwise(0).alias("n_articles"), "n_failed")


def merge_parts(articles: DataFrame, size: int = PART) -> DataFrame:
    """The final sequence of each bundle: part order, then article order."""
    return assign_parts(articles, size).withColumn("sequence", F.row_number().over(Window.partitionBy("bundle").orderBy("part", "place")))


def convert_report(results: DataFrame) -> DataFrame:
    """Per batch: total, succeeded, failed, details of errors as lines (null without any), one text: a batch, one list that a user sent, must fit a row."""
    bad = F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("pos", "url", "error")))), lambda x: F.concat(F.lit("- "), x["url"], F.lit(": "), x["error"]))
    g = results.groupBy("batch").agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.array_join(bad, "\n").alias("errors"))
    return g.withColumn("errors", F.nullif("errors", F.lit("")))


def archive_manifest(files: DataFrame, mode: str) -> DataFrame:
    """Per batch of two or more files: archive name, members in order, size. The name depends on all names, so those of a batch must fit a row."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "filename"))), lambda x: x["filename"])
    g = files.groupBy("batch").agg(names.alias("members"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n"))
    name = F.concat(F.lit(f"youtube_{mode}_batch_"), F.substring(F.sha2(F.array_join("members", "\n"), 256), 1, 12), F.lit(".zip"))
    return g.select("batch", F.when(F.col("n") > 1, name).alias("archive"), "n", "size_bytes")
