"""Pages to articles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as m
from ..functions import urls
from . import html
from .html import PAGE

#: Contents of a selector shorter than this give way to the next one.
LEAST = 100
NO_CONTENT = "Could not extract article content"


def _first(rows: Column, keep) -> Column:
    """The first of an array of structs that keep() takes."""
    return F.get(F.filter(rows, keep), F.lit(0))


def fields(pages: DataFrame, legacy_prefix: bool = True, bare: bool = True) -> DataFrame:
    """Per page: page_id, url, title, author, published_at, content. Metas, selectors and the address are tried in that order; a date that
    is there but can't be read ends the search for one. legacy_prefix: "by" is stripped from authors even without a space ("Byron"). bare: see
    markup.decoded."""
    decoded = partial(m.decoded, bare=bare)
    tokens = html.html_tokens(pages, keep=("url",))
    rows = html.selected(html.with_boilerplate(html.with_ends(tokens, bare=bare)))
    t = F.col("token")
    is_meta = (F.col("kind") == "open") & (F.col("tag") == "meta")
    metas = {"og": is_meta & (m.attribute(t, "property") == "og:title"), "by": is_meta & (m.attribute(t, "name") == "author"), "on": is_meta & (m.attribute(t, "property") == "article:published_time")}
    piece = F.when(F.col("kind") == "text", F.regexp_replace(decoded(t), r"^\s+|\s+$", "")).otherwise("")
    kept = F.when(F.col("boilerplate") | F.col("blank"), "").otherwise(t)
    rows = rows.select(PAGE, "url", "pos", *[F.when(c, F.struct("pos", m.attribute(t, "content").alias("v"))).alias(k) for k, c in metas.items()], piece.alias("text"), kept.alias("html"), t.alias("token"), F.explode_outer("rules").alias("rule"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text", "html")))  # bounded by the page
    by_rule = rows.groupBy(PAGE, "rule").agg(F.max("url").alias("url"), *[F.min(k).alias(k) for k in metas], F.min_by("token", "pos").alias("token"), parts.alias("parts"))
    by_rule = by_rule.select(PAGE, "rule", "url", *metas, "token", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"), m.collapsed(F.array_join(F.transform("parts", lambda x: x["html"]), "")).alias("html"))
    page = by_rule.groupBy(PAGE).agg(F.max("url").alias("url"), *[F.min(k).alias(k) for k in metas], F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "text", "html", "token")))).alias("found"))

    def of(field: str) -> Column:
        numbers = [k for k, s in enumerate(html.SELECTORS) if s[0] == field]
        return F.filter("found", lambda x: x["rule"].isin(numbers))

    page = page.withColumns({k: decoded(F.col(f"{k}.v")) for k in metas})
    host = urls.authority(F.coalesce("url", F.lit("")))
    text = lambda x: x["text"] != ""
    title = F.coalesce(F.nullif(F.trim("og"), F.lit("")), _first(of("title"), text)["text"], _first(of("head"), text)["text"], host)
    meta_rule = next(k for k, s in enumerate(html.SELECTORS) if s[0] == "author" and s[1] == "meta")
    prefix = r"(?i)^(by|author:?)\s*" if legacy_prefix else r"(?i)^(by\s+|author:?\s*)"
    chosen = _first(of("author"), lambda x: (x["rule"] == meta_rule) | (x["text"] != ""))
    by_selector = F.when(chosen["rule"] == meta_rule, m.once(m.attribute(chosen["token"], "content"), lambda x: F.trim(decoded(x)))).otherwise(F.regexp_replace(chosen["text"], prefix, ""))
    author = F.coalesce(F.when(F.col("by") != "", F.trim("by")), by_selector, host)
    time = _first(of("time"), lambda x: F.lit(True))
    time_text = F.when(m.has_attribute(time["token"], "datetime"), m.attribute(time["token"], "datetime")).otherwise(time["text"])
    texts = F.transform(of("date"), lambda x: F.when(m.has_attribute(x["token"], "content"), m.attribute(x["token"], "content")).otherwise(x["text"]))
    dates = F.transform(F.transform(texts, lambda x: decoded(x)), m.parsed_date)
    date = F.when(F.col("on") != "", m.parsed_date(F.col("on"))).when(time.isNotNull(), m.once(time_text, lambda x: m.once(decoded(x), m.parsed_date))).otherwise(F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)))
    body = max(k for k, s in enumerate(html.SELECTORS) if s[0] == "content")
    content = F.coalesce(_first(of("content"), lambda x: (F.length(x["html"]) > LEAST) | (x["rule"] == body))["html"], F.lit(""))
    return page.select(PAGE, "url", title.alias("title"), author.alias("author"), date.alias("published_at"), content.alias("content"))


def extract_articles(pages: DataFrame, **kw) -> DataFrame:
    """Per page an article: page_id, title, author, content, published_at, source_url, source_type, status, error. Pages without content are
    rows that failed."""
    ok = F.col("content") != ""
    return fields(pages, **kw).select(PAGE, "title", "author", "content", "published_at", F.col("url").alias("source_url"), F.lit("web").alias("source_type"), F.when(ok, "ok").otherwise("failed").alias("status"), F.when(~ok, NO_CONTENT).alias("error"))


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LISTS = ("ol", "ul")
_INLINE = ("a", "b", "code", "em", "i", "mark", "small", "span", "strong", "sub", "sup", "u")


def extract_blocks(pages: DataFrame, tags: tuple[str, ...] = ("p", *_HEADINGS, *_LISTS, "li", "blockquote", "pre", "img", "div", "section"), bare: bool = True, dealt: bool = False) -> DataFrame:
    """Typed block rows in document order, outside boilerplate: page_id, pos, type (text, heading, code, ordered_list, unordered_list,
    list_item, blockquote, image), level (of headings), content (text, code, an image's address), items (of lists), language (of code).
    Only closed elements that aren't inside another block count. A div or section is a block where it holds code and no other block, which is
    its code then; an element with a heading in it gives way to the heading, and one with images to them and to its marked-up text. Images
    need an address by http. Texts are trimmed and their white space collapsed, code is kept as it is; blank blocks are dropped. An item ends
    where an item within it begins. bare: see markup.decoded. dealt: pages come from html.by_page, which is done here otherwise."""
    from pyspark.sql import Window

    opens, t = F.col("kind") == "open", F.col("token")
    source = m.attribute(t, "src")
    counted = {
        "n_img": opens & (F.col("tag") == "img") & source.startswith("http"), "n_head": opens & F.col("tag").isin(*_HEADINGS), "n_code": opens & F.col("tag").isin("pre", "code"),
        "n_block": opens & F.col("tag").isin("p", *_LISTS, "li", "blockquote"), "n_li": opens & (F.col("tag") == "li"),
    }
    rows = html.with_boilerplate(html.with_ends(html.html_tokens(pages if dealt else html.by_page(pages)), counted, bare)).where("not boilerplate")
    by_page = Window.partitionBy(PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    holds = {k: F.col(f"{k}_end") > F.col(k) for k in counted}
    tag = F.col("tag")
    images = holds["n_img"] & ~tag.isin(*_LISTS, "blockquote", "pre")
    parts = images & tag.isin(*tags) & ~tag.isin("div", "section")  # elements whose images and marked-up texts are blocks of their own
    rows = rows.withColumn("_parts", F.max(F.when(parts, F.col("close_pos"))).over(before))
    container = holds["n_code"] & ~holds["n_block"] & ~holds["n_head"] & ~holds["n_img"]
    inline = tag.isin(*_INLINE) & (F.col("_parts") > F.col("pos"))
    ok = F.when(tag.isin("div", "section"), container).when(tag.isin(*_HEADINGS), F.lit(True)).otherwise(~holds["n_head"] & ~images)
    end = F.when(opens & (tag == "img"), F.when(F.lit("img" in tags) & source.startswith("http"), F.col("pos"))).when((tag.isin(*tags) & ok) | (inline & ~images), F.col("close_pos"))
    rows = rows.withColumn("_end", end).withColumn("_outer", F.max("_end").over(before))
    rows = rows.withColumn("_open", F.when(F.col("_end").isNotNull() & (F.coalesce("_outer", F.lit(-1)) < F.col("pos")), F.struct("pos", "tag", "_end", "token", F.col("n_li").alias("items"))))
    rows = rows.withColumn("b", F.last("_open", ignorenulls=True).over(by_page)).where("pos <= b._end")
    # code: what stands in pre or code, whose depth is counted
    step = F.when(tag.isin("pre", "code") & opens, 1).when(tag.isin("pre", "code") & (F.col("kind") == "close"), -1).otherwise(0)
    rows = rows.withColumn("_in_code", F.sum(step).over(Window.partitionBy(PAGE, "b.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) > 0)
    is_code, is_list = F.col("b.tag").isin("pre", "div", "section"), F.col("b.tag").isin(*_LISTS)
    text = m.decoded(t, bare)
    piece = F.when(F.col("kind") == "text", F.when(is_code, text).otherwise(F.regexp_replace(text, r"[\s\u00a0]+", " "))).when(tag == "br", "\n").otherwise("")
    named = F.when(opens & tag.isin("pre", "code"), F.regexp_extract(m.attribute(t, "class"), r"(?:^|\s)language-(\S+)", 1))
    label = F.when(~F.col("_in_code") & (F.col("kind") == "text"), F.nullif(F.trim(text), F.lit("")))
    item = F.when(is_list, F.col("n_li") - F.col("b.items")).otherwise(0)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("x")))), lambda p: p["x"]), "")
    shown = F.when(is_code & ~F.col("_in_code"), "").otherwise(piece)
    one = rows.groupBy(PAGE, F.col("b.pos").alias("pos"), F.col("b.tag").alias("tag"), item.alias("item")).agg(
        joined(shown).alias("x"), F.min(F.when(F.col("pos") == F.col("b.pos"), source)).alias("src"), F.max(F.nullif(named, F.lit(""))).alias("named"), F.min_by(label, F.when(label.isNotNull(), F.col("pos"))).alias("label"),
    )
    one = one.withColumn("x", F.when(F.col("tag").isin("pre", "div", "section"), F.col("x")).otherwise(F.regexp_replace(F.regexp_replace("x", r" *\n *", "\n"), r"^\s+|\s+$", "")))
    items = F.transform(F.array_sort(F.collect_list(F.when((F.col("item") > 0) & (F.col("x") != ""), F.struct("item", "x")))), lambda i: i["x"])
    blocks = one.groupBy(PAGE, "pos", "tag").agg(items.alias("items"), F.max(F.when(F.col("item") == 0, F.col("x"))).alias("content"), F.max("src").alias("src"), F.max("named").alias("named"), F.max("label").alias("label"))
    heading, code = tag.isin(*_HEADINGS), tag.isin("pre", "div", "section")
    kind = (
        F.when(heading, "heading").when(tag == "ol", "ordered_list").when(tag == "ul", "unordered_list").when(tag == "li", "list_item").when(tag == "blockquote", "blockquote").when(code, "code").when(tag == "img", "image").otherwise("text")
    )
    content = F.when(tag == "img", m.decoded(F.col("src"), bare)).when(tag.isin(*_LISTS), F.array_join("items", "\n")).otherwise(F.col("content"))
    blocks = blocks.select(PAGE, "pos", kind.alias("type"), F.when(heading, F.substring("tag", 2, 1).cast("int")).alias("level"), content.alias("content"), F.when(tag.isin(*_LISTS), F.col("items")).alias("items"), F.when(code, F.coalesce("named", "label")).alias("language"))
    return blocks.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def dedupe_blocks(blocks: DataFrame, doc: str, pos: str = "pos") -> DataFrame:
    """Text blocks are kept once per trimmed text, images once per content, the first of each; other kinds are all kept."""
    from pyspark.sql import Window

    text, image = F.col("type") == "text", F.col("type") == "image"
    plain = blocks.where(~text & ~image | F.col("type").isNull())
    # first places by a keyed minimum: lighter than numbering all rows
    key = F.when(text, F.trim("content")).otherwise(F.col("content"))
    w = Window.partitionBy(doc, "type", "_key").orderBy(pos)
    once = blocks.where(text | image).withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")
    return once.unionByName(plain)


def render_blocks(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks as markup, one string per document: text by lines, headings, code with its language, lists and loose items, quotes, images.
    items and language may be absent."""
    c = m.escaped(F.col("content"))
    for name, kind in (("items", "array<string>"), ("language", "string")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    lang = m.escaped(F.nullif("language", F.lit("")))
    label, css = (F.coalesce(F.concat(F.lit(a), lang, F.lit(b)), F.lit("")) for a, b in (('<div class="code-lang">', "</div>"), (' class="language-', '"')))
    items = F.array_join(F.transform("items", lambda x: F.concat(F.lit("<li>"), m.escaped(x), F.lit("</li>"))), "\n")
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), m.escaped(x), F.lit("</p>"))), "\n")
    h = F.col("level").cast("string")
    image = F.regexp_replace("content", r"name=\w+", "name=large")
    one = (
        F.when(F.col("type") == "text", text).when(F.col("type") == "heading", F.concat(F.lit("<h"), h, F.lit(">"), c, F.lit("</h"), h, F.lit(">")))
        .when(F.col("type") == "code", F.concat(F.lit('<div class="code-block">'), label, F.lit("<pre><code"), css, F.lit(">"), c, F.lit("</code></pre></div>")))
        .when(F.col("type") == "ordered_list", F.concat(F.lit("<ol>\n"), items, F.lit("\n</ol>"))).when(F.col("type") == "unordered_list", F.concat(F.lit("<ul>\n"), items, F.lit("\n</ul>"))).when(F.col("type") == "list_item", F.concat(F.lit("<li>"), c, F.lit("</li>")))
        .when(F.col("type") == "blockquote", F.concat(F.lit("<blockquote><p>"), c, F.lit("</p></blockquote>"))).when(F.col("type") == "image", F.concat(F.lit('<div class="article-image"><img src="'), image, F.lit('" alt="Article image"></div>')))
    )
    rows = blocks.withColumn("html", one).where("html <> ''")
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "\n").alias("html"))


def block_stats(blocks: DataFrame, doc: str) -> DataFrame:
    kind = F.col("type")
    return blocks.groupBy(doc).agg(F.count("*").alias("n_blocks"), F.count_if(kind == "image").alias("n_images"), F.count_if(kind == "text").alias("n_text"), F.count_if(kind == "code").alias("n_code"))
