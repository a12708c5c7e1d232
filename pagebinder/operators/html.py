"""Pages as tokens: one row per tag or text, in document order. All windows are by page, so tokens are shuffled once;
a page is what a task must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as m

PAGE = "page_id"


#: Bytes of markup for a partition of pages that are cut to tokens, which take some fifty times that in windows.
PART = 4 << 20


def by_page(pages: DataFrame, markup: str = "html") -> DataFrame:
    """pages dealt by page to partitions of about PART bytes of markup (counted first), so that tokens needn't be shuffled and what a task holds doesn't
    grow with the table. Streams stay as they are."""
    if pages.isStreaming:
        return pages
    size = pages.agg(F.sum(F.octet_length(F.col(f"`{markup}`").cast("string")))).first()[0] or 0
    return pages.repartition(max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART)), PAGE)


def html_tokens(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, pos, kind (open, close, text or other), tag, token; without scripts, styles and comments. A page without any
    token has one row of nulls when columns are kept (on its first row only)."""
    cut = F.regexp_extract_all(m.visible(F.col("html")), F.lit(m.TOKEN), F.lit(0))
    if keep:
        rows = pages.select(PAGE, *keep, F.posexplode_outer(cut).alias("pos", "token"))
        rows = rows.withColumns({c: F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)) for c in keep})
    else:
        rows = pages.select(PAGE, F.posexplode(cut).alias("pos", "token"))
    t = F.col("token")
    kind = F.when(t.startswith("</"), "close").when(t.rlike("^<[a-zA-Z]"), "open").when(t.startswith("<"), "other").when(t.isNotNull(), "text")
    return rows.select(PAGE, *keep, "pos", kind.alias("kind"), F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1)).alias("tag"), "token")


def with_ends(tokens: DataFrame, counted: dict[str, Column] | None = None, bare: bool = True) -> DataFrame:
    """tokens with level (how many elements of the tag are open after the token), close_pos (of opens that are closed), open_token (of
    closes), and filled (texts that aren't blank up to the token) with filled_end (the same at the close). Each tag has a depth of
    its own, so others left open do no harm. counted: conditions, whose tokens are counted up to each (name) and, on opens that are
    closed, up to the close (name_end). bare: see markup.decoded."""
    counted = counted or {}
    by_tag = Window.partitionBy(PAGE, "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    by_page = Window.partitionBy(PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    filled = F.sum(((F.col("kind") == "text") & (F.regexp_replace(m.decoded(F.col("token"), bare), r"[\s\u00a0]+", "") != "")).cast("int"))
    rows = tokens.withColumn("level", F.sum(step).over(by_tag)).withColumns({"filled": filled.over(by_page), **{k: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(by_page) for k, c in counted.items()}})
    rows = rows.withColumn("_key", F.when(F.col("kind") == "close", F.col("level") + 1).otherwise(F.col("level")))
    at = Window.partitionBy(PAGE, "tag", "_key").orderBy("pos")
    closed = (F.col("kind") == "open") & (F.lead("kind").over(at) == "close")
    opened = (F.col("kind") == "close") & (F.lag("kind").over(at) == "open")
    return rows.withColumns({
        "close_pos": F.when(closed, F.lead("pos").over(at)), "filled_end": F.when(closed, F.lead("filled").over(at)),
        "open_token": F.when(opened, F.lag("token").over(at)), "open_filled": F.when(opened, F.lag("filled").over(at)),
        **{f"{k}_end": F.when(closed, F.lead(k).over(at)) for k in counted},
    }).drop("_key")


def element_ranges(tokens: DataFrame) -> DataFrame:
    """page_id, tag, open_pos, close_pos, level of the elements that are closed."""
    return with_ends(tokens).where("close_pos is not null").select(PAGE, "tag", F.col("pos").alias("open_pos"), "close_pos", "level")


# What isn't content.
BOILERPLATE_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
BOILERPLATE_CLASSES = ["comments", "sidebar", "advertisement", "ad", "share"]


def with_boilerplate(rows: DataFrame) -> DataFrame:
    """rows of with_ends with `classes` (of the element that the token opens or closes), `boilerplate`: whether the token belongs to an element that isn't content, and `blank`: to a closed
    paragraph without text."""
    opening = F.when(F.col("kind") == "open", F.col("token")).otherwise(F.col("open_token"))
    rows = rows.withColumn("classes", m.classes(opening))
    off = F.col("tag").isin(BOILERPLATE_TAGS)
    for name in BOILERPLATE_CLASSES:
        off = off | F.col("classes").contains(f" {name} ")
    paired = F.col("close_pos").isNotNull() | F.col("open_token").isNotNull()
    empty = (F.col("tag") == "p") & (F.coalesce("filled_end", "filled") == F.coalesce("open_filled", "filled"))
    by_page = Window.partitionBy(PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("kind") == "open", 1).otherwise(-1)
    for name, what in (("boilerplate", off), ("blank", empty)):
        step = F.when(paired & F.coalesce(what, F.lit(False)), sign).otherwise(0)
        rows = rows.withColumn("_step", step).withColumn(name, (F.sum("_step").over(by_page) > 0) | (F.col("_step") < 0)).drop("_step")
    return rows


def drop_boilerplate(tokens: DataFrame) -> DataFrame:
    return with_boilerplate(with_ends(tokens)).where("not boilerplate").select(tokens.columns)


# Selectors of each field in order of priority: (field, tag or None, (attribute, value) or None, ancestor or None).
SELECTORS = [
    ("title", "h1", ("class", "post-title"), None), ("title", "h1", ("class", "entry-title"), None), ("title", "h1", ("class", "article-title"), None),
    ("title", "h1", None, "article"), ("title", "h1", None, "main"), ("title", "h1", None, None),
    ("author", None, ("rel", "author"), None), ("author", None, ("class", "author"), None), ("author", None, ("class", "byline"), None),
    ("author", "meta", ("name", "author"), None), ("author", None, ("class", "post-author"), None),
    ("date", None, ("class", "date"), None), ("date", None, ("class", "published"), None), ("date", None, ("class", "post-date"), None),
    ("content", "article", None, None), ("content", None, ("role", "article"), None), ("content", None, ("class", "post-content"), None),
    ("content", None, ("class", "article-content"), None), ("content", None, ("class", "entry-content"), None), ("content", None, ("class", "content"), None),
    ("content", "main", None, None), ("content", None, ("class", "post"), None), ("content", None, ("id", "content"), None), ("content", "body", None, None),
    ("head", "title", None, None), ("time", "time", None, None),
]


def selected(rows: DataFrame) -> DataFrame:
    """rows of with_boilerplate with `rules`: numbers of the selectors whose first element holds the token, and whether it opens it.
    Contents are chosen among what isn't boilerplate."""
    by_page = Window.partitionBy(PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(PAGE)
    for tag in ("article", "main"):
        step = F.when(F.col("tag") != tag, 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
        rows = rows.withColumn(f"_in_{tag}", F.sum(step).over(by_page) > 0)
    numbers = []
    for field, tag, attr, above in SELECTORS:
        ok = F.col("kind") == "open"
        if tag:
            ok = ok & (F.col("tag") == tag)
        if attr:
            ok = ok & (F.col("classes").contains(f" {attr[1]} ") if attr[0] == "class" else m.attribute(F.col("token"), attr[0]) == attr[1])
        if above:
            ok = ok & F.col(f"_in_{above}")
        if field == "content":
            ok = ok & ~F.col("boilerplate")
        numbers.append(F.when(ok, len(numbers)))
    rows = rows.withColumn("_opens", F.filter(F.array(*numbers), lambda x: x.isNotNull()))
    # the first element of each selector: its place and end; unclosed elements run to the end of the page
    firsts = F.array(*[F.min(F.when(F.array_contains("_opens", k), F.struct("pos", F.coalesce("close_pos", F.lit(2**30)).alias("end")))).over(whole) for k in range(len(SELECTORS))])
    rows = rows.withColumn("_firsts", firsts)
    inside = F.filter(F.transform("_firsts", lambda f, k: F.when(f.isNotNull() & F.col("pos").between(f["pos"], f["end"]), k)), lambda k: k.isNotNull())
    return rows.withColumn("rules", inside).drop("_opens", "_firsts", "_in_article", "_in_main")


def select_first(tokens: DataFrame, bare: bool = True) -> DataFrame:
    """page_id, rule, field, open_token, value (the text pieces of the first element of each selector, trimmed and joined), html (without
    boilerplate and blank paragraphs). bare: see markup.decoded."""
    rows = selected(with_boilerplate(with_ends(tokens, bare=bare))).select(PAGE, "pos", "kind", "token", "boilerplate", "blank", F.explode("rules").alias("rule"))
    piece = F.when(F.col("kind") == "text", F.regexp_replace(m.decoded(F.col("token"), bare), r"^\s+|\s+$", "")).otherwise("")
    # an element's tokens: bounded by its page
    parts = F.array_sort(F.collect_list(F.struct("pos", piece.alias("text"), F.when(F.col("boilerplate") | F.col("blank"), "").otherwise(F.col("token")).alias("html"))))
    out = rows.groupBy(PAGE, "rule").agg(parts.alias("parts"), F.min_by("token", "pos").alias("open_token"))
    fields = F.array(*[F.lit(f) for f, *_ in SELECTORS])
    return out.select(PAGE, "rule", F.get(fields, F.col("rule")).alias("field"), "open_token", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("value"), m.collapsed(F.array_join(F.transform("parts", lambda x: x["html"]), "")).alias("html"))
