"""Pages whose elements aren't closed or cross each other, mended so that token rules see the tree that a tolerant parser builds."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import markup as m
from .html import PAGE

# Fixed values of the HTML standard: elements without an end, and those that end a paragraph.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
ENDS_PARAGRAPH = [
    "address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav",
    "ol", "p", "pre", "section", "table", "ul",
]
#: Siblings: elements that an opening tag ends, and those that it doesn't look beyond.
_ROWS, _PARTS = ["tr", "td", "th"], ["tbody", "thead", "tfoot"]
SIBLINGS = {
    "li": (["li"], ["ol", "ul", "menu"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]),
    "tr": (_ROWS, ["table"]), **{t: ([*_ROWS, *_PARTS], ["table"]) for t in _PARTS}, "option": (["option"], ["select"]), "optgroup": (["option", "optgroup"], ["select"]), "body": (["head"], ["html"]), "a": (["a"], ["p", "li", "td", "th", "div", "table"]),
}
#: What a paragraph doesn't reach out of.
KEEPS = ["table", "td", "th", "caption", "button", "object", "template"]
#: An end is passed over where an open element of higher rank stands before its own; other elements have rank 100.
RANKS = {"div": 150, "section": 150, "article": 150, "main": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
#: Elements open at once in a page that is tested by expressions; deeper ones are walked.
DEPTH = 200


def _tokens(html: Column) -> Column:
    return F.regexp_extract_all(m.visible(html), F.lit(m.TOKEN), F.lit(0))


def is_ambiguous(html: Column) -> Column:
    """Whether the tree differs from what the tags say as written: an element without its end, an end without its element, elements that
    cross, an element that ends another, or one that is closed in its own tag. By folding the page's tags, without a shuffle; a fold that has found something holds nothing more."""
    name = lambda t: F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    tags = F.transform(F.filter(_tokens(html), lambda t: t.rlike("^</?[a-zA-Z]")), lambda t: F.struct(name(t).alias("name"), t.startswith("</").alias("ends"), t.endswith("/>").alias("short")))
    tags = F.filter(tags, lambda t: ~t["name"].isin(VOID))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(False).alias("bad"))

    def within(opened: Column, names: list[str], stops: list[str]) -> Column:
        """Whether one of names is open behind the last of stops."""
        return F.aggregate(opened, F.lit(False), lambda found, x: F.when(x.isin(names), True).when(x.isin(stops), False).otherwise(found))

    def step(s: Column, t: Column) -> Column:
        top = F.get(s["open"], F.size(s["open"]) - 1)
        ends = F.when(t["name"].isin(ENDS_PARAGRAPH), within(s["open"], ["p"], KEEPS)).otherwise(False)
        for names, stops in sorted({(tuple(n), tuple(x)) for n, x in SIBLINGS.values()}):
            tags_ = [tag for tag, of in SIBLINGS.items() if (tuple(of[0]), tuple(of[1])) == (names, stops)]
            ends = ends | F.when(t["name"].isin(tags_), within(s["open"], list(names), list(stops))).otherwise(False)
        bad = s["bad"] | F.when(t["ends"], ~F.coalesce(top == t["name"], F.lit(False))).otherwise(t["short"] | ends | (F.size(s["open"]) >= DEPTH))
        after = F.when(t["ends"], F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(F.concat(s["open"], F.array(t["name"])))
        return F.struct(F.when(bad, F.array().cast("array<string>")).otherwise(after).alias("open"), bad.alias("bad"))

    return F.coalesce(F.aggregate(tags, start, step, lambda s: s["bad"] | (F.size(s["open"]) > 0)), F.lit(False))


class _Tree:
    """Open elements of a page, and its tokens so far. Places of each tag and rank among the open ones are kept, so no step walks them all."""

    def __init__(self):
        self.open, self.at, self.ranked, self.out = [], {}, {}, []

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str) -> None:
        for of, key in ((self.at, tag), (self.ranked, RANKS.get(tag, 100))):
            of.setdefault(key, []).append(len(self.open))
        self.open.append(tag)

    def pop_to(self, size: int) -> None:
        while len(self.open) > size:
            tag = self.open.pop()
            self.at[tag].pop()
            self.ranked[RANKS.get(tag, 100)].pop()
            self.out.append(f"</{tag}>")

    def end(self, ends, stops) -> None:
        """Ends the elements up to the outermost of `ends` that is nearer than any of `stops`."""
        stop = self.last(stops)
        found = [places[k] for t in ends if (places := self.at.get(t)) and (k := bisect_right(places, stop)) < len(places)]
        if found:
            self.pop_to(min(found))

    def opens(self, tag: str, token: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self.end(("p",), KEEPS)
        if tag in SIBLINGS:
            self.end(*SIBLINGS[tag])
        short = token.endswith("/>") and tag not in VOID
        self.out.append(token[:-2].rstrip() + ">" if short else token)
        if tag not in VOID:
            self.push(tag)
            if short:
                self.pop_to(len(self.open) - 1)

    def closes(self, tag: str) -> None:
        at, rank = self.last((tag,)), RANKS.get(tag, 100)
        if at >= 0 and all(not places or places[-1] < at for r, places in self.ranked.items() if r > rank):
            self.pop_to(at)


def mended(tokens: list[str]) -> str:
    """A page's tokens as markup in which every element is closed where a tolerant parser ends it."""
    tree = _Tree()
    for token in tokens:
        ends = token.startswith("</")
        head = token[2 if ends else 1 :].lstrip("/") if token[0] == "<" else ""
        if not (head and head[0].isascii() and head[0].isalpha()):
            tree.out.append(token)
            continue
        n = next((k for k, c in enumerate(head) if not (c.isascii() and (c.isalnum() or c in ":-"))), len(head))
        tree.closes(head[:n].lower()) if ends else tree.opens(head[:n].lower(), token)
    tree.pop_to(0)
    return "".join(tree.out)


@F.pandas_udf(StringType())
def _mend(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in tokens:
        yield batch.map(lambda t: None if t is None else mended(t))


def repaired(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages, with html mended where it is ambiguous, and `repaired`, whether it was. Only ambiguous pages' tokens go to Python, a page
    at a time; other pages stay as they are written. Paragraphs, items, cells, terms and options end where another begins; an end tag ends the
    elements within its own, is passed over where one of higher rank is open or its element isn't, and what is left open ends with the page. Texts stay
    where they are written, in tables too. Elements that were ended aren't opened again. Scripts, styles and comments are dropped from mended pages. Null and empty pages
    aren't ambiguous. Repeated rows give the same again; a column named `repaired` is replaced."""
    rows = pages.withColumn("repaired", is_ambiguous(F.col(html)))
    new = _mend(F.when(F.col("repaired"), _tokens(F.col(html))))
    return rows.withColumn(html, F.coalesce(new, F.col(html)))


def repair_shares(rows: DataFrame, by: str) -> DataFrame:
    """Of repaired rows, per value of a column: pages, those that were mended and their share."""
    g = rows.groupBy(by).agg(F.count("*").alias("n_pages"), F.count_if("repaired").alias("n_repaired"))
    return g.withColumn("share", F.col("n_repaired") / F.col("n_pages"))
