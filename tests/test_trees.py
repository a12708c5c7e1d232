"""Mended pages against a plain walk over the events of html.parser, and that pages which aren't ambiguous are the tree as written."""

import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagebinder.operators import extract, trees


class Walk(HTMLParser):
    """A tree walk that searches the open elements from the innermost for each tag. Texts with the path of elements above them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts = [], []

    def end_nearest(self, names, stops):
        reach = len(self.open)
        while reach and self.open[reach - 1] not in stops:
            reach -= 1
        inner = [k for k in range(reach, len(self.open)) if self.open[k] in names]
        if inner:
            del self.open[inner[0] :]

    def handle_starttag(self, tag, attrs):
        if tag in trees.ENDS_PARAGRAPH:
            self.end_nearest(["p"], trees.KEEPS)
        if tag in trees.SIBLINGS:
            self.end_nearest(*trees.SIBLINGS[tag])
        if tag not in trees.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in trees.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in reversed(range(len(self.open))):
            if self.open[k] == tag:
                del self.open[k:]
                return
            if trees.RANKS.get(self.open[k], 100) > trees.RANKS.get(tag, 100):
                return

    def handle_data(self, data):
        if self.texts and self.texts[-1][0] == self.open:
            self.texts[-1][1] += data
        else:
            self.texts.append([list(self.open), data])


class Written(Walk):
    """Tags as written: an end must belong to the innermost element."""

    def handle_starttag(self, tag, attrs):
        if tag not in trees.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in trees.VOID:  # such an end means nothing
            return
        assert self.open and self.open[-1] == tag, (self.open, tag)
        self.open.pop()


def paths(html, walk):
    w = walk()
    w.feed(html)
    w.close()
    if walk is Written:
        assert not w.open
    return w.texts


TAGS = ["p", "li", "ul", "ol", "b", "i", "a", "div", "table", "tr", "td", "dl", "dt", "dd", "h2", "section", "br", "img", "span", "blockquote"]


def soup(rng, n):
    out = []
    for _ in range(n):
        tag = rng.choice(TAGS)
        out.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f"</{tag}>", f"<{tag} class='x>y'>", f"<{tag}/>", f"t{rng.randrange(99)} "]))
    return "".join(out)


NAMED = ["<p>a<p>b", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<b><i>x</b>y</i>z", "<table>text<tr><td>a<td>b<tr><td>c</table>d", "<p>a<div>b</div>c</p>", "<b><div>x</b>y</div>z", "</p></b>x", "<div/>x<br/>y", "", "no tags", "a < b <3 <", "<p>x</p>"]


def test_mended_pages_equal_a_walk(spark):
    rng = random.Random(5)
    cases = NAMED + [soup(rng, rng.randrange(1, 40)) for _ in range(1500)] + [None]
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = trees.repaired(rows.withColumn("source", F.lit("s"))).orderBy("page_id").collect()
    mended = 0
    for case, r in zip(cases, got, strict=True):
        if case is None:
            assert r.html is None and not r.repaired
            continue
        mended += r.repaired
        assert r.repaired or r.html == case
        if "< " not in case:
            assert paths(r.html, Written) == paths(case, Walk), case
    assert 0 < mended < len(cases)
    assert [r.repaired for r in got[: len(NAMED)]] == [True] * 8 + [False] * 4


def test_closed_pages_stay(spark):
    """Well-formed nestings: mending them would change nothing."""
    rng = random.Random(6)

    def tree(depth):
        tag = rng.choice(TAGS)
        if tag in trees.VOID or depth == 0:
            return f"t{rng.randrange(9)}"
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(3))) + f"</{tag}>"

    cases = [tree(4) for _ in range(800)]
    got = trees.repaired(spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")).orderBy("page_id").collect()
    for case, r in zip(cases, got, strict=True):
        assert r.repaired == (paths(case, Walk) != paths(case, Written) or trees.mended(trees_tokens(case)) != case), case


def trees_tokens(html):
    import re

    return re.findall(r"<[^>]*>|[^<]+", html)


def test_blocks_of_mended_pages(spark):
    page = "<html><body><article><h2>Head</h2><p>a<p>b <b>c<ul><li>one<li>two</ul><blockquote><b><i>q</b></i></blockquote><pre><code class=language-py>x = 1"
    rows = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")
    got = [(r.type, r.content, r["items"], r.language) for r in extract.extract_blocks(trees.repaired(rows)).orderBy("pos").collect()]
    assert got == [("heading", "Head", None, None), ("text", "a", None, None), ("text", "b c", None, None), ("unordered_list", "one\ntwo", ["one", "two"], None), ("blockquote", "q", None, None), ("code", "x = 1", None, "py")]
    none = spark.createDataFrame([], "page_id long, html string")
    assert trees.repaired(none).count() == 0 and extract.extract_blocks(trees.repaired(none)).count() == 0


def test_articles_of_mended_pages(spark):
    page = "<html><head><title>T</title><body><article><p>" + "word " * 40 + "<p>more<aside>side<p>x</aside><footer>foot</article><p>after"
    rows = spark.createDataFrame([(1, "https://h.example/", page)], "page_id long, url string, html string")
    got = extract.extract_articles(trees.repaired(rows)).first()
    assert got.title == "T" and got.content == "<article><p>" + "word " * 40 + "</p><p>more</p></article>"


def test_hostile_pages():
    """Deep pages with ends that are passed over take time linear in their tags."""
    for page in (["<b>", "<div>"] + ["<i>"] * 100_000 + ["</b>"] * 100_000, ["<p>", "<table>"] + ["<i>"] * 100_000 + ["<hr>"] * 100_000, ["<li>"] * 100_000, ["<div>"] * 100_000):
        began = time.monotonic()
        assert trees.mended(page).endswith(">")
        assert time.monotonic() - began < 10


def test_report(spark):
    rows = spark.createDataFrame([(1, "a", "<p>x"), (2, "a", "<p>x</p>"), (3, "b", None)], "page_id long, source string, html string")
    got = {r.source: (r.n_pages, r.n_repaired, r.share) for r in trees.repair_shares(trees.repaired(rows), "source").collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
