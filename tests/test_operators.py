"""Cases beyond what the driver's tables hold."""

import pytest
from pyspark.sql import functions as F

from pagebinder.functions import markup, urls
from pagebinder.operators import attempts, audit, bundles, extract, html, jobs, links, media, sessions, threads, timeline
from pagebinder.sources import readers

LONG = "word " * 40


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    (1, page(f"<h1>Own</h1><article><p>{LONG}</p></article>", '<meta property="og:title" content=" Meta "><title>T</title>'), "Meta", "h.example:8080", None),
    (2, page("<h1>A <b>B</b></h1><main><p>x</p></main>"), "AB", "h.example:8080", None),
    (3, page("<p>x</p>", "<title> Only &amp; title </title>"), "Only & title", "h.example:8080", None),
    (4, page("<p>x</p>"), "h.example:8080", "h.example:8080", None),
    (5, page('<div class="byline">By Jane</div><h1></h1><h1 class="post-title">P</h1>'), "P", "Jane", None),
    (6, page('<span class="author">Byron</span>', '<meta name="author" content="">'), "h.example:8080", "ron", None),
    (7, page("<p>x</p>", '<meta name="author" content=" by M "><meta property="article:published_time" content="2024-1-5T10:00:00Z">'), "h.example:8080", "by M", "2024-01-05 10:00:00"),
    (8, page('<time datetime="2024-01-05">soon</time>', '<meta property="article:published_time" content="soon">'), "h.example:8080", "h.example:8080", None),
    (9, page("<time>5 March 2024</time>"), "h.example:8080", "h.example:8080", "2024-03-05 00:00:00"),
    (10, page('<div class="date">nope</div><div class="published">Mar 5, 2024</div>'), "h.example:8080", "h.example:8080", "2024-03-05 00:00:00"),
    (11, page('<div class="post-author">A</div>', "<meta name='author' content=''>"), "h.example:8080", "", None),
]


def test_fields(spark):
    rows = spark.createDataFrame([(i, "https://h.example:8080/a b", h) for i, h, *_ in PAGES], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract.fields(rows).withColumn("d", F.col("published_at").cast("string")).collect()}
    for i, _, title, author, date in PAGES:
        assert (got[i].title, got[i].author, got[i].d) == (title, author, date), i


def test_content(spark):
    cases = {
        1: page(f"<nav>n</nav><article><script>var t='</p>'</script><p>{LONG}</p><p> </p><p><img src=x></p><aside>{LONG}</aside></article>"),
        2: page(f"<article>short</article><main><div class='x ad y'>ad</div>{LONG}</main>"),
        3: page("<p>tiny</p>"),
        4: None,
        5: page("<div><div class='sidebar'><div>in</div></div>out</div>"),
    }
    rows = spark.createDataFrame([(i, None, h) for i, h in cases.items()], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract.extract_articles(rows).collect()}
    assert got[1].content == f"<article><p>{LONG}</p></article>"
    assert got[2].content == f"<main>{LONG}</main>"
    assert got[3].content == "<body><p>tiny</p></body>" and got[3].status == "ok"
    assert (got[4].content, got[4].status, got[4].error) == ("", "failed", extract.NO_CONTENT)
    assert "in" not in got[5].content and "out" in got[5].content


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract_articles(none).count() == 0 and html.html_tokens(none).count() == 0


def test_dedupe_keeps_other_kinds(spark):
    rows = [(1, 0, "text", "a"), (1, 1, "text", " a "), (1, 2, "code", "a"), (1, 3, "code", "a"), (1, 4, "image", "s"), (1, 5, "image", "s"), (2, 0, "text", "a")]
    got = extract.dedupe_blocks(spark.createDataFrame(rows, "doc long, pos int, type string, content string"), "doc")
    assert sorted((r.doc, r.pos) for r in got.collect()) == [(1, 0), (1, 2), (1, 3), (1, 4), (2, 0)]


@pytest.mark.parametrize(("url", "route", "kind"), [
    ("https://x.com/u/status/1", "thread", None), ("https://www.twitter.com/u/article/12?x", "thread", None), ("https://x.com/u", None, None), ("", None, None), ("not a url", None, None),
    ("ftp://e.example/", None, None), ("https://E.example:80/p q", "web", None), ("https://www.youtube.com/watch?v=a", "web", "video"), ("https://www.youtube.com/watch?v=a&list=b", "web", "playlist"),
    ("https://music.youtube.com/playlist?list=b", "web", "playlist"), ("https://youtube.com/playlist", "web", None), ("https://youtu.be/", "web", None), ("https://youtu.be/x", "web", "video"),
    ("https://youtube.com/shorts/x", "web", "video"), ("https://youtube.com/live/", "web", None), ("https://www.youtube-nocookie.com/embed/x", "web", "video"), ("https://youtube.com/channel/x", "web", None),
])
def test_urls(spark, url, route, kind):
    r = spark.createDataFrame([(url,)], "url string").select(urls.route(F.col("url")).alias("r"), urls.media_kind(F.col("url")).alias("k")).first()
    assert (r.r, r.k) == (route, kind)


def test_registered_source(spark):
    links.register_source("gopher", lambda u: u.startswith("gopher:"), first=True)
    try:
        got = links.route_links(spark.createDataFrame([("gopher://x",), ("https://a.example",)], "url string")).collect()
        assert [r.route for r in got] == ["gopher", "web"]
    finally:
        links.unregister_source("gopher")


def test_slug(spark):
    cases = {"Hello,  World!": "hello-world", "Größe ß É": "groe-e", "": "article", "???": "article", "a" * 90: "a" * 80, "x" * 79 + " y": "x" * 79, "--a--": "a"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", markup.slug(F.col("t"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_titles(spark):
    rows = spark.createDataFrame([("x" * 100,), ("x" * 101,), ("a\nb ",), ("",)], "c string")
    got = [r.t for r in rows.select(threads.derive_title(F.lit(None).cast("string"), F.lit(""), F.col("c"), F.lit("me")).alias("t")).collect()]
    assert got == ["x" * 100, "x" * 97 + "...", "a b", "Tweet by @me"]


def test_streaks_and_delays(spark):
    outcomes = ["failed", "failed", "unsupported", "failed", "ok", "failed", "ok"]
    items = spark.createDataFrame([(1, i, "thread", o) for i, o in enumerate(outcomes)], "batch int, pos int, kind string, outcome string")
    got = sorted((r.pos, r.streak, r.delay) for r in attempts.pacing_delay(items).collect())
    assert [s for _, s, _ in got] == [0, 1, 2, 2, 3, 0, 1]
    assert [d for *_, d in got] == [0.0, 15.0, 25.0, 25.0, 35.0, 5.0, 15.0]


def test_replay_parameter(spark):
    e = spark.createDataFrame([(1, i) for i in range(3)], "job int, sequence int")
    assert [jobs.replay_events(e, a).count() for a in ("0", "1", "9", "-4", "x", None)] == [3, 2, 0, 3, 3, 3]


def test_stale_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", None), (2, "2024-01-19 00:00:00", None), (3, None, "2024-01-01 00:00:00"), (4, "rubbish", "2024-01-01 00:00:00")]
    m = spark.createDataFrame(rows, "session_id int, updated_at string, t string").withColumn("dir_mtime", F.col("t").cast("timestamp"))
    assert sorted(r.session_id for r in sessions.stale_sessions(m, F.lit("2024-01-20").cast("timestamp")).collect()) == [1, 3]


def test_session_meta_survives_malformed_json(spark):
    m = spark.createDataFrame([(1, '{"urls":["a"],"status":"running"}'), (2, "{oops")], "s int, body string")
    got = {r.session_id: r.urls for r in readers.read_session_meta(m, "s", "body").collect()}
    assert got == {1: ["a"], 2: None}


def test_article_store(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "t", "published_at": "2024-01-02T03:04:05", "url": "u"}')
    (tmp_path / "b.json").write_text('{"title": "t2", "published_at": "whenever"}')
    (tmp_path / "_meta.json").write_text('{"title": "not an article"}')
    got = {r.title: r.published_at is None for r in readers.read_article_store(spark, str(tmp_path)).collect()}
    assert got == {"t": False, "t2": True}


def test_artifact_inventory(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"12345")
    (tmp_path / "b.mp3").write_bytes(b"1")
    assert [(r.name, r.size) for r in readers.read_artifact_inventory(spark, str(tmp_path), ".mp4").collect()] == [("a.mp4", 5)]


def test_timeline_modules_and_quotes(spark):
    body = """{"data":{"bookmark_timeline_v2":{"timeline":{"instructions":[{"type":"TimelineAddEntries","entries":[
      {"content":{"__typename":"TimelineTimelineModule","items":[{"item":{"itemContent":{"itemType":"TimelineTweet","tweet_results":{"result":{"__typename":"TweetTombstone"}}}}},
        {"item":{"itemContent":{"itemType":"TimelineTweet","tweet_results":{"result":{"__typename":"TweetWithVisibilityResults","tweet":{"rest_id":"7","legacy":{"full_text":"plain"},
          "note_tweet":{"note_tweet_results":{"result":{"text":"a longer note"}}},"quoted_status_result":{"result":{"legacy":{"extended_entities":{"media":[{"type":"video"}]}}}}}}}}}},
        {"item":{"itemContent":{"itemType":"TimelineTweet","tweet_results":{"result":{"rest_id":"8"}}}}}]}}]}]}}}}"""
    got = timeline.bookmark_records(spark.createDataFrame([(1, body), (2, "oops"), (3, None)], "k int, body string"), "k", "body").collect()
    assert [(r.k, r.tweet_id, r.text_preview, r.has_video) for r in got] == [(1, "7", "a longer note", True)]


def test_file_verdicts(spark):
    good = "\t".join(["#HttpOnly_.youtube.com", "TRUE", "/", "TRUE", "0", "SID", "PLACEHOLDER"])
    foreign, stale = good.replace("youtube.com", "google.com"), good.replace("\t0\t", "\t5\t")
    cases = {"ok": good, "empty": "  ", "too large": good + "\n#" + "x" * 500, "no site rows": foreign, "all expired": stale, "no session rows": good.replace("SID", "PREF"), "no rows": "# only", "line 1: expected 7 tab-separated fields": "a b"}
    files = spark.createDataFrame(list(cases.items()), "file string, text string")
    got = {r.file: r.verdict for r in audit.audit_file_verdict(files, 400, 100).collect()}
    assert got == {k: k for k in cases}


def test_undecryptable_rows(spark):
    df = audit.encrypt_columns(spark.createDataFrame([("secret",), (None,)], "c string"), ["c"], F.lit("0123456789abcdef"))
    wrong = audit.decrypt_columns(df, ["c"], F.lit("fedcba9876543210")).collect()
    assert sorted((r.c, r.error) for r in wrong if r.error) == [(None, "cannot be decrypted")]
    with pytest.raises(ValueError):
        audit.encrypt_columns(df, ["c"], None)


def test_parts(spark):
    rows = [(1, i, f"t{i}", "a", "c", None, "u", "web") for i in range(101)]
    a = spark.createDataFrame(rows, "bundle int, pos int, title string, author string, content string, published_at timestamp, source_url string, source_type string")
    got = sorted((r.part, r.n_articles, r.html.count("page-break-before"), "(+" in r.html) for r in bundles.render_parts(a).collect())
    assert got == [(1, 50, 49, True), (2, 50, 49, True), (3, 1, 0, False)]


def test_tool_errors(spark):
    cases = [("ERROR: [youtube] a-b: gone\nERROR: [youtube:tab] x: y", True), ("", False), ("WARNING: x", False), ("ERROR: disk full", False), ("ERROR: [youtube] a: b\nERROR: Postprocessing: x", False), (None, False)]
    got = media.classify_tool_errors(spark.createDataFrame([(c[0],) for c in cases], "stderr string")).collect()
    assert [r.skippable for r in got] == [c[1] for c in cases]


def test_liked_limit(spark):
    body = '{"items":[{"id":"a","snippet":{"title":"t"}},{"id":""},{"id":"b"},{"id":"a"}],"nextPageToken":"n"}'
    pages = spark.createDataFrame([(1, 0, body), (1, 1, '{"items":[{"id":"c"}]}')], "feed int, page int, body string")
    assert [r.id for r in media.liked_items(pages, 2).orderBy("rank").collect()] == ["a", "b"]
    assert media.liked_items(pages, 0).count() == 1


def test_entities(spark):
    import html

    texts = ["A &amp; B", "It&#8217;s &eacute;", "&notit; &notin; &copy2 &#x1F600; &#0; &#xD800; &#150; &bogus; & &; &amp;eacute;", "x &ampamp; &NotEqualTilde; &#99999999999;", "plain", None, "", "&", "a&nbsp;b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", markup.decoded(F.col("t")).alias("d")).collect():
        assert r.d == (html.unescape(r.t) if r.t else r.t)


def test_slug_decomposes(spark):
    import re
    import unicodedata

    def plain(t):
        x = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        x = re.sub("-+", "-", re.sub(r"[^a-z0-9-]", "", re.sub(r"\s+", "-", x))).strip("-")
        return (x[:80].rstrip("-") if len(x) > 80 else x) or "article"

    texts = ["Őrült ćma ﬁne", "Łódź ＡＢＣ", "½ cup ㎏ Ⅷ … x", "Hello, World! — a & b", "- a - b\n\nc -", "", "éé" * 100, "ab " * 40, "no\u00a0break 𝐁old", "日本語"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in rows.select("t", markup.slug(F.col("t")).alias("s")).collect()} == {t: plain(t) for t in texts}


def test_quoted_tags(spark):
    h = """<a title="b>T" x='>' y=z>q</a><p it's>r</p><img src="x>y"/>s < t > u<b c="unclosed>v</b>"""
    got = html.html_tokens(spark.createDataFrame([(1, h)], "page_id long, html string")).orderBy("pos").collect()
    assert [r.token for r in got] == ["<a title=\"b>T\" x='>' y=z>", "q", "</a>", "<p it's>", "r", "</p>", '<img src="x>y"/>', "s ", "< t >", " u", '<b c="unclosed>', "v", "</b>"]
    assert "".join(r.token for r in got) == h


def test_blocks(spark):
    body = """<div><h2>Head <b>bold</b></h2><p>one <i>two</i>
     three<br>four</p><ul><li>a</li><li> b <ol><li>c</li></ol></li><li></li></ul><ol><li>x &gt; y</li></ol><blockquote> q <p>r</p></blockquote>
     <section data-testid="markdown-code-block"><div><span>py</span></div><pre><code>if a &lt; b:
  c</code></pre></section><pre class="language-sql">SELECT  1</pre><p>lost <em>kept</em><img src="https://i/x.png?name=small"><img src="data:1"></p><img src="http://i/y.png">
     <div><p>in a div</p><code>inline</code></div><p> </p><p>open</div>"""
    rows = extract.extract_blocks(spark.createDataFrame([(1, body), (2, None), (3, "")], "page_id long, html string")).orderBy("pos")
    got = [(r.type, r.level, r.content, r.items, r.language) for r in rows.collect()]
    assert got == [
        ("heading", 2, "Head bold", None, None), ("text", None, "one two three\nfour", None, None), ("unordered_list", None, "a\nb\nc", ["a", "b", "c"], None), ("ordered_list", None, "x > y", ["x > y"], None),
        ("blockquote", None, "q r", None, None), ("code", None, "if a < b:\n  c", None, "py"), ("code", None, "SELECT  1", None, "sql"), ("text", None, "kept", None, None), ("image", None, "https://i/x.png?name=small", None, None),
        ("image", None, "http://i/y.png", None, None), ("text", None, "in a div", None, None),
    ]
    shown = extract.render_blocks(rows, "page_id").first().html.split("\n")
    assert "<p>four</p>" in shown and "<ol>" in shown and '<div class="article-image"><img src="https://i/x.png?name=large" alt="Article image"></div>' in shown
    assert '<div class="code-block"><div class="code-lang">py</div><pre><code class="language-py">if a &lt; b:' in shown
    stats = extract.block_stats(rows, "page_id").first()
    assert (stats.n_blocks, stats.n_images, stats.n_text, stats.n_code) == (11, 2, 3, 2)
