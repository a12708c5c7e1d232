"""Queries against their SQL over small tables of cases that the smallest given ones lack."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracles import plain

import __spark_entry__ as entry
from pagebinder.functions import markup
from pagebinder.operators import audit, chains, extract, html, media
from pagebinder.streaming import jobs as st


@pytest.fixture
def same(spark, tmp_path):
    def check(name: str, **tables: str) -> list:
        """Runs a query and its SQL over tables, given as SQL; returns the query's rows."""
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for table, sql in tables.items():
            con.execute(f"CREATE TABLE {table} AS {sql}")
            con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        rows = df.select(*columns).collect()
        found = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
        assert sorted(repr([plain(v) for v in r]) for r in rows) == want
        return rows

    return check


def test_artifacts_of_a_customer_without_orders(spark, same):
    rows = same("artifacts_by_prefix", customer="SELECT unnest([1, 2, 3])::BIGINT AS c_custkey", orders="SELECT 1::BIGINT AS o_custkey, 4::BIGINT AS o_orderkey UNION ALL SELECT 2, 3")
    assert {r.key: r.error is None for r in rows} == {1: True, 2: False, 3: True}
    wanted = spark.createDataFrame([(3, "youtube_video_3", ".mp4")], "key long, prefix string, extension string")
    assert media.artifacts_by_prefix(wanted, spark.createDataFrame([], "name string")).first().error is not None


CUT = """SELECT page_id::BIGINT AS page_id, concat('https://h.example/', page_id) AS url, concat('<html><head><title>T</title></head><body><article><h1>', h, '</h1><p>see &amp; hear</p></article></body></html>') AS html
FROM (VALUES (1, 'A &amp; b &amp'), (3, 'it&lt'), (4, 'C &copy; &copy'), (8, 'x &am'), (9, 'y &#39'), (13, 'z &#39;s')) v(page_id, h)"""


@pytest.mark.parametrize("name", ["extract_blocks", "render_blocks", "extract_articles", "extract_routed", "extract_title", "select_first", "stream_extract_articles"])
def test_headings_cut_within_an_entity(same, name):
    assert same(name, pages=CUT)


def test_entities_that_no_semicolon_ends(spark):
    rows = spark.createDataFrame([("a &amp b &copy2 &#65 &#65; &eacute; &notit; &amp;amp",)], "t string")
    assert rows.select(markup.decoded(F.col("t"))).first()[0] == "a & b ©2 A A é ¬it; &amp"
    assert rows.select(markup.decoded(F.col("t"), bare=False)).first()[0] == "a &amp b &copy2 &#65 A é &notit; &amp"


class _Map(dict):
    """Map and value state that counts its calls."""

    calls = 0

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_polls_ask_the_state_once_for_each_id(cut):
    r = np.random.default_rng(cut)
    rows = pd.DataFrame({"poll": np.arange(600) // 2, "id": np.where(r.random(600) < 0.3, np.nan, r.integers(0, 40, 600) * (r.random(600) < 0.2))})
    polls = st._Polls(7, 1000)
    polls.seen, polls.empty = _Map(), _Map()
    got = [int(x.stop_poll[0]) for k in range(0, 600, 2 * cut) for x in polls.handleInputRows((5,), iter([rows[k : k + 2 * cut].sample(frac=1, random_state=k)]), None)]
    seen, n, want = set(), 0, []
    for poll, ids in rows.groupby("poll")["id"]:
        fresh = set(ids.dropna()) - seen
        seen |= fresh
        n = 0 if fresh else n + 1
        want += [poll] * (n == 7 and not want)
    assert got == want and polls.empty.get() == (n, bool(want))
    if cut == 1000:
        assert polls.seen.calls == len(seen)  # one call a row before


def test_audits_cut_files_once(spark, capsys):
    files = spark.createDataFrame([(1, "a\tTRUE\t/\tTRUE\t1\tSID\tv\n#HttpOnly_.youtube.com\tTRUE\t/\tTRUE\t0\tSID\tv"), (2, ".youtube.com\tTRUE\t/\tTRUE\t0\tSID\tv"), (3, "# c"), (4, None)], "file int, text string")
    got = audit.audit_file_verdict(files, 1000, 5)
    assert {r.file: r.verdict for r in got.collect()} == {1: "line 1: unsupported domain", 2: "ok", 3: "no rows", 4: "empty"}
    counts = audit.audit_file_counts(audit.audit_line_rules(audit.read_delimited_exports(files)), 5)
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 1, 0, 0, 1), (2, 1, 1, 0, 0, 1)]
    capsys.readouterr()
    got.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("Generate posexplode") == 1


def test_rounds_of_a_chain_hold_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chains, "scratch", lambda *a: str(tmp_path))
    monkeypatch.setattr(chains, "remove", lambda *a: None)
    rows = [("f", f"t{k}" if k else None, f'{{"nextPageToken": "t{k + 1}"}}' if k < 5 else "{}", k) for k in range(6)]
    got = chains.follow_pages(spark.createDataFrame(rows, "feed string, token string, body string, _id int"))
    assert sorted((r._id, r.page, r.error) for r in got.collect()) == [(k, k, None) for k in range(6)]
    assert {t for _, t in spark.read.parquet(f"{tmp_path}/1").dtypes} == {"bigint"}


def test_blocks_are_dealt_by_bytes_of_pages(spark, monkeypatch, capsys):
    """Partitions grow in number with the markup, and tokens aren't shuffled."""
    monkeypatch.setattr(html, "PART", 100)
    pages = spark.createDataFrame([(k, f"<body><p>one {k}</p><h1>é</h1></body>" if k else None) for k in range(40)], "page_id long, html string")
    size = sum(len(f"<body><p>one {k}</p><h1>é</h1></body>".encode()) for k in range(1, 40))
    assert html.by_page(pages).rdd.getNumPartitions() == -(-size // 100)
    assert html.by_page(pages.limit(0)).rdd.getNumPartitions() == 4
    got = extract.extract_blocks(pages)
    assert sorted((r.page_id, r.type, r.content) for r in got.collect()) == sorted(x for k in range(1, 40) for x in ((k, "text", f"one {k}"), (k, "heading", "é")))
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
