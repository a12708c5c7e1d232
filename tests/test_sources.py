"""Numbered lines, chains of pages and suffix rules, against plain walks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagebinder.operators import audit, chains
from pagebinder.sources import lines


def test_lines_of_many_ranges(spark, tmp_path):
    rng = random.Random(3)
    texts = {"a": [f"line {k} " + "x" * rng.randrange(200) for k in range(5000)], "b": ["", "", "é\r", "last"], "c": [], "d": ["one"], "e": ["y" * 50_000, "", "z"]}
    for name, of in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(("\n".join(of) + ("\n" if name in "ae" else "")).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
        rows = lines.read_lines(spark, str(tmp_path), "*.txt").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, k, x) for name, of in texts.items() for k, x in enumerate(of, 1)]
    assert [(r.file[-5], r.line_no, r.line) for r in rows] == want
    assert [r.n for r in rows] == list(range(1, len(want) + 1))


def test_ranges_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_RANGES", 0)
    (tmp_path / "a.txt").write_text("ERROR: x\r\n\nWARNING: y\nz")
    got = lines.read_stderr_files(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line, r.level) for r in got] == [(1, "ERROR: x", "error"), (3, "WARNING: y", "warning"), (4, "z", "other")]


def test_export_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"{audit.HEADER}\n# note\n\n.x.example\tTRUE\t/\n")
    rows = audit.export_lines(lines.read_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.fields) for r in rows] == [(1, "header", None), (2, "comment", None), (3, "blank", None), (4, "data", [".x.example", "TRUE", "/"])]


def walked(pages):
    """Per feed a walk from the page without a token."""
    out, feeds = {}, {}
    for row in sorted(pages, key=lambda r: (r[2] is None, r[2] or "")):
        feeds.setdefault(row[0], {}).setdefault(row[1] or "", row)
    for feed, of in feeds.items():
        token, places = "", {}
        while token in of and token not in places:
            places[token] = len(places)
            token = json.loads(of[token][2] or "{}").get("nextPageToken") or ""
            if not token:
                break
        for t, row in of.items():
            after = json.loads(row[2] or "{}").get("nextPageToken")
            error = "lost" if t not in places else None if not after else "next is missing" if after not in of else "cycle" if places[after] <= places[t] else None
            out[feed, t, row[2]] = (places.get(t), error)
    return out


def test_chains(spark):
    rng = random.Random(1)
    page = lambda feed, token, after: (feed, token, json.dumps({"nextPageToken": after} if after is not None else {"items": []}))
    rows = [page("one", None, None), page("self", "", "s"), page("self", "s", "s"), page("none", "x", "y"), page("none", "y", "x"), (None, None, None), page("joined", None, "b"), page("joined", "a", "b"), page("joined", "b", None)]
    for n in (2, 3, 17, 64, 65):
        tokens = [None, *(f"{rng.random()}" for _ in range(n - 1))]
        rows += [page(f"f{n}", t, a) for t, a in zip(tokens, [*tokens[1:], None], strict=True)]
        rows += [page(f"c{n}", t, a) for t, a in zip(tokens, [*tokens[1:], tokens[n // 2] or "gone"], strict=True)]
    rng.shuffle(rows)
    schema = "feed string, token string, body string, page string"
    got = chains.follow_pages(spark.createDataFrame([(*r, "old") for r in rows], schema)).collect()
    assert {(r.feed, r.token or "", r.body): (r.page, r.error) for r in got} == walked(rows)
    again = chains.follow_pages(spark.createDataFrame([(*r, "old") for r in rows + rows], schema)).collect()
    assert len(again) == 2 * len(rows) and sum(r.error == "repeated" and r.page is None for r in again) == len(rows)
    assert chains.follow_pages(spark.createDataFrame([], schema)).count() == 0


def test_long_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(chains, "remove", lambda spark, path, f=chains.remove: (rounds.append(path), f(spark, path)))
    n = 10_000
    ids = spark.range(n).withColumn("token", F.when(F.col("id") > 0, F.md5(F.col("id").cast("string"))))
    body = F.to_json(F.struct(F.when(F.col("id") < n - 1, F.md5((F.col("id") + 1).cast("string"))).alias("nextPageToken")))
    rows = ids.select(F.lit("f").alias("feed"), "token", body.alias("body"), "id").orderBy(F.md5(F.concat(F.lit("s"), "id")))
    got = chains.follow_pages(rows)
    assert got.where("page = id and error is null").count() == n
    assert len(rounds) <= 15


@pytest.mark.parametrize("limit", [0, 20, 1_000_000])
def test_short_feeds_are_walked_without_rounds(spark, monkeypatch, limit):
    """Feeds shorter and longer than a task walks; only the longer ones go through rounds."""
    monkeypatch.setattr(chains, "WALKED", limit)
    rounds = []
    monkeypatch.setattr(chains, "remove", lambda spark, path, f=chains.remove: (rounds.append(path), f(spark, path)))
    page = lambda feed, token, after: (feed, token, json.dumps({"nextPageToken": after} if after is not None else {}))
    rows = [page(None, None, "b"), page(None, "b", None), page("self", "", "s"), page("self", "s", "s"), page("none", "x", "y"), page("none", "y", "x")]
    for n in (2, 19, 40):
        rows += [page(f"f{n}", f"t{k}" if k else None, f"t{k + 1}" if k < n - 1 else ("t1" if n == 19 else None)) for k in range(n)]
    rows += [page("f40", "lost", "t3")]
    got = chains.follow_pages(spark.createDataFrame(rows, "feed string, token string, body string")).collect()
    assert {(r.feed, r.token or "", r.body): (r.page, r.error) for r in got} == walked(rows)
    assert bool(rounds) == (limit < 40)


def test_suffix_rules(spark):
    hosts = [(1, ".A.b.example"), (2, "xb.example"), (3, "b.example"), (4, "other"), (5, None), (6, ""), (7, "#HttpOnly_.c.a.b.example"), (8, "a.b.example"), (8, "a.b.example")]
    rules = [("b.example", "2", 1), ("a.b.example", "1", 1), ("example", "3", 1), ("b.example", "2", 0), (None, "n", 1)]
    df = audit.match_suffix_rules(spark.createDataFrame(hosts, "k int, domain string"), spark.createDataFrame(rules, "suffix string, rule string, rank int"))
    got = sorted((r.k, r.suffix or "", r.rule or "", r["rank"] or 0) for r in df.collect())
    assert got == [(1, "a.b.example", "1", 1), (2, "example", "3", 1), (3, "b.example", "2", 0), (4, "", "", 0), (5, "", "", 0), (6, "", "", 0), (7, "a.b.example", "1", 1), (8, "a.b.example", "1", 1), (8, "a.b.example", "1", 1)]
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [0, 5])
def test_no_rules(spark, n):
    df = spark.range(n).select("id", F.lit("a.example").alias("domain"))
    assert audit.match_suffix_rules(df, spark.createDataFrame([], "suffix string")).where("suffix is null").count() == n
