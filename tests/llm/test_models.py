"""Quality, languages, web archives and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagebinder.llm import langid, quality, warc
from pagebinder.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def made(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        text = ". ".join(words) if good else " ".join([rng.choice(["BUY!!", "$$$"])] * len(words))
        rows.append((k, text))
        labels.append((k, int(good)))
    return rows, labels


def test_quality_on_held_out(docs, spark):
    rows, labels = made()
    rows += [(1000, ""), (1001, None), (1000, "")]
    truth = spark.createDataFrame([*labels, (1001, None), labels[0]], "doc_id long, quality int")
    d = docs(rows)
    model = quality.fit(d, truth)
    got = quality.scored(d, model).withColumn("held", quality.held_out("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    of = dict(labels)
    held = [r for r in got if r.held and r.doc_id in of]
    assert held and np.mean([r.predicted == of[r.doc_id] for r in held]) > 0.97
    kept = quality.accepted(d.withColumn("score", F.lit("mine")), model)
    assert kept.columns == [*d.columns, "score"] and kept.count() == sum(r.predicted for r in got)


def plain_statistics(t):
    """The statistics of a text, in plain Python."""
    import math
    import re

    if not t:
        return dict.fromkeys(quality.NAMES, 0.0)
    w = re.split("[ \t\n\x0b\f\r]+", t)
    share = lambda chars: sum(c in chars for c in t) / len(t)
    return {
        "log_chars": math.log1p(len(t)), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "symbols": share("#$%&*=<>@^_|~+\\"), "marks": share("!?"), "stops": share(".,;:"),
        "distinct_words": len(set(w)) / len(w), "distinct_few": len(set(w)) / math.sqrt(len(w)), "word_length": len(t) / len(w), "lines": t.count("\n") / len(w),
    }


def plain_score(t, model):
    import math

    s, total = plain_statistics(t), model.bias
    for terms, w in model.rules:
        total += w * all((s[name] > value) == above for name, above, value in terms)
    for name, low, high, w in model.linear:
        total += w * (min(max(s[name], low), high) - low) / (high - low)
    return 1 / (1 + math.exp(-total))


def test_quality_against_brute_force(docs, spark):
    """Statistics, sample, rules and scores of every row, in plain Python."""
    import os
    import zlib

    rows, labels = made(300)
    rows += [(2000, ""), (2001, None), (2002, " \n\t x"), (2003, "é𝄞 ÀB\r\n!?"), (2004, "ab " * 100_000)]
    cases = [(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"))]
    if os.path.exists(SF):
        cases.append((spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    for d, truth in cases:
        model = quality.fit(d, truth)
        known = {r.doc_id: r.quality for r in truth.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
        learnt = sorted((r.doc_id, r.text) for r in d.collect() if r.doc_id in known)
        x = np.array([[plain_statistics(t)[c] for c in quality.NAMES] for _, t in learnt])
        again = quality.fit_arrays(x, np.array([known[k] for k, _ in learnt], float))
        assert len(again.rules) == len(model.rules) and [t for t, _ in again.rules][0][0][0] == [t for t, _ in model.rules][0][0][0]
        for r in quality.scored(d, model).collect():
            assert abs(r.score - plain_score(r.text, model)) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_quality_of_repeated_ids_and_clashing_names(docs, spark):
    rows, labels = made(200)
    rows += [(k, t + " other words" * 5) for k, t in rows[:50]]
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    models = [quality.fit(docs(rows).repartition(n), truth) for n in (1, 3, 7)]
    assert models[0] == models[1] == models[2]
    d = docs(rows[:5]).selectExpr("*", "'x' as score", "1 as _score", "2 as s", "3 as `a.b`")
    got = quality.scored(d, models[0])
    assert got.columns == [*[c for c in d.columns if c != "score"], "score", "predicted"] and got.dtypes[-2][1] == "double"
    assert quality.accepted(d, models[0]).columns == d.columns and len(got.collect()) == 5


def test_labels_of_held_out_rows_dont_count(docs, spark):
    rows, labels = made(200)
    d = docs(rows)
    held = {r.doc_id for r in d.where(quality.held_out("doc_id")).collect()}
    turned = [(k, 1 - y if k in held else y) for k, y in labels]
    a, b = (quality.fit(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert a == b


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = docs([(1, "x")])
    assert [r.score for r in quality.scored(d, quality.fit(d, none)).collect()] == [pytest.approx(0.5)]
    ones = spark.createDataFrame([(k, 1) for k in range(8)], "doc_id long, quality int")
    many = docs([(k, "x") for k in range(8)])
    assert all(r.predicted == 1 for r in quality.scored(many, quality.fit(many, ones)).collect())


def test_languages(docs, spark):
    rng = random.Random(4)
    vocabulary = {"en": ["the", "and", "thing", "other"], "de": ["der", "und", "nicht", "über"]}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(60))
    train = spark.createDataFrame([(k, text(lang), lang) for k in range(40) for lang in vocabulary] + [(0, "x", None), (0, None, "en")], "doc_id long, text string, lang string")
    rows = [(k, f"https://{lang}.example.{'org' if lang == 'en' else 'at'}/", f"<html lang='{lang}'><p>{text(lang)}</p>") for k, lang in enumerate(["en", "de"] * 20)]
    rows += [(100, "https://de.example.at/x", "<p></p>"), (101, None, None), (102, "https://new.example.at", ""), (103, "https://en.example.org", f"<html lang='de'><p>{text('en')}</p>")]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), train).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang == ["en", "de"][k % 2] for k in range(40))
    assert got[100].lang == "de" and got[102].lang == "de" and got[103].lang == "en"
    assert got[101].host == "" and got[101].lang in vocabulary and all(0 < r.probability <= 1 for r in got.values())


def plain_identify(pages, train):
    """identify() in plain Python: page_id, text_lang, lang, probability."""
    import html
    import math
    import re
    from collections import Counter, defaultdict

    def slots(t):
        b = [c + 32 if 65 <= c <= 90 else 32 if c < 32 else 0 if 48 <= c <= 57 else c for c in (t or "").encode()]
        h = [((((x * 961 + y) * 961 + z) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 19 for x, y, z in zip(b, b[1:], b[2:]) if x and y and z]
        return [x & (langid.SLOTS - 1) for x in h]

    count, docs_of = defaultdict(Counter), Counter()
    for t, lang in train:
        if lang:
            count[lang].update(slots(t))
            docs_of[lang] += 1
    langs = sorted(docs_of)
    n = range(len(langs))
    shares = [docs_of[x] / sum(docs_of.values()) for x in langs]
    sums = [sum(count[x].values()) + 0.5 * langid.SLOTS for x in langs]

    def softmax(x):
        e = [math.exp(y - max(x)) for y in x]
        return [y / sum(e) for y in e]

    rows, of_host, of_suffix, of_said, of_all = [], defaultdict(lambda: [0.0] * len(langs)), defaultdict(lambda: [0.0] * len(langs)), defaultdict(lambda: [0.0] * len(langs)), [0.0] * len(langs)
    for page, url, raw in pages:
        host = (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or [0, ""])[1].lower()
        suffix = "" if re.fullmatch("[0-9.]*", host) else host.rpartition(".")[2]
        said = (re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", raw or "") or [0, ""])[1].lower()
        text = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ", raw or "")
        s = slots(html.unescape(re.sub("(?s)<[^>]*>", " ", text)))
        by_text = [sum(math.log((count[x][y] + 0.5) / sums[k]) for y in s) * min(1.0, langid.WEIGHT / max(len(s), 1)) for k, x in enumerate(langs)]
        p = softmax([by_text[k] + math.log(shares[k]) for k in n])
        rows.append((page, host, suffix, said, by_text, p))
        for group in (of_host[suffix, host], of_suffix[suffix], of_said[said], of_all):
            for k in n:
                group[k] += p[k]
    out = {}
    for page, host, suffix, said, by_text, p in rows:
        prior = shares
        for group in (of_all, of_suffix[suffix], of_host[suffix, host]):
            rest = [group[k] - p[k] for k in n]
            prior = [(rest[k] + langid.SMOOTH * prior[k]) / (sum(rest) + langid.SMOOTH) for k in n]
        declared = [math.log((of_said[said][k] - p[k] + 0.5) / (of_all[k] - p[k] + 0.5 * len(of_said))) if said else 0.0 for k in n]
        q = softmax([by_text[k] + declared[k] + math.log(prior[k]) for k in n])
        out[page] = (langs[p.index(max(p))], langs[q.index(max(q))], max(q))
    return out


def test_languages_against_brute_force(docs, spark):
    rng = random.Random(6)
    vocabulary = {"en": ["the", "and", "thing", "water"], "de": ["der", "und", "nicht", "über"], "fr": ["le", "été", "eau", "pas"]}
    text = lambda lang, k: " ".join(rng.choice(vocabulary[lang]) for _ in range(k))
    train = [(text(lang, 40), lang) for _ in range(15) for lang in vocabulary] + [("x 1", None), (None, "en"), ("", "")]
    pages = []
    for k in range(150):
        lang = rng.choice(list(vocabulary))
        body = text(lang, rng.choice([0, 1, 2, 20])).replace("ü", rng.choice(["ü", "&uuml;", "&#252;"])).replace("é", rng.choice(["é", "&eacute;"]))
        head = rng.choice(["", f"<html lang='{lang}'>", "<HTML class=x LANG=en-GB>", "<html lang='de'>"])
        pages.append((k, rng.choice([None, f"https://{lang}.example.{lang}/", "http://10.0.0.1/x", "https://u@mixed.example.com:80/", f"http://h{k % 40}.example.{lang}"]), f"{head}<script>der</script><p>{body} 12</p><!-- x -->"))
    pages += [(500, None, None), (501, "", "")]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(train, "text string, lang string")).collect()}
    want = plain_identify(pages, train)
    assert set(got) == set(want)
    for k, (by_text, lang, probability) in want.items():
        assert abs(got[k].probability - probability) < 1e-6 and got[k].lang == lang and got[k].text_lang == by_text


def test_languages_of_nothing(docs, spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert [r.lang for r in langid.identify(pages, docs([])).collect()] == [None]
    assert langid.identify(pages.limit(0), docs([(1, "some text")])).count() == 0


PAGES = [(1, "http://a", "x" * 1000), (2, "http://b\r\nc", "x" * 1000), (3, None, "x" * 999), (4, "", "x" * 999), (5, "é", None), (6, "d", ""), (7, "e", "é" * 500), (8, "f", "é" * 500), (8, "f", "é" * 500), (None, "g", "x" * 1000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    back = warc.records(warc.index(warc.write(pages.repartition(3), shared_dir(spark, "w"))), payload=True).collect()
    assert len(back) == len(PAGES)
    by = {}
    for r in back:
        by.setdefault(r.page_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to, by[1][0].payload) == ("revisit", 2, None)
    assert (by[None][0].record_type, by[None][0].refers_to) == ("revisit", 2)
    assert bytes(by[2][0].payload) == b"x" * 1000 and by[2][0].url == "http://b%0D%0Ac"
    assert {by[k][0].record_type for k in (3, 4, 5, 6)} == {"response"} and by[5][0].payload_bytes == 0
    assert by[7][0].refers_to == 8 and [r.record_type for r in by[8]] == ["response", "response"]
    assert by[3][0].url is None and by[5][0].url == "é"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_zip64(tmp_path):
    """A package whose end says that its directory is in the ZIP64 form."""
    import struct
    import zipfile

    from pagebinder.llm.sharedfs import Ranges

    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(3):
            with z.open(f"m{k}", "w", force_zip64=True) as m:
                m.write(bytes([k]) * (k + 1))
    data = path.read_bytes()
    at = data.rfind(b"PK\5\6")
    count, size, start = struct.unpack_from("<HII", data, at + 10)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start)
    path.write_bytes(data[:at] + end64 + struct.pack("<4sIQI", b"PK\6\7", 0, at, 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with Ranges(str(path)) as read:
        found = warc.members(read)
        assert {n: read(*f[:2]) for n, f in found.items()} == {f"m{k}": bytes([k]) * (k + 1) for k in range(3)}


def test_packages_of_other_writers(spark, tmp_path, monkeypatch):
    """Several archives, one plain, one that no index names; a compressed index; members that are neither."""
    import gzip
    import hashlib
    import json
    import zipfile

    monkeypatch.setattr(warc, "PART", 7)

    def made(kind, uri, body, digest=True, http=True):
        block = (b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" if http else b"") + body
        head = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uri}>\r\nContent-Type: {'application/http' if http else 'text/plain'}"]
        head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}"] * digest
        return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    a = [made("warcinfo", "urn:uuid:1", b"software: x", digest=False, http=False), made("response", "urn:uuid:2", b"body " * 50), made("response", "urn:page:7", b"")]
    b = [made("response", "urn:uuid:3", b"plain\r\n\r\nbody"), made("resource", "urn:uuid:4", b"r", http=False)]
    packed = [gzip.compress(x) for x in a]
    lines = [f"com,x)/ 2020 {json.dumps({'filename': 'a.warc.gz', 'offset': sum(map(len, packed[:k])), 'length': len(packed[k])})}" for k in (1, 2)]
    path = str(tmp_path / "other.wacz")
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"a comment"
        z.writestr("archive/a.warc.gz", b"".join(packed))
        z.writestr("archive/b.warc", b"".join(b))
        z.writestr("archive/c.warc.gz", b"".join(packed))
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()), zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.idx", "no record")
    got = warc.records(warc.index(spark.createDataFrame([(path,)], "path string")), payload=True).collect()
    rows = sorted((r.record_id, r.record_type, bytes(r.payload), r.payload_bytes) for r in got)
    body = b"body " * 50
    assert rows == sorted([("<urn:uuid:2>", "response", body, 250)] * 2 + [("<urn:page:7>", "response", b"", 0)] * 2 + [("<urn:uuid:1>", "warcinfo", b"software: x", 11), ("<urn:uuid:3>", "response", b"plain\r\n\r\nbody", 13), ("<urn:uuid:4>", "resource", b"r", 1)])
    assert {r.page_id for r in got} == {None, 7} and all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in got)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"".join(packed))
    with pytest.raises(Exception, match="compressed as a whole"):
        warc.index(spark.createDataFrame([(path,)], "path string")).collect()


def test_pipeline(spark):
    """Stage by stage against brute force on what each stage was given."""
    import os

    if not os.path.exists(SF):
        pytest.skip("no tables")
    import corpus_pipeline
    from test_near_duplicates import brute
    from test_search import brute_hits
    from test_secrets import brute as secrets_of
    from test_tokens import check_plan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.stored(stage(spark, steps[-1], SF), "s"))
    assert all(s.columns == columns for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(texts[1]) < set(texts[0])
    known = [k for k in labels if k in texts[0]]
    assert np.mean([(k in texts[1]) == bool(labels[k]) for k in known]) > 0.95
    assert set(texts[2]) == {k for k, _, c in brute(sorted(texts[1].items())) if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts[3]) == {k for k, t in texts[2].items() if not brute_hits(t, items)[1]}
    assert set(texts[4]) == set(texts[3])
    for k, t in texts[3].items():
        if texts[4][k] == t:
            assert not secrets_of(t)[2]
    check_plan(steps[-1].collect(), list(texts[4].items()))


def test_run_removes_what_stages_leave(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from pagebinder.llm.common import stored

    spark.createDataFrame([(k, f"t{k}") for k in range(10)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    even = lambda s, d, _: stored(d.where("doc_id % 2 = 0"), "inner-of-stage")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("even", even), ("small", lambda s, d, _: stored(d, "inner-of-stage").where("doc_id < 5")), ("last", even)])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4]
    folder = os.path.dirname(shared_dir(spark, "x"))
    left = {p.rpartition("-")[0] for p in os.listdir(folder)}
    assert "stage2" in left and not left & {"stage0", "stage1", "inner-of-stage"}


def test_null_ids_and_long_texts(docs, spark):
    """Rows without an id get results like others, and a megabyte of text is read whole."""
    from pagebinder.llm import licenses, secrets

    long = "the water and other things " * 45_000
    d = docs([(None, "password=abcdef and the MIT license"), (None, None), (7, long + "token=zzzzzz9 released under the MIT license"), (None, "password=abcdef and the MIT license")])
    assert sorted((r.doc_id is None, r.n_base, r.score) for r in licenses.scan(d).collect()) == [(False, 1, 1.0), (True, 0, 0.0), (True, 1, 1.0), (True, 1, 1.0)]
    assert sorted((r.doc_id is None, r.n_assign) for r in secrets.report(secrets.scan(d)).collect()) == [(False, 1), (True, 0), (True, 1), (True, 1)]
    texts = [r.text for r in secrets.redacted(d).collect()]
    assert sorted(t is None for t in texts) == [False, False, False, True] and all("abcdef" not in (t or "") and "zzzzzz9" not in (t or "") for t in texts)
    model = quality.fit(d, spark.createDataFrame([(None, 1), (7, 0)], "doc_id long, quality int"))
    assert quality.scored(d, model).where("score is not null").count() == 4
    pages = spark.createDataFrame([(None, None, f"<p>{long}</p>"), (None, "http://e.example", None)], "page_id long, url string, html string")
    train = spark.createDataFrame([("the water", "en"), ("der und", "de"), ("the and", "en")], "text string, lang string")
    assert sorted(r.lang for r in langid.identify(pages, train).collect()) == ["en", "en"]
