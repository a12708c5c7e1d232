"""Top-k search, decontamination and licenses against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pagebinder.llm import decontam, licenses, topk

LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("slices", [1, 2, 4])
def test_top_k(spark, slices):
    rng = random.Random(slices)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(150)]
    rows += [(k, rows[0][1]) for k in range(150, 190)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, []), (205, [0.5]), (250, [-1.0] * 8), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, slices=slices).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    import numpy as np

    fine = {k: [math.floor(256 * float(np.float32(x))) for x in v] for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (k for k in fine if k % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=False)), k) for k, v in fine.items() if k != q)[:5]
        assert sorted(got[q]) == [(j + 1, k, -s) for j, (s, k) in enumerate(want)]


@pytest.mark.parametrize("slices", [2, 3])
def test_top_k_of_repeated_ids(spark, monkeypatch, slices):
    """Ids at several vectors, vectors of several ids, small blocks."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = random.Random(slices)
    vectors = [[rng.randrange(-3, 4) / 256 for _ in range(6)] for _ in range(40)]
    rows = [(rng.choice([0, 50, 100, *range(1, 30)]), rng.choice(vectors)) for _ in range(300)] + [(0, vectors[0])] * 3 + [(None, vectors[1]), (150, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, slices=slices).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id, r.rank))
    distinct = {(k, tuple(round(x * 256) for x in v)) for k, v in rows if k is not None}
    for q in (0, 50, 100, 150):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for i, v in distinct if i == q for k, w in distinct if k != q)
        assert sorted(got[q]) == [(s, k, j + 1) for j, (s, k) in enumerate(scores[:5])]


def test_top_k_keeps_pairs_of_blocks_out_of_the_driver(spark, monkeypatch):
    """100 blocks of rows, 4 of queries: no copy of the queries for each block of rows is joined, so none can be broadcast."""
    rng = random.Random(1)
    df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(400)], "vec_id long, embedding array<float>").cache()
    want = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    plans, stored = [], topk.stored

    def kept(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stored(rows, name)

    for name, value in (("stored", kept), ("BLOCK", 4), ("QUERY_BLOCK", 2), ("HELD", 2)):
        monkeypatch.setattr(topk, name, value, raising=False)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == want
    met = [p for p in plans if "MapInArrow" in p]
    assert len(met) == 2
    assert not any(re.search("Join|Generate|BroadcastExchange", p) for p in met)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.vec_id) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 50), (50, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            g = iw[k : k + window]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def brute_longest(text, items, window=10):
    """The first of the longest matches of a window or more, or of whole shorter items: -length, word, item, word there."""
    w, best = words(text), None
    for item, t in items:
        iw = words(t)
        need = min(window, len(iw))
        for k in range(len(iw) - need + 1) if iw else ():
            for p in range(len(w) - need + 1):
                n = 0
                while k + n < len(iw) and p + n < len(w) and iw[k + n] == w[p + n]:
                    n += 1
                if n >= need:
                    best = min(best or (0,), (-n, p, str(item), k))
    return best


def contaminated_case():
    rng = random.Random(5)
    vocabulary = ["a", "b", "é", "x1", "zz"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 14])))) for k in range(8)] + [(90, None), (91, "..."), (92, "Only-Once, here"), (0, "a a a a")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 4, 30, 200]))) for _ in range(60)]
    texts += [f"{i[1]} tail" for i in items if i[1]] + [None, "", "ONLY once HERE", texts[0]]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("block", [1 << 20, 4])
def test_contamination(docs, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 300)
    rows, items = contaminated_case()
    b = docs([]).sparkSession.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs(rows), b).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found} == {k: brute_hits(t, items) for k, t in rows}
    got = {r.doc_id: r.longest and (-r.longest.length, r.longest.word, r.longest.item_id, r.longest.item_word) for r in found}
    assert got == {k: brute_longest(t, items) for k, t in rows} and any(got.values())
    assert all(sum(s[1::2]) - sum(s[::2]) == n for s, n in ((r.hit_spans, r.n_hit) for r in found))


def test_long_match(docs):
    item = " ".join(f"w{k}" for k in range(30_000))
    b = docs([]).sparkSession.createDataFrame([("q", item)], "item_id string, text string")
    rows = [(1, f"x {item} y"), (2, f"x {item} y"), (None, "w7 w8"), (4, None), (5, "same " * 1000)]
    got = {r.doc_id: r for r in decontam.contamination(docs(rows), b).collect()}
    assert tuple(got[2].longest) == (30_000, 1, "q", 0) and got[1].n_hit == 30_000 and got[5].longest is None and got[None].n_words == 2
    found = {r.word: (r.length, r.doc_id, r.doc_word) for r in decontam.longest_matches(docs(rows), b).where("word % 1000 = 0").collect()}
    assert found == {k: (30_000 - k, 1, k + 1) for k in range(0, 30_000, 1000)}


def test_decontaminated(docs):
    rows, items = contaminated_case()
    b = docs([]).sparkSession.createDataFrame([(1, "b é zz x1 a b b zz é a")], "item_id long, text string")
    d = docs(rows).selectExpr("*", "1 as n_hit", "2 as item_ids", "3 as `a.b`", "4 as _text")
    got = decontam.decontaminated(d, b)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == [k for k, t in rows if not brute_hits(t, [(1, "b é zz x1 a b b zz é a")])[1]]
    assert decontam.decontaminated(d, b.limit(0)).count() == len(rows)


def test_longest_matches(docs):
    b = docs([]).sparkSession.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {r.word: (r.length, r.doc_id, r.doc_word) for r in decontam.longest_matches(docs([(5, "x one two three y"), (6, "three four three four")]), b).collect()}
    assert got == {0: (3, 5, 1), 1: (2, 5, 2), 2: (2, 6, 0), 3: (1, 6, 1)}


def test_longest_matches_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 200)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 8)
    monkeypatch.setattr(decontam, "HELD_MATCHES", 20)
    rows, items = contaminated_case()
    rows = [(-k, t) for k, t in rows] + [(5, "b " * 100)]
    want = {}
    for item, t in [*items, (77, "b " * 80)]:
        iw = words(t)
        for k in range(len(iw)):
            for d, x in rows:
                w = words(x)
                for p in range(len(w)):
                    n = 0
                    while k + n < len(iw) and p + n < len(w) and iw[k + n] == w[p + n]:
                        n += 1
                    if n:
                        want[str(item), k] = min(want.get((str(item), k), (0, 0, 0)), (-n, d, p))
    b = docs([]).sparkSession.createDataFrame([*items, (77, "b " * 80)], "item_id long, text string")
    got = {(r.item_id, r.word): (-r.length, r.doc_id, r.doc_word) for r in decontam.longest_matches(docs(rows), b).collect()}
    assert got == want


def test_suffix_array_order():
    import numpy as np

    rng = np.random.default_rng(2)
    w = rng.integers(1, 4, 500).astype(np.uint64)
    at = np.array([0, 100, 100, 350, 500])
    for depth in (1, 8, 64):
        s = decontam.SuffixArray(w, at, depth).sort()

        def key(p, s=s, depth=depth):
            out = []
            for k in range(p, p + depth):
                out.append(int(s.ranks[k]))
                if s.is_end[k]:
                    break
            return out

        keys = [key(p) for p in s.order.tolist()]
        assert sorted(s.order.tolist()) == list(range(504)) and keys == sorted(keys)


def test_licenses(docs):
    quote = licenses.TEMPLATES[1][1]
    rows = [
        (1, f"Start. {quote}. End"), (2, "See the MIT License and the mit-license; GENERAL public License"), (3, None), (4, ""), (5, "free of charge to any person"),
        (6, "x " + quote.replace("obtaining", "who is obtaining")), (2, "See the MIT License and the mit-license; GENERAL public License"), (7, "Licensed under CC BY-NC 4.0."), (8, "mit license " * 3),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    assert licenses.scan(docs(rows)).count() == len(rows)
    assert (got[1].labels, got[1].base_labels, got[1].score) == ("mit", "", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].score) == (3, 2, 8, "gpl,mit", 1.0)
    assert (got[3].n_words, got[3].labels, got[3].first_word) == (0, "", None) and got[5].labels == ""
    assert got[6].labels == "mit" and got[6].score < 1
    assert got[7].labels == "cc" and got[8].n_base == 3
    assert licenses.scan(docs([])).count() == 0


def test_license_spans_are_verified(docs):
    rows = [(1, "cc by 4 cc by 4 cc by 4"), (2, "licensed under cc x by 4 0"), (3, "licensed under cc by 4 0")]
    got = {r.doc_id: r for r in licenses.scan(docs(rows), templates=[("cc", "licensed under cc by 4 0")]).collect()}
    assert [got[k].labels for k in (1, 2, 3)] == ["", "cc", "cc"]
    assert [got[k].score for k in (1, 2, 3)] == [0.0, 4 / 6, 1.0]
    assert [(s["first"], s["end"], s["covered"]) for s in got[2].spans] == [(0, 7, 1.0)]


def brute_spans(text, templates, k=licenses.K, gap=licenses.GAP, cover=licenses.COVER):
    """(label, covered words of the template) of islands of diagonals, word by word."""
    w, out = words(text), []
    for label, template in templates:
        t = template.split()
        hits = [(p - q, q) for p in range(len(w) - k + 1) for q in range(len(t) - k + 1) if w[p : p + k] == t[q : q + k]]
        diagonals, islands = sorted({d for d, _ in hits}), []
        for d in diagonals:
            if islands and d - islands[-1][-1] <= gap:
                islands[-1].append(d)
            else:
                islands.append([d])
        for island in islands:
            at = {q for d, q in hits if d in island}
            there = {q + j for q in at for j in range(k)}
            if len(there) >= cover * len(t):
                out.append((label, len(there) / len(t), (len(at) + k - 1) / len(t)))
    return sorted(out)


def test_licenses_against_brute_force(docs):
    rng = random.Random(12)
    templates = [("a", "one two three four five six"), ("b", "two three one two four five one two"), ("c", "six five four")]
    texts = [" ".join(rng.choice(["one two three", "four five", "six", "one", "two", "x", "three four five six"]) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    got = {r.doc_id: sorted((s["label"], s["covered"], s["score"]) for s in r.spans) for r in licenses.scan(docs(list(enumerate(texts))), templates=templates).collect()}
    want = {k: brute_spans(t, templates) for k, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 20 and got == want


def test_licenses_in_long_texts(docs):
    unit = "under the mit "
    got = {r.doc_id: r for r in licenses.scan(docs([(1, unit * 60_000), (2, "x " * 400_000 + "released under the MIT license"), (3, "under the mit under the mit")])).collect()}
    assert (got[1].labels, got[1].n_words, got[3].labels, got[3].score) == ("", 180_000, "", 0.0)
    assert got[2].labels == "mit" and got[2].first_word == 400_003
