import random
import re

from pagebinder.llm import jaccard

LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def made(seed, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    line = [rng.choice(vocabulary) for _ in range(13)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 120]))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 6)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w = line + w
        text = rng.choice([" ", "\n", "  "]).join(w)
        rows.append((k * 3, text.upper() if rng.random() < 0.2 else text))
    return [*rows, (1, None), (2, ""), (4, " \t "), (5, " "), (7, "one two"), (8, "ONE two"), rows[0]]


def test_components(docs):
    for seed in range(3):
        rows = made(seed)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(rows)).collect())
        assert got == brute(rows)


def test_frequent_shingles(docs, monkeypatch):
    """Frequent shingles dealt to all buckets, and salted labels, change nothing."""
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    monkeypatch.setattr(jaccard, "TOGETHER", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_LABELS", 0)
    rows = made(4)
    d = docs(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect()) == brute(rows)
    hot = jaccard._signed_rows(d, "doc_id", "text", 5).where("hot").groupBy("class").sum("n_shingles").collect()
    assert any(r[1] >= 5 for r in hot)


def test_many_buckets():
    assert jaccard._buckets(0, 8) == 8 and jaccard._buckets(3_000_000_000, 8) == 2001
    assert 60_000 < jaccard._buckets(10**13, 8) < 10**6


def test_null_ids_and_long_texts(docs):
    long = " ".join(f"w{k}" for k in range(250_000))
    rows = [(None, "a b c d e f"), (None, None), (3, long), (9, long + " tail"), (12, "a b c d e f")]
    got = jaccard.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (9, 3), (12, 12)]
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (2, 12)]


def test_deduplicated(docs):
    rows = made(9, 80)[:-1]
    d = docs(rows).selectExpr("*", "doc_id as gone", "'x' as class")
    got = jaccard.deduplicated(d)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _, c in brute(rows) if i == c)


def test_deduplicated_repeated_ids(docs):
    a, b, c, near = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (7, c.upper()), (8, None), (8, ""), (9, near), (9, near + " more")]
    got = sorted((r.doc_id, r.text or "") for r in jaccard.deduplicated(docs(rows)).collect())
    assert [(i, t.lower()[:2]) for i, t in got] == [(1, "a0"), (5, "b0"), (7, "c0"), (8, ""), (9, "d0")]


def test_long_path(docs):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 60])) for k in range(100)]  # each is near its neighbours only
    got = {r.component_id for r in jaccard.near_duplicates(docs(rows)).collect()}
    assert got == {c for *_, c in brute(rows)} == {0}


def test_nothing(docs):
    assert jaccard.near_duplicates(docs([])).count() == 0
    assert [r.component_id for r in jaccard.near_duplicates(docs([(3, None)])).collect()] == [3]
