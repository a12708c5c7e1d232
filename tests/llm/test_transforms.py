"""Encoding and decoding by merge rounds, lexical search and fill-in-middle, against the tokenizers library and brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from pagebinder.llm import bpe, fim, lexical
from pagebinder.llm.queries import tokenizer_path

CLASHING = "doc_id long, text string, ids string, item_id string, score string, form string, term string"


# --- byte-pair encoding ---------------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = ["", "a", " a", "a  b", "x \xa0 \xa0", "\n a\n\n b \n c", "<|endoftext|> x<|endoftext|><|", "don't 'll I'LL it's", "é ñ 𝄞 word. word, word!! x_y ١٢ ²", "aaa aaaa aaaaa", "word " * 3000, "x" * 6000, "abcdefgh" * 4000]


@pytest.mark.parametrize("together", [True, False])
def test_merges_equal_the_library(together, monkeypatch):
    e, of = bpe.BatchedEncoder(tokenizer_path()), library()
    assert e.merges.together
    e.merges.together = together
    rng = np.random.default_rng(5)
    random = ["".join(rng.choice(list("abcdefgh est.'1  \n\té漢　"), int(n))) for n in rng.integers(1, 60, 3000)]
    texts = TEXTS + random if together else [t for t in TEXTS if len(t) < 7000] + random[:300]
    monkeypatch.setattr(bpe, "FLAT", 500)  # several batches of words
    for got, t, want in zip(e.encode(texts), texts, of.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == want.ids, repr(t[:60])
        assert e.merges.decoded(ids).decode("utf-8", "replace") == of.decode(want.ids, skip_special_tokens=False) == t


def test_decoding_of_cut_characters_and_unknown_ids():
    m, of = bpe.Merges(tokenizer_path()), library()
    ids = of.encode("漢字 é", add_special_tokens=False).ids
    for k in range(len(ids)):
        assert m.decoded(np.array(ids[k:])).decode("utf-8", "replace") == of.decode(ids[k:], skip_special_tokens=False)
    assert m.decoded(np.array([10**6])) == b""


def test_rows_of_encoding(spark):
    rows = spark.createDataFrame([(k % 5, t or None, "i", "x", "y", "z", "t") for k, t in enumerate(TEXTS)], CLASHING)
    both = bpe.decoded(bpe.encoded(rows, tokenizer_path(), keep=("doc_id", "form")), tokenizer_path()).collect()
    assert sorted((r.doc_id, r.form, r.decoded) for r in both) == sorted((k % 5, "z", t) for k, t in enumerate(TEXTS))
    assert bpe.decoded(bpe.encoded(rows.limit(0), tokenizer_path()), tokenizer_path()).count() == 0
    assert bpe.decoded(spark.createDataFrame([(1, None)], "k int, ids binary"), tokenizer_path()).first().decoded == ""


# --- lexical search -------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, of in wanted.items():
        scores = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in of if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(300)] + ["É", "The", "the"]

    def text(n):
        return " ".join(words[min(int(z), 302)] for z in rng.zipf(1.3, n))

    docs = [(k, text(int(n))) for k, n in enumerate(rng.integers(0, 60, 400))]
    docs += [(900, None), (901, ""), (902, "?!"), (None, "w1 w2 rare"), (903, "w1 w2 rare"), (903, "w1 w2 rare"), (904, "w1 " * 20_000 + "w7")]
    shared = [text(6) for _ in range(8)]
    items = [(f"i{k}", f"{shared[k % 8]} {shared[k % 3]} {text(4)} which of these?") for k in range(60)]
    return docs, items + [("none", None), ("empty", ""), ("nowhere", "qqq zzz"), (None, "w1"), ("i3", "RARE w2"), ("i3", "RARE w2")]


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 60])
def test_search_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = corpus()
    rows = spark.createDataFrame([(d, t, "a", "b", "c", "d", "e") for d, t in docs], CLASHING).repartition(5)
    got = lexical.search(rows, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int"))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", docs.text.substr(1, 0)), items)):
        assert lexical.search(d, i).collect() == []


def test_plan_computes_what_items_share_once():
    rng = np.random.default_rng(2)
    sets = [sorted({*range(20 * (k % 4), 20 * (k % 4) + 20), *range(100, 100 + k % 7), *rng.integers(200, 260, 5).tolist()}) for k in range(80)]
    item = np.concatenate([np.full(len(s), k) for k, s in enumerate(sets)])
    term = np.concatenate(sets).astype(np.uint64)
    plan = lexical.Plan(item, term, np.ones(len(term), np.int64))
    adds = len(plan.terms) - plan.leaves + sum(map(len, plan.rounds)) + len(plan.lists) - len(sets)
    assert adds < (len(term) - len(sets)) / 3 and plan.rounds
    doc, m = np.zeros(len(plan.terms), np.int64), np.array([10**6])
    tf = rng.integers(1, 9, len(plan.terms))
    got = plan.scores(doc, plan.terms, tf, m)[:, 0]
    value = dict(zip(plan.terms.tolist(), ((10**9 * tf) // (1000 * tf + 8 * 10**6)).tolist(), strict=True))
    assert got.tolist() == [sum(value[t] for t in s) for s in sets]


# --- fill in the middle ---------------------------------------------------------------------------------------------


def cut(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 7, fim.BLOCK])
def test_cuts_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = np.random.default_rng(block)
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n漢字\n𝄞", "x<P>y\n", "<S>", "a\r\nb\x0bc d\n", "<\nP>\n<M", "long\n" * 5000, "z" * 50_000]
    texts += ["".join(rng.choice(list("ab\n\né漢𝄞<"), int(n))) for n in rng.integers(0, 200, 300)]
    rows = [(k, t, "i", "x", "y", "z", "t") for k, t in enumerate(texts)] + [(5, "again\nand\nagain", *"abcde")] * 2 + [(None, "no\nid\n", *"abcde")]
    df = spark.createDataFrame(rows, CLASHING)
    for rate, spm in ((100, 50), (60, 20)):
        got = fim.transformed(df, keep=("doc_id", "text"), rate=rate, spm=spm)
        got = got.withColumn("back", fim.restored(got.output, got.form)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(r.doc_id, r.text, rate=rate, spm=spm)
            assert r.back == (r.text or "")
    assert fim.transformed(df.limit(0)).count() == 0


def test_descent_finds_every_unit():
    rng = np.random.default_rng(1)
    units = rng.integers(0, 4, 37)
    tree = fim.Fenwick(units, units * 10)
    block, got = tree.descend(np.arange(1, units.sum() + 1))
    assert block.tolist() == np.repeat(np.arange(37), units).tolist()
    assert got.tolist() == [[units[:b].sum(), 10 * units[:b].sum()] for b in block]
