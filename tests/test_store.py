"""The keyed store: batches that repeat or break off, purges, and the stream that writes to it."""

import pytest
from pyspark.sql import functions as F

from pagebinder.sources.store import KeyedStore

ROW = "k long, v string"


def contents(store, df):
    return sorted((r.k, r.v) for r in store.read(df.schema).collect())


def test_store(spark, tmp_path, monkeypatch):
    store, order = KeyedStore(spark, str(tmp_path / "s"), ["k"], 8), [F.desc("v")]
    one, two, three = (spark.createDataFrame(r, ROW) for r in ([(k, "a") for k in range(40)], [(3, "b"), (3, "c"), (99, "b")], [(3, "d"), (5, "d")]))
    assert contents(store, one) == []
    assert len(store.upsert(one, 0, order)) == 8
    touched = store.upsert(two, 1, order)
    assert 1 <= len(touched) <= 2  # only what changed
    want = {k: "a" for k in range(40)} | {3: "c", 99: "b"}
    assert contents(store, one) == sorted(want.items())
    assert store.upsert(one, 1, order) == []  # a repeated number changes nothing
    assert contents(store, one) == sorted(want.items())

    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # data written, but not its ledger
        m.setattr(spark, "createDataFrame", broken)
        with pytest.raises(RuntimeError):
            store.upsert(three, 2, order)
    assert contents(store, one) == sorted(want.items())
    store.upsert(three, 2, order)
    want |= {3: "d", 5: "d"}
    assert contents(store, one) == sorted(want.items())
    store.purge(one.schema, F.col("v") == "a", 3)
    want = {k: v for k, v in want.items() if v != "a"}
    assert contents(store, one) == sorted(want.items())
    store.vacuum()
    assert contents(store, one) == sorted(want.items())
    store.purge(one.schema, F.lit(True), 4)  # buckets become empty
    assert contents(store, one) == []
