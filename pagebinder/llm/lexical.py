"""Ranked lexical search: many queries at once over all documents, with what they share computed once.

Items (queries) are dealt to blocks of about BLOCK_TERMS (item, term) pairs. A block's plan mines what its items share: terms that the same
items hold are one node, whose partial accumulator is the sum of its terms' contributions to a document; nodes that follow each other in
several items (ordered by how many items hold them) are paired, round after round, so that nodes form a sharing graph whose ends are the
items. A task computes the accumulators of a slice of documents once per node, level by level, combines them into items' scores, and
keeps each item's best; the best of all tasks are ranked by salted groups, then by item.

Documents are never shuffled: one pass counts N, L and the documents of each term that a query has, a second one scores. Plans are
written in the shared folder and read by tasks one block at a time; nothing is broadcast, and the driver sees paths and two totals.

Null texts have no terms; documents without terms aren't counted; items without terms, or whose terms are nowhere, have no rows; rows that
share an item_id are one item, with the terms of all, and a null item_id is no item. Rows that share a doc_id are documents of their own;
equal scores go by doc_id, a null one last. Very long texts are one row of a task. Extra columns are ignored, whatever their names. Terms are
64-bit hashes. An empty table on either side gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, slices, trim, words_of
from .sharedfs import Ranges, Written

BLOCK_TERMS = 200_000
#: Documents that are scored together, and groups of an item's candidates before they meet.
DOCS, SALT = 256, 64
FIRST = np.iinfo(np.int64).max


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of each text's distinct terms, by text and term, and the terms of each text with repeats."""
    words, at = words_of(texts, "alnum")
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], words[first], np.diff(np.append(first, len(words))), n


def paired(lists: np.ndarray, ends: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lists of nodes, one after the other, with neighbours that occur together in several lists replaced by new nodes until none do:
    lists, their ends, and for each round its new nodes as pairs of older ones."""
    rounds = []
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    while len(lists) > 1:
        key = np.where(owner[:-1] == owner[1:], lists[:-1] << 32 | lists[1:], -1)
        pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
        weight = np.where(key < 0, 0, count[which] * (len(pairs) + 1) + which)  # of equal counts the larger pair goes first
        around = np.concatenate([[0], weight, [0]])
        chosen = (count[which] > 1) & (key >= 0) & (weight > around[:-2]) & (weight > around[2:])
        made, of, times = np.unique(which[chosen], return_inverse=True, return_counts=True)
        useful = times > 1
        if not useful.any():
            break
        at = np.flatnonzero(chosen)[useful[of]]
        number = np.cumsum(useful) - 1
        lists = lists.copy()
        lists[at] = nodes + number[of[useful[of]]]
        new = pairs[made[useful]]
        rounds.append(np.stack([new >> 32, new & 0xFFFFFFFF], 1))
        nodes += int(useful.sum())
        stays = np.ones(len(lists), bool)
        stays[at + 1] = False
        lists, owner = lists[stays], owner[stays]
    return lists, np.searchsorted(owner, np.arange(len(ends)), "right"), rounds


class Plan:
    """The sharing graph of a block of items.

    terms (sorted), weight, leaf (each term's node); rounds of pairs; `lists` up to `ends`: the nodes that make each item."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray):
        """Of distinct (item, term) pairs, items being numbers from 0."""
        order = np.lexsort((item, term))
        item, term, weight = item[order], term[order], weight[order]
        self.terms, first, held = np.unique(term, return_index=True, return_counts=True)
        self.weight = weight[first]
        owners = np.split(item, first[1:])  # the items that hold each term
        numbers: dict[bytes, int] = {}
        self.leaf = np.array([numbers.setdefault(o.tobytes(), len(numbers)) for o in owners], np.int64)
        nodes = len(numbers)
        one = np.unique(self.leaf, return_index=True)[1]
        node, who = np.repeat(np.arange(nodes), held[one]), np.concatenate([owners[k] for k in one])
        order = np.lexsort((node, -held[one][node], who))
        node, who = node[order], who[order]
        self.lists, self.ends, self.rounds = paired(node, np.searchsorted(who, np.arange(int(item.max()) + 1), "right"), nodes)
        self.leaves = nodes

    def dump(self, ids: pa.Array) -> bytes:
        """With the items' ids."""
        out = io.BytesIO()
        names = pa.ipc.new_stream(sink := pa.BufferOutputStream(), (batch := pa.record_batch({"i": ids})).schema)
        names.write_batch(batch)
        names.close()
        np.savez(out, ids=np.frombuffer(sink.getvalue(), np.uint8), terms=self.terms, weight=self.weight, leaf=self.leaf, lists=self.lists, ends=self.ends, leaves=self.leaves, **{f"round{k}": r for k, r in enumerate(self.rounds)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> tuple[pa.Array, Plan]:
        f, plan = np.load(io.BytesIO(data)), Plan.__new__(Plan)
        plan.terms, plan.weight, plan.leaf, plan.lists, plan.ends, plan.leaves = (f[k] for k in ("terms", "weight", "leaf", "lists", "ends", "leaves"))
        plan.rounds = [f[f"round{k}"] for k in range(sum(name.startswith("round") for name in f.files))]
        return pa.ipc.open_stream(f["ids"].tobytes()).read_all().column("i").combine_chunks(), plan

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Items by documents: m is each document's, and its terms have occurrences tf."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        here = self.terms[at] == term
        at, doc, tf = at[here], doc[here], tf[here]
        value = self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        acc = np.zeros((int(self.leaves) + sum(map(len, self.rounds)), len(m)), np.int64)
        np.add.at(acc, (self.leaf[at], doc), value)
        done = int(self.leaves)
        for pairs in self.rounds:
            acc[done : done + len(pairs)] = acc[pairs[:, 0]] + acc[pairs[:, 1]]
            done += len(pairs)
        out = np.zeros((len(self.ends), len(m)), np.int64)
        for k, (a, b) in enumerate(zip(np.concatenate([[0], self.ends[:-1]]).tolist(), self.ends.tolist(), strict=True)):
            if b > a:
                out[k] = acc[self.lists[a:b]].sum(axis=0)
        return out


def _read(path: str) -> bytes:
    with Ranges(path) as read:
        return read(0, read.size)


_held: dict = {}


def _plan(path: str) -> tuple[pa.Array, Plan]:
    """A Python worker holds the plan that it read last."""
    if path not in _held:
        data = _read(path)
        _held.clear()
        _held[path] = Plan.load(data)
    return _held[path]


def _terms_of_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, term, block)."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("item is not null and text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, word, _, _ = distinct_terms(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(word.view(np.int64))], names=["item", "term"])

    return rows.mapInArrow(terms, rows.select("item", F.lit(0).cast("long").alias("term")).schema).distinct()


def plans_of(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text: str) -> tuple[list[str], int, int]:
    """Writes the blocks' plans: their paths, N and L."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "plans")
    _terms_of_items(items, item_id, item_text).write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    size = terms.count()
    if not size:
        return [], 0, 0
    blocks = -(-size // BLOCK_TERMS)

    def vocabulary(table: pa.Table) -> pa.Table:
        path = f"{folder}/vocabulary/{table.column('b')[0].as_py():06d}"
        with Written(path) as out:
            out.write(np.sort(table.column("term").to_numpy().view(np.uint64)).tobytes())
        return pa.table({"path": [path]})

    wanted = terms.select("term").distinct().withColumn("b", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    parts = sorted(r.path for r in wanted.groupBy("b").applyInArrow(vocabulary, "path string").collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}  # by part: terms, and how many documents hold each
        n_docs = n_terms = 0
        for batch in slices(batches):
            _, word, _, n = distinct_terms(batch.column(0))
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            word.sort()
            for path in parts:
                if path not in held:
                    if len(parts) > 1:
                        yield from told(held)
                    of = np.frombuffer(_read(path), np.uint64)
                    held[path] = [of, np.zeros(len(of), np.int64)]
                of, df = held[path]
                df += np.searchsorted(word, of, "right") - np.searchsorted(word, of, "left")
        yield from told(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_docs]), pa.array([n_terms])], names=["term", "df", "n"])
        trim()

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for of, df in held.values():
            k = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(of[k].view(np.int64)), pa.array(df[k]), pa.nulls(len(k), pa.int64())], names=["term", "df", "n"])
        held.clear()

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "term long, df long, n long")
    counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).write.parquet(f"{folder}/df")
    df = spark.read.parquet(f"{folder}/df")
    total = df.where("term is null").first()
    n_docs, n_terms = (total.df, total.n) if total else (0, 0)
    if not n_docs:
        return [], 0, 0
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")

    def plan(table: pa.Table) -> pa.Table:
        ids = table.column("item").combine_chunks().dictionary_encode()
        path = f"{folder}/plans/{table.column('b')[0].as_py():06d}"
        made = Plan(ids.indices.to_numpy().astype(np.int64), table.column("term").to_numpy().view(np.uint64), table.column("weight").to_numpy())
        with Written(path) as out:
            out.write(made.dump(ids.dictionary))
        return pa.table({"path": [path]})

    weighed = terms.join(df.where("term is not null").select("term", weight.alias("weight")), "term").withColumn("b", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    return sorted(r.path for r in weighed.groupBy("b").applyInArrow(plan, "path string").collect()), n_docs, n_terms


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best positive scores, ties to smaller ids."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of the k documents with the highest scores above 0 of each item."""
    paths, n_docs, n_terms = plans_of(docs, items, item_id, item_text, text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by plan: item, doc_id, score
        for batch in slices(batches):
            text, word, tf, n = distinct_terms(batch.column(1))
            ids = batch.column(0).fill_null(FIRST).to_numpy(zero_copy_only=False)
            m = 100 - 90 + (90 * n * n_docs) // n_terms if n_terms else n
            for path in paths:
                _, plan = _plan(path)
                found = [best.pop(path)] if path in best else []
                for a in range(0, len(n), DOCS):
                    b = min(a + DOCS, len(n))
                    i, j = np.searchsorted(text, [a, b])
                    scores = plan.scores(text[i:j] - a, word[i:j], tf[i:j], m[a:b])
                    for item, of in enumerate(scores):
                        if len(top := _best(of, ids[a:b], k)):
                            found.append((np.full(len(top), item), ids[a:b][top], of[top]))
                if found:
                    item, doc, value = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.lexsort((doc, -value, item))
                    start = np.flatnonzero(np.diff(item[order], prepend=-1))
                    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
                    keep = order[place < k]
                    best[path] = (item[keep], doc[keep], value[keep])
                if len(paths) > 1:
                    yield from told(best)
        yield from told(best)
        trim()

    def told(best: dict) -> Iterator[pa.RecordBatch]:
        for path, (item, doc, value) in best.items():
            yield pa.RecordBatch.from_arrays([_plan(path)[0].take(pa.array(item)), pa.array(doc, pa.int64(), mask=doc == FIRST), pa.array(value)], names=["item_id", "doc_id", "score"])
        best.clear()

    found = rows.mapInArrow(score, schema)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
