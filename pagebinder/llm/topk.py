"""Exact top-k search by inner product with a three-phase uniform threshold.

The score of a vector for a query is a sum over slices of the components. Vectors are packed into blocks of rows; every block of
the queries meets every block of rows, and each slice of the components there is a node with its own list of partial scores.

1. Every node lists its k+1 highest partial scores for each query. What those entries lack in the other slices is added, and
   of each block the k+1 highest scores remain. The lowest of a query's k+1 highest over all blocks is a score that its
   result surely reaches: the cutoff c.
2. The cutoff goes to all nodes, each of which collects all entries of at least c / slices. A vector that no slice lists scores
   less than c in all.
3. What a listed vector lacks in the other slices is added exactly, in the task that has both vectors, and entries that reach
   the cutoff are passed on: k+1 for each query and ties. No vector is fetched again.

Blocks of queries are files in the shared folder, of which the driver holds the paths. A task reads them one at a time for its blocks
of rows, so pairs of blocks go neither through a shuffle nor a broadcast.

Copies: equal vectors are one class, of which the k+1 smallest vec_id can be in a result (one may be the query's own), so a
vector that many rows share costs no more than one; queries with equal vectors are one, too.

Defined results: vectors that are null, or hold null or non-finite components, and rows without a vec_id take no part; shorter
ones count as ending in zeros; a repeated (vec_id, vector) counts once. A vec_id that stands at several vectors is a
candidate with each of them; as a query it has the k highest scores over all its vectors, and none of them is its own candidate. Ties
go to the smaller vec_id. Fewer candidates than k: all.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, shared_dir, stored, trim
from .sharedfs import Ranges, Written

K = 5
SLICES = 2
SCALE = 256
#: Rows of a packed block of queries and of candidates.
QUERY_BLOCK, BLOCK = 1024, 4096
#: Blocks of queries whose highest scores a task holds (some 50 KB each).
HELD = 1024
#: A cutoff that everything reaches; no vec_id, and another that nothing equals.
_LOWEST, _NONE, _OTHER = -(2**62), -(2**63), -(2**63) + 1


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), of vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _dealt(rows: DataFrame, by: str, count: int, size: int):
    """rows grouped by `block`, about `size` of them in each."""
    n = max(1, -(-count // size))
    return rows.withColumn("block", F.pmod(F.xxhash64(by), F.lit(n).cast("long"))).groupBy("block")


def _packed(table: pa.Table, width: int, extra: list[str]) -> dict[str, np.ndarray]:
    """m (vectors v as 64-bit integers, `width` each), and the columns `extra` (longs, or arrays of longs, as long in every row)."""
    v = table.column("v").combine_chunks()
    m = np.zeros((len(v), width), np.int64)
    m[np.arange(width) < v.value_lengths().to_numpy()[:, None]] = v.flatten().to_numpy()
    flat = {c: table.column(c).combine_chunks() for c in extra}
    return {"m": m} | {c: (x.flatten() if pa.types.is_nested(x.type) else x).to_numpy().astype(np.int64) for c, x in flat.items()}


def _written(queries: DataFrame, count: int, width: int) -> list[str]:
    """Writes the blocks of queries (q, v, own, cut); their paths."""
    folder = shared_dir(queries.sparkSession, "query-blocks")

    def pack(table: pa.Table) -> pa.Table:
        path, data = f"{folder}/{table.column('block')[0].as_py():06d}.npz", io.BytesIO()
        np.savez(data, **_packed(table, width, ["q", "cut", "own"]))
        with Written(path) as out:
            out.write(data.getvalue())
        return pa.table({"path": [path]})

    return sorted(r.path for r in _dealt(queries, "q", count, QUERY_BLOCK).applyInArrow(pack, "path string").collect())


def _block(path: str) -> dict[str, np.ndarray]:
    with Ranges(path) as read:
        return dict(np.load(io.BytesIO(read(0, read.size))))


class _Nodes:
    """A block of queries and one of rows: partial scores of each slice."""

    def __init__(self, queries: dict, rows: dict, width: int, slices: int, k: int):
        self.q, self.cut, own, q = (queries[c] for c in ("q", "cut", "own", "m"))
        ids, c = np.frombuffer(rows["ids"], np.int64), np.frombuffer(rows["m"], np.int64).reshape(-1, width)
        # products of floats are exact up to 2**53 and quicker; integers beyond
        small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width < 2**53
        q, c = (y.astype(np.float64 if small else np.int64) for y in (q, c))
        cols = [(width * s // slices, width * (s + 1) // slices) for s in range(slices)]
        self.parts = [q[:, a:b] @ c[:, a:b].T for a, b in cols]
        self.ids = ids.reshape(-1, k + 1)
        # classes that hold nothing but the query's own vec_id
        only = np.where(self.ids[:, 1] == _NONE, self.ids[:, 0], _OTHER) if k else np.full(len(self.ids), _OTHER)
        self.free = own[:, None] != only if np.isin(own, only).any() else None

    def score(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The sum of all slices."""
        return sum(p[i, j] for p in self.parts).astype(np.int64)

    def highest(self, k: int) -> np.ndarray:
        """The k highest scores of each query among what the slices list, highest first; _LOWEST where there are no more."""
        listed = []
        for part in self.parts:
            part = part if self.free is None else np.where(self.free, part, _LOWEST)
            if part.shape[1] > k:
                listed.append(np.argpartition(part, part.shape[1] - k, axis=1)[:, -k:])
            else:
                listed.append(np.broadcast_to(np.arange(part.shape[1]), part.shape))
        j = np.sort(np.concatenate(listed, axis=1), axis=1)
        i = np.broadcast_to(np.arange(len(j))[:, None], j.shape)
        ok = np.ones(j.shape, bool) if self.free is None else self.free[i, j]
        ok[:, 1:] &= j[:, 1:] != j[:, :-1]
        score = np.where(ok, self.score(i, j), _LOWEST)
        return _most(score, k)

    def reaching(self, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """q, vec_id, score of all that reach the query's cutoff."""
        listed = self.parts[0] * slices >= self.cut[:, None]
        for part in self.parts[1:]:
            listed |= part * slices >= self.cut[:, None]
        i, j = np.nonzero(listed if self.free is None else listed & self.free)
        score = self.score(i, j)
        ok = score >= self.cut[i]
        i, score, ids = i[ok], score[ok], self.ids[j[ok]]
        at, k = np.nonzero(ids != _NONE)
        return self.q[i[at]], ids[at, k], score[at]


def _most(score: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row, highest first."""
    return -np.sort(-score, axis=1)[:, :k]


def _met(batches: Iterator[pa.RecordBatch], paths: list[str], width: int, slices: int, k: int) -> Iterator[tuple[str, _Nodes]]:
    """Every block of queries, by its path, with every block of rows."""
    for batch in batches:
        rows = batch.to_pylist()
        for path in paths:
            queries = _block(path)
            for x in rows:
                yield path, _Nodes(queries, x, width, slices, k)


def top_k(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, slices: int = SLICES, scale: int = SCALE) -> DataFrame:
    """For each row of vectors for which the column is_query (of vec_id) holds its k highest scores against all other rows:
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v = scaled(vectors, vec_id, embedding, scale)
    # classes: a vector and its k+1 smallest vec_id
    least = v.distinct().withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    ids = F.array_sort(F.collect_list("vec_id"))
    classes = stored(least.groupBy("v").agg(ids.alias("ids")), "classes")
    # queries: a vector, and the vec_id whose own vectors are left out, if it has several
    asked = v.where(is_query).distinct()
    several = asked.groupBy("vec_id").agg(F.count("*").alias("vectors")).where("vectors > 1").select("vec_id", F.col("vec_id").alias("own"))
    asked = stored(asked.join(several, "vec_id", "left").select(F.col("vec_id").alias("query_id"), "v", F.coalesce("own", F.lit(_NONE)).alias("own")), "queries")
    queries = stored(asked.select("v", "own").distinct().select(F.monotonically_increasing_id().alias("q"), "v", "own"), "query-vectors")
    # vectors take up to eight times as much in memory as in files, by which joins are chosen: these aren't broadcast
    named = stored(asked.join(queries.hint("merge"), ["v", "own"]).select("q", "query_id"), "query-names")
    sizes = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width, nq = sizes["n"], max(sizes["w"] or 0, 1), queries.count()
    padded = F.array(*[F.coalesce(F.get("ids", F.lit(j)), F.lit(_NONE)) for j in range(k + 1)])

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({c: [x.tobytes()] for c, x in _packed(table, width, ["ids"]).items()})

    rows = stored(_dealt(classes.select("v", padded.alias("ids")), "v", n, BLOCK).applyInArrow(pack, "m binary, ids binary"), "rows")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # by block of queries: q, and the highest scores so far
        for path, nodes in _met(batches, everything, width, slices, k):
            score = nodes.highest(k + 1)
            if path in best:
                score = _most(np.concatenate([best[path][1], score], axis=1), k + 1)
            elif len(best) == HELD:
                yield from told(best)
            best[path] = nodes.q, score
        yield from told(best)
        trim()

    def told(best: dict) -> Iterator[pa.RecordBatch]:
        for q, score in best.values():
            i, at = np.nonzero(score > _LOWEST)
            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(score[i, at])], names=["q", "score"])
        best.clear()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes in _met(batches, reachable, width, slices, k):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in nodes.reaching(slices)], names=["q", "vec_id", "score"])
        trim()

    everything = _written(queries.withColumn("cut", F.lit(0).cast("long")), nq, width)
    with arrow_rows(spark, 8):  # a row is a block
        lists = rows.mapInArrow(first, "q long, score long")
        best = Window.partitionBy("q").orderBy(F.desc("score"))
        cut = lists.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).groupBy("q").agg(F.min("score").alias("cut"), F.count("*").alias("have"))
        # with fewer entries than k + 1 there are no more candidates, and all are wanted
        cut = stored(cut.select("q", F.when(F.col("have") > k, F.col("cut")).otherwise(F.lit(_LOWEST)).alias("cut")), "cutoffs")
    reachable = _written(queries.join(cut, "q"), nq, width)
    with arrow_rows(spark, 8):
        found = stored(rows.mapInArrow(second, "q long, vec_id long, score long"), "entries")
    found = found.join(queries.select("q", "own"), "q").where("vec_id <> own").drop("own")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    mine = named.join(top, "q").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
