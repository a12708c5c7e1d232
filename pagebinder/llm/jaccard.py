"""Near-duplicate documents: Jaccard similarity of sets of word shingles, joined under several global token orders.

Documents with equal sets are one class. For each of several orders of all shingles, two sets with a similarity of at least
t share a shingle among the first n - ceil(t*n) + 1 of each. Every order here puts shingles of one class first (they can't be
shared), then goes by rising frequency, but with other bands of frequency and other ties. Candidates come from the first order;
pairs that share no prefix shingle under the second and the third are dropped before sets are compared.

1. One pass hashes each text's shingles: size and class (a 64-bit digest of the set) of each row. It also adds up how often
   shingles come together, so the most frequent ones of the corpus are known (`HEAVY`; `HEAVY_MOST` of them at most).
2. Shingles (48 bits of hash) go to buckets by hash, packed, each class once per task; a bucket counts the classes of each
   shingle and sends those of two or more classes back by class. Frequent shingles, whose count needs no adding up, are
   dealt to all buckets. A class with n shingles, u of them its own, has candidates only if u is less than its prefix; most
   texts end here.
3. In each posting of the first order the other classes are compared with one pivot, so a group of n near copies costs about n
   comparisons. What that links becomes components. Then every candidate pair of two components is compared, so no link that
   joins components is missed; pairs within a component need none.

Defined results: null, empty and wordless texts have empty sets (n_shingles 0) and are alone; texts with fewer words than a
shingle have one shingle, the whole; repeated rows count as copies; a row without a doc_id takes part, but names no component, and
deduplicated() keeps it. Hashes can collide: two given sets are misjudged with
a chance of about n*n / 2**48.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, grams, mixed, stored, trim, words_of

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that a bucket holds, about; of very large inputs it holds more, as `_buckets` says.
BUCKET = 1_500_000
FLUSH = 2_000_000
#: Shingles of so many classes are dealt to all buckets: those of the largest counts, up to HEAVY_MOST (8 bytes each are broadcast). The
#: others have less than total / HEAVY_MOST, and what fewer than TOGETHER classes among FLUSH shingles add.
HEAVY, HEAVY_MOST, TOGETHER = 10_000, 1_000_000, 4
_MASK = np.uint64((1 << 48) - 1)
_EMPTY = np.zeros(0, np.uint64)


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted hashes."""
    words, at = words_of(texts, "text")
    g, out = grams(words, n), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(grams(words[a:b], b - a) if b > a else _EMPTY)
    return out


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    """A digest of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(np.concatenate([_EMPTY, *sets]) + np.uint64(77)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).astype(np.int64)


def _signed_rows(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class; and with `hot` set shingles (as class) that `TOGETHER` classes or more share
    in a task's part, with their number (as n_shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        size = 0
        kind = None

        def made(ids: pa.Array, n, cls, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(np.full(len(ids), hot))], names=["doc_id", "n_shingles", "class", "hot"])

        def together() -> pa.RecordBatch:
            tok, n = np.unique(np.concatenate([_EMPTY, *waiting]) & _MASK, return_counts=True)
            often = n >= TOGETHER
            return made(pa.nulls(int(often.sum()), kind), n[often], tok[often].astype(np.int64), True)

        for batch in batches:
            if batch.num_rows:
                kind = batch.column(0).type
                sets = _sets(batch.column(1), words)
                classes = _classes(sets)
                yield made(batch.column(0), [len(s) for s in sets], classes, False)
                for c, s in zip(classes.tolist(), sets, strict=True):
                    if len(s) and c not in seen:
                        seen.add(c)
                        waiting.append(s)
                        size += len(s)
                if size > FLUSH:
                    yield together()
                    waiting, size = [], 0
        if waiting:
            yield together()
        waiting.clear()
        trim()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(sign, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_shingles long, class long, hot boolean")


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class."""
    return _signed_rows(docs, doc_id, text, words).where("not hot").drop("hot")


def _buckets(total: int, least: int) -> int:
    """Buckets for so many shingles. Past 60,000 of them they grow with the square root, and so does what each holds, since a task's
    part is packed into a row for each bucket."""
    return max(least, min(total // BUCKET + 1, max(60_000, math.isqrt(total) // 8)))


# Packed rows: a bucket, then classes, their sizes, how many shingles each has here, the shingles, their frequencies.
_PACKED = "bucket int, cls binary, n binary, cnt binary, tok binary, df binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("cls", "n", "cnt", "tok", "df")])


def _packed(bucket: np.ndarray, buckets: int, owner: np.ndarray, tok: np.ndarray, df: np.ndarray | None, cls: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """owner: of each shingle, as a place in cls and n; rising."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    tok6 = tok[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    owner = owner[order]
    df = None if df is None else df[order]
    rows = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        i, j = cut[b], cut[b + 1]
        first = np.flatnonzero(np.concatenate([[True], owner[i + 1 : j] != owner[i : j - 1]]))
        who = owner[i:j][first]
        cnt = np.diff(np.concatenate([first, [j - i]]))
        rows.append({"bucket": b, "cls": cls[who].tobytes(), "n": n[who].astype("<u4").tobytes(), "cnt": cnt.astype("<u4").tobytes(), "tok": tok6[i:j].tobytes(), "df": None if df is None else df[i:j].tobytes()})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_PACKED_ARROW)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)

    raw = joined("tok", np.uint8).reshape(-1, 6)
    tok = np.zeros((len(raw), 8), np.uint8)
    tok[:, :6] = raw
    return joined("cls", "<i8"), joined("n", "<u4"), joined("cnt", "<u4").astype(np.int64), tok.view("<u8").ravel(), joined("df", np.uint8)


def _shared_tokens(docs: DataFrame, text: str, words: int, percent: int, buckets: int, heavy: np.ndarray) -> DataFrame:
    """heavy: frequent shingles, sorted. Returns class, n, toks (its shingles that other classes have, the first order), r (how many of them are in the prefix), p2 and p3
    (the prefixes under the other orders, as 32 bits): of classes with r > 0."""

    frequent = docs.sparkSession.sparkContext.broadcast(heavy)

    def is_heavy(tok: np.ndarray) -> np.ndarray:
        known = frequent.value
        return known[np.minimum(np.searchsorted(known, tok), len(known) - 1)] == tok if len(known) else np.zeros(len(tok), bool)

    flush_at = max(FLUSH, 32 * buckets)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        cls: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tok = np.concatenate([_EMPTY, *sets]) & _MASK
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            salt = np.where(is_heavy(tok), np.array(cls, np.int64).astype(np.uint64)[owner], np.uint64(0))
            yield from _packed(mixed(tok + salt) % np.uint64(buckets), buckets, owner, tok, None, np.array(cls, np.int64), np.array([len(s) for s in sets]))
            sets.clear()
            cls.clear()

        size = 0
        for batch in batches:
            here = _sets(batch.column(0), words)
            for c, s in zip(_classes(here).tolist(), here, strict=True):
                if len(s) and c not in seen:
                    seen.add(c)
                    sets.append(s)
                    cls.append(c)
                    size += len(s)
                    if size > flush_at:
                        yield from flush()
                        size = 0
        if sets:
            yield from flush()
        trim()

    def count(table: pa.Table) -> pa.Table:
        trim()
        cls, n, cnt, tok, _ = _unpacked(table)
        # a class comes once from each task that has a copy
        _, once = np.unique(cls, return_index=True)
        use = np.zeros(len(cls), bool)
        use[once] = True
        keep = np.repeat(use, cnt)
        cls, n, cnt, tok = cls[use], n[use], cnt[use], tok[keep]
        values, which, df = np.unique(tok, return_inverse=True, return_counts=True)
        df[is_heavy(values)] = 255
        df = np.minimum(df, 255)[which].astype(np.uint8)
        owner, shared = np.repeat(np.arange(len(cls)), cnt), df > 1
        owner, tok, df = owner[shared], tok[shared], df[shared]
        out = list(_packed((cls.astype(np.uint64) % np.uint64(buckets))[owner], buckets, owner, tok, df, cls, n))
        return pa.Table.from_batches(out, schema=_PACKED_ARROW)

    out_schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("r", pa.int32()), ("toks", pa.list_(pa.int64())), ("p2", pa.list_(pa.int32())), ("p3", pa.list_(pa.int32()))])

    def gather(table: pa.Table) -> pa.Table:
        trim()
        cls, n, cnt, tok, df = _unpacked(table)
        cls, first, which = np.unique(cls, return_index=True, return_inverse=True)
        n = n[first].astype(np.int64)
        shared = np.bincount(which, weights=cnt, minlength=len(cls)).astype(np.int64)
        r = n + (-percent * n) // 100 + 1 - (n - shared)  # n - ceil(t*n) + 1, without its own
        owner = np.repeat(which, cnt)
        ok = (r > 0)[owner]
        owner, tok, df = owner[ok], tok[ok], df[ok]
        order = np.lexsort((tok, df, owner))
        owner, tok, df = owner[order], tok[order], df[order]
        band = np.frexp(df.astype(np.float64))[1]
        rows = []
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(0, np.int64)
        others = []
        for seed, of in ((11, band), (12, band // 2)):
            h = mixed(tok + np.uint64(seed))
            others.append((np.lexsort((h, of, owner)), (tok ^ (tok >> np.uint64(17))).astype(np.uint32).view(np.int32)))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            c = owner[a]
            k = int(min(r[c], b - a))
            rows.append({"class": int(cls[c]), "n": int(n[c]), "r": k, "toks": tok[a:b].astype(np.int64), **{f"p{j + 2}": small[o[a : a + k]] for j, (o, small) in enumerate(others)}})
        return pa.Table.from_pylist(rows, schema=out_schema)

    packed = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(spread, _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(count, _PACKED)
    return counted.groupBy("bucket").applyInArrow(gather, "class long, n long, r int, toks array<long>, p2 array<int>, p3 array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    a, b = (sets.select(F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "toks", "p2", "p3")]) for x in "ab")
    near = pairs.join(a, "a").join(b, "b")
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    filters = F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")
    both = F.size(F.array_intersect("toks_a", "toks_b"))
    return near.where(sizes & filters).where(both * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


#: Rows of (label, label) that are broadcast; beyond, keys are salted.
BROADCAST_LABELS = 1_000_000
SALTS = 16


def _with_hot_key(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """rows left joined with `of` (stored, a row for each key), where one key may have a large part of rows."""
    if of.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(of), key, "left")
    salted = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), [key, "salt"], "left").drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component), of the nodes of edges (a, b); labels go to neighbours and jump until
    none changes."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        spread = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = labels.join(spread, "node").select("node", F.least("comp", "near").alias("now"), F.col("comp").alias("was"))
        new = stored(new, "labels")
        # labels are nodes; those in use are few, and many nodes of a large component have the same
        jump = new.select("now").distinct().join(labels.select(F.col("node").alias("now"), F.col("comp").alias("far")), "now")
        step = stored(_with_hot_key(new, stored(jump, "jumps"), "now").select("node", F.least("now", F.coalesce("far", "now")).alias("comp"), "was"), "labels")
        labels = step.select("node", "comp")
        if step.where("comp <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class, component_id (the smallest doc_id that links reach, its own included),
    component (the same for rows that links join and no others; where a doc_id is repeated, component_id may not tell)."""
    spark = docs.sparkSession
    with arrow_rows(spark):
        signed = stored(_signed_rows(docs, doc_id, text, words), "signatures")
    rows = signed.where("not hot").drop("hot")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    often = signed.where("hot").groupBy("class").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= HEAVY)
    heavy = often.orderBy(F.desc("n"), "class").limit(HEAVY_MOST).select("class").toArrow().column(0).to_numpy()  # 8 MB at most
    buckets = _buckets(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with arrow_rows(spark):
        sets = stored(_shared_tokens(docs, text, words, percent, buckets, np.sort(heavy.astype(np.uint64))), "sets")
    own = F.col("n") - F.size("toks")
    post = sets.select("class", "n", own.alias("own"), F.posexplode(F.slice("toks", 1, F.col("r"))).alias("at", "t")).withColumn("at", F.col("own") + F.col("at"))
    # pivots: the class with the least of its own, which is nearest to the others, and the smallest
    pivots = post.groupBy("t").agg(F.min_by("class", F.struct(F.col("own") / F.col("n"), "class")).alias("p"), F.min("class").alias("q"), F.max("class").alias("last")).where("q <> last")
    met = post.join(pivots.drop("last"), "t")
    star = [met.where(f"class <> {x}").select(F.least("class", x).alias("a"), F.greatest("class", x).alias("b"), F.col("class")) for x in ("p", "q")]
    star = [s.groupBy("class", "a", "b").count().groupBy("class").agg(F.max_by(F.struct("a", "b"), F.struct("count", "a", "b")).alias("x")).select("x.a", "x.b") for s in star]
    edges = stored(_verified(star[0].unionByName(star[1]).distinct(), sets, percent), "links")
    comps = components(edges)
    # all candidate pairs across components
    post = post.join(comps.withColumnRenamed("node", "class"), "class", "left").select("t", "class", "n", "at", F.coalesce("comp", "class").alias("comp"))
    of = post.groupBy("t", "comp").count().groupBy("t").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").select("t", "major")
    post = stored(post.join(of, "t"), "postings")
    left = post.where("comp <> major").select("t", F.col("class").alias("x"), F.col("comp").alias("cx"), "major", F.col("n").alias("nx"), F.col("at").alias("ax"))
    right = post.select("t", F.col("class").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    # at the first shingle that two prefixes share, all that they can share stands from there on; pairs may fail that at later ones
    enough = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    cross = left.join(right, "t").where("cx <> cy and (cy = major or x < y)").where(enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = stored(_verified(cross, sets, percent), "links")
    if not more.isEmpty():
        comps = components(edges.unionByName(more))
    # from classes back to rows
    named = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    named = stored(named.join(comps.withColumnRenamed("node", "class"), "class", "left"), "named")
    linked = stored(named.where("comp is not null").groupBy("comp").agg(F.min("least").alias("component_id")), "least-ids")
    linked = _with_hot_key(named.where("comp is not null").select("class", "comp"), linked, "comp").select("class", "component_id", "comp")
    copies = named.where("comp is null and rows > 1").select("class", F.col("least").alias("component_id"), F.col("class").alias("comp"))
    named = stored(linked.unionByName(copies), "components")
    out = rows.join(named, (rows["class"] == named["class"]) & (rows["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", rows["class"], F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("comp", rows["class"]).alias("component"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of docs, all columns, without those that link (directly or not) to a document of a smaller doc_id. Of rows that
    repeat a doc_id, each is judged by its own text, and one stays of those that link or are equal."""
    found = stored(near_duplicates(docs, doc_id, text, **kw).withColumnRenamed("doc_id", doc_id), "found")
    repeated = stored(found.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id), "repeated")
    gone = stored(found.where(F.col("component_id") != F.col(doc_id)).select(doc_id).unionByName(repeated).distinct(), "gone")
    once = without(docs, gone, doc_id)
    if repeated.isEmpty():
        return once
    signed = _signed(_by_id(docs, repeated, doc_id, "left_semi"), doc_id, text, kw.get("words", WORDS))
    stay = _by_id(found, repeated, doc_id, "left_semi").where(F.col("component_id") == F.col(doc_id)).select(F.col(doc_id).alias("id"), "class", "component").distinct()
    # partial picks come before the shuffle, so a doc_id that many rows have is one row a task there
    picked = signed.groupBy("id", "class").agg(F.min_by("kept", "t").alias("kept"), F.min("t").alias("t"))
    picked = picked.join(stay, ["id", "class"]).groupBy("id", "component").agg(F.min_by("kept", F.struct("class", "t")).alias("kept"))
    return once.unionByName(picked.select(*[F.col("kept")[c].alias(c) for c in docs.columns]))


def _signed(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Per row of docs: kept (its columns), id, t (its text, null as empty), class."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_classes(_sets(batch.column(2), words)))], names=["kept", "id", "t", "class"])

    rows = docs.select(F.struct(*docs.columns).alias("kept"), F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(sign, T.StructType([*rows.schema.fields, T.StructField("class", T.LongType())]))


#: Ids are broadcast up to this many (8 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """gone must be stored, so that counting it is cheap."""
    return _by_id(docs, gone, doc_id, "left_anti")


def _by_id(docs: DataFrame, ids: DataFrame, doc_id: str, how: str) -> DataFrame:
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(ids, doc_id, how)
