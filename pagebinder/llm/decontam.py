"""Benchmark decontamination by suffix arrays over the training text.

Every shard (a part of a task's documents, of bounded size) gets a suffix array of its words, as deep as the longest benchmark
text, so its order is exact for any match. Every suffix of every benchmark text is bisected in it; its neighbours there have its
longest verbatim match. Where that is a window or more, the suffixes of the shard that begin with the window are a range
of the array, and their places are hit. Each hit place is then bisected in the suffix array of the benchmark, which gives the longest
match that begins there and where it stands in a benchmark text. Shards need nothing of each other, so nothing is shuffled.

Spark deals the benchmark into blocks of about `BLOCK_WORDS` words, which tasks write, hashed and sorted, to the shared folder and
read one at a time. A shard's array is built once for all blocks, and texts of a benchmark never pass through the driver.

Defined results: null or empty texts have no words and no hits; repeated rows get repeated results; items that are null or
have no words match nothing; repeated items count once, and items that share an id with other texts are one item with all their
windows. Other columns of the documents are left alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, trim, words_of
from .sharedfs import Ranges, Written

WINDOW = 10
#: Words of a block of benchmark texts, about; a text is not parted.
BLOCK_WORDS = 1 << 20
#: Words of a shard, as far as documents allow, and documents that are looked at together.
SHARD_WORDS, ROWS = 1 << 20, 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS))


class SuffixArray:
    """Of the words (64-bit hashes) of several texts: places in the order of the first `depth` words that stand there. Words are
    ordered by hash; each text has an end mark, which equals nothing that is looked for, so no match runs over a text's end."""

    def __init__(self, words: np.ndarray, at: np.ndarray, depth: int):
        n, texts = len(words), len(at) - 1
        self.text = np.repeat(np.arange(texts), np.diff(at) + 1)
        self.begin = at[:-1] + np.arange(texts)
        place = np.arange(n) + np.repeat(np.arange(texts), np.diff(at))
        self.is_end = np.ones(n + texts, bool)
        self.is_end[place] = False
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.ranks = np.zeros(n + texts, np.int64)  # 0: an end
        self.ranks[place] = rank + 1
        self.order: np.ndarray | None = None
        self.depth = depth

    def sort(self) -> SuffixArray:
        """Prefix doubling: order by 1, 2, 4, ... words, until `depth` is reached or a step parts nothing. Ranks and places share 64
        bits, for sorts without an index."""
        total, span, key = len(self.ranks), 1, self.ranks
        bits, places = max(1, total.bit_length()), np.arange(total, dtype=np.uint64)
        order = np.argsort(key, kind="stable") if self.depth == 1 else np.arange(total)
        kinds = len(self.vocabulary) + bool(total)
        while span < self.depth and total:
            second = np.zeros_like(key)
            second[: max(0, total - span)] = key[span:]
            second[self._ends_within(span)] = 0
            if 3 * bits <= 64:
                both = np.sort((key.astype(np.uint64) << np.uint64(2 * bits)) | (second.astype(np.uint64) << np.uint64(bits)) | places)
                order, both = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
            else:  # a very long text
                order = np.lexsort((second, key))
                both = key[order] * (total + 1) + second[order]
            key = np.empty(total, np.int64)
            key[order] = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
            before, kinds = kinds, int(key[order[-1]]) + 1
            if kinds == before and span > 1:
                break
            span *= 2
        self.order = order
        return self

    def _ends_within(self, span: int) -> np.ndarray:
        """Places with an end mark among the `span` words from there on."""
        c = np.concatenate([[0], np.cumsum(self.is_end)])
        upto = np.minimum(np.arange(len(self.is_end)) + span, len(self.is_end))
        return c[upto] > c[:-1]

    def ranks_of(self, words: np.ndarray) -> np.ndarray:
        """-1 for words that the array doesn't have; 0 is that of end marks."""
        if not len(self.vocabulary):
            return np.full(words.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def compare(self, places: np.ndarray, wanted: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands at `places` with the `lengths` words of `wanted` (ranks) from `starts` on: how many words are equal, and whether what
        stands here comes first (-1), begins with all of them (0) or comes after (1)."""
        equal, sign = np.zeros(len(places), np.int64), np.zeros(len(places), np.int8)
        open_, j = np.flatnonzero(lengths > 0), 0
        while len(open_):
            have, want = self.ranks[places[open_] + j], wanted[starts[open_] + j]
            same = have == want
            sign[open_[~same]] = np.where(have[~same] < want[~same], -1, 1)
            open_ = open_[same]
            j += 1
            equal[open_] = j
            open_ = open_[lengths[open_] > j]
        return equal, sign

    def bisect(self, wanted: np.ndarray, starts: np.ndarray, lengths: np.ndarray, right: bool = False) -> np.ndarray:
        """For each of `starts` the place in the array before (right: behind) which all that comes before (begins with) it stands. All
        are bisected at once."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            sign = self.compare(self.order[mid], wanted, starts[open_], lengths[open_])[1]
            on = (sign < 0) | (right & (sign == 0))
            low[open_] = np.where(on, mid + 1, low[open_])
            high[open_] = np.where(on, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        return low

    def longest(self, wanted: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The words of the longest match of each of `starts`: one of its neighbours in the array has it."""
        at, out = self.bisect(wanted, starts, lengths), np.zeros(len(starts), np.int64)
        for near in (at - 1, at):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            out[ok] = np.maximum(out[ok], self.compare(self.order[near[ok]], wanted, starts[ok], lengths[ok])[0])
        return out

    def least(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest key (of a place) in each range of the array; ranges are not empty."""
        ranges, which = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
        in_order = np.append(key[self.order], np.iinfo(np.int64).max)
        return np.minimum.reduceat(in_order, ranges.ravel())[::2][which.ravel()] if len(ranges) else np.zeros(0, np.int64)


# --- the benchmark, in blocks ---------------------------------------------------------------------------------------


class Block:
    """Benchmark texts: names (item ids as strings), at (where each text's words begin), word (all words, as places in vocabulary)."""

    def __init__(self, names: list[str], words: np.ndarray, at: np.ndarray):
        self.names, self.at = np.array(names, str), at
        self.vocabulary, self.word = np.unique(words, return_inverse=True)
        self.left = np.repeat(at[1:], np.diff(at)) - np.arange(len(words))  # words of each suffix
        self.owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.depth = int(np.diff(at).max(initial=0))
        self.array = SuffixArray(words, at, self.depth)

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with a window, and the windows' words: texts that are shorter are windows as a whole."""
        need = np.minimum(np.diff(self.at)[self.owner], window)
        starts = np.flatnonzero(self.left >= need)
        return starts, need[starts]

    def by_item(self) -> np.ndarray:
        """For each place of the array a key that goes by item, as a string, then by word."""
        rank = np.unique(self.names, return_inverse=True)[1].astype(np.int64)
        a = self.array
        return (rank[a.text] << 40) | (np.arange(len(a.text)) - a.begin[a.text])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=self.names, at=self.at, words=self.vocabulary[self.word], order=self.array.sort().order)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Block:
        f = np.load(io.BytesIO(data))
        block = Block(f["names"].tolist(), f["words"], f["at"])
        block.array.order = f["order"]
        return block


def blocks_of(benchmark: DataFrame, item: str, text: str) -> list[str]:
    """Writes the blocks; their paths."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n, folder = max(1, -(-chars // (6 * BLOCK_WORDS))), shared_dir(spark, "benchmark")

    def pack(table: pa.Table) -> pa.Table:
        words, at = words_of(table.column("t"), "alnum")
        path = f"{folder}/{table.column('b')[0].as_py():06d}.npz"
        with Written(path) as out:
            out.write(Block(table.column("i").to_pylist(), words, at).dump())
        return pa.table({"path": [path]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    return sorted(r.path for r in dealt.groupBy("b").applyInArrow(pack, "path string").collect())


_held: dict[str, Block] = {}


def _block(path: str) -> Block:
    """A Python worker holds the block that it read last."""
    if path not in _held:
        with Ranges(path) as read:
            data = read(0, read.size)
        _held.clear()
        _held[path] = Block.load(data)
    return _held[path]


# --- the search -----------------------------------------------------------------------------------------------------


def _shards(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words, where texts begin) of parts of a batch with about SHARD_WORDS words each."""
    words, at = words_of(texts, "alnum")
    k = 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + SHARD_WORDS, "right")) - 1)
        yield k, words[at[k] : at[end]], at[k : end + 1] - at[k]
        k = end


def _ready(shard: SuffixArray, depth: int) -> None:
    """Sorts the shard, again if it isn't as deep as a block needs."""
    if shard.order is None or shard.depth < depth:
        shard.depth = max(depth, shard.depth)
        shard.sort()


class _Found:
    """What the blocks tell of the texts of a shard."""

    def __init__(self, shard: SuffixArray, texts: int):
        self.mark = np.zeros(len(shard.ranks) + 1, np.int64)  # +1 where runs of hit words begin, -1 where they end
        self.items: list[set] = [set() for _ in range(texts)]
        self.best: list[tuple] = [(0, 0, "", 0)] * texts  # -length, word, item, word of the item

    def longer(self, text: int, found: tuple) -> None:
        self.best[text] = min(self.best[text], found)


def _search(shard: SuffixArray, block: Block, window: int, out: _Found) -> None:
    wanted = shard.ranks_of(block.vocabulary)[block.word]
    starts, need = block.windows(window)
    lacking = np.concatenate([[0], np.cumsum(wanted < 0)])
    possible = lacking[starts + need] == lacking[starts]  # all words of the window are in the shard
    starts, need = starts[possible], need[possible]
    if not len(starts):
        return
    _ready(shard, block.depth)
    ok = shard.longest(wanted, starts, block.left[starts]) >= need
    starts, need = starts[ok], need[ok]
    if not len(starts):
        return
    low, high = shard.bisect(wanted, starts, need), shard.bisect(wanted, starts, need, True)
    # a range is a window, which several texts of the benchmark may have
    ranges, which = np.unique(np.stack([low, high, need], 1), axis=0, return_inverse=True)
    owners: list[set] = [set() for _ in range(len(ranges))]
    for r, name in zip(which.ravel().tolist(), block.names[block.owner[starts]].tolist(), strict=True):
        owners[r].add(name)
    whole = np.zeros(len(shard.ranks), bool)  # where a window of full length begins
    for (a, b, length), names in zip(ranges.tolist(), owners, strict=True):
        places = shard.order[a:b]
        out.mark[places] += 1  # a window begins once at a place
        out.mark[places + length] -= 1
        for t in np.unique(shard.text[places]).tolist():
            out.items[t].update(names)
        if length == window:
            whole[places] = True
        else:
            texts = shard.text[places]
            for t, w in zip(texts.tolist(), (places - shard.begin[texts]).tolist(), strict=True):
                out.longer(t, (-length, w, min(names), 0))
    # the longest match from each of those places on, by the benchmark's array
    places = np.flatnonzero(whole)
    told = block.array.ranks_of(shard.vocabulary)
    text = np.where(shard.ranks > 0, told[shard.ranks - 1], -1) if len(told) else shard.ranks
    ends = np.flatnonzero(shard.is_end)
    length = block.array.longest(text, places, ends[np.searchsorted(ends, places)] - places)
    order = np.lexsort((places, -length, shard.text[places]))
    first = order[np.concatenate([[True], np.diff(shard.text[places][order]) > 0])] if len(order) else order
    places, length = places[first], length[first]
    low, high = block.array.bisect(text, places, length), block.array.bisect(text, places, length, True)
    key = block.array.least(block.by_item(), low, high)
    names = np.unique(block.names)
    for p, n, k in zip(places.tolist(), length.tolist(), key.tolist(), strict=True):
        t = int(shard.text[p])
        out.longer(t, (-n, p - int(shard.begin[t]), str(names[k >> 40]), k & ((1 << 40) - 1)))


def _spans(mark: np.ndarray, begin: np.ndarray) -> list[list[int]]:
    """Per text its runs of hit words: begin and end of each, one after the other."""
    hit = np.cumsum(mark[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.concatenate([np.searchsorted(a, begin), [len(a)]])
    return [np.stack([a[i:j] - f, b[i:j] - f], 1).ravel().tolist() if j > i else [] for i, j, f in zip(cut[:-1], cut[1:], begin, strict=True)]


_MATCH = "struct<length:bigint,word:bigint,item_id:string,item_word:bigint>"
_MATCH_ARROW = pa.struct([("length", pa.int64()), ("word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the columns `keep`, then n_words, n_hit (words inside any occurrence of a window of a benchmark
    item), item_ids (of the items with windows there, sorted as strings), hit_spans (runs of hit words: first word and end
    of each, from 0, one after the other), longest (the longest verbatim match of a window or more, or of a whole shorter item: length,
    first word here, item_id, first word there; the first of equals in this order; else null). These names must not be among `keep`."""
    blocks = blocks_of(benchmark, item_id, item_text)
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    results = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.int64())), ("longest", _MATCH_ARROW)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n_words, spans, found, longest = [], [], [], []
            for _, words, at in _shards(batch.column(batch.num_columns - 1)):
                shard = SuffixArray(words, at, 1)
                out = _Found(shard, len(at) - 1)
                for path in blocks if len(words) else ():
                    _search(shard, _block(path), window, out)
                n_words += np.diff(at).tolist()
                spans += _spans(out.mark, shard.begin)
                found += [sorted(x) for x in out.items]
                longest += [{"length": -n, "word": w, "item_id": i, "item_word": k} if n else None for n, w, i, k in out.best]
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip((n_words, n_hit, found, spans, longest), results, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *[c for c, _ in results]])
        trim()

    added = T.StructType.fromDDL(f"n_words bigint, n_hit bigint, item_ids array<string>, hit_spans array<bigint>, longest {_MATCH}")
    return df.mapInArrow(search, T.StructType([*df.schema.fields[:-1], *added.fields]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs, all columns, that have no word inside an occurrence of a window of a benchmark item."""
    codes = [f"_c{k}" for k in range(len(docs.columns))]
    text = codes[docs.columns.index(kw.pop("text", "text"))]
    found = contamination(docs.toDF(*codes), benchmark, text=text, keep=tuple(codes), **kw)
    return found.where("n_hit = 0").select(*codes).toDF(*docs.columns)


#: Longest matches that a task holds before it passes them on.
HELD_MATCHES = 4_000_000


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each suffix of each benchmark item (item_id, word: its first word's place) the longest verbatim match anywhere in docs:
    length, and doc_id and doc_word of one such match (the smallest doc_id, a null one last, then doc_word). Suffixes without any matching
    word have no row. Repeated items are matched once, of items that share an id the longest match counts."""
    blocks = blocks_of(benchmark, item_id, item_text)
    schema = "item_id string, word long, length long, doc_id long, doc_word long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}  # of each block: -length, doc_id, doc_word of each suffix

        def told() -> Iterator[pa.RecordBatch]:
            for path, rows in best.items():
                block = _block(path)
                k = np.flatnonzero(rows[:, 0])
                ids = pa.array(rows[k, 1], pa.int64(), mask=rows[k, 1] == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(block.names[block.owner[k]].tolist(), pa.string()), pa.array(k - block.at[block.owner[k]]), pa.array(-rows[k, 0]), ids, pa.array(rows[k, 2])], names=["item_id", "word", "length", "doc_id", "doc_word"])
            best.clear()

        for batch in _slices(batches):
            for first, words, at in _shards(batch.column(1)):
                shard = SuffixArray(words, at, 1)
                ids = batch.column(0).slice(first, len(at) - 1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                key = (rank[shard.text] << 40) | (np.arange(len(shard.text)) - shard.begin[shard.text])
                texts = np.argsort(ids, kind="stable")
                for path in blocks if len(words) else ():
                    block = _block(path)
                    wanted = shard.ranks_of(block.vocabulary)[block.word]
                    starts = np.flatnonzero(wanted > 0)
                    _ready(shard, block.depth)
                    length = shard.longest(wanted, starts, block.left[starts])
                    least = shard.least(key, shard.bisect(wanted, starts, length), shard.bisect(wanted, starts, length, True))
                    new = np.stack([-length, ids[texts[least >> 40]], least & ((1 << 40) - 1)], 1)
                    rows = best.setdefault(path, np.zeros((len(block.word), 3), np.int64))
                    old = rows[starts]
                    better = (new[:, 0] < old[:, 0]) | (new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | (new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2]))
                    rows[starts[better]] = new[better]
                    if sum(map(len, best.values())) > HELD_MATCHES:
                        yield from told()
        yield from told()

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(search, schema)
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), "doc_id", "doc_word")).alias("m")
    return found.groupBy("item_id", "word").agg(best).select("item_id", "word", (-F.col("m.l")).alias("length"), "m.doc_id", "m.doc_word")
