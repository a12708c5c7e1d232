"""Packing of tokenized documents into sequences of fixed size: best fit, then swap-based local search.

Tokenizing writes one small row per piece (its place, length and checksum), which is stored; packing needs lengths only, so
ids are never shuffled. Pieces are dealt at random into groups of about `GROUP`; each group is packed by itself: best fit in
falling length, then a local search that moves pieces out of the emptiest sequences, or exchanges one for one or two for one,
whenever the squared fill of the sequences rises, until no step is left or all room together is less than a sequence. Rooms, lengths
and pair lengths are indexed, so a step looks at lengths, not at sequences. Sequences that stay well below full are taken
apart and packed again with those of the other groups.

Defined results: null texts count as empty; an empty document is one piece, the end id; repeated rows are packed each; pieces
of full length have a sequence of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, encoder, stored, trim

SIZE = 1024
END_ID = 2
GROUP = 20_000
#: Sequences filled less than this in their group are packed again across groups.
REPACK_BELOW = 0.97


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Per piece of at most `size` ids: doc_id, piece, start, length, ids_crc32; with ids=True the ids too. Only documents
    longer than that are cut; their first piece takes what is left over."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, out = [], [], [], [], [], []
            for k, x in enumerate(encoder(tokenizer).encode(batch.column(1))):
                data = x + end
                n = len(data) // 4
                a, b, i = 0, n if n <= size else (n % size or size), 0
                while a < n:
                    part = data[4 * a : 4 * b]
                    row.append(k), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if ids:
                        out.append(np.frombuffer(part, "<u4").astype(np.int32))
                    a, b, i = b, b + size, i + 1
            if row:
                arrays = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(out, pa.list_(pa.int32()))] * ids, names=names)
        trim()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(cut, schema)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: in falling length, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set when a bin with room r exists
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        fit = rooms >> lengths[k]
        if fit:
            room = lengths[k] + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(k)
        by_room[room - lengths[k]].append(b)
        if room > lengths[k]:
            rooms |= 1 << (room - lengths[k])
    return bins


class _Open:
    """Bins that have room, known by their room and by the lengths of their pieces, single (1) or in pairs (2)."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.room = [size - sum(lengths[k] for k in b) for b in bins]
        self.by_room: dict[int, set[int]] = {}
        self.rooms = 0  # bit r is set where a bin has room r
        self.free = 0  # all their room
        self.having: tuple[dict, ...] = ({}, {}, {})  # (length, room): bins
        self.masks: tuple[list, ...] = ([], [0] * size, [0] * size)  # of a length: rooms of the bins that have it, as bits
        self.most = np.full((3, size), -1)  # the largest of them
        for b in range(len(bins)):
            self.add(b)

    def _keys(self, b: int) -> list[tuple[int, int]]:
        """(kind, length) of single pieces and pairs. Distinct lengths in a bin are few: 1 + 2 + ... + 45 is more than 1024."""
        have: dict[int, int] = {}
        for k in self.bins[b]:
            have[self.lengths[k]] = have.get(self.lengths[k], 0) + 1
        one = sorted(have)
        two = {x + y for i, x in enumerate(one) for y in one[i + (have[x] == 1) :]}
        return [(1, x) for x in one] + [(2, x) for x in two if x < self.size]

    def add(self, b: int) -> None:
        r = self.room[b]
        if not r or not self.bins[b]:
            return  # full or empty bins take no part
        self.by_room.setdefault(r, set()).add(b)
        self.rooms |= 1 << r
        self.free += r
        for kind, x in self._keys(b):
            self.having[kind].setdefault((x, r), set()).add(b)
            self.masks[kind][x] |= 1 << r
            if r > self.most[kind, x]:
                self.most[kind, x] = r

    def remove(self, b: int) -> None:
        r = self.room[b]
        if not r or b not in self.by_room.get(r, ()):
            return
        self.by_room[r].discard(b)
        self.free -= r
        if not self.by_room[r]:
            self.rooms &= ~(1 << r)
        for kind, x in self._keys(b):
            here = self.having[kind][x, r]
            here.discard(b)
            if not here:
                self.masks[kind][x] &= ~(1 << r)
                self.most[kind, x] = self.masks[kind][x].bit_length() - 1

    def change(self, b: int, out: list[int], into: list[int]) -> None:
        """The pieces `out` leave bin b for `into`."""
        self.remove(b)
        self.bins[b] = [x for x in self.bins[b] if x not in out] + into
        self.room[b] += sum(self.lengths[x] for x in out) - sum(self.lengths[x] for x in into)
        self.add(b)

    def exchange(self, length: int, fill: int, kinds: tuple[int, ...]) -> tuple[int, int, int] | None:
        """(gain, kind, bin) of the largest gain for which pieces of this length can take the place of one or two shorter ones, in a
        bin that is fuller after it than the bin they come from was, so that the squared fill rises."""
        best = None
        for kind in kinds:
            short = np.arange(1, length)
            for x in (short[self.most[kind, 1:length] >= length - short]).tolist():
                gain = length - x
                if best and gain <= best[0]:
                    break
                fit = (self.masks[kind][x] >> gain) & ((1 << (self.size - fill)) - 1)
                if fit:
                    room = gain + (fit & -fit).bit_length() - 1
                    best = (gain, kind, min(self.having[kind][x, room]))
                    break
        return best

    def emptied(self, e: int) -> bool:
        """Whether anything changed when bin e was emptied as far as it can be."""
        lengths, changed = self.lengths, False
        self.remove(e)
        mine = sorted(self.bins[e], key=lengths.__getitem__)
        fill = self.size - self.room[e]
        while mine:
            stay = []
            for k in reversed(mine):  # a move fills the fullest bin that has room
                fit = self.rooms >> lengths[k]
                room = lengths[k] + (fit & -fit).bit_length() - 1
                if fit and self.size - room + lengths[k] > fill:
                    self.change(min(self.by_room[room]), [], [k])
                    fill -= lengths[k]
                    changed = True
                else:
                    stay.append(k)
            mine = stay[::-1]
            single = {lengths[k]: [k] for k in mine}
            double = {lengths[x] + lengths[y]: [x, y] for i, x in enumerate(mine) for y in mine[i + 1 : i + 2] + [of[0] for of in single.values() if lengths[of[0]] > lengths[x]]}
            found = [(*x, into) for n, into in single.items() if (x := self.exchange(n, fill, (1, 2)))]
            found += [(*x, into) for n, into in double.items() if n < self.size and (x := self.exchange(n, fill, (1,)))]
            if not found:
                break
            gain, kind, b, into = max(found)
            out = self._pieces(b, kind, sum(lengths[k] for k in into) - gain)
            self.change(b, out, into)
            mine = sorted([x for x in mine if x not in into] + out, key=lengths.__getitem__)
            fill -= gain
            changed = True
        self.bins[e], self.room[e] = mine, self.size - fill
        self.add(e)
        return changed

    def _pieces(self, b: int, kind: int, length: int) -> list[int]:
        of: dict[int, list[int]] = {}
        for k in self.bins[b]:
            of.setdefault(self.lengths[k], []).append(k)
        if kind == 1:
            return of[length][:1]
        x = next(x for x in of if length - x in of and (2 * x != length or len(of[x]) > 1))
        return of[x][:2] if 2 * x == length else [of[x][0], of[length - x][0]]


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empties bins, the emptiest first, by moves and by one-for-one and two-for-one exchanges that raise the squared fill, until
    no bin has any left or until all room together is less than a bin."""
    of = _Open([list(b) for b in bins], lengths, size)
    going = True
    while going:
        going = False
        for e in sorted(range(len(of.bins)), key=lambda b: (of.room[b], b), reverse=True):
            if of.free < size:
                return [b for b in of.bins if b]
            if of.bins[e] and of.room[e]:
                going |= of.emptied(e)
    return [b for b in of.bins if b]


def _packed(rows: DataFrame, n: int, size: int, groups: int, round_: int) -> DataFrame:
    """rows with sequence_id, offset, fill. n: the number of rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = (round_ << 60) | (int(pdf["g"].iloc[0]) << 24)
        for j, b in enumerate(bins):
            here = np.cumsum([0, *[lengths[k] for k in b]])
            seq[b], off[b], fill[b] = base + j, here[:-1], here[-1]
        return pdf.assign(sequence_id=seq, offset=off, fill=fill)

    names = [f for f in rows.schema if f.name not in ("sequence_id", "offset", "fill", "g")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    dealt = rows.select(*[f.name for f in names], F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(pack, f"{schema}, g long, sequence_id long, offset long, fill long").drop("g")


def packed(rows: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """rows (with length, 1 to size; stored or otherwise the same when read again) with sequence_id and offset."""
    whole = rows.where(F.col("length") >= size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = rows.where(F.col("length") < size)
    n = part.count()
    first = stored(_packed(part, n, size, n // group + 1, 1), "packed")
    good = F.col("fill") >= int(size * REPACK_BELOW)
    again = first.where(~good)
    m = again.count()
    second = _packed(again, m, size, m // group + 1, 2)
    return whole.unionByName(first.where(good).drop("fill")).unionByName(second.drop("fill"))


def packed_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with arrow_rows(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer, doc_id, text, size, end_id), "pieces")
    return packed(cut, size)


def sequences(docs: DataFrame, plan: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """The sequences themselves: sequence_id, ids. plan: of packed_documents, over documents with distinct doc_id."""
    ids = pieces(docs, tokenizer, ids=True, **kw).select("doc_id", "piece", "ids")
    joined = ids.join(plan.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has `size` ids at most
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
