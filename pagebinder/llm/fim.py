"""Fill-in-middle transformation: texts cut at line borders into prefix, middle and suffix, which are put in another order behind sentinels.

Units are lines (`[^\\n]*\\n|[^\\n]+`). A batch's texts lie in blocks of BLOCK bytes, which no two texts share; a Fenwick tree over the
blocks stores how many lines end in each and how many code points begin there. The k-th line end of a text is the k-th past those of the
texts before it: binary lifting finds its block in the tree, with the code points before it, and the block's bytes tell the place.

Rows are independent: nothing is shuffled, and a task holds a slice of a batch. Null texts count as empty; empty texts and texts that
hold a sentinel stay plain; a null id is drawn as an id without digits; repeated rows and ties make no difference; extra columns pass if
they are kept, and mustn't be named as the results are. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, slices, text_bytes, trim

BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE = 10


class Fenwick:
    """Prefix sums of two counts over blocks: row j holds the sums of the blocks that end with the j-th (from 1), as many as j's lowest bit says."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        sums = np.concatenate([[[0, 0]], np.cumsum(np.stack([units, points], 1), axis=0)])
        j = np.arange(len(sums))
        self.tree = sums - sums[j - (j & -j)]

    def before(self, blocks: np.ndarray) -> np.ndarray:
        """(units, code points) in the first so many blocks."""
        out, j = np.zeros((len(blocks), 2), np.int64), blocks.copy()
        while j.any():
            out += self.tree[j]
            j &= j - 1
        return out

    def descend(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each number (from 1) of a unit the block that holds its end, and (units, code points) before that block."""
        last = len(self.tree) - 1
        at, got = np.zeros(len(units), np.int64), np.zeros((len(units), 2), np.int64)
        step = 1 << max(last.bit_length() - 1, 0)
        while step:
            there = np.minimum(at + step, last)
            go = (at + step <= last) & (got[:, 0] + self.tree[there, 0] < units)
            at, got = np.where(go, there, at), got + self.tree[there] * go[:, None]
            step >>= 1
        return at, got


class Lines:
    """The line ends of the texts of a batch."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        size = np.diff(self.offsets)
        held = -(-size // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(held)])  # the first block of each text
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], held)
        self.begin = np.repeat(self.offsets[:-1], held) + within * BLOCK
        self.end = np.minimum(self.begin + BLOCK, np.repeat(self.offsets[1:], held))
        ends, points = self.data == NEWLINE, (self.data & 0xC0) != 0x80
        counts = [np.add.reduceat(x, self.begin, dtype=np.int64) if len(self.begin) else np.zeros(0, np.int64) for x in (ends, points)]
        self.tree = Fenwick(*counts)
        self.base = self.tree.before(self.first)  # of the texts before each text
        open_end = np.zeros(len(size), bool)
        full = size > 0
        open_end[full] = self.data[self.offsets[1:][full] - 1] != NEWLINE
        self.newlines = np.diff(self.base[:, 0])
        self.n, self.points, self.size = self.newlines + open_end, np.diff(self.base[:, 1]), size

    def cuts(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the place, in bytes and in code points, where its first so many lines end."""
        at, points = np.where(units > 0, self.size, 0), np.where(units > 0, self.points, 0)  # none, or a last line without a newline
        for some in np.array_split(inner := np.flatnonzero((units > 0) & (units <= self.newlines)), len(inner) // 4096 + 1):
            wanted = self.base[some, 0] + units[some]
            block, got = self.tree.descend(wanted)
            place = self.begin[block][:, None] + np.arange(BLOCK)
            inside = place < self.end[block][:, None]
            data = self.data[np.minimum(place, len(self.data) - 1)]
            found = np.cumsum((data == NEWLINE) & inside, axis=1) >= (wanted - got[:, 0])[:, None]
            k = found.argmax(axis=1) + 1  # bytes of the block up to the line's end
            at[some] = self.begin[block] + k - self.offsets[:-1][some]
            head = (np.arange(BLOCK) < k[:, None]) & ((data & 0xC0) != 0x80)
            points[some] = got[:, 1] + head.sum(axis=1) - self.base[some, 1]
        return at, points


def draws(ids: list, seed: int) -> np.ndarray:
    """h1 to h4 of each id: 32-bit parts of the sha256 of seed:id."""
    data = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(data, ">u4").reshape(-1, 4).astype(np.int64)


_ADDED = [("n", pa.int64(), T.LongType()), ("form", pa.string(), T.StringType()), ("prefix_chars", pa.int64(), T.LongType()), ("middle_chars", pa.int64(), T.LongType()), ("output", pa.string(), T.StringType())]


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Per row of docs: the columns `keep`, then n (lines), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if
    plain), output. rate: how many of a hundred documents are transformed; spm: how many of a hundred of those begin with the suffix."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            lines = Lines(texts)
            h = draws(batch.column(batch.num_columns - 2).to_pylist(), seed)
            a, b = h[:, 0] % (lines.n + 1), h[:, 1] % (lines.n + 1)
            (p, p_chars), (m, m_chars) = lines.cuts(np.minimum(a, b)), lines.cuts(np.maximum(a, b))
            m_chars = m_chars - p_chars
            forms, out = [], []
            data = lines.data.tobytes()
            for k, (begin, end) in enumerate(zip(lines.offsets[:-1].tolist(), lines.offsets[1:].tolist(), strict=True)):
                whole = data[begin:end]
                if not whole or any(s.encode() in whole for s in (PREFIX, SUFFIX, MIDDLE)) or h[k, 2] % 100 >= rate:
                    forms.append("plain")
                    out.append(whole)
                    continue
                prefix, middle, suffix = whole[: p[k]], whole[p[k] : m[k]], whole[m[k] :]
                forms.append("spm" if h[k, 3] % 100 < spm else "psm")
                parts = [(PREFIX, prefix), (SUFFIX, suffix)]
                out.append(b"".join(s.encode() + x for s, x in [*(parts if forms[-1] == "psm" else parts[::-1]), (MIDDLE, middle)]))
            plain = np.array([f == "plain" for f in forms], bool)
            added = [pa.array(lines.n), pa.array(forms, pa.string()), pa.array(p_chars, mask=plain), pa.array(m_chars, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names=[*batch.schema.names[:-2], *[c for c, _, _ in _ADDED]])
        trim()

    return df.mapInArrow(cut, T.StructType([*df.schema.fields[:-2], *[T.StructField(c, t) for c, _, t in _ADDED]]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form: no part holds a sentinel."""
    prefix = F.when(form == "psm", 1).otherwise(2)
    back = let(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), lambda parts: F.concat(F.get(parts, prefix), F.get(parts, F.lit(3)), F.get(parts, 3 - prefix)))
    return F.when(form == "plain", output).otherwise(back)
