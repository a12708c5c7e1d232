"""Files of token ids, compressed in blocks by `rangecoder`.

A file holds the documents of a range of doc_id, in rising order: the mark, blocks of at most `BLOCK` ids (see
`rangecoder.encode`; each has its checksum and can be read alone), the directory and the end. The directory has, compressed
by zlib, how many documents at its beginning have no doc_id, the doc_id and the number of ids of each document and the place, size and number of ids of each block; the end has its
place, size and crc32 and the mark again. Blocks don't follow the borders of documents.

Files are written in the shared folder, each under its name only when it is whole.

Defined results: null texts count as empty; an empty document is the end id alone; rows that repeat a doc_id are kept, in the
order of their texts' hashes; rows without a doc_id come first and stay without. doc_id must be an integer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import arrow_rows, encoder, shared_dir, stored, trim
from .sharedfs import Ranges, Written

MARK = b"PBTOKID1"
BLOCK = 1 << 20
END_ID = 2
_END = struct.Struct("<QQI8s")


class _Writer:
    def __init__(self, out: Written):
        self.out, self.docs, self.lengths, self.blocks = out, [], [], []
        self.waiting, self.n, self.nulls = [], 0, 0
        out.write(MARK)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(0 if doc is None else doc)
        self.nulls += doc is None
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n += len(ids) // 4
        if self.n >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        a = 0
        while a < len(ids) and (last or len(ids) - a >= BLOCK):
            block = rangecoder.encode(ids[a : a + BLOCK])
            self.blocks.append((self.out.size, len(block), min(BLOCK, len(ids) - a)))
            self.out.write(block)
            a += BLOCK
        rest = ids[a:]
        self.waiting, self.n = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(True)
        parts = [np.array(self.docs, "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes(), np.array(self.blocks, "<u8").tobytes()]
        directory = zlib.compress(struct.pack("<QQQ", len(self.docs), len(self.blocks), self.nulls) + b"".join(parts))
        end = _END.pack(self.out.size, len(directory), zlib.crc32(directory), MARK)
        self.out.write(directory)
        self.out.write(end)


def documents_of(read: Ranges) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file, in order; a block at a time is held."""
    at, size, crc, mark = _END.unpack(read(read.size - _END.size, _END.size))
    directory = read(at, size)
    if mark != MARK or zlib.crc32(directory) != crc:
        raise ValueError("not a whole file of token ids")
    raw = zlib.decompress(directory)
    docs, blocks, nulls = struct.unpack_from("<QQQ", raw)
    ids, lengths = np.frombuffer(raw, "<i8", docs, 24), np.frombuffer(raw, "<i8", docs, 24 + 8 * docs)
    places = np.frombuffer(raw, "<u8", 3 * blocks, 24 + 16 * docs).reshape(-1, 3)
    have, k = np.zeros(0, np.uint32), 0
    for doc, n in zip([None] * nulls + ids[nulls:].tolist(), lengths.tolist(), strict=True):
        parts, missing = [], n
        while missing > len(have):
            parts.append(have)
            missing -= len(have)
            have = rangecoder.decode(read(int(places[k, 0]), int(places[k, 1]))).astype("<u4")
            k += 1
        parts.append(have[:missing])
        have = have[missing:]
        yield doc, np.concatenate(parts) if len(parts) > 1 else parts[0]


def write(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns, stored, a row for each: path, part (of rising doc_id), first_id, n_docs, n_ids, bytes."""
    end = np.array([end_id], "<u4").tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part, first_id = first.column(2)[0].as_py(), first.column(0)[0].as_py()
        path = f"{folder}/ids-{part:06d}.pbt"
        with Written(path) as out:
            to = _Writer(out)
            while first is not None:
                for doc, ids in zip(first.column(0).to_pylist(), encoder(tokenizer).encode(first.column(1)), strict=True):
                    to.add(doc, ids + end)
                first = next(batches, None)
            to.close()
        trim()
        row = {"path": path, "part": part, "first_id": first_id, "n_docs": len(to.docs), "n_ids": sum(to.lengths), "bytes": out.size}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("part", "first_id", "n_docs", "n_ids", "bytes"))]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    # also by text, so that a doc_id that many rows have is not one partition
    rows = rows.repartitionByRange("doc_id", F.xxhash64("t")).sortWithinPartitions("doc_id", F.xxhash64("t")).withColumn("p", F.spark_partition_id())
    with arrow_rows(docs.sparkSession):
        return stored(rows.mapInArrow(put, "path string, part long, first_id long, n_docs long, n_ids long, bytes long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (the ids of all documents before it), n_tokens, ids_crc32; with ids=True the ids."""
    # a row per file, with a file for each partition of the corpus
    files = manifest.withColumn("before", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    files = files.select("path", F.coalesce("before", F.lit(0)).alias("before")).repartition(max(1, manifest.count()), "path")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Ranges(path) as ranges:
                    rows: list[tuple] = []
                    for doc, x in documents_of(ranges):
                        rows.append((doc, start, len(x), zlib.crc32(x.tobytes()), *[x.astype(np.int32)] * ids))
                        start += len(x)
                        if len(rows) == 1000:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    return files.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)


def round_trip(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Writes docs to a new folder in the shared one and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer, shared_dir(spark, "ids"), **kw))
