"""Byte-pair encoding and decoding by batched numpy merge rounds, from a tokenizer's file (byte-level BPE).

The symbols of many words lie in one flat array. In a round each word merges its pair of lowest rank, wherever it stands in the word; ranks
of pairs are found by binary search over the sorted keys of all pairs, once for each pair that came to be. Words without a pair to merge
leave the array. Merging all of a word's places at once is exact where no merge of a product ranks before the merge that makes it; the file is
tested for that, and if it fails only the first place of each word is merged in a round.

Texts are parted where words begin in any case, and ids of pieces are kept by the worker, as common.Encoder does; parts of pieces follow the byte-level
pattern. Rows are independent, so nothing is shuffled. Null and empty texts have no ids and decode to ""; very long texts are
encoded in one piece of memory of a task (some 40 bytes a character); repeated rows give the same again; columns pass if they are kept and
mustn't be named `ids` or `decoded`; an empty table gives none. Ids that the vocabulary hasn't got decode to nothing, and bytes that aren't UTF-8
to replacement characters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Encoder, byte_chars, slices, trim

# How byte-level BPE parts a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NO_RANK = np.iinfo(np.int32).max
#: Symbols that a batch of words may have, unless one word has more.
FLAT = 1 << 20


class Merges:
    """The tables of a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            of = json.load(f)
        model, before = of["model"], of["pre_tokenizer"]
        if model["type"] != "BPE" or of["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["ignore_merges"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocabulary, chars = model["vocab"], byte_chars()
        self.of_byte = np.array([vocabulary[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in column], np.int64) for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        first = np.full(int(max(vocabulary.values())) + 1, -1, np.int64)  # the last rank that makes a symbol
        np.maximum.at(first, made, np.arange(len(made)))
        self.together = bool((np.maximum(first[left], first[right]) < np.arange(len(made))).all())
        self.special = {t["content"]: t["id"] for t in of["added_tokens"]}
        byte = {c: b for b, c in enumerate(chars)}
        tokens = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(tokens) + 1
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where none merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as bytes of unsigned 32-bit little-endian integers."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbol), NO_RANK, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        out = [b""] * len(words)
        while len(symbol):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(symbol)))
            done = least == NO_RANK
            if done.any():
                leaves = np.repeat(done, size)
                data, a = symbol[leaves].astype("<u4").tobytes(), 0
                for w, n in zip(word[start[done]].tolist(), (size[done] * 4).tolist(), strict=True):
                    out[w] = data[a : a + n]
                    a += n
                symbol, word, rank = symbol[~leaves], word[~leaves], rank[~leaves]
                least, size = least[~done], size[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            if self.together:  # of places that overlap (a pair of equals) every second, from the first
                run = np.diff(hit, prepend=-2) != 1
                first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            else:
                hit = hit[np.diff(word[hit], prepend=-1) != 0]
            symbol[hit] = self.made[rank[hit]]
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            place = np.cumsum(stays)[hit] - 1
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            # pairs that begin or end with a new symbol
            touched = np.zeros(len(symbol) + 1, bool)
            touched[place] = touched[place - 1] = True  # the one before the first is past the end
            new = np.flatnonzero(touched[:-1])
            last = new == len(symbol) - 1
            after = np.where(last, new, new + 1)
            rank[new] = np.where(~last & (word[new] == word[after]), self.rank(symbol[new], symbol[after]), NO_RANK)
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        ids = ids[ids < len(self.length)].astype(np.int64)
        n = self.length[ids]
        at = np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.bytes[at].tobytes()


class BatchedEncoder(Encoder):
    """Ids of pieces by merge rounds."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.kept, self.old = {}, {}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        return self._ids([p.decode() for p in pieces])

    def _ids(self, texts: list[str]) -> list[bytes]:
        cut: list[list] = []
        for t in texts:  # words, or ids of special tokens
            words: list = []
            for k, part in enumerate(self.parts.split(t) if any(s in t for s in self.merges.special) else [t]):
                words += [self.merges.special[part]] if k % 2 else WORDS.findall(part)
            cut.append(words)
        distinct = [(w, w.encode()) for w in {w for words in cut for w in words if isinstance(w, str)}]
        of: dict = {i: np.array([i], "<u4").tobytes() for i in self.merges.special.values()}
        batch, held = [], 0
        for w in distinct:
            if held and held + len(w[1]) > FLAT:
                of.update(zip([x for x, _ in batch], self.merges.merged([x for _, x in batch]), strict=True))
                batch, held = [], 0
            batch.append(w)
            held += len(w[1])
        of.update(zip([x for x, _ in batch], self.merges.merged([x for _, x in batch]), strict=True))
        return [b"".join(map(of.__getitem__, words)) for words in cut]


_encoders: dict[str, BatchedEncoder] = {}


def encoder(path: str) -> BatchedEncoder:
    """One for each path in a Python worker."""
    if path not in _encoders:
        _encoders[path] = BatchedEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the columns `keep`, and ids, unsigned 32-bit little-endian integers as binary. path: the tokenizer's file, on every
    executor."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = encoder(path).encode(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], "ids"])
        trim()

    return df.mapInArrow(encode, T.StructType([*df.schema.fields[:-1], T.StructField("ids", T.BinaryType())]))


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of rows, and decoded, the text of the ids (null: "")."""
    df = rows.withColumn("decoded", F.coalesce(F.col(f"`{ids}`"), F.lit(b"")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of = encoder(path).merges
            texts = [of.decoded(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)
        trim()

    return df.mapInArrow(decode, T.StructType([*df.schema.fields[:-1], T.StructField("decoded", T.StringType())]))
