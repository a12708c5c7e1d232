"""Helpers that several operators share: the shared folder, materialised tables, word hashing, tokenizing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of `documents` and `benchmark` words; see `words_of`.
ALNUM = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
NOT_SPACE = [b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D]
#: The same as patterns for Spark's split().
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_local: list[str] = []
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) in the cluster's shared folder, spark.checkpoint.dir. Only a local session may go without that
    setting (as tests do), and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="pagebinder-"))
        base = _local[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the folders that shared_dir() named within it, but for those that are taken out of the list that it gives."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: work is done once, lineage is cut, and lost
    executors cost nothing that was finished."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows while jobs run within it (some texts are very long); then as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on between tasks, and other stages need it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use() names it: the optimizer copies expressions, but not what a lambda
    has bound. (A lambda's body is computed for each element, with all that it names.)"""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text):
    """A-Z to lower case and nothing else. lower() has a quick path for ASCII and is then the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- hashes of words, for whole Arrow columns at once ---------------------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15)
_P = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            a = np.full(max(n, 1 << 20), base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def _table(word_bytes: list[int]) -> np.ndarray:
    t = np.zeros(256, np.uint64)
    for b in word_bytes:
        t[b] = b + 1
    for b in range(0x41, 0x5B):  # A-Z count as a-z
        if t[b + 32]:
            t[b] = b + 33
    return t


_tables = {"alnum": _table(ALNUM), "text": _table(NOT_SPACE)}


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none), and the place where each begins, with the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and each text's first word's index, with the end.
    kind: "alnum" (ASCII letters and digits and all of non-ASCII) or "text" (what white space parts)."""
    data, offsets = text_bytes(texts)
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    k = 0
    while k < len(counts):  # about 1 MB at a time; one text at least
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + (1 << 20), "right")) - 1)
        part, at = data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        value = _tables[kind][part]
        word = value != 0
        first = word.copy()
        first[1:] &= ~word[:-1]
        borders = at[:-1][at[:-1] < len(part)]
        first[borders] = word[borders]
        starts = np.flatnonzero(first)
        if len(starts):
            up, down = _power_tables(len(part))
            h = np.add.reduceat(value * up[: len(part)], starts) * down[starts]
            # reduceat sums up to the next start: a text that begins with a gap ends the word before it all the same,
            # since gaps count 0
            hashes.append(mixed(h + _M))
        counts[k:end] = np.diff(np.searchsorted(starts, at))
        k = end
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each place on, without regard to where texts end."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : len(words) - n + 1 + j]
    return mixed(out + np.uint64(n))


# --- token ids ------------------------------------------------------------------------------------------------------

_tokenizers: dict = {}


#: What a byte is to the byte-level pattern: unknown, white space, a blank, letter, digit, another character of ASCII, an apostrophe, part of another character.
_ANY, _WHITE, _BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(8)
_class = np.full(256, _OTHER, np.uint8)
_class[:128] = _ANY
_class[[9, 10, 11, 12, 13]], _class[32], _class[39] = _WHITE, _BLANK, _QUOTE
_class[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _class[0x30:0x3A] = _LETTER, _DIGIT
_class[[b for b in range(0x21, 0x7F) if _class[b] == _ANY]] = _SIGN
#: Whether a piece begins at a byte of the second class behind one of the first, as 8 * first + second.
_begins = np.zeros(64, bool)
for _a, _b in [(a, b) for a in (_LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER) for b in (_WHITE, _BLANK)] + [(_LETTER, _SIGN), (_LETTER, _QUOTE), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _SIGN), (_DIGIT, _QUOTE), (_SIGN, _LETTER), (_SIGN, _DIGIT)]:
    _begins[8 * _a + _b] = True
#: White space beyond ASCII, and what some versions of Unicode take for it.
_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: A piece that is one word of the byte-level pattern.
_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: One without white space but for a blank at its beginning.
_LINE = re.compile(rb" ?(?:[!-~]|[\xc3-\xdf].|(?!\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\xe0-\xef]..|[\xf0-\xf4]...)+", re.DOTALL)


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level BPE's file: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern begins a word whatever stands around, in UTF-8 bytes of texts that begin at offsets (with the end):
    where a text begins; before white space behind anything else; between letters, digits and other characters of ASCII and Latin-1,
    but not behind an apostrophe; behind a single white-space character that isn't a blank. Places at other white space don't count."""
    kind = _class[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    letters = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[letters] = kind[letters + 1] = _LETTER
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        for s in _SPACES:
            if len(at) and s[0] == lead:
                found = at[at + len(s) <= len(data)]
                for k, b in enumerate(s[1:], 1):
                    found = found[data[found + k] == b]
                for k in range(len(s)):
                    kind[found + k] = _ANY
    first = np.zeros(len(data) + 1, bool)
    if len(data):
        inner = _begins[(kind[:-1] << 3) | kind[1:]]
        first[1:-1] = inner
        lone = np.flatnonzero(inner[:-1] & (kind[1:-1] == _WHITE) & (kind[2:] > _BLANK))
        first[lone + 2] = True
    first[offsets] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """Ids by the tokenizers library. Texts are parted where its byte-level pattern begins a word in any case (piece_starts), so the ids of a text
    are those of its pieces; a batch's distinct pieces are looked up once, and their ids are kept by the worker, as bytes of unsigned 32-bit
    little-endian integers: of `KEEP` pieces, and of as many that were kept before them and may come back. Pieces that are a word of the
    pattern need the library's merges only, others its pattern too. Texts with what could be a special token are encoded whole."""

    KEEP = 300_000
    LONGEST = 200  # bytes of a piece that is kept

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.of, self.merging = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merging.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.shown = np.array(list(map(ord, byte_chars())), "<u4")
        vocabulary = self.of.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes], words: bool) -> list[bytes]:
        """Ids of pieces as lines of one text, which is quicker; pieces end where their bytes do."""
        if words:
            text, lengths = self.shown[np.frombuffer(b"\n".join(pieces), np.uint8)], list(map(len, pieces))
            text[text == self.shown[10]] = 10
            of, text, step = self.merging, text.tobytes().decode("utf-32-le"), 1
        else:
            of, text, step = self.of, b"\n".join([*pieces, b""]).decode(), 2
            lengths = [n for p in pieces for n in (len(p), 1)]
        ids = np.array(of.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        made, want = np.cumsum(self.size[ids]), np.cumsum(lengths)
        ends = np.searchsorted(made, want)
        if not len(made) or made[-1] != want[-1] or (made[ends] != want).any():  # another vocabulary
            return self._ids([p.decode() for p in pieces])
        data, ends = ids.tobytes(), (4 * (ends + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]][::step], ends[::step], strict=True)]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        kinds: tuple[list[int], ...] = ([], [], [])
        for k, p in enumerate(pieces):
            kinds[0 if _WORD.fullmatch(p) else 1 if _LINE.fullmatch(p) else 2].append(k)
        out = [b""] * len(pieces)
        for kind, at in enumerate(kinds):
            of = [pieces[k] for k in at]
            for k, x in zip(at, (self._joined(of, kind == 0) if kind < 2 else self._ids([p.decode() for p in of])) if of else [], strict=True):
                out[k] = x
        return out

    def _learned(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, kept from now on: those that were kept before the last turn move, others are encoded."""
        if len(self.kept) + len(pieces) > self.KEEP:
            self.kept, self.old = {}, self.kept
        out = list(map(self.old.get, pieces))
        new = [k for k, x in enumerate(out) if x is None]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            for k, x in zip(part, self._pieces([pieces[k] for k in part]), strict=True):
                out[k] = x
        self.kept.update((p, x) for p, x in zip(pieces, out, strict=True) if len(p) <= self.LONGEST)
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        starts = piece_starts(data, offsets)
        if not len(starts):
            return [b""] * (len(offsets) - 1)
        borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, borders, pa.py_buffer(data)]).dictionary_encode()
        distinct, of = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        ids = list(map(self.kept.get, distinct))
        lacking = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(lacking, self._learned([distinct[k] for k in lacking]), strict=True):
            ids[k] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, n = np.frombuffer(b"".join(ids), "<u4"), sizes[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[of] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; null texts are empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)).tolist()
        plain = pc.if_else(pc.match_substring(texts, "<|"), "", texts) if whole else texts
        data, offsets = text_bytes(plain)
        out: list[bytes] = []
        while len(out) < len(texts):  # about 8 MB at a time; one text at least
            k = len(out)
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + (1 << 23), "right")) - 1)
            out += self._encode(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k])
        for k, x in zip(whole, self._ids([texts[k].as_py() for k in whole]), strict=True):
            out[k] = x
        return out


def encoder(path: str) -> Encoder:
    """One for each path in a Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]
