"""An adaptive range coder for blocks of token ids that mixes predictions of order 0, 1 and 2.

A block is cut into lanes of equal length that are coded side by side with one model, so that numpy codes a token of every
lane at once; each lane has a carry-less range coder of its own. Before each step the model predicts, for each lane, an id
from the two ids before (order 2) and one from the id before (order 1); adaptive weights, kept for each pair of the
predictions' confidences, divide the range between the two and order 0, an adaptive distribution over all ids. After each step
the model learns the ids of all lanes. Blocks share nothing, so each can be read alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 4096
WEIGHT_BITS, ID_BITS = 10, 18
_BITS = np.uint64(WEIGHT_BITS + ID_BITS)
#: Ids must be below this.
VOCABULARY = 1 << 17
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_16, _48, _ID, _1 = np.uint64(16), np.uint64(48), np.uint64(ID_BITS), np.uint64(1)
_HASH_BITS = 18
_HEAD = struct.Struct("<IIII")  # ids, lanes, size of the vocabulary, crc32 of the ids as unsigned 32-bit integers


class _Model:
    def __init__(self, vocabulary: int, lanes: int, decoding: bool):
        self.size = vocabulary
        # a guess and how sure it is (0 to 3), as 4 * id + sureness
        self.by1, self.by2 = np.zeros(vocabulary, np.int64), np.zeros(1 << _HASH_BITS, np.int64)
        self.hits = np.ones((16, 3), np.int64)  # for each pair of sureness: order 2 right, order 1 right, neither
        self.seen = np.zeros(vocabulary, np.int64)
        self.new: list[np.ndarray] = []
        self.decoding, self.step, self.next = decoding, 0, 0
        self.a = self.b = np.zeros(lanes, np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Order 0 and the weights from what was seen."""
        if self.new:
            self.seen += np.bincount(np.concatenate(self.new), minlength=self.size)
            self.new = []
        spare = (1 << ID_BITS) - self.size
        self.freq = (1 + self.seen * spare // max(int(self.seen.sum()), 1)).astype(np.uint64)
        ends = np.cumsum(self.freq)
        self.start = ends - self.freq
        if self.decoding:
            self.symbol = np.zeros(1 << ID_BITS, np.int32)
            self.symbol[: int(ends[-1])] = np.repeat(np.arange(self.size, dtype=np.int32), self.freq.astype(np.int64))
        w = 1 + self.hits * ((1 << WEIGHT_BITS) - 3) // self.hits.sum(1, keepdims=True)
        w[:, 2] = (1 << WEIGHT_BITS) - w[:, 0] - w[:, 1]
        self.weight = w.astype(np.uint64)
        self.bound = np.cumsum(self.weight, 1) - self.weight
        # the same for whole intervals, by 3 * context + choice
        self.starts, self.freqs = (self.bound << _ID).ravel(), (self.weight << _ID).ravel()
        self.first, self.second, self.rest = (np.ascontiguousarray(x) for x in (self.bound[:, 1], self.bound[:, 2], self.weight[:, 2]))

    def predict(self) -> None:
        self.h = (self.a * 40503 + self.b * 30011) >> 5 & ((1 << _HASH_BITS) - 1)
        self.g1, self.g2 = self.by1.take(self.b), self.by2.take(self.h)
        self.p1, self.p2 = self.g1 >> 2, self.g2 >> 2
        self.context = (self.g2 & 3) * 4 + (self.g1 & 3)

    def learn(self, ids: np.ndarray, choice: np.ndarray) -> None:
        """choice: 3 * context + which prediction was right."""
        self.hits += np.bincount(choice, minlength=48).reshape(16, 3)
        for table, at, guess, mine in ((self.by2, self.h, self.g2, self.p2), (self.by1, self.b, self.g1, self.p1)):
            # a right guess gets surer, a wrong one less sure, or replaced; of lanes that share a place the last one counts
            right, sure = mine == ids, guess & 3
            new = guess + (right & (sure < 3))
            wrong = np.flatnonzero(~right)
            new[wrong] = np.where(sure.take(wrong) > 0, new.take(wrong) - 1, ids.take(wrong) << 2)
            table[at] = new
        self.new.append(ids)
        self.a, self.b = self.b, ids
        self.step += 1
        if self.step >= self.next:
            self.refresh()
            self.next = self.step + min(8, self.step)


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 256))
    return lanes, -(-n // lanes)


def _ready(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Which lanes have two bytes to move; a range that is too short but spans a border is cut off there."""
    same = (low ^ (low + rng)) < _TOP
    short = rng < _BOT
    if (cut := short & ~same).any():
        rng[cut] = (~low[cut] + _1) & (_BOT - _1)
    return np.flatnonzero(same | short)


def encode(ids: np.ndarray) -> bytes:
    """A block: head, lengths of the lanes' output, output."""
    ids = np.asarray(ids)
    n = len(ids)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    vocabulary = int(ids.max()) + 1
    if vocabulary > VOCABULARY:
        raise ValueError(f"ids must be below {VOCABULARY}")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    model = _Model(vocabulary, lanes, False)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    width = 3 * steps + 16
    out, at = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    for x in np.ascontiguousarray(grid.reshape(lanes, steps).T):
        model.predict()
        not2, not1 = model.p2 != x, model.p1 != x
        choice = model.context * 3 + not2 * (1 + not1.view(np.int8))
        start, freq = model.starts.take(choice), model.freqs.take(choice)
        rest = np.flatnonzero(not2 & not1)
        w, y = model.rest.take(model.context.take(rest)), x.take(rest)
        start[rest] += model.start.take(y) * w
        freq[rest] = model.freq.take(y) * w
        rng >>= _BITS
        low += start * rng
        rng *= freq
        go = _ready(low, rng)
        while len(go):
            l = low.take(go)  # noqa: E741
            here = at.take(go)
            out[here] = l >> _48
            at[go] = here + 1
            l <<= _16
            r = rng.take(go) << _16
            more = _ready(l, r)
            low[go], rng[go] = l, r
            go = go[more]
        model.learn(x, choice)
    for _ in range(4):
        out[at] = low >> _48
        at += 1
        low <<= _16
    lengths = at - np.arange(lanes) * width
    body = b"".join(out[k * width : k * width + m].astype("<u2").tobytes() for k, m in enumerate(lengths.tolist()))
    return _HEAD.pack(n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes())) + lengths.astype("<u4").tobytes() + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; an error if their checksum is another."""
    n, lanes, vocabulary, crc = _HEAD.unpack_from(block)
    if not n:
        return np.zeros(0, np.int32)
    steps = -(-n // lanes)
    lengths = np.frombuffer(block, "<u4", lanes, _HEAD.size).astype(np.int64)
    data = np.concatenate([np.frombuffer(block, "<u2", -1, _HEAD.size + 4 * lanes), np.zeros(16, np.uint16)]).astype(np.uint16)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    model = _Model(vocabulary, lanes, True)
    low, rng, code = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _16) | data[at]
        at += 1
    grid = np.zeros((steps, lanes), np.int32)
    top = len(data) - 1
    for step in range(steps):
        model.predict()
        rng >>= _BITS
        v = (code - low) // rng
        part = v >> _ID
        beyond1, beyond2 = part >= model.first.take(model.context), part >= model.second.take(model.context)
        choice = model.context * 3 + (beyond1.view(np.int8) + beyond2)
        start, freq = model.starts.take(choice), model.freqs.take(choice)
        x = np.where(beyond1, model.p1, model.p2)
        rest = np.flatnonzero(beyond2)
        w = model.rest.take(model.context.take(rest))
        slot = np.minimum((v.take(rest) - start.take(rest)) // w, np.uint64((1 << ID_BITS) - 1))
        y = model.symbol.take(slot.astype(np.int64))
        x[rest] = y
        start[rest] += model.start.take(y) * w
        freq[rest] = model.freq.take(y) * w
        low += start * rng
        rng *= freq
        go = _ready(low, rng)
        while len(go):
            l, r, here = low.take(go) << _16, rng.take(go) << _16, at.take(go)  # noqa: E741
            code[go] = (code.take(go) << _16) | data.take(np.minimum(here, top))
            at[go] = here + 1
            more = _ready(l, r)
            low[go], rng[go] = l, r
            go = go[more]
        model.learn(x, choice)
        grid[step] = x
    ids = grid.T.ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids
