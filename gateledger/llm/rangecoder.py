"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: models start empty, and a checksum of the ids is
kept beside it.  The ids of a block are laid out in lanes that are coded in
lock step, so every step is a handful of array operations over all lanes.

Each id gets the mixture of three predictions: order 0 spreads its share over
all ids by how often they occurred, order 1 and order 2 stake theirs on the id
that last followed the same one or two ids.  The stakes are the measured hit
rates of slots with the same recent success, so the mixture follows the data.
The three shares lie side by side, and an id is coded in the share of the
highest order that names it, which spares the decoder all searches but one.
All arithmetic is on integers; both directions run the same model.

Steps are kept cheap: the shares fill a power of two, so the coder shifts where
it would divide; a step moves at most one 32-bit word; a carry is noted and added
when the block is done; and order 0 is counted anew after 1, 2, 4, ... rows, later
every REFRESH rows, with a table from places to ids in which the decoder looks up.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 4096
BITS = 30  # of the scale of the mixture; order 0 keeps about (3/32)^2 of it
LARGEST = 1 << 23  # vocabulary
REFRESH = 16  # rows between counts of order 0
SLOTS = 1 << 18
LEVELS = 16
U = np.uint64
LOW, WORD = U(1 << 32), U(32)
# For the last four bits of a slot, twice, plus one for a hit: what to add to it, and whether it is given up.
_SURE = np.arange(LEVELS)
STEP = np.stack([(_SURE >> 1) - _SURE, np.minimum(_SURE + 2, LEVELS - 1) - _SURE], axis=1).ravel().astype(np.int32)
GIVEN_UP = np.stack([_SURE <= 2, np.zeros(LEVELS, bool)], axis=1).ravel()


def due(t: int) -> bool:
    """Whether order 0 is counted before row ``t``."""
    return t % REFRESH == 0 if t > REFRESH else t & (t - 1) == 0


def contexts(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Slots of order 2 after the ids ``two`` and ``one``."""
    return ((two * 0x9E3779B1 + one * 0x85EBCA6B) >> 7) & (SLOTS - 1)


class Model:
    """The three predictions for a block of ids below ``size``."""

    def __init__(self, size: int):
        if not 0 < size <= LARGEST:
            raise ValueError("no vocabulary of this size")
        self.size = size
        self.scale = max(20, size.bit_length() + 1)  # bits of all counts of order 0
        self.share = BITS - self.scale  # bits of a stake
        self.counts = np.zeros(size, np.int64)
        # Slots hold an id and, in the last four bits, how sure they are of it.
        self.slots = (np.zeros(size, np.int32), np.zeros(SLOTS, np.int32))
        self.tries = np.ones((2, LEVELS), np.int64) * 4
        self.hits = np.tile(np.arange(LEVELS, dtype=np.int64) // 4, (2, 1))

    def count(self, rows: np.ndarray) -> None:
        """Order 0 with further rows of ids."""
        self.counts += np.bincount(rows.ravel(), minlength=self.size)
        total, room = int(self.counts.sum()), (1 << self.scale) - self.size
        freq = 1 + self.counts * room // max(1, total)
        freq[int(np.argmax(freq))] += (1 << self.scale) - int(freq.sum())
        self.freq = freq
        self.cum = np.cumsum(freq) - freq

    def places(self) -> np.ndarray:
        """The id at each place of order 0."""
        return np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.int32), self.freq)

    def look(self, one: np.ndarray, at: np.ndarray) -> None:
        """Predictions after the id ``one``, in the slot ``at`` of order 2; shares in units of 1 << scale."""
        self.at = (one, at)
        self.seen = [slots.take(i) for slots, i in zip(self.slots, self.at, strict=True)]
        self.named = [v >> 4 for v in self.seen]
        self.sure = [v & 15 for v in self.seen]
        stake = np.minimum((self.hits << self.share) // self.tries, (29 << self.share) >> 5)
        stake[:, 0] = 0  # nothing seen, or wrong so far
        self.second = stake[1].take(self.sure[1])
        rest = (1 << self.share) - self.second
        self.first = (rest * stake[0].take(self.sure[0])) >> self.share
        self.unit = rest - self.first

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the shares of ``x``."""
        start, length = self.unit * self.cum.take(x), self.unit * self.freq.take(x)
        for k, before, share in ((0, self.unit, self.first), (1, self.unit + self.first, self.second)):
            mine = np.flatnonzero((self.named[k] == x) & (share > 0))
            start[mine], length[mine] = before[mine] << self.scale, share[mine] << self.scale
        return start, length

    def find(self, v: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in whose shares ``v`` lies, with start and length of these."""
        # a quotient of such small integers is exact below its fraction
        x = places.take((v / self.unit).astype(np.int64), mode="clip").astype(np.int64)
        start, length = self.unit * self.cum.take(x), self.unit * self.freq.take(x)
        part = v >> self.scale
        upto = self.unit + self.first
        mine = np.flatnonzero(part >= self.unit)
        second = part[mine] >= upto[mine]
        x[mine] = np.where(second, self.named[1][mine], self.named[0][mine])
        start[mine] = np.where(second, upto[mine], self.unit[mine]) << self.scale
        length[mine] = np.where(second, self.second[mine], self.first[mine]) << self.scale
        return x, start, length

    def learn(self, x: np.ndarray) -> None:
        fresh = ((x << 4) + 1).astype(np.int32)
        for k in (0, 1):
            case = 2 * self.sure[k] + (self.named[k] == x)
            seen = np.bincount(case, minlength=2 * LEVELS).reshape(LEVELS, 2)
            self.tries[k] += seen.sum(axis=1)
            self.hits[k] += seen[:, 1]
            kept = self.seen[k] + STEP.take(case)
            np.copyto(kept, fresh, where=GIVEN_UP.take(case))
            self.slots[k][self.at[k]] = kept


def shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 32))
    return lanes, -(-n // lanes)


def pack_ids(ids: np.ndarray, size: int) -> bytes:
    """Code a non-empty block of ids below ``size``."""
    n = len(ids)
    lanes, rows = shape(n)
    grid = np.zeros(lanes * rows, np.int64)
    grid[:n] = ids
    # two rows of zeros stand before the first ids
    grid = np.concatenate([np.zeros((2, lanes), np.int64), grid.reshape(lanes, rows).T])
    slots = contexts(grid[:-2], grid[1:-1])
    model, counted = Model(size), 2
    low, width = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    # a word in its low half, with room for a carry; place 0 takes none
    out, filled = np.zeros((rows + 3, lanes), U), np.zeros(lanes, np.int64)
    every = np.arange(lanes)
    for t in range(rows):
        if due(t):
            model.count(grid[counted:t + 2])
            counted = t + 2
        x = grid[t + 2]
        model.look(grid[t + 1], slots[t])
        start, length = model.interval(x)
        width >>= U(BITS)
        further = low + width * start.view(U)
        over = np.flatnonzero(further < low)
        out[filled[over], over] += U(1)
        low, width = further, width * length.view(U)
        at = np.flatnonzero(width < LOW)
        filled[at] += 1
        out[filled[at], at] = low[at] >> WORD
        low[at] <<= WORD
        width[at] <<= WORD
        model.learn(x)
    for part in (low >> WORD, low & (LOW - U(1))):
        filled += 1
        out[filled, every] = part
    for k in range(int(filled.max()), 1, -1):
        out[k - 1] += out[k] >> WORD
    used = (np.arange(1, out.shape[0])[:, None] <= filled).T
    body = out[1:].T[used].astype("<u4")  # without the carries
    return struct.pack("<III", n, size, zlib.crc32(ids.astype("<u4").tobytes())) + filled.astype("<u4").tobytes() + body.tobytes()


def unpack_ids(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if its checksum does not agree."""
    if len(block) < 12:
        raise ValueError("token block is cut short")
    n, size, checksum = struct.unpack_from("<III", block)
    lanes, rows = shape(n)
    if len(block) < 12 + 4 * lanes:
        raise ValueError("token block is cut short")
    filled = np.frombuffer(block, "<u4", lanes, 12).astype(np.int64)
    if len(block) != 12 + 4 * lanes + 4 * int(filled.sum()):
        raise ValueError("token block is cut short")
    words = np.concatenate([np.frombuffer(block, "<u4", -1, 12 + 4 * lanes).astype(U), np.zeros(2, U)])
    at = np.cumsum(filled) - filled
    code = (words[at] << WORD) | words[at + 1]
    at += 2
    model, counted, places = Model(size), 2, None
    width = np.full(lanes, 2**64 - 1, U)
    grid = np.zeros((rows + 2, lanes), np.int64)
    for t in range(rows):
        if due(t):
            model.count(grid[counted:t + 2])
            counted, places = t + 2, model.places()
        model.look(grid[t + 1], contexts(grid[t], grid[t + 1]))
        width >>= U(BITS)
        v = np.minimum(code // width, U((1 << BITS) - 1)).view(np.int64)
        x, start, length = model.find(v, places)
        code -= width * start.view(U)
        width *= length.view(U)
        short = np.flatnonzero(width < LOW)
        code[short] = (code[short] << WORD) | words.take(at[short], mode="clip")
        at[short] += 1
        width[short] <<= WORD
        grid[t + 2] = x
        model.learn(x)
    ids = grid[2:].T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != checksum:
        raise ValueError("token block does not match its checksum")
    return ids
