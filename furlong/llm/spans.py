"""Vectorised work on UTF-8 bytes inside Arrow batches: words, spans and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the memory of the prefix sums.
WINDOW = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of each value."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER_VALUE = BYTE_VALUE[LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(n, base, np.uint64)
        grown[:1] = 1
        have = np.multiply.accumulate(grown)
        if n <= WINDOW:
            _powers[base] = have
    return have[:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column end to end, and where each row starts (n + 1 offsets).
    Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_starts(size: int, offsets: np.ndarray) -> np.ndarray:
    """Marks, one more than there are bytes, of the positions at which a row starts or ends."""
    marks = np.zeros(size + 1, bool)
    marks[offsets] = True
    return marks


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\x20\x09-\x0D]+, and how many words lie before each row
    (n + 1). Words never cross rows."""
    solid = ~SPACE[buf]
    edge = row_starts(len(buf), offsets)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans come in the order of their starts and may overlap.

    Prefix sums of a polynomial modulo 2**64 over windows of bounded size; the odd base can be
    divided out, so equal spans have equal hashes wherever they lie. values: of each byte."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + WINDOW // 2)))
        high = int(ends[i:j].max())
        size = int(high - low)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(values[buf[low:high]] * powers(_BASE, max(size, 1))[:size], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * powers(inverse, size + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def chain(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of `length` consecutive values."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix(out)


class Index:
    """Numbers for 64-bit keys: an open hash table that numpy reads and fills."""

    def __init__(self, bits: int = 16):
        self.count = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        mask = (1 << self.bits) - 1
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            number = self.numbers[slot]
            same = self.keys[slot] == keys[left]
            out[left[same]] = number[same]
            more = ~same & (number >= 0)
            left, slot = left[more], (slot[more] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give numbers, in the order given, to distinct keys that have none yet."""
        numbers = np.arange(self.count, self.count + len(keys))
        self.count += len(keys)
        if self.count * 3 > 1 << self.bits:
            used = self.numbers >= 0
            keys, numbers = np.concatenate([self.keys[used], keys]), np.concatenate([self.numbers[used], numbers])
            self._room(max(self.bits, (self.count * 3).bit_length()))
        slot = self._slot(keys)
        while len(keys):
            free = self.numbers[slot] < 0
            taken, at = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[at]
            self.keys[taken], self.numbers[taken] = keys[who], numbers[who]
            rest = np.ones(len(keys), bool)
            rest[who] = False
            keys, numbers, slot = keys[rest], numbers[rest], (slot[rest] + (~free[rest]).astype(np.int64)) & ((1 << self.bits) - 1)
