"""Numpy steps on Arrow text columns, used inside Spark tasks.

Every function works on a bounded slice of whole texts: the bytes of an Arrow string column are
taken as one array, words are found by their separators, and hashes of words and of runs of
words come from prefix sums, so that no Python statement runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text worked on at once (a longer text is a slice of its own)
SLICE = 1 << 20

MIX1 = np.uint64(0xD6E8FEB86659FD93)
MIX2 = np.uint64(0xA0761D6478BD642F)
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
HALF = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (a bijection)."""
    x = x ^ (x >> HALF)
    x = x * MIX1
    x = x ^ (x >> HALF)
    x = x * MIX2
    return x ^ (x >> HALF)


def give_back() -> None:
    """Return freed memory to the system: a worker goes on to other groups and would keep the most that any took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the number of each key among them, and a place of each; np.unique takes thrice the memory."""
    order = np.argsort(key).astype(np.int32)
    ranked = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    values, sample = ranked[new], order[new]
    del ranked
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    number = np.empty(len(key), np.int32)
    number[order] = rank
    return values, number, sample


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.zeros(0, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = pow(self.base, -1, 1 << 64)
            for name, b in (("up", self.base), ("down", inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null counts as an empty text."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk) == 0:
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_binary()) if not pa.types.is_large_binary(chunk.type) else chunk
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
            to = min(max(to, at + 1), len(chunk))
            yield first + at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
        first += len(chunk)


def is_word_byte() -> np.ndarray:
    """By byte: True unless it is one of 0x20, 0x09-0x0D."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def is_alnum_byte() -> np.ndarray:
    """By byte: True for 0-9, a-z and everything from 0x80."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lowered() -> np.ndarray:
    """By byte: A-Z in lower case, all else unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def find_words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and per row the index of its first word (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


class Hasher:
    """64-bit hashes of words, and of runs of consecutive words."""

    def __init__(self):
        self.bytes, self.words = Powers(BYTE_BASE), Powers(WORD_BASE)
        self.byte_value = mix(np.arange(1, 257, dtype=np.uint64))

    def word_hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.bytes.take(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte_value[data] * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    def run_hash(self, word: np.ndarray, length: int) -> np.ndarray:
        """Of ``length`` words from each position; empty if there are fewer words."""
        n = len(word) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = self.words.take(len(word) + 1)
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * up[:-1], out=total[1:])
        return mix((total[length:] - total[:n]) * down[:n] + np.uint64(length))


def run_starts(first_word: np.ndarray, length: int) -> np.ndarray:
    """Positions at which ``length`` words of one row begin."""
    n = int(first_word[-1])
    ok = np.zeros(n + 1, np.int64)
    last = first_word[1:] - length + 1
    keep = last > first_word[:-1]
    np.add.at(ok, first_word[:-1][keep], 1)
    np.add.at(ok, last[keep], -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) of any pair."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start + length, n), -1)
    return np.cumsum(change)[:n] > 0


def row_of(first_word: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over ``width`` places from each position."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out[:n]


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words, each followed by one space, and the new starts of all words (a dropped one has no bytes)."""
    size = np.where(keep, end - start + 1, 0)
    to = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, start[keep], 1)
    np.add.at(change, end[keep], -1)
    take = np.cumsum(change)[:-1] > 0
    out = np.full(int(to[-1]), 0x20, np.uint8)
    space = np.zeros(len(out), bool)
    space[to[1:][keep] - 1] = True
    out[~space] = data[take]
    return out, to


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pack_steps(x: np.ndarray) -> bytes:
    """Differences of neighbours: runs and slow growth compress well in a shuffle."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def pack_gaps(x: np.ndarray) -> bytes:
    """Distinct keys in order by their gaps, each in the bytes that make the whole shortest.

    A gap that is too wide for them is cut into steps of the largest number, which stands for no key.
    """
    if not len(x):
        return b""
    gap = np.diff(x)
    cost = [size * (len(gap) + int((gap // np.uint64(256**size - 1)).sum(dtype=float))) for size in range(1, 9)]
    size = int(np.argmin(cost)) + 1
    most = np.uint64(256**size - 1)
    long = (gap // most).astype(np.int64)
    step = np.full(len(gap) + int(long.sum()), most, np.uint64)
    step[np.arange(len(gap)) + np.cumsum(long)] = gap % most
    return bytes([size]) + x[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_gaps(x: bytes) -> np.ndarray:
    if not x:
        return np.zeros(0, np.uint64)
    size = x[0]
    wide = np.zeros(((len(x) - 9) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(x, np.uint8, offset=9).reshape(-1, size)
    step = wide.view(np.uint64).ravel()
    first = np.frombuffer(x, np.uint64, 1, offset=1)
    key = np.cumsum(step, dtype=np.uint64) + first
    return np.concatenate([first, key[step != np.uint64(256**size - 1)]])


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(x, kind)


def unpack_steps(x: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, kind), dtype=kind)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets of mixed keys by their upper bits, in the order of the keys."""
    return ((key >> HALF) * np.uint64(n)) >> HALF
