"""Vectorised word handling for Arrow batches: spans, 64-bit word hashes, window hashes.

Every function works on the UTF-8 bytes of whole texts.  All separators that
the operators use are ASCII, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_BLOCK = 1 << 20  # bytes hashed at once: bounds the memory of one very long text
_POSITIONS = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15) & MASK)
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(start + step)


_BYTE = stream64(11, 256)
_PLACE = stream64(13, _POSITIONS) | np.uint64(1)
_WINDOW = stream64(17, 64) | np.uint64(1)
_WINDOW2 = stream64(19, 64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separator bytes of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Separator bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
NON_WORD = np.zeros(256, dtype=bool)
NON_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts after another, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `limit` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = spans(batch.column(batch.schema.get_field_index(name)))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            end = min(batch.num_rows, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a batch of texts.

    start, end: byte positions; bounds: word index where each text begins (n+1);
    hash: one 64-bit value per word; data: the (lower-cased) bytes.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool = False, hashed: bool = True):
        data, off = spans(column)
        if lower:
            data = LOWER[data]
        self.data, self.off = data, off
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, off).astype(np.int64)
        self.count = np.diff(self.bounds)
        self.hash = self._hashes(inside) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        sizes = self.end - self.start
        total = np.cumsum(sizes)
        out = np.empty(len(sizes), dtype=np.uint64)
        at = 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + _BLOCK, side="right")))
            region = slice(int(self.start[at]), int(self.end[to - 1]))
            chars = self.data[region][inside[region]]
            first = total[at:to] - sizes[at:to] - base
            place = np.arange(len(chars)) - np.repeat(first, sizes[at:to])
            value = _PLACE[place & (_POSITIONS - 1)]
            if sizes[at:to].max() > _POSITIONS:
                value = value * (mix64(place.astype(np.uint64) >> np.uint64(16)) | np.uint64(1))
            out[at:to] = np.add.reduceat(_BYTE[chars] * value, first)
            at = to
        return mix64(out ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def text_of_word(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on (0 where fewer than k follow in the batch)."""
        return window_hash(self.hash, k, second)

    def starts_of(self, k: int) -> np.ndarray:
        """Word indexes from which k words of the same text follow."""
        ok = np.zeros(len(self) + 1, dtype=np.int32)
        has = self.count >= k
        np.add.at(ok, self.bounds[:-1][has], 1)
        np.add.at(ok, (self.bounds[1:] - k + 1)[has], -1)
        return np.flatnonzero(np.cumsum(ok[:-1]))


def window_hash(values: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    weights = _WINDOW2 if second else _WINDOW
    out = np.zeros(len(values), dtype=np.uint64)
    m = len(values) - k + 1
    if m > 0:
        for j in range(k):
            weight = weights[j % 64] * np.uint64(2 * (j // 64) + 1)
            out[:m] += values[j : j + m] * weight
        out[:m] = mix64(out[:m])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
