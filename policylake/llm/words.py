"""Words of whole Arrow text columns as numpy offsets and 64-bit keys; the helpers that tasks use.

A text column is one byte buffer with document offsets, so words, their keys and the keys of word
sequences are found with array operations over the whole batch; no Python object per word. Keys are
64-bit, so unequal words or sequences share one with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # keeps the first k bytes of 8
LONG = 64  # bytes; longer words are hashed one by one

#: Byte tables: what each byte counts as, 0x20 being a separator.
SAME = np.arange(256, dtype=np.uint8)
SAME[9:14] = 0x20
LOWER = SAME.copy()
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
ALNUM = LOWER.copy()  # digits, letters and all bytes from 0x80
for _low, _high in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    ALNUM[_low:_high] = 0x20


@dataclass
class Words:
    data: np.ndarray  # the bytes after the table
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each document, and the number of words

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; null counts as empty."""
    array = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if isinstance(column, pa.ChunkedArray) and column.num_chunks \
        else pa.array([], pa.large_string()) if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset: array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(column: pa.Array | pa.ChunkedArray, table: np.ndarray = SAME) -> Words:
    """Words of every document: runs of bytes that ``table`` doesn't map to a separator."""
    data, offsets = flat(column)
    data = table[data]
    inside = data != 0x20
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = offsets[offsets < len(data)]
    begins[at] = inside[at]
    at = offsets[offsets > 0] - 1
    closes[at] = inside[at]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Key of a pair, from the keys of its halves; order matters."""
    h = (x * _K1 + y) * _K2
    h ^= h >> _S1
    h *= _K1
    return h ^ (h >> _S2)


def word_keys(words: Words) -> np.ndarray:
    """A 64-bit key for each word, from its bytes alone: equal on every machine."""
    lengths = words.ends - words.starts
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the 8 bytes from each place
    keys = mix(lengths.astype(np.uint64), eight[words.starts] & _TAIL[np.minimum(lengths, 8)])
    at, left = np.flatnonzero(lengths > 8), 8
    while len(at) and left < LONG:
        rest = np.minimum(lengths[at] - left, 8)
        keys[at] = mix(keys[at], eight[words.starts[at] + left] & _TAIL[rest])
        left += 8
        at = at[lengths[at] > left]
    for i in at:  # few: words longer than LONG bytes
        keys[i] = xxhash.xxh64_intdigest(words.data[words.starts[i]: words.ends[i]].tobytes(), 7)
    return keys


def sequence_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Key of each ``n`` consecutive keys (one for each start), by doubling."""
    if len(keys) < n:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, keys, 1
    while True:
        if n & size:
            part = power[done: done + len(keys) - n + 1]
            out = part if out is None else mix(out, part)
            done += size
        if done == n:
            return out
        power = mix(power[:-size], power[size:])
        size *= 2


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Mask over words: ``n`` words of the same document start here."""
    total = int(first[-1])
    mask = np.zeros(total, bool)
    counts = np.diff(first)
    fit = counts >= n
    change = np.zeros(total + 1, np.int8)
    np.add.at(change, first[:-1][fit], 1)
    np.add.at(change, first[1:][fit] - n + 1, -1)
    np.cumsum(change[:-1], out=change[:-1])
    mask[:] = change[:-1] > 0
    return mask


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask over words: inside one of the runs of ``length`` words from ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def per_document(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words of each document the mask holds."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[first[1:]] - total[first[:-1]]


def by_bytes(rows, column: int | str, limit: int = 2 << 20):
    """Slices of a batch or table whose texts have about ``limit`` bytes at most, or one row."""
    sizes = np.diff(flat(rows.column(column))[1])
    ends = np.cumsum(sizes)
    at = 0
    while at < rows.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield rows.slice(at, upto - at)
        at = upto
