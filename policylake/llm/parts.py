"""Documents in parts of bounded bytes, and blobs of 64-bit keys that travel between parts and key groups.

Operators that compare all word sequences of a corpus deal the documents into parts, send each key
group (a range of key hashes) one blob from each part instead of a row for each key, and get one
blob back. Parts depend on a document's id and text alone, so a lost task finds the same ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 4 << 20


def part_count(docs: DataFrame, text: str, part_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def in_parts(docs: DataFrame, id: str, text: str, parts: int) -> DataFrame:
    """``part, _id, _text, _hash`` of every row; a part holds about as many bytes as any other.

    Rows with equal id and text fall into one part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_hash"))
    return rows.select(F.pmod(F.xxhash64("_id", "_hash"), F.lit(int(parts))).cast("int").alias("part"), "_id", "_text", "_hash")


def in_order(table):
    """A part's documents in an order that doesn't depend on how they came."""
    return table.sort_by([("_hash", "ascending"), ("_id", "ascending")])


def key_group(keys: np.ndarray, groups: int) -> np.ndarray:
    """Group of each key, by its high bits, so that sorted keys are sorted by group too."""
    return (((keys >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences in byte planes: the high planes are mostly zero and compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers below 2**56, 7 bits each, and where each begins."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 8):
        more = values >= 1 << (7 * k)
        if not more.any():
            break
        sizes += more
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(begins[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        out[begins[at] + k] = ((values[at] >> (7 * k)) & 127) | np.where(sizes[at] > k + 1, 128, 0)
    return out, begins


def numbers(blob: bytes) -> np.ndarray:
    """The numbers that ``varints`` packed."""
    raw = np.frombuffer(blob, np.uint8)
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), first)
