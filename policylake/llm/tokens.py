"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

File format: Parquet, one row a chunk. A chunk holds the ids of consecutive documents, one after the
other as little-endian unsigned integers of ``id_bytes`` bytes, the documents' ids, and where each
begins as an Elias-Fano sequence of n + 1 numbers up to the chunk's length: ``width`` low bits of
each number packed one after the other, the high bits as unary gaps, and a sample of where every
``SAMPLE``-th one stands. So ``select(i)`` returns an offset from about 2 + log2(tokens / documents)
bits a document. Chunks are ordered by ``part`` and ``seq``; a document is never split, so a chunk
has at most ``chunk_tokens`` ids or one document. Spark's writer commits the files, so they may lie
in any store and survive lost executors.

Defined cases: null texts count as empty and yield the end id alone; documents are in ascending
order of id, null ids first, equal ids by a hash of the text; repeated rows come as often as they
are; an empty table gives no chunk; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policylake.llm.words import LOWER, SAME, by_bytes, flat

SAMPLE = 256
BATCH_BYTES = 4 << 20  # of text, encoded at once; a row may be larger
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _ONES.sum(1).astype(np.int64)
_NTH = np.array([[*np.flatnonzero(row), *[0] * 8][:8] for row in _ONES], np.int64)  # place of a byte's n-th one


def _pack(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, lowest bit first."""
    if not width:
        return b""
    bits = ((numbers[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


@dataclass
class EliasFano:
    """A non-decreasing sequence of ``size`` numbers."""

    size: int
    width: int
    low: bytes
    high: bytes
    samples: bytes  # uint32 places of every SAMPLE-th one of the high bits

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        size = len(numbers)
        if not size:
            return cls(0, 0, b"", b"", b"")
        width = max(0, (int(numbers[-1]) // size).bit_length() - 1)
        places = (numbers >> width) + np.arange(size)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(size, width, _pack(numbers, width), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at these places, each from its nearest sample on."""
        index = np.asarray(index, np.int64)
        high, samples = np.frombuffer(self.high, np.uint8), np.frombuffer(self.samples, "<u4").astype(np.int64)
        at = samples[index // SAMPLE]
        left, byte = index % SAMPLE, at >> 3
        ones = _COUNT[high[byte] & ((0xFF << (at & 7)) & 0xFF).astype(np.uint8)]  # from the sample on, in its byte
        left = left + _COUNT[high[byte]] - ones  # now counted from the byte's start
        open_ = np.flatnonzero(left >= _COUNT[high[byte]])
        while len(open_):
            left[open_] -= _COUNT[high[byte[open_]]]
            byte[open_] += 1
            open_ = open_[left[open_] >= _COUNT[high[byte[open_]]]]
        place = 8 * byte + _NTH[high[byte], left]
        return ((place - index) << self.width) | self._low(index)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.int64)
        packed = np.concatenate([np.frombuffer(self.low, np.uint8), np.zeros(8, np.uint8)])
        words = np.ndarray((len(packed) - 7,), "<u8", packed, strides=(1,))  # the 8 bytes from each place
        first = index * self.width
        return ((words[first >> 3] >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)


_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = 1
_KIND[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2  # not the apostrophe, nor what special tokens are made of
_MARK = b"~"


class Encoder:
    """A tokenizers file with a memory of text pieces.

    The tokenizer drops white space and encodes what stands between on its own, so a text's ids are
    those of its pieces in order. Where a letter or digit meets plain punctuation a piece ends too,
    as the tokenizer cuts there. Texts with what may be a special token are encoded whole.
    Pieces of at most ``SHORT`` bytes are kept: when more than ``REMEMBER`` have come or were used again, the
    others are forgotten. So the memory holds about twice as many at most, and frequent ones stay.
    """

    REMEMBER = 500_000
    SHORT = 64
    GROUP = 1024  # new pieces encoded as one text

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.id_type = np.dtype("<u2" if self.code == "H" else "<u4")
        self.mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in texts], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; short ones are encoded many at once, with a mark between them that none of them holds."""
        joined = [p for p in pieces if len(p) <= self.SHORT and _MARK not in p and b"<|" not in p]
        groups = [joined[i: i + self.GROUP] for i in range(0, len(joined), self.GROUP)]
        found: dict[bytes, bytes] = {}
        for group, ids in zip(groups, self._ids([(b" " + _MARK + b" ").join(g) for g in groups])):
            at = np.flatnonzero(np.frombuffer(ids, self.id_type) == self.mark[0]) if len(self.mark) == 1 else ()
            if len(at) + 1 != len(group):  # not a tokenizer of which a mark can be told from all else
                continue
            at = np.array(at, np.int64) * self.id_type.itemsize
            begins, ends = [0, *(at + self.id_type.itemsize).tolist()], [*at.tolist(), len(ids)]
            found.update(zip(group, [ids[a:b] for a, b in zip(begins, ends)]))
        alone = [p for p in pieces if p not in found]
        found.update(zip(alone, self._ids(alone)))
        return [found[p] for p in pieces]

    def _remembered(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces, from the memory where it has them."""
        if len(self.pieces) > self.REMEMBER:
            self.pieces, self.older = {}, self.pieces
        out = list(map(self.pieces.get, pieces))
        missed = [i for i, ids in enumerate(out) if ids is None]
        for i in missed:
            out[i] = self.older.get(pieces[i])
        new = [i for i in missed if out[i] is None]
        for i, ids in zip(new, self._piece_ids([pieces[i] for i in new])):
            out[i] = ids
        self.pieces.update((pieces[i], out[i]) for i in missed if len(pieces[i]) <= self.SHORT)
        return out

    def encode_column(self, column: pa.Array | pa.ChunkedArray) -> list[bytes]:
        """Ids of each text, as bytes; a piece is looked up once for the whole column."""
        data, offsets = flat(column)
        lower = LOWER[data]
        bare = np.flatnonzero(data[1:] > 127)  # what follows may be a mark that composes with the small letter only
        lower[bare] = SAME[data[bare]]
        inside, kind = lower != 0x20, _KIND[lower]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | (kind[1:] ^ kind[:-1] == 3)
        at = offsets[offsets < len(data)]
        start[at] = inside[at]
        first = np.searchsorted(np.flatnonzero(start), offsets)  # first piece of each text, and the number of pieces
        pieces = _binary(np.flatnonzero(start[inside]), lower[inside]).dictionary_encode()
        bounds, raw = _bytes_of(pieces.dictionary)
        ids = self._remembered([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        bounds, raw = _bytes_of(pa.array(ids, pa.large_binary()).take(pieces.indices))
        ends = bounds[first].tolist()
        out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
        whole = data.tobytes()
        if b"<|" in whole:
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if b"<|" in whole[a:b]:
                    out[i] = self._ids([whole[a:b]])[0]
        return out


def _binary(begins: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values that lie one after the other in ``data``, each from its place to the next one's."""
    offsets = np.append(begins, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where each value begins in the bytes of all, and these."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(1, np.int64), b""
    offsets = np.frombuffer(offsets, np.int64)[values.offset: values.offset + len(values) + 1]
    return offsets, data.to_pybytes() if data is not None else b""


_ENCODERS: dict[str, Encoder] = {}  # one in each Python worker


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


CHUNK = "part int, seq int, id_bytes int, n_docs bigint, n_tokens bigint, doc_ids array<{kind}>, size int, width int, low binary, high binary, samples binary, ids binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2,
                 chunk_tokens: int = 1 << 20, part_bytes: int = 8 << 20) -> None:
    """Encode every text, append ``end_id`` and write chunks to the folder ``path`` in ascending order of id.

    Rows are dealt out by ranges of id that hold about ``part_bytes`` of text each, so part p comes
    before part p + 1.
    """
    kind = docs.schema[id].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))

    def task(batches):
        from pyspark import TaskContext

        known, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], known.id_type).tobytes()
        names: list = []
        pieces: list[bytes] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // known.id_type.itemsize
            bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
            one = lambda x, t: pa.array([x], t)
            columns = [one(part, pa.int32()), one(seq, pa.int32()), one(known.id_type.itemsize, pa.int32()), one(len(names), pa.int64()), one(int(lengths.sum()), pa.int64()),
                       pa.array([names], pa.list_(names_type)), one(bounds.size, pa.int32()), one(bounds.width, pa.int32())]
            columns += [one(x, pa.binary()) for x in (bounds.low, bounds.high, bounds.samples, b"".join(pieces))]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "id_bytes", "n_docs", "n_tokens", "doc_ids", "size", "width", "low", "high", "samples", "ids"])

        for batch in (few for whole in batches for few in by_bytes(whole, 1, BATCH_BYTES)):
            names_type = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), known.encode_column(batch.column(1))):
                ids += end
                if pieces and size + len(ids) > chunk_tokens * known.id_type.itemsize:
                    yield chunk()
                    names, pieces, size, seq = [], [], 0, seq + 1
                names.append(name)
                pieces.append(ids)
                size += len(ids)
        if pieces:
            yield chunk()

    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie"))
    ranged = rows.repartitionByRange(int(parts), F.col("_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_tie").select("_id", "_text")
    ranged.mapInArrow(task, CHUNK.format(kind=kind)).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, id: str = "doc_id", ids: bool = False) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document in the files; ``ids`` adds the array itself.

    ``start`` counts the ids of all documents before. Chunks are decoded where they lie; only their
    sizes are added up, first those of whole parts.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bounds = EliasFano(row["size"], row["width"], row["low"], row["high"], row["samples"]).select(np.arange(row["size"]))
                all_ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                raw = memoryview(all_ids.tobytes())
                pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                names = pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type)
                columns = [pa.array([row[c]] * len(pairs), pa.int32()) for c in ("part", "seq")] + [names, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in pairs], pa.int64())]
                fields = ["part", "seq", "_id", "at", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([all_ids[a:b].astype(np.int64) for a, b in pairs], pa.list_(pa.int64())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)

    docs = chunks.mapInArrow(task, f"part int, seq int, _id {kind}, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)
    parts = chunks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part, not for each document
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = chunks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("within"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select(F.col("_id").alias(id), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
