"""Stupid-backoff scores: count tables of n-grams in hash groups, joined to the corpus's own n-grams.

Documents are dealt into parts. A part sends each key group its distinct n-grams with their counts;
the group adds them up over all parts (the count table of these keys) and answers every part with
the totals of its n-grams (the join), in their order. Orders follow each other: an n-gram of two or
more words goes out only if both shorter ones inside are frequent, as it can't be frequent otherwise;
with a ``min_count`` of 1, the default, every n-gram goes out and counts. Documents then find
all their own n-grams in the tables, so none of their words backs off.

``backoff_scores_by_rows`` is the same as plain relations: an n-gram is a row, the count tables and the
join are Spark's. It writes several times as much to disk (figures in the README), so the query
takes the parts.

A word's score is the relative frequency of the longest n-gram that ends in it, has at most
``order`` words and occurs ``min_count`` times in the corpus, times ``backoff`` for each word that
was dropped; single words always count. A document's score is the sum of the logarithms.

Defined cases: null texts have no words, a score of 0 and no mean; repeated rows count as often as
they come and come back; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.parts import in_order, in_parts, key_group, numbers, pack_sorted, part_count, unpack_sorted, varints
from policylake.llm.words import sequence_keys, split_words, window_starts, word_keys
from policylake.session import materialize

ORDER, MIN_COUNT, BACKOFF = 3, 1, 0.4
MESSAGE = "part int, grp int, n int, keys binary, counts binary"
REPLY = "part int, grp int, n int, totals binary"
ALL_WORDS = 0  # the "order" whose single key counts the corpus's words


TEXT = "part int, _id {kind}, _text binary, _hash bigint"


def _deflated(batches):
    """Rows with their texts deflated, as they travel."""
    for batch in batches:
        texts = pa.array([zlib.compress(x) for x in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, batch.column(3)], ["part", "_id", "_text", "_hash"])


def _texts(column: pa.ChunkedArray) -> pa.Array:
    texts = [zlib.decompress(x) for x in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))])


def _pack(keys: np.ndarray) -> bytes:
    """``pack_sorted`` with the four high byte planes deflated: the highest one that isn't zero has a few bits a key."""
    planes = pack_sorted(keys)
    return planes[: 4 * len(keys)] + zlib.compress(planes[4 * len(keys):], 1) + len(keys).to_bytes(8, "little")


def _unpack(blob: bytes) -> np.ndarray:
    low = 4 * int.from_bytes(blob[-8:], "little")
    return unpack_sorted(blob[:low] + zlib.decompress(blob[low:-8]))


class _Part:
    """N-grams of a part's documents, and what the count tables say about them so far."""

    def __init__(self, table: pa.Table, replies: pa.Table | None, min_count: int):
        self.table = in_order(table)
        self.words = split_words(_texts(self.table["_text"]))
        self.keys = word_keys(self.words)
        self.min_count = min_count
        self.answers: dict[int, np.ndarray] = {}
        blobs: dict[int, list] = {}
        for row in replies.to_pylist() if replies is not None else []:
            blobs.setdefault(row["n"], []).append((row["grp"], row["totals"]))
        for n, found in blobs.items():
            self.answers[n] = np.concatenate([numbers(zlib.decompress(b)) for _, b in sorted(found)])
        self.counts: dict[int, np.ndarray] = {}  # of the n-gram that begins at each word; 0 if it wasn't asked for

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the asked n-grams begin, in the order of their keys; the keys; the first of equal ones; their number."""
        begin = window_starts(self.words.first, n) if n > 1 else np.ones(len(self.words), bool)
        if n > 1:
            shorter = self.totals(n - 1) >= self.min_count
            begin[:-1] &= shorter[:-1] & shorter[1:]
        begin = np.flatnonzero(begin)
        keys = sequence_keys(self.keys, n)[begin] if len(begin) else np.empty(0, np.uint64)
        order = np.argsort(keys)
        begin, keys = begin[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return begin, keys, first, np.diff(np.concatenate([first, [len(keys)]]))

    def totals(self, n: int) -> np.ndarray:
        if n not in self.counts:
            begin, _, _, sizes = self.grams(n)
            self.counts[n] = np.zeros(len(self.words), np.int64)
            self.counts[n][begin] = np.repeat(self.answers.get(n, np.empty(0, np.int64)), sizes)
        return self.counts[n]

    def message(self, n: int, groups: int) -> pa.Table:
        _, keys, first, sizes = self.grams(n)
        keys = keys[first]
        cuts = np.searchsorted(key_group(keys, groups), np.arange(groups + 1))
        rows = [(g, n, _pack(keys[a:b]), zlib.compress(varints(sizes[a:b])[0].tobytes(), 1)) for g, a, b in zip(range(groups), cuts[:-1], cuts[1:]) if b > a]
        if n == 1:
            rows.append((0, ALL_WORDS, _pack(np.zeros(1, np.uint64)), zlib.compress(varints(np.array([len(self.words)]))[0].tobytes(), 1)))
        return _message(self.table["part"][0].as_py(), rows)

    def scores(self, order: int, backoff: float) -> np.ndarray:
        """Logarithm (base 10) of each word's score."""
        every = self.answers[ALL_WORDS][0] if len(self.words) else 1
        score = np.log10(np.maximum(self.totals(1), 1) / every)
        position = np.arange(len(self.words)) - np.repeat(self.words.first[:-1], self.words.counts())
        context = np.minimum(position, order - 1)  # words before that an n-gram may hold
        score = score + context * np.log10(backoff)
        for n in range(2, order + 1):
            at = np.flatnonzero((position >= n - 1))
            seen = at[self.totals(n)[at - n + 1] >= self.min_count]
            score[seen] = np.log10(self.totals(n)[seen - n + 1] / self.totals(n - 1)[seen - n + 1]) + (context[seen] - n + 1) * np.log10(backoff)
        return score


def _message(part: int, rows: list) -> pa.Table:
    return pa.table({"part": pa.array([part] * len(rows), pa.int32()), "grp": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()),
                     "keys": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())})


def count_table(table: pa.Table) -> pa.Table:
    """Totals of a group's n-grams over all parts, for each part in the order of its keys."""
    keys = [_unpack(x) for x in table["keys"].to_pylist()]
    every, counts = np.concatenate(keys), np.concatenate([numbers(zlib.decompress(x)) for x in table["counts"].to_pylist()])
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))
    totals = np.empty(len(every), np.int64)
    totals[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.concatenate([first, [len(every)]])))
    ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
    return pa.table({c: table[c] for c in ("part", "grp", "n")} | {"totals": pa.array([zlib.compress(varints(totals[a:b])[0].tobytes(), 1) for a, b in zip(ends, ends[1:])], pa.binary())})


def backoff_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, part_bytes: int = 12 << 20) -> DataFrame:
    """``id, n_words, log_score, mean_score`` of every row, under the counts of all rows."""
    kind = docs.schema[id].dataType.simpleString()
    parts = part_count(docs, text, part_bytes)
    groups = max(1, parts * 3 // 2)  # keeps a group's keys well below a part's memory
    dealt = in_parts(docs, id, text, parts).mapInArrow(_deflated, TEXT.format(kind=kind))

    def first(table: pa.Table) -> pa.Table:
        return _Part(table, None, min_count).message(1, groups)

    def following(n: int):
        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            return _Part(left, right, min_count).message(n, groups) if left.num_rows else _message(0, [])
        return task

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_id": pa.array([], left.schema.field("_id").type), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        part = _Part(left, right, min_count)
        sums = np.concatenate([[0.0], np.cumsum(part.scores(order, backoff))])
        bounds = part.words.first
        return pa.table({"_id": part.table["_id"], "n_words": pa.array(part.words.counts()), "log_score": pa.array(sums[bounds[1:]] - sums[bounds[:-1]])})

    def counted(messages: DataFrame) -> DataFrame:
        return messages.groupBy("grp", "n").applyInArrow(count_table, REPLY)

    replies = counted(dealt.groupBy("part").applyInArrow(first, MESSAGE))
    for n in range(2, order + 1):
        replies = replies.union(counted(dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(following(n), MESSAGE)))
    out = dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(score, f"_id {kind}, n_words bigint, log_score double")
    return out.select(F.col("_id").alias(id), "n_words", F.round("log_score", 4).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_score"))


def backoff_scores_by_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """``backoff_scores`` with DataFrame operations only: n-grams are exploded, counted by key, joined back and summed per document.

    Each word is a row with the keys of the n-grams that end in it; ``id`` need not be unique.
    """
    rows = materialize(docs.select(F.col(id).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")))
    words = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    keyed = rows.select("_row", F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    exploded = keyed.select("_row", "_w", F.posexplode("_w").alias("_at", "_k1"))
    gram = lambda first, n: F.get("_w", first) if n == 1 else F.xxhash64(*[F.get("_w", first + i) for i in range(n)])
    grams = materialize(exploded.select(
        "_row", "_at", "_k1", *[F.when(F.col("_at") >= n - 1, gram(F.col("_at") - (n - 1), n)).alias(f"_k{n}") for n in range(2, order + 1)],
        *[F.when(F.col("_at") >= n, gram(F.col("_at") - n, n)).alias(f"_c{n}") for n in range(1, order)]))  # contexts: the n words before
    scored = grams.withColumn("_score", F.lit(None).cast("double"))
    total = grams.count()
    tables = {n: materialize(grams.filter(f"_k{n} IS NOT NULL").groupBy(F.col(f"_k{n}").alias("_key")).agg(F.count("*").alias("_n"))) for n in range(1, order + 1)}
    for n in range(order, 0, -1):
        mine = tables[n].select(F.col("_key").alias(f"_k{n}"), F.col("_n").alias(f"_n{n}"))
        scored = scored.join(mine, f"_k{n}", "left")
        if n > 1:
            scored = scored.join(tables[n - 1].select(F.col("_key").alias(f"_c{n - 1}"), F.col("_n").alias("_below")), f"_c{n - 1}", "left")
            least = F.col(f"_n{n}") >= min_count
        else:
            scored, least = scored.withColumn("_below", F.lit(total)), F.lit(True)
        dropped = F.least("_at", F.lit(order - 1)) - (n - 1)
        value = F.log10(F.col(f"_n{n}") / F.col("_below")) + dropped * F.log10(F.lit(backoff))
        scored = scored.withColumn("_score", F.coalesce("_score", F.when(least, value))).drop("_below", f"_n{n}", f"_k{n}")
    sums = scored.groupBy("_row").agg(F.count("*").alias("n_words"), F.sum("_score").alias("log_score"))
    out = rows.select("_id", "_row").join(sums, "_row", "left").select(F.col("_id").alias(id), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.round(F.coalesce("log_score", F.lit(0.0)), 4).alias("log_score"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)))
