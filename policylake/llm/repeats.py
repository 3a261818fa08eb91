"""Exact substring dedup: prefix-partitioned suffix trees, cut at the depth that makes a repeat.

A suffix starts at a word and goes on to the end of its document; only its first ``size`` words
matter. Suffixes are split by the key of a prefix into groups that fit in memory, each group builds
the part of the suffix tree below its prefixes, and an inner node ``size`` words deep with two leaves
is a repeat: all its suffixes start a window that also starts elsewhere. Neighbouring windows join to
maximal repeats.

Three passes over the same dealt-out documents:

1. *Sampling.* Each window has an anchor, the smallest key of its ``PREFIX``-word sequences, so equal
   windows have equal anchors. An anchor that stands at one place of the corpus only rules out all
   its windows; about one word in 14 is an anchor, and one word in four remains.
2. *Trees.* The remaining suffixes go to the group of their prefix, ``PREFIX`` words long, or
   ``LONG_PREFIX`` where the anchor is so frequent that one prefix could hold too many suffixes.
   A suffix travels as the keys of its prefix and of the rest of its window, the tree's two edges;
   equal ones of a part travel once. So a passage that a third of all documents hold costs its
   group one entry a part.
3. *Removal.* The parts find their repeated windows again and take out the covered words.

Keys have 64 bits: two unequal windows pass for equal with a probability of about 2**-128.

Defined cases: null texts have no words; texts shorter than a window are kept whole; repeated rows
are repeats of each other and come back as often as they come; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.parts import PART_BYTES, in_order, in_parts, key_group, pack_sorted, part_count, unpack_sorted
from policylake.llm.words import Words, covered, mix, per_document, sequence_keys, split_words, window_starts, word_keys

SIZE = 35
PREFIX, LONG_PREFIX = 8, 24
FREQUENT = 1 << 16  # places of an anchor from which on its windows take the longer prefix
MESSAGE = "part int, grp int, kind int, keys binary, rest binary, many binary"
REPLY = "part int, grp int, kind int, flags binary"


def _slide(values: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``n`` consecutive values."""
    size, out = 1, values
    while 2 * size <= n:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(values) - n + 1], out[n - size: n - size + len(values) - n + 1]) if size < n else out


class _Part:
    """The windows of a part's documents and their anchors."""

    def __init__(self, table: pa.Table, size: int):
        self.table, self.size = in_order(table), size
        self.words: Words = split_words(self.table["_text"])
        self.keys = word_keys(self.words)
        self.starts = np.flatnonzero(window_starts(self.words.first, size))
        if not len(self.starts):
            self.anchors = self.anchor_of = np.empty(0, np.uint64)
            self.many = np.empty(0, bool)
            return
        self.prefixes = sequence_keys(self.keys, PREFIX)
        least = np.zeros(len(self.prefixes), np.uint64)
        least[self.starts] = _slide(self.prefixes, size - PREFIX + 1, np.minimum)[self.starts]
        self.anchor_of = least[self.starts]
        back = np.concatenate([np.zeros(size - PREFIX, np.uint64), least])  # a window of the same document has its anchor here
        here = self.prefixes[(_slide(back, size - PREFIX + 1, np.maximum) == self.prefixes) & (self.prefixes > 0)]
        self.anchors, counts = np.unique(here, return_counts=True)
        self.many = counts > 1

    def suffixes(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows whose anchor is repeated, in the order of their two edges, the edges, and the first of equal ones."""
        kind = flags[np.searchsorted(self.anchors, self.anchor_of)] if len(self.anchors) else np.empty(0, np.uint8)
        starts, kind = self.starts[kind > 0], kind[kind > 0]
        if not len(starts):
            empty = np.empty(0, np.uint64)
            return starts, empty, empty, np.empty(0, np.int64)
        rest = sequence_keys(self.keys, self.size - PREFIX)
        top, low = self.prefixes[starts], rest[starts + PREFIX]
        long = starts[kind > 1]
        if len(long):
            top[kind > 1] = mix(sequence_keys(self.keys, LONG_PREFIX)[long], np.uint64(LONG_PREFIX))
            low[kind > 1] = sequence_keys(self.keys, self.size - LONG_PREFIX)[long + LONG_PREFIX]
        order = np.lexsort((low, top))
        starts, top, low = starts[order], top[order], low[order]
        return starts, top, low, np.flatnonzero(_changes(top, low))


def _changes(*sorted_by: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return new


def _message(part: int, kind: int, groups: int, keys: np.ndarray, rest: np.ndarray | None, many: np.ndarray) -> pa.Table:
    """A blob for each group of ascending keys."""
    cuts = np.searchsorted(key_group(keys, groups), np.arange(groups + 1))
    full = np.flatnonzero(np.diff(cuts))
    ends = [(int(cuts[g]), int(cuts[g + 1])) for g in full]
    return pa.table({
        "part": pa.array([part] * len(full), pa.int32()), "grp": pa.array(full, pa.int32()), "kind": pa.array([kind] * len(full), pa.int32()),
        "keys": pa.array([pack_sorted(keys[a:b]) for a, b in ends], pa.binary()), "rest": pa.array([b"" if rest is None else rest[a:b].tobytes() for a, b in ends], pa.binary()),
        "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in ends], pa.binary())})


def _reply(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return pa.table({c: table[c] for c in ("part", "grp", "kind")} | {"flags": pa.array([flags[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})


def _opened(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)].astype(bool) for x, k in zip(table["many"].to_pylist(), keys)]
    return keys, np.concatenate(many)


def anchor_group(table: pa.Table) -> pa.Table:
    """For each anchor: 0 if it stands at one place only, 2 if at very many, else 1."""
    keys, many = _opened(table)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(_changes(every[order]))
    sizes = np.diff(np.concatenate([first, [len(every)]]))
    again = np.maximum(sizes > 1, np.maximum.reduceat(many[order], first)).astype(np.uint8)
    again[sizes > FREQUENT] = 2
    flags = np.empty(len(every), np.uint8)
    flags[order] = np.repeat(again, sizes)
    return _reply(table, flags, list(map(len, keys)))


def subtree(table: pa.Table) -> pa.Table:
    """Sort a group's suffixes; 1 for those below a deep inner node: both edges shared with another."""
    tops, many = _opened(table)
    top, low = np.concatenate(tops), np.concatenate([np.frombuffer(x, "<u8") for x in table["rest"].to_pylist()])
    order = np.lexsort((low, top))  # the leaves from left to right
    node = np.flatnonzero(_changes(top[order], low[order]))  # first leaf of each node at full depth
    leaves = np.diff(np.concatenate([node, [len(top)]]))
    inner = np.maximum(leaves > 1, np.maximum.reduceat(many[order], node)).astype(np.uint8)
    flags = np.empty(len(top), np.uint8)
    flags[order] = np.repeat(inner, leaves)
    return _reply(table, flags, list(map(len, tops)))


def _flags(replies: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r["grp"], r["flags"]) for r in replies.to_pylist() if r["kind"] == kind)
    return np.frombuffer(b"".join(f for _, f in rows), np.uint8)


def _join_kept(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The kept words, each with a space behind it; where each document's begin and end."""
    starts, lengths = words.starts[keep], (words.ends - words.starts)[keep] + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    source = np.repeat(starts - begins[:-1], lengths) + np.arange(begins[-1])
    out = np.append(words.data, np.uint8(0x20))[source]
    out[begins[1:] - 1] = 0x20
    bounds = begins[np.concatenate([[0], np.cumsum(keep)])[words.first]]
    return out.tobytes(), bounds[:-1], np.maximum(bounds[1:] - 1, bounds[:-1])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``id, n_words, n_removed, spans, kept_text`` of every row.

    ``spans``: first word and words of each maximal run covered by repeated windows of ``size`` words;
    ``kept_text``: the other words, joined by one space.
    """
    if size <= LONG_PREFIX:
        raise ValueError(f"a window has more than {LONG_PREFIX} words")
    kind = docs.schema[id].dataType.simpleString()
    parts = part_count(docs, text, part_bytes)
    groups = max(1, parts // 4)
    dealt = in_parts(docs, id, text, parts)

    def anchors(table: pa.Table) -> pa.Table:
        part = _Part(table, size)
        return _message(table["part"][0].as_py(), 0, groups, part.anchors, None, part.many)

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _message(0, 1, groups, np.empty(0, np.uint64), None, np.empty(0, bool))
        _, top, low, first = _Part(left, size).suffixes(_flags(right, 0))
        many = np.diff(np.concatenate([first, [len(top)]])) > 1
        return _message(left["part"][0].as_py(), 1, groups, top[first], low[first], many)

    def removal(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Part(left, size)
        starts, _, _, first = part.suffixes(_flags(right, 0))
        inner = np.repeat(_flags(right, 1), np.diff(np.concatenate([first, [len(starts)]]))) > 0
        gone = covered(starts[inner], size, len(part.words))
        counts, removed = part.words.counts(), per_document(gone, part.words.first)
        raw, begins, ends = _join_kept(part.words, ~gone)
        edge = gone.copy()
        at = part.words.first[:-1][counts > 0]
        edge[1:] &= ~gone[:-1]
        edge[at] = gone[at]
        close = gone.copy()
        close[:-1] &= ~gone[1:]
        close[at[1:] - 1] = gone[at[1:] - 1]
        run, until = np.flatnonzero(edge), np.flatnonzero(close) + 1
        of = np.searchsorted(part.words.first, run, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(run - part.words.first[of]), pa.array(until - run)], ["first", "words"])
        offsets = pa.array(np.searchsorted(of, np.arange(len(counts) + 1)), pa.int32())
        return pa.table({
            "_id": part.table["_id"], "n_words": pa.array(counts), "n_removed": pa.array(removed), "spans": pa.ListArray.from_arrays(offsets, spans),
            "kept_text": pa.array([raw[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist())], pa.string())})

    def empty_or(run):
        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows:
                return run(left, right)
            return pa.table({"_id": pa.array([], left.schema.field("_id").type), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()),
                             "spans": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), "kept_text": pa.array([], pa.string())})
        return task

    repeated = dealt.groupBy("part").applyInArrow(anchors, MESSAGE).groupBy("grp").applyInArrow(anchor_group, REPLY)
    trees = dealt.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(suffixes, MESSAGE).groupBy("grp").applyInArrow(subtree, REPLY)
    out = dealt.groupBy("part").cogroup(repeated.union(trees).groupBy("part")).applyInArrow(empty_or(removal), f"_id {kind}, n_words bigint, n_removed bigint, spans array<struct<first:bigint,words:bigint>>, kept_text string")
    return out.select(F.col("_id").alias(id), "n_words", "n_removed", "spans", "kept_text")
