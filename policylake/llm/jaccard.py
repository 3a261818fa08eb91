"""Jaccard join of n-gram sets: prefix filter to find what can meet, prefix trees to join it.

1. *Order.* Documents are dealt into parts; texts with equal sets collapse to one set. Every part
   sends each n-gram key once with the number of its sets, key groups add them up and send back how
   frequent each is. Rare n-grams come first in the global order.
2. *Prefixes.* Sets of similarity t share an n-gram among the first ``n - ceil(t n) + 1`` of each.
   N-grams of one set only use up places there, so a set whose prefix holds no other has no partner
   and is left. The others and the n-grams of their prefixes are rows from here on.
3. *Bundles.* Sets that share prefix n-grams, over any number of steps, are a bundle; linked sets are
   in one. A bundle goes to one task once. One that is larger than ``block_bytes`` is cut: into the
   groups of its prefix n-grams, or as a whole, whichever costs less, and a group still too large into
   blocks that meet in pairs. Before they do, each block meets itself and a few hubs of its group,
   and only sets outside the largest component so found meet the other blocks.
4. *Prefix tree.* A task stores its sets, frequent n-grams first, in a trie: sorted sequences with the
   lengths of their common beginnings. A walk over it carries for every set how many n-grams of the
   path it holds, so shared beginnings are counted once. A subtree is left when what remains of it can
   bring no set to the threshold, or all that could reach it are connected already. What a leaf links
   to is verified by exact counts; links within a component found before are not written.

N-grams are 64-bit keys and sets 128-bit digests; two unequal ones pass for equal with a chance of
2**-64 and 2**-128 a pair. A group whose sets share n-grams but are not similar is still compared
block by block: work within it, not its output, grows faster than its size.

Defined cases: null, blank and empty texts have an empty set, link with nothing and are their own
component (a null id gives null); fewer words than an n-gram make one of all of them; rows with equal
sets are linked; null ids take part but never name a component, unless it holds null ids only;
repeated rows come back as often as they come; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.parts import PART_BYTES, key_group, numbers, pack_sorted, part_count, unpack_sorted, varints
from policylake.llm.simhash import components
from policylake.llm.words import LOWER, by_bytes, mix, sequence_keys, split_words, window_starts, word_keys
from policylake.session import materialize

SIZE, PERCENT = 5, 80
BLOCK_BYTES = 8 << 20
HUBS = 16
STRIDE = 32  # n-grams of a path between two looks at what remains
MESSAGE = "part int, grp int, keys binary, many binary"
REPLY = "part int, grp int, codes binary"
SETS = "digest string, n bigint, bytes bigint, prefix array<bigint>, grams binary"


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every text's distinct n-grams, ascending within it, and where each text's begin."""
    words = split_words(texts, LOWER)
    keys, counts = word_keys(words), words.counts()
    at = np.flatnonzero(window_starts(words.first, size))
    doc, grams = np.searchsorted(words.first, at, side="right") - 1, sequence_keys(keys, size)[at] if len(at) else np.empty(0, np.uint64)
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        if len(short):
            doc = np.concatenate([doc, short])
            grams = np.concatenate([grams, mix(sequence_keys(keys, few)[words.first[short]], np.uint64(few))])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def _digests(grams: np.ndarray, first: np.ndarray) -> list[str | None]:
    raw = grams.tobytes()
    return [hashlib.md5(raw[8 * a: 8 * b]).hexdigest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def set_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``_id, digest, n`` of every row: which set it has (null: empty) and of how many n-grams."""
    kind = docs.schema[id].dataType.simpleString()

    def task(batches):
        for batch in batches:
            for rows in by_bytes(batch, 1):
                grams, first = shingle_sets(rows.column(1), size)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_digests(grams, first), pa.string()), pa.array(np.diff(first), pa.int64())], ["_id", "digest", "n"])

    return docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(task, f"_id {kind}, digest string, n bigint")


def _dealt(docs: DataFrame, text: str, size: int, parts: int) -> DataFrame:
    """``part, digest, _text``: texts with a set, by the set's digest, each set once a task."""
    def task(batches):
        seen: set[str] = set()
        for batch in batches:
            for rows in by_bytes(batch, 0):
                found = _digests(*shingle_sets(rows.column(0), size))
                new = []
                for i, digest in enumerate(found):
                    if digest is not None and digest not in seen:
                        seen.add(digest)
                        new.append(i)
                digests = [found[i] for i in new]
                yield pa.RecordBatch.from_arrays([pa.array([int(d[:8], 16) % parts for d in digests], pa.int32()), pa.array(digests, pa.string()), rows.column(0).take(pa.array(new, pa.int64()))], ["part", "digest", "_text"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(task, "part int, digest string, _text string")


class _Part:
    """The distinct sets of a part, in the order of their digests, and its distinct n-grams."""

    def __init__(self, table: pa.Table, size: int):
        digests = table["digest"].to_pylist()
        rows = {d: i for i, d in enumerate(digests)}
        self.digests = sorted(rows)
        self.grams, self.first = shingle_sets(table["_text"].take(pa.array([rows[d] for d in self.digests], pa.int64())), size)
        self.keys, self.at, self.counts = np.unique(self.grams, return_inverse=True, return_counts=True)


def _count_message(table: pa.Table, size: int, groups: int) -> pa.Table:
    part = _Part(table, size)
    cuts = np.searchsorted(key_group(part.keys, groups), np.arange(groups + 1))
    full = np.flatnonzero(np.diff(cuts))
    ends = [(int(cuts[g]), int(cuts[g + 1])) for g in full]
    return pa.table({
        "part": pa.array([table["part"][0].as_py()] * len(full), pa.int32()), "grp": pa.array(full, pa.int32()),
        "keys": pa.array([pack_sorted(part.keys[a:b]) for a, b in ends], pa.binary()),
        "many": pa.array([zlib.compress(varints(part.counts[a:b] - 1)[0].tobytes(), 1) for a, b in ends], pa.binary())})


def _frequency_codes(table: pa.Table) -> pa.Table:
    """For every n-gram sent: the binary logarithm of the number of its sets, 0 for one set."""
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    counts = np.concatenate([numbers(zlib.decompress(x)) + 1 for x in table["many"].to_pylist()])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    first = np.flatnonzero(new)
    code = np.ceil(np.log2(np.add.reduceat(counts[order], first))).astype(np.uint8)
    codes = np.empty(len(every), np.uint8)
    codes[order] = np.repeat(code, np.diff(np.concatenate([first, [len(every)]])))
    ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
    return pa.table({"part": table["part"], "grp": table["grp"], "codes": pa.array([zlib.compress(codes[a:b].tobytes(), 1) for a, b in zip(ends, ends[1:])], pa.binary())})


def _candidate_sets(left: pa.Table, right: pa.Table, size: int, percent: int) -> pa.Table:
    """Sets with shared n-grams in their prefix; ``grams``: all their shared n-grams, rare ones first."""
    rows = {"digest": [], "n": [], "bytes": [], "prefix": [], "grams": []}
    if left.num_rows:
        part = _Part(left, size)
        codes = np.frombuffer(b"".join(zlib.decompress(r["codes"]) for r in sorted(right.to_pylist(), key=lambda r: r["grp"])), np.uint8)[part.at]
        n = np.diff(part.first)
        order = np.lexsort((part.grams, codes, np.repeat(np.arange(len(n)), n)))
        grams, own = part.grams[order], np.add.reduceat(codes == 0, part.first[:-1], dtype=np.int64)
        shared = n + (-percent * n // 100) + 1 - own  # places of the prefix that its own n-grams leave
        for d in np.flatnonzero(shared > 0).tolist():
            rest = grams[part.first[d] + own[d]: part.first[d + 1]]
            if len(rest):
                for name, value in zip(rows, (part.digests[d], int(n[d]), 8 * len(rest) + 100, rest[: shared[d]].view(np.int64).tolist(), rest.tobytes())):
                    rows[name].append(value)
    return pa.table({"digest": pa.array(rows["digest"], pa.string()), "n": pa.array(rows["n"], pa.int64()), "bytes": pa.array(rows["bytes"], pa.int64()),
                     "prefix": pa.array(rows["prefix"], pa.list_(pa.int64())), "grams": pa.array(rows["grams"], pa.binary())})


def trie_links(digests: list[str], sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[str, str]]:
    """Links between the given distinct sets that connect every component of linked ones.

    ``sets`` hold their shared n-grams, rare ones first, ``sizes`` all n-grams of each.
    """
    m = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), lengths)
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    tokens = tokens.astype(">u4")
    paths = [tokens[begins[i]: begins[i + 1]][::-1] for i in range(m)]  # frequent ones first
    order = sorted(range(m), key=lambda i: paths[i].tobytes())
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    paths, sizes, lengths = [paths[i].astype(np.int64) for i in order], np.asarray(sizes, np.int64)[order], lengths[order]
    by_token = np.lexsort((rank[owner], tokens))
    holders = np.split(rank[owner][by_token], np.flatnonzero(np.diff(tokens[by_token].astype(np.int64))) + 1)  # sets, by place in the trie, of each n-gram

    shared = np.zeros(m + 1, np.int64)  # depth down to which a path is the one before's
    for s in range(1, m):
        a, b = paths[s - 1], paths[s]
        k = min(len(a), len(b))
        other = np.flatnonzero(a[:k] != b[:k])
        shared[s] = other[0] if len(other) else k

    held = np.zeros(m, np.int64)  # n-grams of the walk's path that each set holds
    label = np.arange(m)
    links: list[tuple[str, str]] = []
    path: list[int] = []

    def back_to(depth: int) -> None:
        while len(path) > depth:
            held[holders[path.pop()]] -= 1

    def hopeless(s: int, depth: int) -> int:
        """The first set after the subtree at this depth, if nothing in it can link two components; else 0."""
        after = np.flatnonzero(shared[s + 1:] < depth)
        end = s + 1 + int(after[0]) if len(after) else m
        most, least = int(lengths[s:end].max()) - depth, int(sizes[s:end].min())
        reach = np.flatnonzero((100 + percent) * (held[:end] + most) >= percent * (sizes[:end] + least))
        mine = label[s]
        return end if (label[reach] == mine).all() and (label[s:end] == mine).all() else 0

    s = 0
    while s < m:
        back_to(int(shared[s]))
        skip = 0
        while len(path) < len(paths[s]):
            for token in paths[s][len(path): len(path) + STRIDE].tolist():
                path.append(token)
                held[holders[token]] += 1
            if skip := hopeless(s, len(path)):
                break
        if skip:
            back_to(int(shared[skip]) if skip < m else 0)
            s = skip
            continue
        linked = np.flatnonzero((100 + percent) * held[:s] >= percent * (sizes[:s] + sizes[s]))
        for other in linked[np.unique(label[linked], return_index=True)[1]].tolist():
            if label[other] != label[s]:
                links.append((digests[order[other]], digests[order[s]]))
                label[label == label[other]] = label[s]
        s += 1
    return links


def _join(groups: DataFrame, percent: int) -> DataFrame:
    """``a, b`` links of ``key, digest, n, grams``: one prefix tree for each key."""
    def task(table: pa.Table) -> pa.Table:
        rows = {d: (n, g) for d, n, g in zip(table["digest"].to_pylist(), table["n"].to_pylist(), table["grams"].to_pylist())}
        digests = sorted(rows)
        links = trie_links(digests, np.array([rows[d][0] for d in digests]), [np.frombuffer(rows[d][1], "<u8") for d in digests], percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.string()), "b": pa.array([b for _, b in links], pa.string())})

    return groups.groupBy("key").applyInArrow(task, "a string, b string")


def _units(sets: DataFrame, block_bytes: int) -> DataFrame:
    """``digest, unit, unit_bytes``: which sets have to meet, in bundles or in the groups of a large bundle's n-grams."""
    entries = materialize(sets.select("digest", "bytes", F.explode("prefix").alias("gram")))
    grams = materialize(entries.groupBy("gram").agg(F.count("*").alias("sets"), F.min("digest").alias("hub"), F.sum("bytes").alias("gram_bytes")).filter("sets > 1"))
    meeting = entries.join(grams, "gram")
    bundles = materialize(components(meeting.filter("digest != hub").select("digest", "hub"), "digest", "hub"))
    members = sets.join(bundles, sets["digest"] == bundles["node"]).select("digest", "root", "bytes")
    whole = members.groupBy("root").agg(F.sum("bytes").alias("unit_bytes"))
    blocks = lambda size: F.ceil(F.col(size) / F.lit(block_bytes))
    cut = grams.join(bundles, grams["hub"] == bundles["node"]).groupBy("root").agg(F.sum(F.col("gram_bytes") * blocks("gram_bytes")).alias("cut_cost"))
    plan = materialize(whole.join(cut, "root").select("root", "unit_bytes", ((F.col("unit_bytes") > block_bytes) & (F.col("cut_cost") < F.col("unit_bytes") * blocks("unit_bytes"))).alias("by_gram")))
    uncut = members.join(plan.filter(~F.col("by_gram")), "root").select("digest", F.col("root").alias("unit"), "unit_bytes")
    torn = bundles.join(plan.filter("by_gram").select("root"), "root").select(F.col("node").alias("digest"))
    return uncut.union(meeting.join(torn, "digest").select("digest", F.concat(F.lit("gram "), F.col("gram").cast("string")), "gram_bytes"))


def similar_sets(sets: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``a, b``: links between the candidate sets, as many as connect each component."""
    units = materialize(_units(sets, block_bytes).withColumn("blocks", F.ceil(F.col("unit_bytes") / F.lit(block_bytes)).cast("int")))
    most = units.agg(F.max("blocks")).first()[0]
    bodies = sets.select("digest", "n", "grams")
    bins = max(1, -(-(sets.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    small = units.filter("blocks = 1").select("digest", F.concat(F.lit("bin "), F.pmod(F.xxhash64("unit"), F.lit(bins)).cast("string")).alias("key")).distinct()
    links = _join(bodies.join(small, "digest"), percent)
    if not most or most == 1:
        return links
    large = materialize(units.filter("blocks > 1"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks"))
    hubs = large.groupBy("unit", "blocks", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(HUBS))).agg(F.min("digest").alias("digest"))
    name = lambda *c: F.concat_ws("#", "unit", *c)
    first = large.select("digest", name(block).alias("key")).union(hubs.select("digest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "unit").select("digest", name("i")))
    links = materialize(links.union(_join(bodies.join(first.distinct(), "digest"), percent)))
    roots = materialize(components(links))
    labelled = materialize(large.join(roots, large["digest"] == roots["node"], "left").select(large["*"], F.coalesce("root", "digest").alias("label")))
    main = labelled.groupBy("unit", "label").agg(F.count("*").alias("sets")).groupBy("unit").agg(F.max_by("label", F.struct("sets", "label")).alias("main"))
    size = sets.select("digest", "bytes")
    rest = materialize(labelled.join(main, "unit").filter("label != main").join(size, "digest").select("digest", "unit", "blocks", "bytes"))
    rows = rest.groupBy("unit").agg(F.ceil(F.sum("bytes") / F.lit(block_bytes)).cast("int").alias("rows"))
    over = lambda n, alias: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(alias)
    down = rest.join(rows, "unit").select("digest", "unit", F.pmod(F.xxhash64("digest", F.lit(2)), F.col("rows")).alias("i"), over("blocks", "j"))
    across = large.join(rows, "unit").select("digest", "unit", over("rows", "i"), block.alias("j"))
    second = down.select("digest", name("i", "j").alias("key")).union(across.select("digest", name("i", "j"))).distinct()
    return links.union(_join(bodies.join(second, "digest"), percent))


def candidate_sets(docs: DataFrame, text: str = "text", size: int = SIZE, percent: int = PERCENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """``digest, n, bytes, prefix, grams`` of the distinct sets that share an n-gram of their prefix with another."""
    parts = part_count(docs, text, part_bytes)
    groups = max(1, parts // 4)
    dealt = _dealt(docs, text, size, parts)
    codes = dealt.groupBy("part").applyInArrow(lambda t: _count_message(t, size, groups), MESSAGE).groupBy("grp").applyInArrow(_frequency_codes, REPLY)
    return dealt.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(lambda a, b: _candidate_sets(a, b, size, percent), SETS)


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: rows link if their sets' Jaccard similarity is ``percent`` hundredths or more."""
    prints = materialize(set_digests(docs, id, text, size))
    sets = materialize(candidate_sets(docs, text, size, percent, part_bytes))
    roots = components(similar_sets(sets, percent, block_bytes))
    classes = prints.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("_id").alias("least"))
    rooted = materialize(classes.join(roots, classes["digest"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "digest").alias("root")))
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    known = rooted.join(named, "root").select("digest", "component_id")
    out = prints.filter("digest IS NOT NULL").join(known, "digest").select("_id", "n", "component_id").union(prints.filter("digest IS NULL").select("_id", "n", "_id"))
    return out.select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), "component_id")
