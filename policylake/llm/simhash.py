"""SimHash near-duplicates: fingerprints, pigeonhole blocks, links and connected components.

A fingerprint has 64 bits, each set if more than half of the hashes of the text's shingles have it
set. Two fingerprints that differ in at most ``distance`` bits agree in at least ``blocks - distance``
of ``blocks`` bit blocks, so every combination of that many blocks is a join key: close pairs share
at least one. Distances are verified inside the rows that share a key.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; fewer words
than a shingle make one shingle of all words; rows with a null id get a fingerprint and take part in
linking, but never name a component unless it holds null ids only; repeated rows come back as often
as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm.words import LOWER, flat
from policylake.session import materialize

SEED = 42
_LANES = np.array([sum(((v >> (7 - b)) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)  # bit b of a byte in lane b


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # a byte lane holds up to 255
        block = hashes[at: at + 255].byteswap().view(np.uint8).reshape(-1, 8)
        total += _LANES[block].sum(0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text in UTF-8."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    counts = bit_counts(np.array(hashes, np.uint64))
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, digest: bool = False) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long) for every row; ``digest`` adds the text's MD5."""
    kind = docs.schema[id].dataType.simpleString()
    more = [_digest(F.col(text)).alias("_md5")] * digest

    def task(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            raw = LOWER[data].tobytes()
            prints = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "fp", "_md5"][: len(columns)])

    return docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *more).mapInArrow(task, f"_id {kind}, fp bigint" + ", _md5 string" * digest)


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Array of ``struct<combination, key>``: every way to pick the blocks that a close pair must share."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    picks = []
    for n, chosen in enumerate(combinations(masks, blocks - distance)):
        mask = sum(chosen)
        picks.append(F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*picks)


def links(prints: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """Distinct pairs ``a < b`` of distinct fingerprints (column ``fp``) that differ in at most ``distance`` bits.

    Copies have collapsed before: only distinct fingerprints meet. More blocks give longer keys and
    more copies of each fingerprint: 7 for 4 bits means keys of 27 bits, 35 rows a fingerprint; from
    some 10**9 fingerprints on, take 9. The pair is verified in the join, so only links leave it.
    The planner takes the copies for as small as the table they come from, so a merge join is asked for.
    """
    if not distance < blocks <= 16:
        raise ValueError("there must be more blocks than bits that may differ, and at most 16")
    keyed = prints.select("fp", F.explode(_block_keys(F.col("fp"), distance, blocks)).alias("k")).select("fp", "k.n", "k.key")
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    same = (left["n"] == right["n"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b"))
    return left.join(right.hint("merge"), same & near).select("a", "b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of an edge list.

    Alternates large and small star steps: each links a node's neighbours to the smallest of them,
    so the edges become stars in a number of rounds that follows the logarithm of the nodes. Every
    round is a written table, which also cuts the lineage.
    """
    def fold(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a > b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    stars = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    before = state(stars)
    while before[0]:
        both = stars.union(stars.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = fold(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.*")
        stars = materialize(fold(small))
        after = state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def _rooted(prints: DataFrame, least: Column, distance: int, blocks: int) -> DataFrame:
    """``fp, _least, root`` of every distinct fingerprint: the smallest ``least`` of its rows and its component."""
    classes = materialize(prints.groupBy("fp").agg(F.min(least).alias("_least")))
    roots = components(links(classes, distance, blocks))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """``id, fingerprint`` (hex), ``component_id``: the smallest id of the texts reachable over links."""
    prints = materialize(fingerprints(docs, id, text, shingle))
    rooted = _rooted(prints, F.col("_id"), distance, blocks)
    named = materialize(rooted.groupBy("root").agg(F.min("_least").alias("component_id")))  # apart, so that a hot root can be split in the join
    classes = rooted.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select(F.col("_id").alias(id), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id, nulls last, and of those the one with the smallest MD5 of its text.

    So equal ids with texts of different groups stay once for each group, and a group of null ids
    only keeps one of them. Of rows with that id and text, any one stays.
    """
    prints = materialize(fingerprints(docs, id, text, shingle, digest=True))
    rooted = _rooted(prints, F.struct(F.col("_id").isNull().alias("_unnamed"), "_id", "_md5"), distance, blocks)
    chosen = materialize(rooted.groupBy("root").agg(F.min("_least").alias("_least")).select("_least._id", "_least._md5"))  # a text has one group, so no pair comes twice
    key = lambda i, digest: F.concat_ws("|", F.col(i).cast("string"), digest)  # noqa: E731  a null id leaves the digest alone
    chosen = chosen.select(key("_id", F.col("_md5")).alias("_key"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), key(id, _digest(F.col(text))).alias("_key"))
    kept = rows.join(chosen.hint("merge"), "_key", "left_semi")  # a key a group is too much for the driver
    return kept.groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")  # in the join's partitions
