"""Shards by jump consistent hashing: a stable key and the number of shards decide, without a table.

With one more shard a row either stays or moves to the new one. Slots number the rows of a shard
without gaps: blocks of a shard (a hash of key and text) are numbered by themselves and start where
the blocks before them end, so no task sees a whole shard, nor all rows of one key. Rows that are
equal in key, size and checksum are counted first and numbered as one run.

Defined cases: a null key counts as the empty string; null texts have no bytes; equal keys land in
one shard, and their rows are told apart by text only for the order of slots; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 4096  # equal rows that are numbered from one array
STEP = np.uint64(2862933555777941757)  # fixed value: the generator of the published method


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; every key jumps ahead until it would pass the last shard."""
    state, shard = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    at, ahead = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(at):
        shard[at] = ahead
        state[at] = state[at] * STEP + np.uint64(1)
        ahead = ((shard[at] + 1) * (2.0**31 / ((state[at] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        more = ahead < shards
        at, ahead = at[more], ahead[more]
    return shard.astype(np.int32)


def stable_key(key: Column) -> Column:
    """64 bits of the MD5 of a key's string, as a signed long: equal in every run and engine."""
    hexed = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(hexed, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return jump(key)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, block_rows: int = 100_000) -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` of every row (``grown_shard``: with one more)."""
    if shards < 1:
        raise ValueError("at least one shard")
    blocks = max(1, -(-docs.count() // (shards * block_rows)) * 2)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    runs = rows.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("_n")).withColumn("_hash", stable_key(F.col("_key")))
    runs = runs.withColumns({"shard": shard_of(F.col("_hash"), shards), "grown_shard": shard_of(F.col("_hash"), shards + 1), "_block": F.pmod(F.xxhash64("_hash", "text_crc32", "size"), F.lit(blocks))})
    sizes = runs.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_block").orderBy("_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, ["shard", "_block"])
    pieces = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / RUN))))
    numbered = pieces.withColumn("_row", F.explode(F.sequence(F.col("_piece") * RUN, F.least(F.col("_n"), (F.col("_piece") + 1) * RUN) - 1)))
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_before") + F.col("_at") + F.col("_row")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files: int = 1) -> None:
    """All columns of ``docs`` as Parquet, a folder for each shard with about ``files`` files, by key."""
    split = F.pmod(F.xxhash64(stable_key(F.col(key))), F.lit(files))
    out = docs.withColumn("shard", shard_of(stable_key(F.col(key)), shards))
    out.repartition(shards * files, "shard", split).sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)
