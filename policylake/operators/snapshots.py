"""Snapshot tables on disk: laid out by hash of the key, so that a change rewrites only what it touches.

``merge`` finds the buckets of the changed keys, reads and joins only their partitions (the scan is
pruned) and replaces them by dynamic partition overwrite. The merged rows are written before the
first bucket is replaced, so no job reads what it overwrites, and a merge that broke off is made good
by running it again: the rules of ``merge_snapshot`` give the same rows twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.operators.merge import merge_snapshot
from policylake.session import materialize, path_exists

BUCKET, PREFIX = "_bucket", "_prefix"


@dataclass(frozen=True)
class SnapshotTable:
    """A table of unique ``keys`` in ``path``; the number of buckets is that of the first write."""

    path: str
    keys: Sequence[str]
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def create(self, rows: DataFrame) -> None:
        rows.select("*", self._bucket()).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def part(self, spark: SparkSession, buckets: Sequence[int]) -> DataFrame:
        """The rows of some buckets; the others are not listed as files of the scan."""
        return spark.read.parquet(self.path).filter(F.col(BUCKET).isin(*buckets)).drop(BUCKET)

    def merge(self, changes: DataFrame, rules: Mapping[str, str] | None = None, default: str = "overwrite", insert: bool = True) -> list[int]:
        """Apply ``changes`` (unique keys) as ``merge_snapshot`` does; returns the buckets that were rewritten."""
        spark = changes.sparkSession
        changes = materialize(changes.select("*", self._bucket()))
        touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())  # numbers below ``buckets``
        if touched:
            merged = merge_snapshot(self.part(spark, touched), changes.drop(BUCKET), list(self.keys), rules, default, insert)
            staged = materialize(merged.select("*", self._bucket()))
            staged.repartition(F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return touched


def store_new(rows: DataFrame, path: str, hash_col: str = "hash") -> DataFrame:
    """Append the rows of unique ``hash_col`` that the content-addressed store in ``path`` doesn't hold; returns the store.

    Rows lie in partitions of the hash's first two digits. Only hashes of the partitions in question
    are read, and only new ones written: storing twice, or again after a failure, changes nothing.
    """
    spark = rows.sparkSession
    staged = materialize(rows.withColumn(PREFIX, F.substring(hash_col, 1, 2)))
    fresh = staged
    if path_exists(spark, path):
        prefixes = [r[0] for r in staged.select(PREFIX).distinct().collect()]  # 256 at most
        stored = spark.read.schema(staged.schema).parquet(path).filter(F.col(PREFIX).isin(*prefixes))
        fresh = staged.join(stored.select(hash_col), hash_col, "left_anti").select(staged.columns)
    materialize(fresh).repartition(F.col(PREFIX)).write.mode("append").partitionBy(PREFIX).parquet(path)
    return spark.read.schema(staged.schema).parquet(path).drop(PREFIX)
