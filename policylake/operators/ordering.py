"""Ordering, numbering and lookups that keep working when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def newest(df: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """``orderBy`` with an optional limit; with a limit each task keeps only its own top n."""
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


def order_by_first(df: DataFrame, columns: Sequence[str], n: int | None = None, tie: str = "id") -> DataFrame:
    """Ascending by the first non-null of ``columns``."""
    return newest(df, [F.coalesce(*columns).asc_nulls_first(), F.col(tie).asc()], n)


def locale_sort(df: DataFrame, column: str, locale: str = "zh") -> DataFrame:
    """Order by the collation of a locale (pinyin for zh)."""
    return df.orderBy(F.collate(F.col(column), locale))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of the smallest row per key: a partial aggregate, not a window.

    Every task sends one row per key, whatever the size of the group.
    """
    ranked = df.select(*key, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), F.struct(*keep).alias("_k"))
    return ranked.groupBy(*key).agg(F.min_by("_k", "_o").alias("_k")).select(*key, "_k.*")


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", spread: Sequence[str] = (),
              hot_rows: int = HOT_ROWS, keys_from: DataFrame | None = None) -> DataFrame:
    """Join a fact side to a side with at most one row per key, with hot keys salted.

    Keys with more than ``hot_rows`` rows are counted first and get one salt for each ``hot_rows``
    rows: their rows are spread by a hash of ``spread`` (deterministic, so a lost task recomputes
    the same rows) and the one matching row is repeated per salt. Rows with a null key match
    nothing and are spread over all tasks. Other keys join as usual. ``keys_from`` is a cheaper
    frame with the same keys to count (by default ``big`` itself); whether the list of hot keys is
    broadcast is left to the planner, which knows its size.
    """
    on = list(on)
    counted = (big if keys_from is None else keys_from).groupBy(*on).count().filter(F.col("count") > hot_rows)
    hot = counted.select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    spread_by = F.xxhash64(*[F.col(c) for c in (spread or [c for c in big.columns if c not in on])])
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    left = big.join(hot, on, "left")
    salt = F.when(blank, spread_by).when(F.col("_salts").isNotNull(), F.pmod(spread_by, F.col("_salts").cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    left = left.withColumn("_salt", salt).drop("_salts")
    right = small.join(hot, on, "left")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint") - 1)
    right = right.withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, on + ["_salt"], how).drop("_salt")


def number_rows(df: DataFrame, group: Sequence[str], order: str, block: int = 100_000, out: str = "row_no") -> DataFrame:
    """1-based position of each row in its group, ordered by a unique integer column.

    Two levels: rows are numbered inside blocks of the order column, and blocks get the number
    of rows before them. A group of any size is spread over its blocks; the second level sees
    one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy(*group, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    numbered = blocked.withColumn("_at_block", F.row_number().over(inside))
    joined = numbered.join(offsets, [*group, "_block"])
    return joined.withColumn(out, F.col("_before") + F.col("_at_block")).drop("_block", "_before", "_at_block")
