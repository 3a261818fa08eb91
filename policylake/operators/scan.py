"""Prefix scans over long ordered groups: equal blocks in order, a summary of each, what earlier blocks hand over.

A scan (running counts, maxima, states) over one key's rows needs no task that sees all of them:
``in_blocks`` cuts the rows, ordered by key and order columns, into blocks of about equal size, wherever
keys begin or end; a key with most of the rows has most of the blocks. Work inside a block knows what
came before from ``carried``, which looks at one row for each key and block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.session import materialize

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``_block``: ascending along keys and order; written once, so that every reader sees the same cuts.

    By default as many blocks as ``spark.sql.shuffle.partitions``. Rows that agree in all the columns are
    in one block, so ``order`` should tell rows apart.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn(BLOCK, F.spark_partition_id()))


def within(keys: Sequence[str], order: Sequence[str]):
    """Window over one key's rows of one block."""
    return Window.partitionBy(BLOCK, *keys).orderBy(*order)


def carried(df: DataFrame, keys: Sequence[str], summary: Sequence[Column], *steps: Callable[..., dict[str, Column]]) -> DataFrame:
    """One row for each key and block: what ``steps`` make of the ``summary`` of earlier blocks.

    A step gets the window over a key's earlier blocks and returns named columns; later steps may use
    the columns of earlier ones.
    """
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    out, names = df.groupBy(*keys, BLOCK).agg(*summary), []
    for step in steps:
        made = step(earlier)
        out, names = out.withColumns(made), [*names, *made]
    return out.select(*keys, BLOCK, *names)


def with_carried(df: DataFrame, hand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``hand`` for its key (null is a key like others) and block."""
    on = [*keys, BLOCK]
    named = hand.select(*[F.col(c).alias(f"_hand_{c}") for c in on], *[c for c in hand.columns if c not in on])
    return df.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hand_{c}")) for c in on]), "left").drop(*[f"_hand_{c}" for c in on])
