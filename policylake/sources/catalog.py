"""Catalog views: table counts, previews and guarded ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_counts(tables: Mapping[str, DataFrame], labels: Mapping[str, str] | None = None) -> DataFrame:
    """``name, label, row_count`` of each table, by name. Columnar scans read no columns."""
    labels = labels or {}
    rows = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), F.lit(labels.get(name, "")).alias("label"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows).orderBy("name")


def preview(tables: Mapping[str, DataFrame], name: str, n: int) -> DataFrame:
    """First ``n`` (at least one) rows of a known table."""
    if name not in tables:
        raise ValueError(f"unknown table: {name}")
    return tables[name].limit(max(1, n))


def run_readonly_sql(spark: SparkSession, statement: str, n: int | None = None) -> DataFrame:
    """Result (with ``n`` its first rows) of a SELECT or WITH statement; anything else is refused.

    A statement that may also stand as a subquery is a query: WITH before INSERT is none.
    """
    text = statement.strip().rstrip(";")
    if not text.lower().startswith(("select", "with")) or ";" in text:
        raise ValueError("only one SELECT or WITH statement is allowed")
    try:
        spark.sql(f"SELECT 1 FROM (\n{text}\n) WHERE false")
    except ParseException as error:
        raise ValueError("only queries are allowed") from error
    out = spark.sql(text)
    return out if n is None else out.limit(max(1, n))


def register(tables: Mapping[str, DataFrame]) -> None:
    """Temporary views for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
