"""Data packs, bulk imports and line dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake import schemas as S
from policylake.functions.text import strip
from policylake.operators.ordering import number_rows

# Bulk import columns; numbers and flags keep 0 and false, texts skip blanks.
TEXT_COLUMNS = """
title program policy_level issuer funding_source official_file_name doc_no description end_note document_type
jurisdiction_code jurisdiction_name jurisdiction_city jurisdiction_district category amount_type cap_unit
rule_text rule_type conditions_text effective_from effective_to source_url notes
""".split()
VALUE_COLUMNS = "amount_value rate cap_amount threshold_amount discount_amount per_user_limit stackable".split()


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(p.capitalize() for p in tail)


def accept_aliases(rows: DataFrame) -> DataFrame:
    """Bulk rows with camelCase or snake_case names to snake_case columns (camelCase wins)."""
    have = set(rows.columns)

    def pick(name: str, skip_blank: bool) -> Column:
        options = []
        for alias in dict.fromkeys((_camel(name), name)):
            if alias in have:
                value = F.col(f"`{alias}`").cast("string")
                options.append(F.nullif(value, F.lit("")) if skip_blank else value)
        return F.coalesce(*options, F.lit(None).cast("string")).alias(name)

    return rows.select(*[pick(n, True) for n in TEXT_COLUMNS], *[pick(n, False) for n in VALUE_COLUMNS])


def read_contributions(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Bulk rows from JSON (array or object) or CSV with trimmed headers and cells."""
    if fmt == "json":
        rows = spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(path)
    elif fmt == "csv":
        rows = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
        rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
        rows = rows.withColumns({c: strip(F.col(f"`{c}`")) for c in rows.columns})
    else:
        raise ValueError("only json and csv are supported")
    return accept_aliases(rows)


def read_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Manifest, sources, policies and aggregates of a pack folder.

    File names come from the manifest (one small row); missing entries use the default names.
    """
    read = lambda name, schema: spark.read.schema(schema).option("multiLine", "true").json(f"{path.rstrip('/')}/{name}")
    manifest = read("manifest.json", S.PACK_MANIFEST)
    files = manifest.select("files.sources", "files.policies", "files.aggregates").first() or (None, None, None)
    return {
        "manifest": manifest,
        "sources": read(files[0] or "sources.json", S.PACK_SOURCE),
        "policies": read(files[1] or "policies.json", S.PACK_POLICY),
        "aggregates": read(files[2] or "aggregates.json", S.PACK_AGGREGATE),
    }


def lines_to_records(lines: DataFrame, names: Sequence[str], group: Sequence[str] = (), order: str = "line_no",
                     value: str = "line", block: int = 100_000) -> DataFrame:
    """Fixed-width chunks of non-blank lines to one row each; an incomplete tail is dropped.

    ``order`` numbers the lines of a ``group`` (any increasing integers). Lines are numbered in
    blocks, so a group holding most of the lines is spread over many tasks.
    """
    width = len(names)
    kept = lines.select(*group, F.col(order).alias("_at"), strip(value).alias("_v")).filter(F.col("_v") != "")
    numbered = number_rows(kept, group, "_at", block=block, out="_n")
    cells = numbered.select(*group, F.floor((F.col("_n") - 1) / width).alias("record_no"), ((F.col("_n") - 1) % width).alias("_i"), "_v")
    picks = [F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)]
    rows = cells.groupBy(*group, "record_no").agg(F.count("*").alias("_c"), *picks)
    return rows.filter(F.col("_c") == width).drop("_c")


def split_header_groups(lines: DataFrame, header: str = "ID", order: str = "line_no", value: str = "line") -> DataFrame:
    """Adds ``section``: 1 up to the second header line, 2 from there on; blank lines are dropped."""
    kept = lines.filter(strip(value) != "")
    start = kept.agg(F.min(order)).scalar()
    cut = kept.filter((strip(value) == header) & (F.col(order) > start)).agg(F.min(order)).scalar()
    return kept.withColumn("section", F.when(F.col(order) >= cut, 2).otherwise(1))
