"""Content and dedup keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake.functions.text import col, let, squeeze, straight_quotes


def content_hash(c: Column | str) -> Column:
    """sha256 hex of bytes or text."""
    return F.sha2(col(c), 256)


def dedup_key(*parts: Column | str) -> Column:
    """sha256 of the non-blank parts, white space removed and lower-cased; '' below two parts."""
    # removing all white space makes the trimming and collapsing of normalize_text redundant
    cleaned = F.array(*[F.lower(squeeze(straight_quotes(p))) for p in parts])
    kept = F.filter(cleaned, lambda x: x != "")
    return let(kept, lambda k: F.when(F.size(k) < 2, "").otherwise(F.sha2(F.array_join(k, "|"), 256)))


def derived_id(*parts: Column | str) -> Column:
    """Deterministic row id from a natural key, stable across reruns and lost executors."""
    return F.sha2(F.concat_ws("\x1f", *[col(p).cast("string") for p in parts]), 256)
