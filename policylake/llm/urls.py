"""URL rules by hashed expressions: host suffixes with path prefixes, short digests, then full ones.

A rule is a host and the start of a path; it fits its host and all subdomains. Every URL is expanded
into expressions ``host suffix + path prefix``, for the shapes (host labels, path characters) that
occur in the rules. Expressions meet the rules on a short prefix of their SHA-256, as a list of
short hashes can be shared and searched cheaply; full digests confirm. The longest rule wins, then
the longer host, then block over allow.

Defined cases: null, empty and scheme-less URLs have an empty host and path and get the default
verdict; equal URLs are judged once; every row comes back, repeated ones as often as they come;
empty tables of pages or rules are fine; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def expressions(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """Host suffixes of so many labels with path prefixes of so many characters."""
    size = F.size(F.split(host, r"\.", -1))
    made = [F.when((size >= labels) & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars))) for labels, chars in shapes]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """``id, host, path, rule, verdict`` of every row; ``short``: hex digits of the digest prefix."""
    rules = rules.filter(F.coalesce("host", F.lit("")) != "").select(F.col("verdict").alias("_verdict"), F.lower("host").alias("_host"), F.coalesce("path", F.lit("")).alias("_path")).distinct()
    shape = rules.select(F.size(F.split("_host", r"\.", -1)).alias("labels"), F.length("_path").alias("chars")).distinct()
    shapes = sorted(tuple(r) for r in shape.collect())  # at most host labels x path lengths, never one per rule
    rules = rules.withColumn("_rule", F.concat("_host", "_path"))
    rules = rules.withColumn("_digest", F.sha2("_rule", 256)).withColumn("_short", F.substring("_digest", 1, short))
    rows = pages.select(F.col(id).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = rows.select("_url").distinct().select("_url", host.alias("host"), path.alias("path"))
    exploded = urls.select("_url", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("e"))
    hashed = exploded.select("_url", F.sha2("e", 256).alias("d")).withColumn("s", F.substring("d", 1, short))
    met = hashed.join(rules, F.col("s") == F.col("_short")).filter(F.col("d") == F.col("_digest"))
    rank = F.struct(F.length("_rule"), F.length("_host"), F.col("_verdict") == "block")
    best = met.groupBy("_url").agg(F.max_by(F.struct("_rule", "_verdict"), rank).alias("b"))
    judged = urls.join(best, "_url", "left").select("_url", "host", "path", F.col("b._rule").alias("rule"), F.coalesce("b._verdict", F.lit(default)).alias("verdict"))
    return rows.join(judged, "_url").select(F.col("_id").alias(id), "host", "path", "rule", "verdict")
