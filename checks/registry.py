"""Registry of queries and their SQL, table access and the SQL spelling of shared idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.functions.text import WHITESPACE, WS

TEXT_TABLES = ("documents", "pages")  # few, heavy rows: worth all cores even when one split holds them
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is what DuckDB runs on the same tables."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row-wise heavy work on the test tables, which lie in fewer files than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def write_files(rows: DataFrame, column: str, path: str, per_folder: int = 1000) -> None:
    """Each row's text as a file of its own below ``path``, ``per_folder`` files in a folder; a folder for each file would cost as much as the file."""
    folder = F.floor(F.monotonically_increasing_id() / per_folder)
    files = rows.select(column, folder.alias("folder")).write.option("maxRecordsPerFile", 1)
    files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder").text(path)  # tasks place their files, not the driver


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def any_contains(c: str, items) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(i)})" for i in items) + ")"


def sql_strip(c: str) -> str:
    return f"trim({c}, {quoted(WHITESPACE)})"


def sql_clean(c: str) -> str:
    inner = f"regexp_replace(replace({c}, '　', ' '), '[ \t]+', ' ', 'g')"
    return sql_strip(f"regexp_replace({inner}, '\n{{3,}}', '\n\n', 'g')")


def sql_compact(c: str, limit: int | None = None) -> str:
    line = f"replace({sql_clean(c)}, '\n', ' ')"
    return line if limit is None else f"substr({line}, 1, {limit})"


def sql_squeeze(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {quoted(WS + '+')}, '', 'g')"


def sql_normalize(c: str) -> str:
    spaced = f"regexp_replace(coalesce({c}, ''), {quoted(WS + '+')}, ' ', 'g')"
    return sql_strip(f"translate({spaced}, '“”‘’', '\"\"''''')")


def sql_group(c: str, pattern: str, index: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {quoted(pattern)}, {index}), '')"


def sql_unescape(c: str) -> str:
    """Character references of the test pages, each once."""
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "copy": "©", "middot": "·"}
    number = lambda pattern, prefix: f"WHEN regexp_matches(p, '^{pattern};') THEN concat(chr(TRY_CAST(concat('{prefix}', regexp_extract(p, '^{pattern};', 1)) AS INTEGER)), substr(p, strpos(p, ';') + 1))"
    named = " ".join(f"WHEN starts_with(p, '{n};') THEN concat({quoted(x)}, substr(p, {len(n) + 2}))" for n, x in names.items())
    piece = f"CASE {number('#([0-9]+)', '')} {number('#[xX]([0-9A-Fa-f]+)', '0x')} {named} ELSE concat('&', p) END"
    return f"concat(string_split({c}, '&')[1], array_to_string(list_transform(string_split({c}, '&')[2:], lambda p: {piece}), ''))"


def sql_first_keyword(c: str, rules, before: int, after: int) -> tuple[str, str]:
    """Label and quote window of the first rule and keyword that occurs."""
    label, quote = [], []
    for rule in rules:
        for kw in rule.keywords:
            test = f"WHEN contains({c}, {quoted(kw)}) THEN"
            at = f"strpos({c}, {quoted(kw)})"
            label.append(f"{test} {quoted(rule.label)}")
            quote.append(f"{test} substr({c}, greatest({at} - {before}, 1), {at} - greatest({at} - {before}, 1) + {len(kw)} + {after})")
    return "CASE " + " ".join(label) + " END", "CASE " + " ".join(quote) + " END"
