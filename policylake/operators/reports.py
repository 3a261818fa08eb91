"""Counts, profiles and quality reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.text import coverage, format_metric, metric_label
from policylake.operators.search import evidence_count


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("row_count"))


def global_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def active_sources(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(F.count_if(F.col("document_count") > 0).alias("active_sources"))


def readiness_counts(users: DataFrame, invites: DataFrame, policies: DataFrame, sources: DataFrame) -> DataFrame:
    """Active users, active admins, unused invites, policies and sources as one row."""
    active = users.filter(F.col("status") == "active")
    return global_counts({
        "active_users": active, "active_admins": active.filter(F.col("role") == "admin"),
        "unused_invites": invites.filter(F.col("used_by").isNull() & ~F.col("disabled")), "policies": policies, "sources": sources,
    })


def outcome_counts(results: DataFrame, column: str = "outcome") -> DataFrame:
    return count_by(results, column)


def status_overview(contributions: DataFrame) -> DataFrame:
    return count_by(contributions, "status")


def recent(contributions: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` contributions that have an author, with the author's name."""
    names = users.select(F.col("id").alias("user_id"), "display_name")
    return contributions.join(names, "user_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id")).limit(n)


def _entry(section: str | Column, metric: str | Column, count: bool | Column = True) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    body = F.struct(lit(section).alias("section"), lit(metric).alias("metric"))
    return body if count is True else F.when(count, body)


def _count_entries(df: DataFrame, entries: list[Column]) -> DataFrame:
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.section", "e.metric")
    return rows.groupBy("section", "metric").agg(F.count("*").cast("double").alias("value"))


def document_profile(documents: DataFrame) -> DataFrame:
    """``section, metric, value`` over ``document_type, is_related, importable, evidence_n``.

    One scan and one aggregate for all metrics.
    """
    kind = F.coalesce(F.nullif("document_type", F.lit("")), F.lit("unknown"))
    related = F.coalesce(F.col("is_related"), F.lit(False))
    return _count_entries(documents, [
        _entry("documents", "total"), _entry("document_types", kind), _entry("documents", "related", related),
        _entry("documents", "importable", F.coalesce(F.col("importable"), F.lit(False))),
        _entry("documents", "with_evidence", F.coalesce(F.col("evidence_n"), F.lit(0)) > 0),
        _entry("documents", "risky_but_related", related & kind.isin("news", "interpretation", "listing")),
    ])


def policy_profile(policies: DataFrame) -> DataFrame:
    """Histograms of policies in long form."""
    kind = F.coalesce(F.nullif("document_type", F.lit("")), F.lit("unknown"))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    verification = F.coalesce(F.nullif("verification_status", F.lit("")), F.lit("pending"))
    return _count_entries(policies, [
        _entry("policies", "total"), _entry("statuses", status), _entry("verification", verification), _entry("policy_types", kind),
        _entry("active_policy_types", kind, status == "active"), _entry("superseded_policy_types", kind, status == "superseded"),
    ])


def missing_counts(policies: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Policies without evidence, amount rule, either date, province, category or URL, as one row."""
    # a policy may have several rules: every rule row counts, the URL counts once per policy
    p = policies.withColumnRenamed("id", "policy_id")
    per_row = p.join(rules.select("policy_id", "category", "rate", "fixed_amount", "cap_amount", "rule_text"), "policy_id", "left")
    per_row = per_row.join(evidence_count(evidence), "policy_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    no_amount = F.col("rate").isNull() & F.col("fixed_amount").isNull() & F.col("cap_amount").isNull() & blank("rule_text")
    out = per_row.agg(
        F.count_if(F.coalesce("evidence_count", F.lit(0)) == 0).alias("evidence"), F.count_if(no_amount).alias("amount_rule"),
        F.count_if(blank("effective_from") | blank("effective_to")).alias("dates"), F.count_if(blank("jurisdiction_name")).alias("province"),
        F.count_if(blank("category")).alias("category"),
    )
    urls = policies.agg(F.count_if(blank("source_url"))).scalar()
    return out.withColumn("official_url", urls)


def recognition_report(documents: DataFrame, policies: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """The whole quality report in long form ``section, metric, value``."""
    docs = document_profile(documents)
    ratio = docs.filter("section = 'documents'").agg(
        F.max(F.when(F.col("metric") == "with_evidence", F.col("value"))).alias("a"), F.max(F.when(F.col("metric") == "total", F.col("value"))).alias("n"),
    ).select(F.lit("documents").alias("section"), F.lit("evidence_coverage").alias("metric"),
             coverage(F.coalesce("a", F.lit(0.0)), F.coalesce("n", F.lit(0.0))).alias("value"))
    missing = missing_counts(policies, rules, evidence)
    names = missing.columns
    stacked = missing.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("e"))
    stacked = stacked.select(F.lit("missing").alias("section"), "e.metric", "e.value")
    return reduce(DataFrame.unionByName, [docs, ratio, policy_profile(policies), stacked])


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per section: the report has a few dozen rows by construction."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    report.groupBy("section").agg(pairs.alias("metrics")).coalesce(1).write.mode("overwrite").json(path)


def display_statistics(aggregates: DataFrame) -> DataFrame:
    """Adds the display text and label of each published statistic.

    The measures are never added up: allocated, disbursed and sales amounts differ in kind.
    """
    return aggregates.withColumns({
        "display_value": format_metric(F.col("metric_type"), F.col("amount_yuan"), F.col("count_value")),
        "display_label": metric_label(F.col("metric_type")),
    })
