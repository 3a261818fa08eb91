"""End-to-end plans: pages or files to scored documents, links and policy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.functions.extract import extract_fields, infer_title
from policylake.functions.text import clean_text
from policylake.functions.relevance import DEFAULT, Vocabulary, score_relevance
from policylake.operators.imports import import_documents
from policylake.operators.links import candidate_links
from policylake.sources.html import inner_text, page_links, page_titles
from policylake.streaming.documents import recognise


def scored_documents(documents: DataFrame, text: str = "text", vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Title and relevance of plain-text documents: scan and project, no exchange on a large input."""
    none = F.lit(None).cast("string")
    titled = documents.withColumn("title", infer_title(F.col(text), none, none, none)["value"])
    return score_relevance(titled, text, "title", vocabulary)


def level_histogram(scored: DataFrame) -> DataFrame:
    """Documents, related documents and summed score tenths per relevance level."""
    tenths = F.round(F.col("relevance.score") * 10).cast("bigint")
    return scored.groupBy(F.col("relevance.level").alias("level")).agg(
        F.count("*").alias("documents"), F.count_if("relevance.is_related").alias("related"), F.sum(tenths).alias("score_tenths"))


def recognise_pages(pages: DataFrame, url: str = "url", html: str = "html", vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Pages to extracted and scored documents with crawl candidates, wholly in the JVM."""
    df = page_titles(pages, html).withColumnRenamed("title", "page_title")
    df = df.withColumn("text", clean_text(inner_text(F.col(html))))
    df = extract_fields(df, "text", heading=F.col("heading"), title=F.col("page_title"))
    df = df.withColumn("links", page_links(html)).drop(html)
    df = df.withColumn("candidates", candidate_links(F.col("links"), F.col(url)))
    return score_relevance(df, "text", "title", vocabulary)


def files_to_policies(files: DataFrame, existing: DataFrame, as_of: str, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw files to the four policy tables, duplicates, rejects and audit events."""
    web = F.when(F.col("path").rlike("^https?://"), F.col("path"))  # an uploaded file has no URL
    docs = recognise(files).select(
        F.col("content_hash").alias("id"), web.alias("url"), web.alias("canonical_url"), F.col("page_title").alias("document_title"),
        F.col("modificationTime").alias("created_at"), "*")
    return import_documents(docs, overrides, existing, as_of)
