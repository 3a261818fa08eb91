"""Search, joins and facets over the policy tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake import rules as R
from policylake.functions.geo import normalize_city, normalize_district, normalize_province, policy_geo
from policylake.operators.ordering import first_per_key, newest


def contains_text(c: Column | str, q: str) -> Column:
    """Case-insensitive substring test; the text of ``q`` is literal, null never matches."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))


def optional_filters(df: DataFrame, filters: Mapping[str, tuple[str | None, Callable[[str], Column]]]) -> DataFrame:
    """Apply each predicate whose parameter is non-blank: ``{name: (value, value -> predicate)}``."""
    for value, predicate in filters.values():
        if value is not None and str(value).strip() != "":
            df = df.filter(predicate(str(value).strip()))
    return df


def text_match(columns: Sequence[str], q: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_text(c, q) for c in columns])


def text_search(df: DataFrame, columns: Sequence[str], q: str | None) -> DataFrame:
    """Rows where any column contains ``q``; all rows for a blank ``q``."""
    return optional_filters(df, {"q": (q, lambda v: text_match(columns, v))})


# Where each geographic level looks for its value.
GEO_COLUMNS = {
    "province": ("jurisdiction_name", ("jurisdiction_name", "title")),
    "city": ("jurisdiction_city", ("jurisdiction_name", "title")),
    "district": ("jurisdiction_district", ("title",)),
}


def geo_match(level: str, value: str) -> Column:
    exact, partial = GEO_COLUMNS[level]
    return F.coalesce(F.col(exact) == value, F.lit(False)) | text_match(partial, value)


def geo_filter(df: DataFrame, level: str, value: str | None) -> DataFrame:
    """Exact value of the level's column, or contained in the name or title."""
    return optional_filters(df, {level: (value, lambda v: geo_match(level, v))})


def enum_filter(df: DataFrame, column: str, value: str | None, all_value: str | None = "all", null_as: str | None = None,
                allowed: Sequence[str] | None = None) -> DataFrame:
    """Equality; skipped for blank, ``all_value`` or a value outside ``allowed``."""
    if not value or value == all_value or (allowed is not None and value not in allowed):
        return df
    c = F.col(column) if null_as is None else F.coalesce(column, F.lit(null_as))
    return df.filter(c == value)


def evidence_match(evidence: DataFrame, q: str) -> DataFrame:
    """Policies with a quote containing ``q``: one row per policy, ``policy_id, evidence_hit``."""
    return evidence.filter(contains_text("quote", q)).select("policy_id").distinct().withColumn("evidence_hit", F.lit(True))


def policy_rules(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """policies left join rules on the policy id; rule columns that collide get the prefix ``rule_``."""
    clash = {c for c in rules.columns if c in policies.columns}
    side = rules.select(*[F.col(c).alias({"policy_id": "_pid"}.get(c, f"rule_{c}" if c in clash else c)) for c in rules.columns])
    return policies.join(side, F.col("id") == F.col("_pid"), "left").drop("_pid")


def first_evidence(evidence: DataFrame) -> DataFrame:
    """``policy_id, content_snippet``: quote of the earliest evidence row."""
    earliest = F.min_by("quote", F.struct("created_at", "id"))
    return evidence.groupBy("policy_id").agg(earliest.alias("content_snippet"))


def evidence_count(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("policy_id").agg(F.count("*").alias("evidence_count"))


def evidence_policies(evidence: DataFrame, policies: DataFrame, columns: Sequence[str] = ("title",)) -> DataFrame:
    """Evidence rows with columns of their policy."""
    side = policies.select(F.col("id").alias("policy_id"), *[F.col(c).alias(f"policy_{c}") for c in columns])
    return evidence.join(side, "policy_id")


def policy_contributions(policies: DataFrame, contributions: DataFrame, how: str = "inner", columns: Sequence[str] = ("status",)) -> DataFrame:
    """Policies with columns of their contribution (prefixed ``contribution_``)."""
    side = contributions.select(F.col("id").alias("contribution_id"), *[F.col(c).alias(f"contribution_{c}") for c in columns])
    return policies.join(side, "contribution_id", how)


def search_policies(policies: DataFrame, rules: DataFrame, evidence: DataFrame, q: str = "", category: str = "", province: str = "",
                    city: str = "", district: str = "", status: str = "active", verification: str = "", n: int | None = None) -> DataFrame:
    """Matching policies (with ``n`` the newest) with their rule and a content snippet.

    All cheap predicates are applied before any join and reach the scan; evidence is cut to the
    policies that are returned before snippets are folded.
    """
    base = enum_filter(policies, "status", status)
    base = enum_filter(base, "verification_status", verification, null_as="pending", allowed=("pending", "verified"))
    base = optional_filters(base, {
        "province": (province, lambda v: geo_match("province", v)),
        "city": (city, lambda v: geo_match("city", v)),
        "district": (district, lambda v: geo_match("district", v)),
    })
    joined = optional_filters(policy_rules(base, rules), {"category": (category, lambda v: contains_text("category", v))})
    if q.strip():
        hits = evidence_match(evidence, q.strip()).withColumnRenamed("policy_id", "id")
        joined = joined.join(hits, "id", "left").filter(
            text_match(("title", "issuer", "program", "source_url"), q.strip()) | F.col("evidence_hit").isNotNull()
        ).drop("evidence_hit")
    order = [F.col("updated_at").desc_nulls_last(), F.col("id").asc()]
    if "rule_id" in joined.columns:
        order.append(F.col("rule_id").asc())
    top = newest(joined, order, n)
    shown = evidence if n is None else evidence.join(top.select(F.col("id").alias("policy_id")).distinct(), "policy_id", "left_semi")
    return top.join(first_evidence(shown).withColumnRenamed("policy_id", "id"), "id", "left")


def normalized_geo_params(df: DataFrame, province: str, city: str, district: str) -> dict[str, Column]:
    """The normalised form of the three geo parameters (the given text where unknown)."""
    p = normalize_province(F.lit(province))
    return {
        "province": F.coalesce(F.nullif(p, F.lit("")), F.lit(province)),
        "city": F.coalesce(F.nullif(normalize_city(F.lit(city), p), F.lit("")), F.lit(city)),
        "district": F.coalesce(F.nullif(normalize_district(F.lit(district)), F.lit("")), F.lit(district)),
    }


def facets_of(pool: DataFrame, levels: Sequence[str], chosen: Mapping[str, str | Column | None]) -> DataFrame:
    """Cascading facets in long form: ``facet, value``.

    The values of a level are taken from the rows that satisfy the choices of all earlier
    levels. One pass over the pool: a row emits its values for the levels it qualifies for and
    one distinct removes repeats (map-side first).
    """
    passes: Column = F.lit(True)
    entries = []
    for level in levels:
        entries.append(F.when(passes & (F.coalesce(F.col(level), F.lit("")) != ""), F.struct(F.lit(level).alias("facet"), F.col(level).alias("value"))))
        choice = chosen.get(level)
        if choice is not None and not (isinstance(choice, str) and choice == ""):
            passes = passes & F.coalesce(F.col(level) == (F.lit(choice) if isinstance(choice, str) else choice), F.lit(False))
    return pool.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.facet", "e.value").distinct()


def facets(policies: DataFrame, rules: DataFrame, province: str = "", city: str = "", district: str = "", status: str = "active",
           verification: str = "") -> DataFrame:
    """Provinces, cities, districts and categories; search text and category do not narrow them."""
    pool = enum_filter(policies, "status", status)
    pool = enum_filter(pool, "verification_status", verification, null_as="pending", allowed=("pending", "verified"))
    pool = policy_rules(policy_geo(pool), rules.select("policy_id", "category"))  # geography once for each policy, not for each rule
    wanted = normalized_geo_params(pool, province, city, district)
    levels = pool.select(F.col("geo_province").alias("province"), F.col("geo_city").alias("city"), F.col("geo_district").alias("district"), "category")
    chosen = {k: wanted[k] if given else None for k, given in (("province", province), ("city", city), ("district", district))}
    return facets_of(levels, ("province", "city", "district", "category"), chosen)


def sources_docs_contribs(sources: DataFrame, documents: DataFrame, contributions: DataFrame, status: str = "approved") -> DataFrame:
    """sources left join documents left join contributions of one status (the test is part of the join)."""
    d = documents.select(F.col("source_id").alias("_sid"), F.col("id").alias("document_id"), F.col("created_at").alias("document_at"))
    c = contributions.filter(F.col("status") == status).select(F.col("document_id").alias("_did"), F.col("id").alias("contribution_id"))
    out = sources.join(d, sources["id"] == F.col("_sid"), "left").drop("_sid")
    return out.join(c, F.col("document_id") == F.col("_did"), "left").drop("_did")


def source_dashboard(sources: DataFrame, documents: DataFrame, contributions: DataFrame, status: str = "approved") -> DataFrame:
    """Per source: distinct documents, distinct approved contributions, newest document.

    Contributions are joined to documents by document and then folded per source, so the source
    side never fans out and a source with most of the documents only meets partial aggregates.
    """
    c = contributions.filter((F.col("status") == status) & F.col("document_id").isNotNull()).groupBy("document_id").agg(F.count_distinct("id").alias("_n"))
    d = documents.filter(F.col("source_id").isNotNull()).groupBy("id", "source_id").agg(F.max("created_at").alias("created_at"))
    per_doc = d.join(c, d["id"] == c["document_id"], "left")
    per_source = per_doc.groupBy("source_id").agg(
        F.count("*").alias("document_count"), F.coalesce(F.sum("_n"), F.lit(0)).alias("imported_count"), F.max("created_at").alias("last_document_at"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return sources.join(per_source, sources["id"] == per_source["source_id"], "left").select(
        *[sources[c] for c in sources.columns], zero("document_count"), zero("imported_count"), "last_document_at")


def comments_with_users(comments: DataFrame, users: DataFrame) -> DataFrame:
    return comments.join(users.select(F.col("id").alias("user_id"), "display_name"), "user_id")


def timeline(events: DataFrame, users: DataFrame, entity_type: str | None = None, entity_id: str | None = None, n: int | None = None) -> DataFrame:
    """Events, with ``n`` the newest ones (of one entity), with the actor's name; names are joined after the limit."""
    kept = optional_filters(events, {
        "type": (entity_type, lambda v: F.col("entity_type") == v), "id": (entity_id, lambda v: F.col("entity_id") == v),
    })
    top = newest(kept, [F.col("created_at").desc_nulls_last(), F.col("id").asc()], n)
    return top.join(users.select(F.col("id").alias("actor_id"), "display_name"), "actor_id", "left")


def invites_with_users(invites: DataFrame, users: DataFrame) -> DataFrame:
    """Invites with the names of the user who redeemed and the user who created them."""
    used = users.select(F.col("id").alias("used_by"), F.col("display_name").alias("used_by_name"))
    made = users.select(F.col("id").alias("created_by"), F.col("display_name").alias("created_by_name"))
    return invites.join(used, "used_by", "left").join(made, "created_by", "left")


def contribution_detail(contributions: DataFrame, comments: DataFrame, events: DataFrame, users: DataFrame, n_events: int | None = None) -> DataFrame:
    """All comments (oldest first) and all, or the newest ``n_events``, events of each contribution, in long form.

    ``id, kind, seq_at, item_id, body, user_name``: nesting would collect a whole thread into
    one row, so the caller sorts by ``kind, seq_at`` instead. The event cap is a rank filter that
    Spark applies on the map side first.
    """
    ids = contributions.select("id")
    said = comments.select(F.col("contribution_id").alias("id"), F.lit("comment").alias("kind"), F.col("created_at").alias("seq_at"),
                           F.col("id").alias("item_id"), "body", "user_id")
    recent = Window.partitionBy("entity_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").asc())
    seen = events.filter(F.col("entity_type") == "contribution")
    if n_events is not None:
        seen = seen.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= n_events)
    seen = seen.select(F.col("entity_id").alias("id"), F.lit("event").alias("kind"), F.col("created_at").alias("seq_at"),
                       F.col("id").alias("item_id"), F.col("action").alias("body"), F.col("actor_id").alias("user_id"))
    names = users.select(F.col("id").alias("user_id"), F.col("display_name").alias("user_name"))
    said = said.join(names, "user_id").join(ids, "id", "left_semi")
    seen = seen.join(names, "user_id", "left").join(ids, "id", "left_semi")
    return said.unionByName(seen).drop("user_id")


def visible_contributions(contributions: DataFrame, viewer_id: str, viewer_role: str) -> DataFrame:
    """Reviewers and admins see all rows, others their own and those past the draft stage."""
    if viewer_role in ("admin", "reviewer"):
        return contributions
    return contributions.filter((F.col("user_id") == viewer_id) | F.col("status").isin(*R.VISIBLE_STATUSES))


def pending_queue(contributions: DataFrame, text: str = "") -> DataFrame:
    return text_search(contributions.filter(F.col("status").isin(*R.PENDING_STATUSES)), ("title",), text)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``, first row per key within the batch."""
    order = order or [F.struct(*[c for c in new.columns if c not in keys])]
    rest = [c for c in new.columns if c not in keys]
    fresh = first_per_key(new, keys, order, rest) if rest else new.select(*keys).distinct()
    return fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def first_by_title(policies: DataFrame, patterns: Sequence[str], jurisdiction: str = R.NATIONAL) -> DataFrame:
    """For each title fragment the oldest policy of the jurisdiction whose title contains it."""
    hits = F.array_compact(F.array(*[F.when(contains_text("title", p), F.lit(p)) for p in patterns]))
    rows = policies.filter(F.col("jurisdiction_name") == jurisdiction).withColumn("pattern", F.explode(hits))
    return first_per_key(rows, ["pattern"], [F.col("created_at"), F.col("id")], ["id", "title", "created_at"])


def union_with_default(a: DataFrame, b: DataFrame, literal: DataFrame, key: str) -> DataFrame:
    """Union of both groups plus the literal rows whose key occurs in neither."""
    both = a.unionByName(b)
    return both.unionByName(literal.join(both.select(key).distinct(), key, "left_anti").select(*both.columns))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values."""
    return df.select(column).filter(F.coalesce(F.col(column), F.lit("")) != "").distinct()


def order_statistics(aggregates: DataFrame) -> DataFrame:
    return aggregates.orderBy(F.col("as_of_date").desc_nulls_last(), F.col("metric_type").asc_nulls_first())
