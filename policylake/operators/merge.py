"""Snapshot merges: every change is a function from the current and changed rows to a new table.

Parquet has no row updates, so a mutation is one join on the (unique) key plus an audit frame.
Nothing here writes; callers write the returned snapshot to a new folder and switch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake import rules as R
from policylake.functions.extract import classify_title
from policylake.functions.geo import corrected_jurisdiction, infer_geo
from policylake.functions.keys import dedup_key, derived_id
from policylake.functions.relevance import DEFAULT, Vocabulary, score_relevance
from policylake.functions.text import NUMBER, REDUCTION_HINT, WS, first_text, has_word, policy_status, rule_type
from policylake.functions.urls import normalize_url, url_host
from policylake.operators.ordering import HOT_ROWS, first_per_key, skew_join
from policylake.operators.scan import carried, in_blocks, with_carried, within
from policylake.operators.search import first_by_title
from policylake.operators.validation import split_valid, validate_contributions
from policylake.session import materialize


def merge_snapshot(current: DataFrame, changes: DataFrame, key: str | Sequence[str], rules: Mapping[str, str] | None = None,
                   default: str = "overwrite", insert: bool = True) -> DataFrame:
    """New snapshot from rows keyed uniquely on both sides.

    Rules per column: ``keep`` the current value, ``overwrite`` with the change (null too),
    ``fill_if_blank`` only null or '' targets, ``patch_if_present`` when the change is not null.
    Columns missing from ``changes`` are kept; with ``insert`` unknown keys become new rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rules = rules or {}
    cur = current.withColumn("_old", F.lit(True))
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c not in keys], F.lit(True).alias("_new"))
    joined = cur.join(new, keys, "full_outer" if insert else "left")
    out = []
    for c in current.columns:
        if c in keys or c not in changes.columns:
            out.append(F.col(c))
            continue
        old, change, kind = F.col(c), F.col(f"_n_{c}"), current.schema[c].dataType
        change = change.cast(kind)
        rule = rules.get(c, default)
        if rule == "keep":
            merged = F.when(F.col("_old").isNull(), change).otherwise(old)
        elif rule == "fill_if_blank":
            empty = old.isNull() | (old.cast("string") == "")
            filled = change.isNotNull() & (change.cast("string") != "")
            merged = F.when(empty & filled, change).otherwise(old)
        elif rule == "patch_if_present":
            merged = F.coalesce(change, old)
        elif rule == "overwrite":
            merged = F.when(F.col("_new").isNotNull(), change).otherwise(old)
        else:
            raise ValueError(f"unknown rule: {rule}")
        out.append(merged.alias(c))
    return joined.select(*out)


def audit_events(changes: DataFrame, entity_type: str, entity_id: str, action: Column | str, as_of: str | Column,
                 actor_id: str | Column | None = None, detail: Column | None = None) -> DataFrame:
    """Audit rows for a frame of changes; ids derive from the event itself."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    at = lit(as_of).cast("timestamp")
    none = F.lit(None).cast("string")
    rows = changes.select(
        F.lit(entity_type).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"),
        (lit(actor_id).cast("string") if actor_id is not None else none).alias("actor_id"), lit(action).alias("action"),
        (F.to_json(detail) if detail is not None else none).alias("detail"), at.alias("created_at"),
    )
    return rows.select(derived_id("entity_type", "entity_id", "action", "created_at", "detail").alias("id"), "*")


def import_run_row(summary: DataFrame, pack_path: str, as_of: str, dry_run: bool = False) -> DataFrame:
    """Audit row of a pack import from a one-row summary; no rows for a dry run."""
    body = F.to_json(F.struct(*summary.columns, F.lit(dry_run).alias("dry_run")))
    row = summary.select(
        derived_id("pack_id", "version", F.lit(as_of)).alias("id"), "pack_id", F.col("version").alias("pack_version"), F.lit(pack_path).alias("pack_path"),
        body.alias("summary_json"), F.lit(dry_run).alias("dry_run"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )
    return row.filter(F.lit(not dry_run))


# --- duplicates ------------------------------------------------------------------------------

def earliest_per_key(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return first_per_key(df, [key], [F.col(o) for o in order], keep)


def mark_duplicates(df: DataFrame, key: str = "dedup_key", order: str = "created_at", id_col: str = "id", out: str = "duplicate_of",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the earliest *other* row with the same key: the first row points at the second.

    A ranking limited to two sends at most the first two rows of a key from each task; the lookups
    are salted for keys with very many rows. Rows with a blank key have no duplicate and take no part
    in any of it.
    """
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    narrow = materialize(df.select(key, order, id_col).filter(~blank))  # the key may be costly and is read three times
    at = F.dense_rank().over(Window.partitionBy(key).orderBy(order, id_col))
    two = narrow.withColumn("_at", at).filter("_at <= 2")
    facts = two.groupBy(key).agg(F.min_by(id_col, "_at").alias("_id1"), F.max_by(id_col, "_at").alias("_id2"), F.max("_at").alias("_n")).filter("_n > 1").drop("_n")
    kept = [c for c in df.columns if c != out]
    joined = skew_join(df.filter(~blank), facts, [key], "left", [id_col], hot_rows, keys_from=narrow)
    marked = joined.withColumn(out, F.when(F.col(id_col) == F.col("_id1"), F.col("_id2")).otherwise(F.col("_id1"))).select(*kept, out)
    return marked.unionByName(df.filter(blank).select(*kept, F.lit(None).cast(df.schema[id_col].dataType).alias(out)))


def content_dedup(snapshots: DataFrame, existing: DataFrame, hash_col: str = "content_hash", order: str = "created_at", id_col: str = "id",
                  hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """New snapshots (first per hash, hash not stored yet) and ``id -> document_id, duplicate``."""
    stored = first_per_key(existing, [hash_col], [F.col(order), F.col(id_col)], [id_col]).withColumnRenamed(id_col, "_stored")
    first = first_per_key(snapshots, [hash_col], [F.col(order), F.col(id_col)], [id_col]).withColumnRenamed(id_col, "_first")
    owner = first.join(stored, hash_col, "left").select(hash_col, F.coalesce("_stored", "_first").alias("document_id"))
    narrow = snapshots.select(hash_col, id_col)
    mapping = skew_join(narrow, owner, [hash_col], "inner", [id_col], hot_rows)
    mapping = mapping.withColumn("duplicate", F.col(id_col) != F.col("document_id")).select(id_col, "document_id", "duplicate")
    fresh = snapshots.join(mapping.filter(~F.col("duplicate")).select(id_col), id_col, "left_semi")
    return fresh, mapping


def add_discovered(documents: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """Documents plus one ``discovered`` row per link URL that is not stored yet."""
    fresh = first_per_key(links, ["url"], [F.col("title"), F.col("source_id")], ["title", "source_id"])
    known = documents.select(F.col("canonical_url").alias("url")).filter(F.col("url").isNotNull()).distinct()
    rows = fresh.join(known, "url", "left_anti").select(
        derived_id("url").alias("id"), "source_id", "url", F.col("url").alias("canonical_url"), "title",
        F.lit("discovered").alias("status"), F.lit(as_of).cast("timestamp").alias("created_at"))
    return documents.unionByName(rows, allowMissingColumns=True)


# --- publishing ------------------------------------------------------------------------------

def publish_conflicts(contributions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id, duplicate_of`` of rows whose duplicate is already approved."""
    approved = contributions.filter(F.col("status") == "approved").select(F.col("id").alias("duplicate_of"), F.lit(True).alias("_hit"))
    linked = contributions.filter(F.col("duplicate_of").isNotNull()).select("id", "duplicate_of")
    return skew_join(linked, approved, ["duplicate_of"], "inner", ["id"], hot_rows).select("id", "duplicate_of")


PUBLISHED_KEEP = ("id", "created_at", "verification_status", "verified_at", "verified_by")


def policies_from_contributions(contributions: DataFrame, as_of: str) -> DataFrame:
    """Policy rows of contributions that are about to be published."""
    df = infer_geo(contributions, "jurisdiction_name", "jurisdiction_city", "jurisdiction_district", "title", "source_url", out=("_p", "_c", "_d"))
    c, filled = F.col, (lambda x: F.nullif(x, F.lit("")))
    at = F.lit(as_of).cast("timestamp")
    return df.select(
        derived_id(F.lit("policy"), "id").alias("id"), c("id").alias("contribution_id"), "title",
        F.coalesce(filled(c("official_file_name")), c("title")).alias("official_file_name"), F.coalesce("doc_no", F.lit("")).alias("doc_no"),
        "program", "policy_level", "issuer", F.coalesce("funding_source", F.lit("")).alias("funding_source"),
        F.coalesce(filled(c("description")), filled(c("conditions_text")), filled(c("notes")), F.lit("")).alias("description"),
        F.coalesce("end_note", F.lit("")).alias("end_note"), F.coalesce(filled(c("document_type")), F.lit("unknown")).alias("document_type"),
        F.lit("pending").alias("verification_status"), F.lit(None).cast("timestamp").alias("verified_at"), F.lit(None).cast("string").alias("verified_by"),
        "jurisdiction_code",
        F.coalesce(filled(c("_p")), filled(c("jurisdiction_name")), F.lit(R.NATIONAL)).alias("jurisdiction_name"),
        F.coalesce(filled(c("_c")), c("jurisdiction_city"), F.lit("")).alias("jurisdiction_city"),
        F.coalesce(filled(c("_d")), c("jurisdiction_district"), F.lit("")).alias("jurisdiction_district"),
        policy_status(c("effective_to"), as_of[:10]).alias("status"), "effective_from", "effective_to", "source_url",
        at.alias("created_at"), at.alias("updated_at"),
    )


def publish(policies: DataFrame, contributions: DataFrame, as_of: str) -> DataFrame:
    """Upsert keyed on the contribution; id, creation time and verification of a known policy stay."""
    rows = policies_from_contributions(contributions, as_of).select(*policies.columns)
    return merge_snapshot(policies, rows, "contribution_id", {c: "keep" for c in PUBLISHED_KEEP}).select(*policies.columns)


def rules_from_contributions(contributions: DataFrame, policy_ids: DataFrame, as_of: str) -> DataFrame:
    """One subsidy rule per published contribution; ``policy_ids`` maps contribution to policy."""
    c = F.col
    joined = contributions.join(policy_ids.select("contribution_id", "policy_id"), contributions["id"] == c("contribution_id"))
    text = F.coalesce("rule_text", F.lit(""))
    return joined.select(
        derived_id(F.lit("rule"), "policy_id").alias("id"), "policy_id", "category", "amount_type", "rate", c("amount_value").alias("fixed_amount"),
        "cap_amount", F.coalesce(F.nullif("cap_unit", F.lit("")), F.lit("元")).alias("cap_unit"), text.alias("rule_text"),
        rule_type(c("rule_type"), text, c("rate"), c("amount_value")).alias("rule_type"), "threshold_amount", "discount_amount", "per_user_limit",
        "stackable", F.coalesce(F.nullif("conditions_text", F.lit("")), "description", F.lit("")).alias("conditions_text"),
        F.to_json(F.struct(c("contribution_id").alias("contributionId"))).alias("conditions_json"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def evidence_or_fallback(contributions: DataFrame, policy_ids: DataFrame, as_of: str) -> DataFrame:
    """Extracted evidence of a contribution, else its source URL, else a manual review row.

    ``contributions`` has ``evidence array<struct<field_name, quote, page_number, confidence>>``.
    """
    c = F.col
    kind = "array<struct<field_name:string,quote:string,page_number:int,confidence:double>>"
    one = lambda field, quote: F.array(F.struct(F.lit(field).alias("field_name"), quote.alias("quote"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("double").alias("confidence")))
    rows = F.when(F.size(F.coalesce("evidence", F.array().cast(kind))) > 0, c("evidence").cast(kind)).when(
        F.coalesce("source_url", F.lit("")) != "", one("source_url", c("source_url"))
    ).otherwise(one("manual_review", F.lit("人工填写后审核入库，待官方来源核验")))
    joined = contributions.join(policy_ids.select("contribution_id", "policy_id"), contributions["id"] == c("contribution_id"))
    flat = joined.select("policy_id", "document_id", F.posexplode(rows).alias("_i", "e")).select("policy_id", "document_id", "_i", "e.*")
    return flat.select(derived_id(F.lit("evidence"), "policy_id", "_i").alias("id"), "policy_id", "document_id", "field_name", "quote", "page_number",
                       "confidence", F.lit(as_of).cast("timestamp").alias("created_at"))


def replace_children(children: DataFrame, new: DataFrame, parent_key: str) -> DataFrame:
    """Delete the children of every parent in ``new``, then add ``new``."""
    parents = new.select(parent_key).distinct()
    return children.join(parents, parent_key, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


# What a review action does.
TRANSITIONS = {"start_review": "in_review", "request_changes": "changes_requested", "reject": "rejected", "approve": "approved"}


def apply_reviews(contributions: DataFrame, actions: DataFrame, conflicts: DataFrame | None = None, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Contributions after all their actions (``contribution_id, action, comment, actor_id, at, id``), and rejects.

    Actions apply one after the other by ``at`` and ``id``, and a refused one changes nothing.
    Refused are unknown ids, unknown actions, change requests without a comment, approvals from a
    closed state and approvals of rows in ``conflicts``. Only approvals depend on the state: it is
    that of the last other action, or approved if an approval came after it. Both are last values of
    earlier rows, which a prefix scan over blocks of equal size hands on: the reviews of one
    contribution are spread over as many tasks as they fill.
    """
    state = contributions.select(F.col("id").alias("contribution_id"), F.col("status").alias("_status"))
    judged = actions.join(state, "contribution_id", "left")
    if conflicts is not None:
        judged = judged.join(conflicts.select(F.col("id").alias("contribution_id"), F.lit(True).alias("_conflict")).distinct(), "contribution_id", "left")
    else:
        judged = judged.withColumn("_conflict", F.lit(None).cast("boolean"))
    action, approve = F.col("action"), F.col("action") == "approve"
    alone = (
        F.when(F.col("_status").isNull(), "not found")
        .when(~F.coalesce(action.isin(*TRANSITIONS), F.lit(False)), "action not allowed")
        .when((action == "request_changes") & (F.coalesce(F.trim("comment"), F.lit("")) == ""), "comment required")
    )
    target = F.coalesce(*[F.when(action == name, status) for name, status in TRANSITIONS.items()])
    judged = judged.withColumns({"_alone": alone, "_target": target})
    alone_ok = F.col("_alone").isNull()
    judged = judged.withColumns({"_other": F.when(alone_ok & ~approve, F.col("_target")), "_approves": F.when(alone_ok, approve)})
    ranged = in_blocks(judged, ["contribution_id"], ["at", "id"], blocks)
    before = within(["contribution_id"], ["at", "id"]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"{c}_here": F.last(c, ignorenulls=True).over(before) for c in ("_other", "_approves")})
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "id"))).alias(c)
    hand = carried(ranged, ["contribution_id"], [latest("_other"), latest("_approves")], lambda earlier: {f"{c}_before": F.last(c, ignorenulls=True).over(earlier) for c in ("_other", "_approves")})
    judged = with_carried(local, hand, ["contribution_id"]).withColumns({
        "_state": F.coalesce("_other_here", "_other_before", "_status"), "_again": F.coalesce("_approves_here", "_approves_before", F.lit(False))})
    closed = ~F.col("_state").isin(*R.SUBMITTABLE_STATUSES)
    conflict = F.coalesce("_conflict", F.lit(False))
    late = F.when(approve & closed, "state cannot be submitted").when(approve & conflict, "duplicate already published").when(approve & F.col("_again"), "state cannot be submitted")
    judged = judged.withColumn("_reason", F.coalesce("_alone", late))
    valid = judged.filter(F.col("_reason").isNull())
    last = valid.groupBy("contribution_id").agg(F.max_by(F.struct("_target", "actor_id", "at"), F.struct("at", "id")).alias("_a"))
    changes = last.select(F.col("contribution_id").alias("id"), F.col("_a._target").alias("status"), F.col("_a.actor_id").alias("reviewer_id"), F.col("_a.at").alias("reviewed_at"), F.col("_a.at").alias("updated_at"))
    merged = merge_snapshot(contributions, changes, "id", insert=False).select(*contributions.columns)
    return merged, judged.filter(F.col("_reason").isNotNull()).select("contribution_id", "action", F.col("_reason").alias("reason"))


def verify_policies(policies: DataFrame, actions: DataFrame) -> DataFrame:
    """Set verified, by whom and when for ``policy_id, actor_id, at`` (the last action counts)."""
    last = actions.groupBy("policy_id").agg(F.max(F.struct("at", "actor_id")).alias("_a")).select("policy_id", F.col("_a.actor_id").alias("verified_by"), F.col("_a.at").alias("verified_at"))
    changes = last.select(F.col("policy_id").alias("id"), F.lit("verified").alias("verification_status"), "verified_at", "verified_by", F.col("verified_at").alias("updated_at"))
    return merge_snapshot(policies, changes, "id", insert=False).select(*policies.columns)


# --- patches ---------------------------------------------------------------------------------

# Extracted fields that may fill a contribution (the document number may not).
MERGED_FIELDS = R.words(
    """
    title official_file_name program issuer funding_source document_type jurisdiction_name jurisdiction_city
    jurisdiction_district category amount_type amount_value rate cap_amount cap_unit rule_text rule_type
    threshold_amount discount_amount per_user_limit stackable conditions_text end_note effective_from effective_to
    """
)


def merge_extracted(base: DataFrame, parsed: DataFrame, key: str = "id", fields: Sequence[str] = MERGED_FIELDS) -> DataFrame:
    """Fill null or '' fields from extracted values; stored values win."""
    have = [f for f in fields if f in base.columns and f in parsed.columns]
    return merge_snapshot(base, parsed.select(key, *have), key, default="fill_if_blank", insert=False).select(*base.columns)


KEY_COLUMNS = ("title", "issuer", "doc_no", "effective_from", "jurisdiction_name")


def patch_contributions(contributions: DataFrame, patches: DataFrame, as_of: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Apply non-null patch values, revalidate, recompute the dedup key and the duplicates.

    Returns the new snapshot and the rejected patches; a rejected row keeps its old values.
    """
    ids = patches.select("id")
    patched = merge_snapshot(contributions, patches, "id", default="patch_if_present", insert=False).select(*contributions.columns)
    touched = patched.join(ids, "id", "left_semi")
    valid, rejects = split_valid(materialize(validate_contributions(touched)), ["id"])
    valid = valid.withColumns({"dedup_key": F.nullif(dedup_key(*KEY_COLUMNS), F.lit("")), "updated_at": F.lit(as_of).cast("timestamp")})
    changes = valid.select(*contributions.columns)
    merged = materialize(merge_snapshot(contributions, changes, "id", insert=False).select(*contributions.columns))
    linked = mark_duplicates(merged.drop("duplicate_of"), hot_rows=hot_rows).select("id", "duplicate_of")
    linked = linked.join(changes.select("id"), "id", "left_semi")
    return merge_snapshot(merged, linked, "id", insert=False).select(*contributions.columns), rejects


def apply_policy_edits(policies: DataFrame, rules: DataFrame, contributions: DataFrame, patches: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Edit policies and carry the values to their rule and contribution.

    ``patches`` has ``policy_id`` and any of the policy, rule and amount columns; blank values
    keep what is stored. Rows failing validation are returned as ``rejects`` and change nothing.
    """
    p_cols = [c for c in policies.columns if c != "id"]
    r_cols = [c for c in rules.columns if c not in ("id", "policy_id", "created_at")]
    old = policies.select(F.col("id").alias("policy_id"), *[F.col(c).alias(f"_p_{c}") for c in p_cols])
    old = old.join(rules.select("policy_id", F.col("id").alias("_rule_id"), *[F.col(c).alias(f"_r_{c}") for c in r_cols]), "policy_id", "left")
    df = patches.select("policy_id", *[F.col(c).alias(f"_x_{c}") for c in patches.columns if c != "policy_id"]).join(old, "policy_id")
    x = lambda n: F.col(f"_x_{n}") if f"_x_{n}" in df.columns else F.lit(None).cast("string")
    p, r = (lambda n: F.col(f"_p_{n}")), (lambda n: F.col(f"_r_{n}"))
    num = lambda n, stored: F.coalesce(F.nullif(x(n).cast("string"), F.lit("")).try_cast("double"), stored)
    keep = lambda n: first_text(x(n), p(n))
    df = df.withColumns({
        "title": keep("title"), "source_url": normalize_url(first_text(x("source_url"), p("source_url"))),
        "_name": first_text(x("jurisdiction_name"), p("jurisdiction_name")), "_city": first_text(x("jurisdiction_city"), p("jurisdiction_city")),
        "_district": first_text(x("jurisdiction_district"), p("jurisdiction_district")),
    })
    df = infer_geo(df, "_name", "_city", "_district", "title", "source_url", out=("_gp", "_gc", "_gd"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    df = df.withColumns({
        "jurisdiction_name": F.coalesce(filled("_gp"), filled("_name"), F.lit(R.NATIONAL)), "jurisdiction_city": F.coalesce(filled("_gc"), F.col("_city")),
        "jurisdiction_district": F.coalesce(filled("_gd"), F.col("_district")),
        "program": keep("program"), "policy_level": keep("policy_level"), "issuer": keep("issuer"), "funding_source": keep("funding_source"),
        "official_file_name": first_text(x("official_file_name"), p("official_file_name"), F.col("title")), "doc_no": keep("doc_no"),
        "description": first_text(x("description"), p("description"), x("conditions_text"), r("conditions_text")), "end_note": keep("end_note"),
        "document_type": first_text(x("document_type"), p("document_type"), F.lit("unknown")), "jurisdiction_code": keep("jurisdiction_code"),
        "effective_from": keep("effective_from"), "effective_to": keep("effective_to"),
        "verification_status": F.when(x("verification_status").isin("pending", "verified"), x("verification_status")).otherwise(p("verification_status")),
        "category": first_text(x("category"), r("category")), "amount_type": first_text(x("amount_type"), r("amount_type"), F.lit("unknown")),
        "rate": num("rate", r("rate")), "amount_value": num("amount_value", r("fixed_amount")), "cap_amount": num("cap_amount", r("cap_amount")),
        "cap_unit": first_text(x("cap_unit"), r("cap_unit"), F.lit("元")), "rule_text": first_text(x("rule_text"), r("rule_text")),
        "rule_type": first_text(x("rule_type"), r("rule_type"), F.lit("unknown")), "threshold_amount": num("threshold_amount", r("threshold_amount")),
        "discount_amount": num("discount_amount", r("discount_amount")), "per_user_limit": num("per_user_limit", r("per_user_limit")).cast("int"),
        "stackable": F.coalesce(F.nullif(x("stackable").cast("string"), F.lit("")).try_cast("boolean"), r("stackable")),
        "conditions_text": first_text(x("conditions_text"), r("conditions_text"), x("description"), p("description")),
        "notes": first_text(x("conditions_text"), r("conditions_text"), p("description")),
        "updated_at": F.lit(as_of).cast("timestamp"), "contribution_id": p("contribution_id"), "_status": first_text(x("status"), p("status"), F.lit("active")),
    })
    df = df.withColumn("status", policy_status(F.col("effective_to"), as_of[:10], F.col("_status")))
    valid, rejects = split_valid(materialize(validate_contributions(df)), ["policy_id"])
    edited = ["title", "official_file_name", "doc_no", "program", "policy_level", "issuer", "funding_source", "description", "end_note", "document_type",
              "verification_status", "jurisdiction_code", "jurisdiction_name", "jurisdiction_city", "jurisdiction_district", "status", "effective_from",
              "effective_to", "source_url", "updated_at"]
    new_policies = merge_snapshot(policies, valid.select(F.col("policy_id").alias("id"), *edited), "id", insert=False).select(*policies.columns)
    rule_values = ["category", "amount_type", "rate", F.col("amount_value").alias("fixed_amount"), "cap_amount", "cap_unit", "rule_text", "rule_type",
                   "threshold_amount", "discount_amount", "per_user_limit", "stackable", "conditions_text"]
    known = valid.filter(F.col("_rule_id").isNotNull()).select(F.col("_rule_id").alias("id"), *rule_values)
    fresh = valid.filter(F.col("_rule_id").isNull()).select(
        derived_id(F.lit("rule"), "policy_id").alias("id"), "policy_id", *rule_values, F.to_json(F.struct(F.lit(as_of).alias("editedAt"))).alias("conditions_json"),
        F.lit(as_of).cast("timestamp").alias("created_at"))
    new_rules = merge_snapshot(rules, known, "id", insert=False).select(*rules.columns).unionByName(fresh.select(*rules.columns))
    shared = [c for c in edited if c in contributions.columns and c not in ("status", "verification_status", "jurisdiction_code")]
    carried = shared + ["category", "amount_type", "amount_value", "rate", "cap_amount", "rule_text", "rule_type", "threshold_amount", "discount_amount",
                        "per_user_limit", "stackable", "conditions_text"]
    back = valid.filter(F.col("contribution_id").isNotNull()).select(F.col("contribution_id").alias("id"), *[c for c in carried if c in contributions.columns])
    new_contributions = merge_snapshot(contributions, back, "id", insert=False).select(*contributions.columns)
    events = audit_events(valid, "policy", "policy_id", "updated", as_of, detail=F.struct(F.lit("policy_editor").alias("via")))
    return {"policies": new_policies, "rules": new_rules, "contributions": new_contributions, "events": events, "rejects": rejects}


def delete_parents(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str, child_key: str, mode: str = "set_null") -> tuple[DataFrame, DataFrame]:
    """Remove parents listed in ``keys``; children lose the reference or are removed with them."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    kept = parents.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    if mode == "cascade":
        return kept, children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti")
    marked = skew_join(children, gone.select(F.col("_gone").alias(child_key), F.lit(True).alias("_hit")), [child_key], "left")
    cleared = marked.withColumn(child_key, F.when(F.col("_hit").isNull(), F.col(child_key)))
    return kept, cleared.select(*children.columns)


def upsert_sources(sources: DataFrame, patches: DataFrame, as_of: str) -> DataFrame:
    """Create or patch sources: a given field wins over the stored one; URLs are normalised."""
    urls = {c: F.when(F.col(c).isNotNull(), F.nullif(normalize_url(c), F.lit(""))) for c in ("base_url", "listing_url") if c in patches.columns}
    changes = patches.withColumns({**urls, "updated_at": F.lit(as_of).cast("timestamp"), "created_at": F.lit(as_of).cast("timestamp")})
    return merge_snapshot(sources, changes, "id", {"created_at": "keep"}, default="patch_if_present").select(*sources.columns)


def apply_refetch(documents: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each target takes the columns of its latest fetch (``target_id`` plus document columns);
    the temporary rows are dropped."""
    columns = [c for c in documents.columns if c not in ("id", "source_id", "contribution_id") and c in fetched.columns]
    last = fetched.groupBy("target_id").agg(F.max_by(F.struct("id", *columns), F.struct("fetched_at", "id")).alias("_f"))
    changes = last.select(F.col("target_id").alias("id"), *[F.col(f"_f.{c}").alias(c) for c in columns])
    temporary = fetched.filter(F.col("id") != F.col("target_id")).select("id").distinct()
    kept = documents.join(temporary, "id", "left_anti")
    return merge_snapshot(kept, changes, "id", insert=False).select(*documents.columns)


def attach_document(contributions: DataFrame, links: DataFrame) -> DataFrame:
    """Set ``document_id`` only where none is stored; the first link per contribution counts."""
    first = links.groupBy("contribution_id").agg(F.min("document_id").alias("document_id")).withColumnRenamed("contribution_id", "id")
    return merge_snapshot(contributions, first, "id", {"document_id": "fill_if_blank"}, insert=False).select(*contributions.columns)


# --- maintenance -----------------------------------------------------------------------------

def _status_change(policies: DataFrame, contributions: DataFrame, marked: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """``marked``: policy_id, contribution_id, status, action, detail."""
    at = F.lit(as_of).cast("timestamp").alias("updated_at")
    new_policies = merge_snapshot(policies, marked.select(F.col("policy_id").alias("id"), "status", at), "id", insert=False).select(*policies.columns)
    back = marked.select(F.col("contribution_id").alias("id"), F.lit("rejected").alias("status"), at)
    new_contributions = merge_snapshot(contributions, back, "id", insert=False).select(*contributions.columns)
    events = audit_events(marked, "policy", "policy_id", F.col("action"), as_of, detail=F.col("detail"))
    return {"policies": new_policies, "contributions": new_contributions, "events": events}


def prune_irrelevant(policies: DataFrame, contributions: DataFrame, as_of: str, text: str = "text", vocabulary: Vocabulary = DEFAULT) -> dict[str, DataFrame]:
    """Supersede policies whose source text is not related; ``contributions`` carries the text and fields."""
    scored = score_relevance(contributions.filter(F.col(text).isNotNull()), text, "title", vocabulary)
    off = scored.filter(~F.col("relevance.is_related")).select(F.col("id").alias("contribution_id"), "relevance")
    marked = policies.select(F.col("id").alias("policy_id"), "contribution_id", "title").join(off, "contribution_id").select(
        "policy_id", "contribution_id", F.lit("superseded").alias("status"), F.lit("filtered_as_irrelevant").alias("action"),
        F.struct("title", F.col("relevance.score").alias("score"), F.col("relevance.level").alias("level")).alias("detail"))
    return _status_change(policies, contributions, marked, as_of)


def title_outcome(title: Column, pattern: str = R.LISTING_TITLE_PATTERN, old_years: Sequence[str] = ("2024", "2025"), current_year: str = "2026") -> Column:
    """``superseded`` for listing titles, ``expired`` for old years only, else null."""
    listing = title.rlike(pattern)
    old = has_word(title, old_years) & ~title.contains(current_year)
    return F.when(listing, "superseded").when(old, "expired")


def prune_titles(policies: DataFrame, contributions: DataFrame, as_of: str, pattern: str = R.LISTING_TITLE_PATTERN,
                 old_years: Sequence[str] = ("2024", "2025"), current_year: str = "2026") -> dict[str, DataFrame]:
    """Supersede active policies with listing titles, expire those of old years."""
    title = F.trim(F.coalesce("title", F.lit("")))
    active = policies.filter(F.col("status") == "active").withColumn("_to", title_outcome(title, pattern, old_years, current_year)).filter(F.col("_to").isNotNull())
    active = active.join(contributions.select(F.col("id").alias("contribution_id")), "contribution_id", "left_semi")
    action = F.when(F.col("_to") == "expired", "filtered_as_old").otherwise("filtered_as_listing_page")
    marked = active.select(F.col("id").alias("policy_id"), "contribution_id", F.col("_to").alias("status"), action.alias("action"), F.struct("title").alias("detail"))
    return _status_change(policies, contributions, marked, as_of)


def correct_jurisdictions(policies: DataFrame, contributions: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Set the jurisdiction read from title or host where it differs; recompute dedup keys."""
    host = F.coalesce(url_host("source_url"), F.lit(""))
    staged = policies.withColumn("_to", corrected_jurisdiction("title", host))
    wrong = staged.filter(F.col("_to").isNotNull() & ~F.col("_to").eqNullSafe(F.col("jurisdiction_name")))
    wrong = wrong.join(contributions.select(F.col("id").alias("contribution_id")), "contribution_id", "left_semi")
    at = F.lit(as_of).cast("timestamp").alias("updated_at")
    new_policies = merge_snapshot(policies, wrong.select("id", F.col("_to").alias("jurisdiction_name"), at), "id", insert=False).select(*policies.columns)
    key = F.nullif(dedup_key("title", "issuer", "effective_from", "_to"), F.lit(""))
    back = wrong.select(F.col("contribution_id").alias("id"), F.col("_to").alias("jurisdiction_name"), key.alias("dedup_key"), at)
    new_contributions = merge_snapshot(contributions, back, "id", insert=False).select(*contributions.columns)
    return {"policies": new_policies, "contributions": new_contributions}


def backfill_documents(documents: DataFrame, text: str = "text", vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Re-derive type (stored, else by title) and relevance of every extracted document."""
    kind = F.coalesce(F.nullif("document_type", F.lit("")), classify_title("title"))
    return score_relevance(documents.withColumn("document_type", kind), text, "title", vocabulary)


def backfill_policies(policies: DataFrame, rules: DataFrame, contributions: DataFrame, parsed: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Re-derive type, geography, dedup key and rule columns.

    ``parsed`` holds extracted values per contribution: ``contribution_id`` and field columns.
    """
    fields = [c for c in parsed.columns if c != "contribution_id"]
    src = parsed.select("contribution_id", *[F.col(c).alias(f"_e_{c}") for c in fields])
    e = lambda n: F.col(f"_e_{n}") if n in fields else F.lit(None).cast("string")
    filled = lambda c: F.nullif(c, F.lit(""))
    df = policies.join(src, "contribution_id", "left")
    df = df.withColumns({
        "_kind": F.coalesce(filled(e("document_type")), filled(F.col("document_type")), classify_title("title")),
        "_name": F.coalesce(filled(F.col("jurisdiction_name")), e("jurisdiction_name")), "_city": F.coalesce(filled(F.col("jurisdiction_city")), e("jurisdiction_city")),
        "_district": F.coalesce(filled(F.col("jurisdiction_district")), e("jurisdiction_district")),
    })
    df = infer_geo(df, "_name", "_city", "_district", "title", "source_url", out=("_gp", "_gc", "_gd"))
    at = F.lit(as_of).cast("timestamp").alias("updated_at")
    changes = df.select(
        "id", F.col("_kind").alias("document_type"), F.coalesce(filled(F.col("verification_status")), F.lit("pending")).alias("verification_status"),
        F.coalesce(filled(F.col("_gp")), F.col("jurisdiction_name")).alias("jurisdiction_name"), filled(F.col("_gc")).alias("jurisdiction_city"),
        filled(F.col("_gd")).alias("jurisdiction_district"), at)
    new_policies = merge_snapshot(policies, changes, "id", insert=False).select(*policies.columns)
    name = F.coalesce(filled(F.col("_gp")), F.col("jurisdiction_name"))
    back = df.filter(F.col("contribution_id").isNotNull()).select(
        F.col("contribution_id").alias("id"), filled(F.col("_gp")).alias("jurisdiction_name"),
        filled(dedup_key("title", "issuer", e("doc_no"), "effective_from", name)).alias("dedup_key"), at)
    new_contributions = merge_snapshot(contributions, back, "id", {"jurisdiction_name": "patch_if_present"}, insert=False).select(*contributions.columns)
    side = df.select(F.col("id").alias("policy_id"), F.col("description").alias("_description"), *[F.col(f"_e_{c}") for c in fields])
    r = rules.join(side, "policy_id")
    text = F.coalesce(filled(e("rule_text")), F.col("rule_text"), F.lit(""))
    num = lambda n: F.coalesce(e(n).try_cast("double"), F.col(n))
    reduced = text.rlike(REDUCTION_HINT)
    from_text = lambda mark, stored: F.nullif(F.coalesce(filled(F.regexp_extract(text, rf"{mark}{WS}*{NUMBER}", 1)).try_cast("double"), stored), F.lit(0.0))
    kind = (
        F.when(reduced, "full_reduction")
        .when(e("rate").isNotNull() | F.col("rate").isNotNull(), "percentage")
        .when(e("amount_value").isNotNull() | F.col("fixed_amount").isNotNull(), "fixed")
        .otherwise(F.coalesce(filled(e("rule_type")), filled(F.col("rule_type")), F.lit("unknown")))
    )
    updates = r.select(
        "id", kind.alias("rule_type"),
        F.when(reduced, from_text("满", num("threshold_amount"))).otherwise(num("threshold_amount")).alias("threshold_amount"),
        F.when(reduced, from_text("减", num("discount_amount"))).otherwise(num("discount_amount")).alias("discount_amount"),
        F.coalesce(e("per_user_limit").try_cast("int"), F.col("per_user_limit")).alias("per_user_limit"),
        F.coalesce(e("stackable").try_cast("boolean"), F.col("stackable")).alias("stackable"),
        F.coalesce(filled(e("conditions_text")), filled(F.col("_description")), F.col("conditions_text"), F.lit("")).alias("conditions_text"))
    new_rules = merge_snapshot(rules, updates, "id", insert=False).select(*rules.columns)
    return {"policies": new_policies, "contributions": new_contributions, "rules": new_rules}


def curate(policies: DataFrame, rules: DataFrame, patches: Mapping[str, Mapping[str, str | None]], as_of: str, jurisdiction: str = R.NATIONAL) -> dict[str, DataFrame]:
    """Patch the oldest policy whose title contains each fragment; rule columns go to its rule.

    ``patches``: fragment -> column values; ``cap_unit`` and ``description`` also reach the rule.
    """
    target = first_by_title(policies, list(patches), jurisdiction).select(F.col("id"), "pattern")
    value = lambda column: reduce(lambda acc, kv: acc.when(F.col("pattern") == kv[0], F.lit(kv[1].get(column))), patches.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    columns = sorted({c for patch in patches.values() for c in patch if c in policies.columns})
    changes = target.select("id", *[value(c).cast("string").alias(c) for c in columns], F.lit(as_of).cast("timestamp").alias("updated_at"))
    new_policies = merge_snapshot(policies, changes, "id", insert=False).select(*policies.columns)
    note = F.to_json(F.struct(F.lit(True).alias("curated"), value("description").alias("description")))
    side = target.select(F.col("id").alias("policy_id"), value("cap_unit").alias("cap_unit"), note.alias("conditions_json"))
    updates = rules.select("id", "policy_id").join(side, "policy_id").select("id", "cap_unit", "conditions_json")
    return {"policies": new_policies, "rules": merge_snapshot(rules, updates, "id", insert=False).select(*rules.columns)}
