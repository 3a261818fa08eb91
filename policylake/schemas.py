"""Schemas of the stored tables and of the pack files, as DDL text (usable by every reader)."""

from __future__ import annotations

PACK_MANIFEST = (
    "packId string, version string, title string, description string, generatedAt string, sourcePolicy string, "
    "files struct<sources string, policies string, aggregates string>"
)
PACK_SOURCE = (
    "name string, level string, jurisdictionName string, baseUrl string, sourceType string, accessMethod string, "
    "frequency string, complianceNote string"
)
PACK_POLICY = (
    "externalId string, title string, program string, level string, issuer string, jurisdictionName string, "
    "category string, amountType string, rate double, amountValue double, capAmount double, effectiveFrom string, "
    "effectiveTo string, sourceUrl string, notes string, fundingSource string, "
    "evidence array<struct<fieldName string, quote string, confidence double>>"
)
PACK_AGGREGATE = (
    "jurisdictionName string, program string, metricType string, amountYuan double, countValue double, unit string, "
    "asOfDate string, sourceUrl string, quote string"
)
EXAMPLE_RECORD = (
    "externalId string, title string, fundingSource string, category string, province string, city string, "
    "district string, ruleText string, rate double, capAmount double, capUnit string, effectiveFrom string, "
    "effectiveTo string, endNote string, officialFileName string, docNo string, notes string"
)

SOURCES = (
    "id string, name string, level string, jurisdiction_code string, jurisdiction_name string, category string, "
    "keywords string, base_url string, listing_url string, source_type string, access_method string, frequency string, "
    "enabled boolean, compliance_note string, interval_minutes int, last_run_status string, last_error string, "
    "last_fetched_at timestamp, next_fetch_at timestamp, created_by string, created_at timestamp, updated_at timestamp"
)
CONTRIBUTIONS = (
    "id string, user_id string, status string, title string, program string, policy_level string, issuer string, "
    "funding_source string, official_file_name string, doc_no string, description string, end_note string, "
    "document_type string, jurisdiction_code string, jurisdiction_name string, jurisdiction_city string, "
    "jurisdiction_district string, category string, amount_type string, amount_value double, rate double, "
    "cap_amount double, cap_unit string, rule_text string, rule_type string, threshold_amount double, "
    "discount_amount double, per_user_limit int, stackable boolean, conditions_text string, effective_from string, "
    "effective_to string, source_url string, notes string, extracted_json string, validation_json string, "
    "dedup_key string, duplicate_of string, document_id string, reviewer_id string, reviewed_at timestamp, "
    "created_at timestamp, updated_at timestamp"
)
DOCUMENTS = (
    "id string, source_id string, contribution_id string, url string, canonical_url string, title string, "
    "mime_type string, byte_size bigint, content_hash string, raw_path string, extracted_text string, "
    "extracted_json string, status string, error string, fetched_by string, fetched_at timestamp, parsed_at timestamp, "
    "created_at timestamp"
)
POLICIES = (
    "id string, contribution_id string, title string, official_file_name string, doc_no string, program string, "
    "policy_level string, issuer string, funding_source string, description string, end_note string, "
    "document_type string, verification_status string, verified_at timestamp, verified_by string, "
    "jurisdiction_code string, jurisdiction_name string, jurisdiction_city string, jurisdiction_district string, "
    "status string, effective_from string, effective_to string, source_url string, created_at timestamp, "
    "updated_at timestamp"
)
SUBSIDY_RULES = (
    "id string, policy_id string, category string, amount_type string, rate double, fixed_amount double, "
    "cap_amount double, cap_unit string, rule_text string, rule_type string, threshold_amount double, "
    "discount_amount double, per_user_limit int, stackable boolean, conditions_text string, conditions_json string, "
    "created_at timestamp"
)
EVIDENCE = (
    "id string, policy_id string, document_id string, field_name string, quote string, page_number int, "
    "confidence double, created_at timestamp"
)
EVENTS = (
    "id string, entity_type string, entity_id string, actor_id string, action string, detail string, created_at timestamp"
)
AGGREGATES = (
    "id string, jurisdiction_code string, jurisdiction_name string, program string, metric_type string, "
    "amount_yuan double, count_value double, unit string, period_start string, period_end string, as_of_date string, "
    "source_url string, quote string, created_at timestamp"
)
IMPORT_RUNS = (
    "id string, pack_id string, pack_version string, pack_path string, summary_json string, dry_run boolean, created_at timestamp"
)
USERS = ("id string, username string, display_name string, role string, status string, created_at timestamp, updated_at timestamp")
INVITES = (
    "id string, code string, role string, note string, expires_at string, used_by string, used_at timestamp, "
    "disabled boolean, created_by string, created_at timestamp"
)
COMMENTS = ("id string, contribution_id string, user_id string, body string, created_at timestamp")

# Allowed values, required columns, unique keys and parents of each table.
CONSTRAINTS = {
    "sources": {
        "enum": {
            "level": "national province city district other", "source_type": "html_listing policy_page open_api manual_upload other",
            "access_method": "manual scheduled api", "frequency": "manual daily weekly monthly",
        },
        "not_null": "id name level source_type access_method frequency created_at updated_at", "unique": ("id",),
    },
    "contributions": {
        "enum": {"status": "draft submitted in_review changes_requested approved rejected", "amount_type": "percent fixed tiered other unknown"},
        "not_null": "id user_id status title created_at updated_at", "unique": ("id",),
        "parents": {"user_id": ("users", "id"), "duplicate_of": ("contributions", "id"), "document_id": ("documents", "id")},
    },
    "documents": {
        "enum": {"status": "discovered fetched parsed ocr_required processed failed"},
        "not_null": "id status created_at", "unique": ("id",),
        "parents": {"source_id": ("sources", "id"), "contribution_id": ("contributions", "id")},
    },
    "policies": {
        "enum": {"status": "active expired superseded unknown"},
        "not_null": "id contribution_id title verification_status status created_at updated_at", "unique": ("id", "contribution_id"),
        "parents": {"contribution_id": ("contributions", "id")},
    },
    "subsidy_rules": {"not_null": "id policy_id amount_type created_at", "unique": ("id",), "parents": {"policy_id": ("policies", "id")}},
    "evidence": {"not_null": "id policy_id field_name created_at", "unique": ("id",), "parents": {"policy_id": ("policies", "id")}},
    "aggregates": {
        "enum": {"metric_type": "allocated_funds disbursed_funds driven_sales beneficiary_count other"},
        "not_null": "id jurisdiction_name metric_type source_url created_at", "unique": ("id",),
    },
    "users": {
        "enum": {"role": "admin reviewer contributor viewer", "status": "active disabled"},
        "not_null": "id username display_name role status created_at updated_at", "unique": ("id", "username"),
    },
    "invites": {
        "enum": {"role": "admin reviewer contributor viewer"}, "not_null": "id code role created_by created_at", "unique": ("id", "code"),
        "parents": {"used_by": ("users", "id"), "created_by": ("users", "id")},
    },
    "comments": {"not_null": "id contribution_id user_id body created_at", "unique": ("id",), "parents": {"contribution_id": ("contributions", "id"), "user_id": ("users", "id")}},
}
