"""Search, facet, report, merge, import and schedule queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import text_queries as TQ
from checks.adapters import PROVINCES, S, adapt, cte, notices
from checks.registry import any_contains, in_list, query, quoted, sql_normalize, sql_squeeze, table
from policylake import rules as R
from policylake import schemas
from policylake.functions import extract as X
from policylake.functions import relevance as V
from policylake.functions.keys import dedup_key
from policylake.functions.text import policy_level, policy_status
from policylake.functions.urls import resolve_url
from policylake.operators import dictionary, exports, imports, merge, ordering, reports, schedule, search, validation
from policylake.session import materialize
from policylake.sources.catalog import table_counts
from policylake.sources.html import extract_links
from policylake.sources.packs import lines_to_records

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "1999-06-30T12:00:00"
TODAY = AS_OF[:10]

# --- search ----------------------------------------------------------------------------------


@query("policy_search", f"""
WITH {cte('policies', 'subsidy_rules', 'evidence')},
hit AS (SELECT DISTINCT policy_id FROM evidence WHERE contains(lower(quote), 'part 1')),
snip AS (SELECT policy_id, min_by(quote, (created_at, id)) AS content_snippet FROM evidence GROUP BY policy_id)
SELECT p.id, r.id AS rule_id, p.title, r.category, CAST(p.updated_at AS VARCHAR) AS updated_at, content_snippet FROM policies p LEFT JOIN subsidy_rules r ON r.policy_id = p.id LEFT JOIN snip s ON s.policy_id = p.id
WHERE p.status = 'active' AND coalesce(p.verification_status, 'pending') = 'pending' AND (p.jurisdiction_name = '广东' OR contains(p.jurisdiction_name, '广东') OR contains(p.title, '广东')) AND contains(lower(r.category), 'a')
  AND (contains(lower(p.title), 'part 1') OR contains(lower(p.issuer), 'part 1') OR contains(lower(p.program), 'part 1') OR contains(lower(p.source_url), 'part 1') OR p.id IN (SELECT policy_id FROM hit))
ORDER BY p.updated_at DESC NULLS LAST, p.id, r.id LIMIT 500""")
def policy_search(spark, d):
    out = search.search_policies(adapt(spark, d, "policies"), adapt(spark, d, "subsidy_rules"), adapt(spark, d, "evidence"), q="Part 1", category="A", province="广东", verification="pending", n=500)
    return out.select("id", "rule_id", "title", "category", F.col("updated_at").cast("string").alias("updated_at"), "content_snippet")


# All three levels at once: each is met by its own column or by the name or title that may hold it.
_PLACED = """placed AS (SELECT * EXCLUDE (jurisdiction_city, jurisdiction_district, title), CASE WHEN n % 3 = 0 THEN '广州市' WHEN n % 3 = 1 THEN '深圳市' END AS jurisdiction_city,
  CASE WHEN n % 4 = 0 THEN '天河区' END AS jurisdiction_district, concat(title, CASE WHEN n % 5 = 0 THEN ' 广州市' ELSE '' END, CASE WHEN n % 7 = 0 THEN ' 天河区' ELSE '' END) AS title
  FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM policies))"""


@query("policy_place_search", f"""
WITH {cte('policies', 'subsidy_rules', 'evidence')}, {_PLACED}, snip AS (SELECT policy_id, min_by(quote, (created_at, id)) AS content_snippet FROM evidence GROUP BY policy_id)
SELECT p.id, r.id AS rule_id, p.title, content_snippet FROM placed p LEFT JOIN subsidy_rules r ON r.policy_id = p.id LEFT JOIN snip s ON s.policy_id = p.id
WHERE p.status = 'active' AND (p.jurisdiction_name = '广东省' OR contains(p.title, '广东省')) AND (coalesce(p.jurisdiction_city = '广州市', false) OR contains(p.jurisdiction_name, '广州市') OR contains(p.title, '广州市'))
  AND (coalesce(p.jurisdiction_district = '天河区', false) OR contains(p.title, '天河区'))""")
def policy_place_search(spark, d):
    n = F.substr("id", F.lit(2)).cast("bigint")
    policies = adapt(spark, d, "policies").withColumns({
        "jurisdiction_city": F.when(n % 3 == 0, "广州市").when(n % 3 == 1, "深圳市"), "jurisdiction_district": F.when(n % 4 == 0, "天河区"),
        "title": F.concat("title", F.when(n % 5 == 0, " 广州市").otherwise(""), F.when(n % 7 == 0, " 天河区").otherwise(""))})
    out = search.search_policies(policies, adapt(spark, d, "subsidy_rules"), adapt(spark, d, "evidence"), province="广东省", city="广州市", district="天河区")
    return out.select("id", "rule_id", "title", "content_snippet")


@query("policy_rule_join", f"""
WITH {cte('policies', 'subsidy_rules')} SELECT p.id, r.id AS rule_id, p.status, r.category, r.rate, r.cap_amount FROM policies p LEFT JOIN subsidy_rules r ON r.policy_id = p.id""")
def policy_rule_join(spark, d):
    return search.policy_rules(adapt(spark, d, "policies"), adapt(spark, d, "subsidy_rules")).select("id", "rule_id", "status", "category", "rate", "cap_amount")


@query("source_dashboard", f"""
WITH {cte('sources', 'source_documents', 'contributions')}
SELECT s.id, s.name, count(DISTINCT d.id) AS document_count, count(DISTINCT c.id) AS imported_count, CAST(max(d.created_at) AS VARCHAR) AS last_document_at
FROM sources s LEFT JOIN source_documents d ON d.source_id = s.id LEFT JOIN contributions c ON c.document_id = d.id AND c.status = 'approved' GROUP BY s.id, s.name""")
def source_dashboard(spark, d):
    out = search.source_dashboard(adapt(spark, d, "sources"), adapt(spark, d, "source_documents"), adapt(spark, d, "contributions"))
    return out.select("id", "name", "document_count", "imported_count", F.col("last_document_at").cast("string").alias("last_document_at"))


@query("source_fanout_join", f"""
WITH {cte('sources', 'source_documents', 'contributions')}
SELECT s.id, d.id AS document_id, c.id AS contribution_id FROM sources s LEFT JOIN source_documents d ON d.source_id = s.id LEFT JOIN contributions c ON c.document_id = d.id AND c.status = 'approved'""")
def source_fanout_join(spark, d):
    return search.sources_docs_contribs(adapt(spark, d, "sources"), adapt(spark, d, "source_documents"), adapt(spark, d, "contributions")).select("id", "document_id", "contribution_id")


@query("active_sources", f"WITH {cte('source_documents', 'sources')} SELECT count(DISTINCT s.id) AS active_sources FROM sources s JOIN source_documents d ON d.source_id = s.id")
def active_sources(spark, d):
    return reports.active_sources(search.source_dashboard(adapt(spark, d, "sources"), adapt(spark, d, "source_documents"), adapt(spark, d, "contributions")))


@query("cascading_facets", """
WITH p AS (SELECT r_name, n_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT 'region' AS facet, r_name AS value FROM p UNION ALL SELECT DISTINCT 'nation', n_name FROM p WHERE r_name = 'ASIA'
UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM p WHERE r_name = 'ASIA' AND n_name = 'NATION_2' UNION ALL SELECT DISTINCT 'balance', balance FROM p WHERE r_name = 'ASIA' AND n_name = 'NATION_2'""")
def cascading_facets(spark, d):
    pool = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pool = pool.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "debit").otherwise("credit").alias("balance"))
    return search.facets_of(pool, ("region", "nation", "segment", "balance"), {"region": "ASIA", "nation": "NATION_2"})


@query("policy_facets", f"""
WITH {cte('policies', 'subsidy_rules')}, p AS (SELECT p.jurisdiction_name AS province, CASE WHEN p.jurisdiction_name IN {in_list(R.MUNICIPALITIES)} THEN p.jurisdiction_name ELSE '' END AS city, r.category
  FROM policies p LEFT JOIN subsidy_rules r ON r.policy_id = p.id WHERE p.status = 'active' AND coalesce(p.verification_status, 'pending') = 'verified')
SELECT DISTINCT 'province' AS facet, province AS value FROM p UNION ALL SELECT DISTINCT 'city', city FROM p WHERE province = '上海市' AND city <> ''
UNION ALL SELECT DISTINCT 'category', category FROM p WHERE province = '上海市' AND category <> ''""")
def policy_facets(spark, d):
    return search.facets(adapt(spark, d, "policies"), adapt(spark, d, "subsidy_rules"), province="上海", verification="verified")


@query("status_counts", f"WITH {cte('contributions')} SELECT status, count(*) AS row_count FROM contributions GROUP BY status")
def status_counts(spark, d):
    return reports.status_overview(adapt(spark, d, "contributions"))


@query("global_counts", "SELECT (SELECT count(*) FROM orders) AS contributions, (SELECT count(*) FROM supplier) AS sources, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM part) AS policies, (SELECT count(*) FROM customer) AS users")
def global_counts(spark, d):
    names = {"contributions": "orders", "sources": "supplier", "documents": "documents", "policies": "part", "users": "customer"}
    return reports.global_counts({alias: table(spark, d, name) for alias, name in names.items()})


@query("recent", f"""
WITH {cte('contributions', 'users')} SELECT c.id, c.title, c.status, u.display_name, CAST(c.updated_at AS VARCHAR) AS updated_at FROM contributions c JOIN users u ON u.id = c.user_id ORDER BY c.updated_at DESC, c.id LIMIT 8""")
def recent(spark, d):
    out = reports.recent(adapt(spark, d, "contributions"), adapt(spark, d, "users"), 8)
    return out.select("id", "title", "status", "display_name", F.col("updated_at").cast("string").alias("updated_at"))


@query("double_dim_join", f"""
WITH {cte('line_invites', 'users')} SELECT i.id, i.used_by, i.created_by, u.display_name AS used_by_name, c.display_name AS created_by_name FROM line_invites i LEFT JOIN users u ON u.id = i.used_by LEFT JOIN users c ON c.id = i.created_by""")
def double_dim_join(spark, d):
    return search.invites_with_users(adapt(spark, d, "line_invites"), adapt(spark, d, "users")).select("id", "used_by", "created_by", "used_by_name", "created_by_name")


@query("timeline", f"""
WITH {cte('audit', 'users')} SELECT a.id, a.entity_id, a.action, CAST(a.created_at AS VARCHAR) AS created_at, u.display_name FROM audit a LEFT JOIN users u ON u.id = a.actor_id
WHERE a.entity_type = 'contribution' ORDER BY a.created_at DESC, a.id LIMIT 100""")
def timeline(spark, d):
    out = search.timeline(adapt(spark, d, "audit"), adapt(spark, d, "users"), "contribution", n=100)
    return out.select("id", "entity_id", "action", F.col("created_at").cast("string").alias("created_at"), "display_name")


@query("detail_view", f"""
WITH {cte('contributions', 'comments', 'audit', 'users')}, e AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC NULLS LAST, id) AS rn FROM audit WHERE entity_type = 'contribution')
SELECT c.contribution_id AS id, 'comment' AS kind, CAST(c.created_at AS VARCHAR) AS seq_at, c.id AS item_id, c.body, u.display_name AS user_name FROM comments c JOIN users u ON u.id = c.user_id WHERE c.contribution_id IN (SELECT id FROM contributions)
UNION ALL SELECT e.entity_id, 'event', CAST(e.created_at AS VARCHAR), e.id, e.action, u.display_name FROM e LEFT JOIN users u ON u.id = e.actor_id WHERE rn <= 20 AND e.entity_id IN (SELECT id FROM contributions)""")
def detail_view(spark, d):
    out = search.contribution_detail(adapt(spark, d, "contributions"), adapt(spark, d, "comments"), adapt(spark, d, "audit"), adapt(spark, d, "users"), n_events=20)
    return out.select("id", "kind", F.col("seq_at").cast("string").alias("seq_at"), "item_id", "body", "user_name")


@query("comments_join", f"WITH {cte('comments', 'users')} SELECT c.id, c.contribution_id, u.display_name FROM comments c JOIN users u ON u.id = c.user_id")
def comments_join(spark, d):
    return search.comments_with_users(adapt(spark, d, "comments"), adapt(spark, d, "users")).select("id", "contribution_id", "display_name")


@query("visible_rows", f"""
WITH {cte('contributions')} SELECT id, user_id, status FROM contributions WHERE user_id = '7' OR status IN ('submitted', 'in_review', 'changes_requested', 'approved')""")
def visible_rows(spark, d):
    return search.visible_contributions(adapt(spark, d, "contributions"), "7", "contributor").select("id", "user_id", "status")


@query("pending_queue", f"WITH {cte('contributions')} SELECT id, title, status FROM contributions WHERE status IN ('submitted', 'in_review') AND contains(lower(title), 'urgent')")
def pending_queue(spark, d):
    return search.pending_queue(adapt(spark, d, "contributions"), "URGENT").select("id", "title", "status")


@query("newest_contributions", f"""
WITH {cte('contributions')} SELECT id, status, CAST(updated_at AS VARCHAR) AS updated_at FROM contributions WHERE status = 'approved' AND (contains(lower(title), 'low') OR contains(lower(jurisdiction_name), 'low') OR contains(lower(category), 'low')
 OR contains(lower(issuer), 'low')) ORDER BY updated_at DESC, id LIMIT 300""")
def newest_contributions(spark, d):
    found = search.text_search(search.enum_filter(adapt(spark, d, "contributions"), "status", "approved"), ("title", "jurisdiction_name", "category", "issuer"), "LOW")
    return ordering.newest(found, [F.col("updated_at").desc_nulls_last(), F.col("id")], 300).select("id", "status", F.col("updated_at").cast("string").alias("updated_at"))


@query("policy_list", f"""
WITH {cte('policies', 'subsidy_rules')} SELECT p.id, r.id AS rule_id, p.issuer, r.category FROM policies p LEFT JOIN subsidy_rules r ON r.policy_id = p.id
WHERE contains(lower(p.issuer), 'office 3') AND contains(p.jurisdiction_name, '省') AND contains(lower(r.category), 'o') ORDER BY p.updated_at DESC, p.id, r.id LIMIT 500""")
def policy_list(spark, d):
    found = search.optional_filters(search.policy_rules(adapt(spark, d, "policies"), adapt(spark, d, "subsidy_rules")), {
        "q": ("office 3", lambda v: search.text_match(("title", "issuer", "source_url"), v)), "category": ("O", lambda v: search.contains_text("category", v)),
        "jurisdiction": ("省", lambda v: search.contains_text("jurisdiction_name", v)), "unused": ("", lambda v: F.lit(False))})
    return ordering.newest(found, [F.col("updated_at").desc(), F.col("id"), F.col("rule_id")], 500).select("id", "rule_id", "issuer", "category")


@query("evidence_lookup", f"""
WITH {cte('policies', 'evidence', 'contributions')}, e AS (SELECT policy_id, min_by(quote, (created_at, id)) AS content_snippet, count(*) AS n FROM evidence GROUP BY policy_id)
SELECT p.id, p.title, e.content_snippet, coalesce(e.n, 0) AS evidence_count, c.status AS contribution_status FROM policies p JOIN contributions c ON c.id = p.contribution_id LEFT JOIN e ON e.policy_id = p.id""")
def evidence_lookup(spark, d):
    e = adapt(spark, d, "evidence")
    p = search.policy_contributions(adapt(spark, d, "policies"), adapt(spark, d, "contributions")).withColumnRenamed("id", "policy_id")
    out = p.join(search.first_evidence(e), "policy_id", "left").join(search.evidence_count(e), "policy_id", "left")
    return out.select(F.col("policy_id").alias("id"), "title", "content_snippet", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "contribution_status")


@query("contains_lookup", """
WITH h AS (SELECT n_name, s_suppkey, s_name, concat('Region NATION_', CAST(s_nationkey AS VARCHAR)) AS region, s_acctbal > 0 AS enabled FROM nation LEFT JOIN supplier ON contains(concat('Region NATION_', CAST(s_nationkey AS VARCHAR)), n_name))
SELECT n_name, s_suppkey, s_name FROM h QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY enabled DESC, s_suppkey) = 1""")
def contains_lookup(spark, d):
    dim = table(spark, d, "supplier").withColumn("region", F.concat(F.lit("Region NATION_"), F.col("s_nationkey").cast("string")))
    order = [F.when(F.col("s_acctbal") > 0, 0).otherwise(1), F.col("s_suppkey")]
    return dictionary.lookup_contains(table(spark, d, "nation").select("n_name"), "n_name", dim, "region", order, ["s_suppkey", "s_name"])


# A dictionary that is a table: the long words of benchmark items, by length and name, labelled by their ends.
_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS keyword FROM benchmark"


@query("dictionary_labels", f"""
WITH words AS ({_WORDS}), hits AS (SELECT doc_id, keyword, right(keyword, 3) AS label FROM documents JOIN words ON contains(text, keyword))
SELECT doc_id, arg_min(label, (length(keyword), keyword)) AS label, arg_min(keyword, (length(keyword), keyword)) AS keyword, count(*) AS hits, CAST(sum(length(keyword)) AS BIGINT) AS points FROM hits GROUP BY doc_id""")
def dictionary_labels(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("keyword")).distinct()
    rules = words.select("keyword", F.length("keyword").alias("rule_no"), F.col("keyword").alias("keyword_no"), F.right("keyword", F.lit(3)).alias("label"), F.length("keyword").alias("points"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = materialize(dictionary.find_words(docs, "doc_id", "text", rules, "keyword"))
    return dictionary.first_label(docs, "doc_id", "text", rules, found).join(dictionary.weighted_hits(docs, "doc_id", "text", rules, found), "doc_id").select("doc_id", "label", "keyword", "hits", "points")


@query("dictionary_relevance", f"""
WITH words AS ({_WORDS}), d AS (SELECT doc_id, text, left(text, 60) AS title FROM documents),
hits AS (SELECT doc_id, length(keyword) * (CASE WHEN contains(title, keyword) THEN 145 ELSE 100 END + least(2, (length(text) - length(replace(text, keyword, ''))) // length(keyword)) * 45 + 8) AS points FROM d JOIN words ON contains(text, keyword))
SELECT doc_id, count(*) AS hits, CAST(sum(points) AS BIGINT) AS points FROM hits GROUP BY doc_id""")
def dictionary_relevance(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("word")).distinct().withColumn("weight", F.length("word"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 60).alias("title"))
    return dictionary.keyword_points(docs, "doc_id", "title", "text", words)


TITLE_PARTS = ("small", "red", "gear", "absent")


@query("title_lookup", f"""
WITH f AS (SELECT * FROM (VALUES {', '.join(f"('{p}')" for p in TITLE_PARTS)}) v(pattern)), p AS (SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'ECONOMY')
SELECT pattern, p_partkey AS id, p_name AS title FROM f JOIN p ON contains(lower(p_name), pattern) QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY p_partkey) = 1""")
def title_lookup(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("created_at"), F.col("p_type").alias("jurisdiction_name"))
    return search.first_by_title(p, TITLE_PARTS, "ECONOMY").select("pattern", "id", "title")


@query("default_row_union", """
WITH b AS (SELECT s_name AS id, s_acctbal AS balance FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_name, c_acctbal FROM customer)
SELECT * FROM b UNION ALL SELECT id, balance FROM (VALUES ('Customer#000000001', 1.0::DOUBLE), ('Nobody', 2.0::DOUBLE)) v(id, balance) WHERE id NOT IN (SELECT id FROM b)""")
def default_row_union(spark, d):
    a = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_name").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_acctbal").alias("balance"))
    literal = spark.createDataFrame([("Customer#000000001", 1.0), ("Nobody", 2.0)], "id string, balance double")
    return search.union_with_default(a, b, literal, "id")


@query("locale_sort", f"SELECT DISTINCT p AS place FROM (SELECT ([{', '.join(quoted(p) for p in PROVINCES)}])[c_custkey % 8 + 1] AS p FROM customer)")
def locale_sort(spark, d):
    place = F.get(F.array(*[F.lit(p) for p in PROVINCES]), F.col("c_custkey") % 8)
    return ordering.locale_sort(search.distinct_values(table(spark, d, "customer").select(place.alias("place")), "place"), "place")


@query("statistics_order", "SELECT o_orderpriority AS metric_type, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS as_of_date, count(*) AS n FROM orders GROUP BY ALL")
def statistics_order(spark, d):
    stats = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric_type"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("as_of_date")).agg(F.count("*").alias("n"))
    return search.order_statistics(stats)


@query("order_by_first", f"""
WITH {cte('sources')} SELECT id, name FROM sources ORDER BY coalesce(listing_url, base_url) NULLS FIRST, id LIMIT 20""")
def order_by_first(spark, d):
    return ordering.order_by_first(adapt(spark, d, "sources"), ["listing_url", "base_url"], 20).select("id", "name")


@query("insert_if_absent", """
WITH new AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, min_by(c_name, c_custkey) AS first_name FROM customer GROUP BY ALL)
SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_acctbal > 8000 AND o.c_nationkey = new.nation AND o.c_mktsegment = new.segment)""")
def insert_if_absent(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("first_name"), "c_custkey", "c_acctbal")
    return search.insert_if_absent(c.filter("c_acctbal > 8000"), c, ["nation", "segment"], [F.col("c_custkey")]).select("nation", "segment", "first_name")


# --- reports ---------------------------------------------------------------------------------

_DOCS = """d AS (SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 'policy' WHEN 'fr' THEN 'news' WHEN 'de' THEN 'listing' ELSE '' END AS document_type, coalesce(l.quality = 1, false) AS is_related,
  coalesce(l.quality = 1 AND l.toxic = 0, false) AS importable, d.n_chars % 3 AS evidence_n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("recognition_report", f"""
WITH {cte('policies', 'subsidy_rules', 'evidence')}, {_DOCS}, k AS (SELECT *, coalesce(nullif(document_type, ''), 'unknown') AS kind FROM d), pk AS (SELECT *, coalesce(nullif(document_type, ''), 'unknown') AS kind FROM policies),
j AS (SELECT p.*, r.category, r.rate, r.fixed_amount, r.cap_amount, r.rule_text, (SELECT count(*) FROM evidence e WHERE e.policy_id = p.id) AS n FROM policies p LEFT JOIN subsidy_rules r ON r.policy_id = p.id),
m AS (SELECT 'documents' AS section, 'total' AS metric, count(*) AS value FROM k UNION ALL SELECT 'documents', 'related', count(*) FROM k WHERE is_related UNION ALL SELECT 'documents', 'importable', count(*) FROM k WHERE importable
UNION ALL SELECT 'documents', 'with_evidence', count(*) FROM k WHERE evidence_n > 0 UNION ALL SELECT 'documents', 'risky_but_related', count(*) FROM k WHERE is_related AND kind IN ('news', 'interpretation', 'listing')
UNION ALL SELECT 'document_types', kind, count(*) FROM k GROUP BY kind UNION ALL SELECT 'policies', 'total', count(*) FROM pk UNION ALL SELECT 'statuses', status, count(*) FROM pk GROUP BY status
UNION ALL SELECT 'verification', coalesce(verification_status, 'pending'), count(*) FROM pk GROUP BY 2 UNION ALL SELECT 'policy_types', kind, count(*) FROM pk GROUP BY kind
UNION ALL SELECT 'active_policy_types', kind, count(*) FROM pk WHERE status = 'active' GROUP BY kind UNION ALL SELECT 'superseded_policy_types', kind, count(*) FROM pk WHERE status = 'superseded' GROUP BY kind
UNION ALL SELECT 'missing', 'evidence', count(*) FROM j WHERE n = 0 UNION ALL SELECT 'missing', 'amount_rule', count(*) FROM j WHERE rate IS NULL AND fixed_amount IS NULL AND cap_amount IS NULL AND coalesce(rule_text, '') = ''
UNION ALL SELECT 'missing', 'dates', count(*) FROM j WHERE coalesce(effective_from, '') = '' OR coalesce(effective_to, '') = '' UNION ALL SELECT 'missing', 'province', count(*) FROM j WHERE coalesce(jurisdiction_name, '') = ''
UNION ALL SELECT 'missing', 'category', count(*) FROM j WHERE coalesce(category, '') = '' UNION ALL SELECT 'missing', 'official_url', count(*) FROM policies WHERE coalesce(source_url, '') = '')
SELECT section, metric, CAST(value AS DOUBLE) AS value FROM m WHERE value > 0 OR section = 'missing'
UNION ALL SELECT 'documents', 'evidence_coverage', round(count(*) FILTER (evidence_n > 0) / count(*), 4) FROM k""")
def recognition_report(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "policy").when(F.col("lang") == "fr", "news").when(F.col("lang") == "de", "listing").otherwise("")
    docs = docs.select("doc_id", kind.alias("document_type"), (F.col("quality") == 1).alias("is_related"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("importable"), (F.col("n_chars") % 3).alias("evidence_n"))
    return reports.recognition_report(docs, adapt(spark, d, "policies"), adapt(spark, d, "subsidy_rules"), adapt(spark, d, "evidence"))


@query("readiness", f"""
WITH {cte('users', 'invites', 'sources')} SELECT (SELECT count(*) FROM users WHERE status = 'active') AS active_users, (SELECT count(*) FROM users WHERE status = 'active' AND role = 'admin') AS active_admins,
 (SELECT count(*) FROM invites WHERE used_by IS NULL AND NOT disabled) AS unused_invites, (SELECT count(*) FROM part) AS policies, (SELECT count(*) FROM sources) AS sources""")
def readiness(spark, d):
    return reports.readiness_counts(adapt(spark, d, "users"), adapt(spark, d, "invites"), table(spark, d, "part"), adapt(spark, d, "sources"))


@query("triage_counts", f"""
WITH {_DOCS}, t AS (SELECT d.*, o.n_chars, CASE WHEN o.n_chars % 5 = 0 THEN '1990-01-01' WHEN o.n_chars % 5 = 1 THEN '' ELSE '2030-01-01' END AS effective_to, o.lang = 'es' AS failed,
 row_number() OVER (PARTITION BY o.text ORDER BY o.doc_id) > 1 AS copy FROM d JOIN documents o ON o.doc_id = d.doc_id)
SELECT CASE WHEN failed THEN 'failed' WHEN NOT is_related OR (effective_to <> '' AND effective_to < '{TODAY}') THEN 'skipped' WHEN copy THEN 'duplicate' ELSE 'imported' END AS outcome, count(*) AS row_count FROM t GROUP BY 1""")
def triage_counts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    end = F.when(F.col("n_chars") % 5 == 0, "1990-01-01").when(F.col("n_chars") % 5 == 1, "").otherwise("2030-01-01")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", "failed").otherwise("processed").alias("status"), (F.col("quality") == 1).alias("is_related"), end.alias("effective_to"))
    hashed = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("created_at"))
    _, mapping = merge.content_dedup(hashed, hashed.filter(F.lit(False)))
    copies = mapping.filter("duplicate").select(F.col("id").alias("document_id"))
    return reports.outcome_counts(imports.triage_outcomes(rows, AS_OF, copies))


@query("catalog_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, '' AS label, count(*) AS row_count FROM {t}" for t in TABLES) + ")")
def catalog_counts(spark, d):
    return table_counts({t: table(spark, d, t) for t in TABLES})


@query("event_counts", """
SELECT CAST(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS window_start, event_type, count(*) AS event_count FROM events GROUP BY ALL""")
def event_counts(spark, d):
    return schedule.event_counts(table(spark, d, "events"), "ts", "6 hours", ("event_type",)).select(F.col("window_start").cast("string").alias("window_start"), "event_type", "event_count")


def _export_sql(export: str, source: str, names: tuple[str, ...], order: str = "") -> str:
    columns = ", ".join(f'{c} AS "{h}"' for h, c in (p.split("=") for p in exports.HEADERS[export].split()))
    return f"WITH {cte(*names)} SELECT {columns} FROM {source}"


_POLICY_SOURCE = "(SELECT p.*, 'national' AS policy_level, r.category, r.amount_type, r.rate, r.fixed_amount, r.cap_amount FROM policies p LEFT JOIN subsidy_rules r ON r.policy_id = p.id)"


@query("export_policies", _export_sql("policies", _POLICY_SOURCE, ("policies", "subsidy_rules")))
def export_policies(spark, d):
    return exports.export_policies(adapt(spark, d, "policies").withColumn("policy_level", F.lit("national")), adapt(spark, d, "subsidy_rules"))


@query("export_evidence", _export_sql("evidence", "(SELECT e.*, p.title AS policy_title FROM evidence e JOIN policies p ON p.id = e.policy_id)", ("evidence", "policies")))
def export_evidence(spark, d):
    return exports.export_evidence(adapt(spark, d, "evidence"), adapt(spark, d, "policies"))


@query("export_sources", _export_sql("sources", "(SELECT *, name AS last_fetched_at FROM sources)", ("sources",)))
def export_sources(spark, d):
    return exports.export_sources(adapt(spark, d, "sources").withColumn("last_fetched_at", F.col("name")))


@query("export_contributions", _export_sql("contributions", "(SELECT c.* EXCLUDE (updated_at), CAST(updated_at AS VARCHAR) AS updated_at, user_id AS reviewer_id, effective_from AS reviewed_at FROM contributions c)", ("contributions",)))
def export_contributions(spark, d):
    c = adapt(spark, d, "contributions").withColumns({"updated_at": F.col("updated_at").cast("string"), "reviewer_id": F.col("user_id"), "reviewed_at": F.col("effective_from")})
    return exports.export_contributions(c)


@query("export_documents", _export_sql("documents", "(SELECT page_id, url, 'text/html' AS mime_type, sha256(html) AS content_hash, 'fetched' AS status, '' AS error, url AS title, url AS fetched_at, url AS parsed_at FROM pages)", ("users",)))
def export_documents(spark, d):
    u = F.col("url")
    p = table(spark, d, "pages").select("page_id", "url", F.lit("text/html").alias("mime_type"), F.sha2("html", 256).alias("content_hash"), F.lit("fetched").alias("status"), F.lit("").alias("error"),
                                        u.alias("title"), u.alias("fetched_at"), u.alias("parsed_at"), F.col("page_id").alias("created_at"))
    return exports.export_documents(p)


@query("export_users", _export_sql("users", "users", ("users",)))
def export_users(spark, d):
    return exports.export_users(adapt(spark, d, "users"))


@query("export_invites", _export_sql("invites", "(SELECT i.*, u.username AS used_by_username FROM invites i LEFT JOIN users u ON u.id = i.used_by)", ("invites", "users")))
def export_invites(spark, d):
    return exports.export_invites(adapt(spark, d, "invites"), adapt(spark, d, "users"))


_STATS = """s AS (SELECT n_name AS jurisdiction_name, CASE n_nationkey % 3 WHEN 0 THEN 'driven_sales' WHEN 1 THEN 'beneficiary_count' ELSE 'allocated_funds' END AS metric_type,
  CAST(floor(sum(l_extendedprice)) AS BIGINT) AS amount_yuan, count(*) AS count_value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


@query("statistics_display", f"""
WITH {_STATS} SELECT jurisdiction_name, CASE metric_type WHEN 'driven_sales' THEN '带动销售额' WHEN 'beneficiary_count' THEN '惠及人数' ELSE '已下达资金' END AS display_label,
 CASE WHEN metric_type = 'beneficiary_count' THEN concat(printf('%.2f', count_value / 100000000.0), ' 亿人次') WHEN amount_yuan >= 100000000 THEN concat(printf('%.2f', amount_yuan / 100000000.0), ' 亿元')
 ELSE concat(format('{{:,}}', amount_yuan), ' 元') END AS display_value FROM s""")
def statistics_display(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"))
    j = l.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    metric = F.when(F.col("n_nationkey") % 3 == 0, "driven_sales").when(F.col("n_nationkey") % 3 == 1, "beneficiary_count").otherwise("allocated_funds")
    stats = j.groupBy(F.col("n_name").alias("jurisdiction_name"), metric.alias("metric_type")).agg(F.floor(F.sum("v")).cast("double").alias("amount_yuan"), F.sum("n").cast("double").alias("count_value"))
    return reports.display_statistics(stats).select("jurisdiction_name", "display_label", "display_value")


# --- validation ------------------------------------------------------------------------------

_N = lambda c: sql_normalize(c)
_URL = "trim(coalesce(source_url, ''))"


@query("validate_rows", f"""
WITH {cte('contributions')}, v AS (SELECT *, {_N('title')} AS t, {_N('effective_from')} AS ef, {_N('effective_to')} AS et FROM contributions)
SELECT id, array_to_string([x FOR x IN [CASE WHEN length(t) < 4 THEN '政策标题至少 4 个字符' END, CASE WHEN policy_level <> '' AND policy_level NOT IN {in_list(R.LEVELS)} THEN '政策层级不合法' END,
  CASE WHEN amount_type NOT IN {in_list(R.AMOUNT_TYPES)} THEN '金额类型不合法' END, CASE WHEN amount_value < 0 THEN '金额必须是非负数' END, CASE WHEN cap_amount < 0 THEN '上限金额必须是非负数' END,
  CASE WHEN rate > 100 OR rate < 0 THEN '补贴比例需在 0-100 之间' END, CASE WHEN ef <> '' AND NOT regexp_matches(ef, '^\\d\\d\\d\\d-\\d\\d-\\d\\d$') THEN '生效日期格式应为 YYYY-MM-DD' END,
  CASE WHEN ef <> '' AND et <> '' AND ef > et THEN '生效日期不能晚于截止日期' END, CASE WHEN {_URL} <> '' AND NOT starts_with({_URL}, 'http') THEN '来源链接必须是 http 或 https 地址' END] IF x IS NOT NULL], '|') AS errors,
 array_to_string([x FOR x IN [CASE WHEN {_URL} = '' THEN '尚未填写官方来源链接' END, CASE WHEN coalesce(jurisdiction_name, '') = '' THEN '尚未填写适用地区' END,
  CASE WHEN amount_type = 'percent' AND rate IS NULL THEN '比例型补贴建议填写补贴比例' END, CASE WHEN amount_type = 'fixed' AND amount_value IS NULL THEN '固定金额补贴建议填写补贴金额' END] IF x IS NOT NULL], '|') AS warnings,
 t AS title, split_part({_URL}, '#', 1) AS source_url FROM v""")
def validate_rows(spark, d):
    v = validation.validate_contributions(adapt(spark, d, "contributions"))
    return v.select("id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "title", "source_url")


@query("constraint_check", f"""
WITH {cte('contributions', 'users')} SELECT 'contributions' AS table_name, id AS row_key, 'amount_type is not allowed' AS error FROM contributions WHERE amount_type = 'odd'
UNION ALL SELECT 'contributions', title, 'title is not unique' FROM contributions GROUP BY title HAVING count(*) > 1
UNION ALL SELECT 'contributions', user_id, 'user_id has no users row' FROM (SELECT DISTINCT user_id FROM contributions) WHERE user_id NOT IN (SELECT id FROM users WHERE status = 'active')""")
def constraint_check(spark, d):
    spec = {**schemas.CONSTRAINTS["contributions"], "unique": ("id", "title")}
    parents = {"users": adapt(spark, d, "users").filter("status = 'active'")}
    return validation.check_constraints("contributions", adapt(spark, d, "contributions"), spec, parents)


# --- duplicates and merges -------------------------------------------------------------------

_KEYED = """keyed AS (SELECT *, sha256(concat_ws('|', lower({t}), lower({i}))) AS dedup_key FROM contributions)""".format(t=sql_squeeze("title"), i=sql_squeeze("issuer"))


def _keyed(spark, d):
    return adapt(spark, d, "contributions").withColumn("dedup_key", dedup_key("title", "issuer"))


_DUPES = f"""{cte('contributions')}, {_KEYED}, marked AS (SELECT *, row_number() OVER w AS rn, nth_value(id, 1) OVER f AS first_id, nth_value(id, 2) OVER f AS second_id FROM keyed
 WINDOW w AS (PARTITION BY dedup_key ORDER BY created_at, id), f AS (PARTITION BY dedup_key ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
dupes AS (SELECT *, CASE WHEN rn = 1 THEN second_id ELSE first_id END AS duplicate_of FROM marked)"""


@query("duplicate_of", f"WITH {_DUPES} SELECT id, dedup_key, duplicate_of FROM dupes")
def duplicate_of(spark, d):
    return merge.mark_duplicates(_keyed(spark, d)).select("id", "dedup_key", "duplicate_of")


@query("publish_conflicts", f"WITH {_DUPES} SELECT a.id, a.duplicate_of FROM dupes a JOIN dupes b ON b.id = a.duplicate_of WHERE b.status = 'approved'")
def publish_conflicts(spark, d):
    return merge.publish_conflicts(merge.mark_duplicates(_keyed(spark, d)))


@query("earliest_per_key", f"WITH {cte('contributions')} SELECT category, min_by(id, (created_at, id)) AS id, min_by(title, (created_at, id)) AS title FROM contributions GROUP BY category")
def earliest_per_key(spark, d):
    return merge.earliest_per_key(adapt(spark, d, "contributions"), "category", ["created_at", "id"], ["id", "title"])


@query("content_dedup", """
WITH s AS (SELECT doc_id, sha256(text) AS h, source, min(doc_id) OVER (PARTITION BY text) AS first_id, min(CASE WHEN source = 'src1' THEN doc_id END) OVER (PARTITION BY text) AS stored FROM documents)
SELECT doc_id AS id, coalesce(stored, first_id) AS document_id, doc_id <> coalesce(stored, first_id) AS duplicate FROM s""")
def content_dedup(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("created_at"), "source")
    _, mapping = merge.content_dedup(s, s.filter("source = 'src1'"))
    return mapping


@query("add_discovered", f"""
WITH {TQ._LINKS}, l AS (SELECT page_id, {TQ._ESCAPED} AS url, link_text FROM links), new AS (SELECT url, min(link_text) AS title FROM l WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM pages) GROUP BY url)
SELECT url, url AS canonical_url, '' AS title, 'fetched' AS status FROM pages UNION ALL SELECT url, url, title, 'discovered' FROM new""")
def add_discovered(spark, d):
    pages = table(spark, d, "pages")
    docs = pages.select(F.col("page_id").cast("string").alias("id"), F.lit(None).cast("string").alias("source_id"), "url", F.col("url").alias("canonical_url"), F.lit("").alias("title"), F.lit("fetched").alias("status"),
                        F.lit(AS_OF).cast("timestamp").alias("created_at"))
    links = extract_links(pages, keep=("page_id", "url")).select(resolve_url("href", "url").alias("url"), F.col("link_text").alias("title"), F.lit(None).cast("string").alias("source_id")).filter(F.col("url").isNotNull())
    return merge.add_discovered(docs, links, AS_OF).select("url", "canonical_url", "title", "status")


_LEVEL = "CASE WHEN c.jurisdiction_name = '全国' THEN 'national' ELSE 'province' END"


@query("merge_upsert", f"""
WITH {cte('contributions', 'policies')}, cur AS (SELECT * FROM policies WHERE status = 'superseded'), new AS (SELECT * FROM contributions WHERE status IN ('approved', 'submitted'))
SELECT coalesce(p.contribution_id, c.id) AS contribution_id, CASE WHEN c.id IS NULL THEN p.title ELSE c.title END AS title, CASE WHEN c.id IS NULL THEN p.program ELSE c.program END AS program,
  CASE WHEN c.id IS NULL THEN p.status WHEN coalesce(c.effective_to, '') <> '' AND c.effective_to < '{TODAY}' THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN p.id IS NULL THEN 'pending' ELSE p.verification_status END AS verification_status, CAST(CASE WHEN p.id IS NULL THEN TIMESTAMP '{AS_OF.replace('T', ' ')}' ELSE p.created_at END AS VARCHAR) AS created_at,
  CASE WHEN c.id IS NULL THEN coalesce(p.jurisdiction_city, '') WHEN c.jurisdiction_name IN {in_list(R.MUNICIPALITIES)} THEN c.jurisdiction_name ELSE '' END AS city
FROM cur p FULL OUTER JOIN new c ON c.id = p.contribution_id""")
def merge_upsert(spark, d):
    c = adapt(spark, d, "contributions").filter(F.col("status").isin("approved", "submitted"))
    cols = merge.policies_from_contributions(c, AS_OF).columns
    base = adapt(spark, d, "policies").filter("status = 'superseded'")
    base = base.select(*[F.col(x) if x in base.columns else F.lit(None).cast("string").alias(x) for x in cols])
    out = merge.publish(base, c, AS_OF)
    return out.select("contribution_id", "title", "program", "status", "verification_status", F.col("created_at").cast("string").alias("created_at"), F.coalesce("jurisdiction_city", F.lit("")).alias("city"))


@query("replace_children", f"""
WITH {cte('subsidy_rules', 'contributions')}, new AS (SELECT * FROM contributions WHERE status = 'approved')
SELECT policy_id, amount_type, rate, coalesce(rule_text, '') AS rule_text, 'kept' AS origin FROM subsidy_rules WHERE policy_id NOT IN (SELECT concat('p', id) FROM new)
UNION ALL SELECT concat('p', id), amount_type, rate, rule_text, CASE WHEN rule_text <> '' THEN 'full_reduction' WHEN rate IS NOT NULL THEN 'percentage' WHEN amount_value IS NOT NULL THEN 'fixed' ELSE 'unknown' END FROM new""")
def replace_children(spark, d):
    c = adapt(spark, d, "contributions").filter("status = 'approved'")
    ids = c.select(F.col("id").alias("contribution_id"), F.concat(F.lit("p"), "id").alias("policy_id"))
    new = merge.rules_from_contributions(c, ids, AS_OF).select("policy_id", "amount_type", "rate", "rule_text", F.col("rule_type").alias("origin"))
    old = adapt(spark, d, "subsidy_rules").select("policy_id", "amount_type", "rate", F.coalesce("rule_text", F.lit("")).alias("rule_text"), F.lit("kept").alias("origin"))
    return merge.replace_children(old, new, "policy_id")


@query("publish_evidence", f"""
WITH {cte('contributions')} SELECT concat('p', id) AS policy_id, CASE WHEN source_url <> '' THEN 'source_url' ELSE 'manual_review' END AS field_name,
 CASE WHEN source_url <> '' THEN source_url ELSE '人工填写后审核入库，待官方来源核验' END AS quote FROM contributions""")
def publish_evidence(spark, d):
    kind = "array<struct<field_name:string,quote:string,page_number:int,confidence:double>>"
    c = adapt(spark, d, "contributions").withColumn("evidence", F.lit(None).cast(kind))
    ids = c.select(F.col("id").alias("contribution_id"), F.concat(F.lit("p"), "id").alias("policy_id"))
    return merge.evidence_or_fallback(c, ids, AS_OF).select("policy_id", "field_name", "quote")


# Written as a reviewer works: one action after the other, each against the status that the ones before have left.
_ACTIONS = f"""acts AS (SELECT {S('user_id')} AS contribution_id, CASE event_type WHEN 'view' THEN 'start_review' WHEN 'click' THEN 'request_changes' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'reject' ELSE 'archive' END AS action,
 CASE WHEN value > 20 THEN 'please fix' ELSE ' ' END AS comment, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
steps AS (SELECT id AS contribution_id, status, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS reason FROM contributions
 UNION ALL
 SELECT contribution_id, CASE WHEN reason IS NOT NULL THEN status WHEN action = 'start_review' THEN 'in_review' WHEN action = 'request_changes' THEN 'changes_requested' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END,
  n, CASE WHEN reason IS NULL THEN now ELSE ts END, action, reason
 FROM (SELECT s.contribution_id, s.status, a.n, s.ts, a.ts AS now, a.action, CASE WHEN a.action = 'archive' THEN 'action not allowed' WHEN a.action = 'request_changes' AND trim(a.comment) = '' THEN 'comment required'
   WHEN a.action = 'approve' AND s.status NOT IN ('draft', 'changes_requested', 'submitted', 'in_review') THEN 'state cannot be submitted' END AS reason
  FROM steps s JOIN acts a ON a.contribution_id = s.contribution_id AND a.n = s.n + 1))"""


def _review(spark, d):
    e = table(spark, d, "events")
    t = F.col("event_type")
    action = F.when(t == "view", "start_review").when(t == "click", "request_changes").when(t == "purchase", "approve").when(t == "signup", "reject").otherwise("archive")
    acts = e.select(F.col("user_id").cast("string").alias("contribution_id"), action.alias("action"), F.when(F.col("value") > 20, "please fix").otherwise(" ").alias("comment"),
                    F.lit("r1").alias("actor_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    c = adapt(spark, d, "contributions").withColumns({"reviewer_id": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp_ntz")})
    return merge.apply_reviews(c, acts)


@query("review_transitions", f"""
WITH RECURSIVE {cte('contributions')}, {_ACTIONS} SELECT contribution_id AS id, arg_max(status, n) AS status, CASE WHEN max(ts) IS NOT NULL THEN 'r1' END AS reviewer_id, CAST(max(ts) AS VARCHAR) AS reviewed_at FROM steps GROUP BY contribution_id""")
def review_transitions(spark, d):
    return _review(spark, d)[0].select("id", "status", "reviewer_id", F.col("reviewed_at").cast("string").alias("reviewed_at"))


@query("review_rejects", f"""
WITH RECURSIVE {cte('contributions')}, {_ACTIONS} SELECT contribution_id, action, reason FROM steps WHERE reason IS NOT NULL
UNION ALL SELECT contribution_id, action, 'not found' FROM acts WHERE contribution_id NOT IN (SELECT id FROM contributions)""")
def review_rejects(spark, d):
    return _review(spark, d)[1]


_PART_TITLE = "concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' 通知公告' WHEN 1 THEN ' 2024' WHEN 2 THEN ' 2025 2026' WHEN 3 THEN ' 网站' WHEN 4 THEN ' 2025 政策专区' ELSE '' END)"


def _part_tables(spark, d):
    p = table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS id", "concat('c', CAST(p_partkey AS STRING)) AS contribution_id", f"{_PART_TITLE} AS title", "CASE WHEN p_size < 40 THEN 'active' ELSE 'expired' END AS status",
                                           "p_brand AS jurisdiction_name", "p_type AS issuer", "concat('https://', lower(p_type), '.tj.gov.cn/') AS source_url", "'2026-01-01' AS effective_from", "TIMESTAMP '2020-01-01 00:00:00' AS updated_at")
    c = p.selectExpr("contribution_id AS id", "'approved' AS status", "title", "jurisdiction_name", "CAST(NULL AS STRING) AS dedup_key", "updated_at")
    return p, c


@query("prune_titles", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_size < 40 THEN 'active' ELSE 'expired' END AS status, p_partkey % 7 AS v FROM part),
n AS (SELECT *, CASE WHEN status <> 'active' THEN NULL WHEN v IN (0, 3, 4) THEN 'superseded' WHEN v = 1 THEN 'expired' END AS marked FROM p)
SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(marked, status) AS status, CASE WHEN marked IS NULL THEN 'approved' ELSE 'rejected' END AS contribution_status,
 CASE marked WHEN 'superseded' THEN 'filtered_as_listing_page' WHEN 'expired' THEN 'filtered_as_old' END AS action FROM n""")
def prune_titles(spark, d):
    p, c = _part_tables(spark, d)
    out = merge.prune_titles(p, c, AS_OF)
    joined = search.policy_contributions(out["policies"], out["contributions"], "left")
    events = out["events"].select(F.col("entity_id").alias("id"), "action")
    return joined.join(events, "id", "left").select("id", "status", "contribution_status", "action")


@query("correct_jurisdictions", """
SELECT CAST(p_partkey AS VARCHAR) AS id, '天津' AS jurisdiction_name, '天津' AS contribution_jurisdiction, sha256(concat_ws('|', lower(regexp_replace(concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' 通知公告' WHEN 1 THEN ' 2024' WHEN 2 THEN ' 2025 2026' WHEN 3 THEN ' 网站'
 WHEN 4 THEN ' 2025 政策专区' ELSE '' END), '\\s+', '', 'g')), lower(p_type), '2026-01-01', '天津')) AS dedup_key FROM part""")
def correct_jurisdictions(spark, d):
    p, c = _part_tables(spark, d)
    out = merge.correct_jurisdictions(p, c, AS_OF)
    return search.policy_contributions(out["policies"], out["contributions"], "inner", ("jurisdiction_name", "dedup_key")).select(
        "id", "jurisdiction_name", F.col("contribution_jurisdiction_name").alias("contribution_jurisdiction"), F.col("contribution_dedup_key").alias("dedup_key"))


_PRUNE = f"WITH {TQ._DOC_SCORES}"


@query("prune_irrelevant", f"{_PRUNE} SELECT doc_id AS id, CASE WHEN is_related THEN 'active' ELSE 'superseded' END AS status, CASE WHEN is_related THEN 'approved' ELSE 'rejected' END AS contribution_status FROM relevance")
def prune_irrelevant(spark, d):
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents")
    at = F.lit(AS_OF).cast("timestamp").alias("updated_at")
    c = docs.select(F.col("doc_id").alias("id"), F.lit("approved").alias("status"), X.infer_title(F.col("text"), none, none, none)["value"].alias("title"), "text", at)
    p = docs.select("doc_id", F.col("doc_id").alias("contribution_id"), F.lit("t").alias("title"), F.lit("active").alias("status"), at).withColumnRenamed("doc_id", "id")
    out = merge.prune_irrelevant(p, c, AS_OF, vocabulary=TQ.DOC_VOCABULARY)
    return search.policy_contributions(out["policies"], out["contributions"]).select("id", "status", "contribution_status")


@query("backfill_documents", f"""
WITH {TQ._TITLE_CTE}, scored_in AS (SELECT titled.doc_id, titled.text, coalesce(named, plain) AS title, CASE d.lang WHEN 'en' THEN 'policy' WHEN 'fr' THEN 'news' ELSE 'unknown' END AS kind FROM titled JOIN documents d ON d.doc_id = titled.doc_id),
{TQ._sql_relevance(TQ.DOC_VOCABULARY, 'scored_in', {}, 'doc_id, kind')} SELECT doc_id, kind AS document_type, score_tenths, level, is_related, importable FROM relevance""")
def backfill_documents(spark, d):
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").withColumns({
        "title": X.infer_title(F.col("text"), none, none, none)["value"], "document_type": F.when(F.col("lang") == "en", "policy").when(F.col("lang") == "fr", "news").otherwise("")})
    out = merge.backfill_documents(docs, vocabulary=TQ.DOC_VOCABULARY)
    r = F.col("relevance")
    return out.select("doc_id", "document_type", F.round(r["score"] * 10).cast("bigint").alias("score_tenths"), r["level"].alias("level"), r["is_related"].alias("is_related"), r["importable"].alias("importable"))


_PATCH = f"""patch AS (SELECT {S('l_orderkey')} AS id, max(CASE WHEN l_returnflag = 'R' THEN concat('Title of ', {S('l_partkey')}) END) AS title, max(CASE WHEN l_tax > 0.05 THEN l_quantity * 3 END) AS rate FROM lineitem GROUP BY 1)"""


@query("patch_rows", f"""
WITH {cte('contributions')}, {_PATCH}, n AS (SELECT c.*, p.id AS pid, coalesce(p.title, c.title) AS new_title, coalesce(p.rate, c.rate) AS new_rate FROM contributions c LEFT JOIN patch p ON p.id = c.id),
v AS (SELECT *, pid IS NOT NULL AND NOT (coalesce(new_rate, 0) > 100 OR amount_type = 'odd' OR policy_level = 'area' OR coalesce(amount_value, 0) < 0 OR effective_from = '1998/01' OR (coalesce(effective_to, '') <> '' AND effective_from > effective_to) OR starts_with(source_url, 'ftp')) AS ok FROM n)
SELECT id, CASE WHEN ok THEN {_N('new_title')} ELSE title END AS title, CASE WHEN ok THEN new_rate ELSE rate END AS rate, pid IS NOT NULL AND NOT ok AS rejected FROM v""")
def patch_rows(spark, d):
    c = adapt(spark, d, "contributions").withColumns({"dedup_key": F.lit(None).cast("string"), "duplicate_of": F.lit(None).cast("string")})
    patches = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Title of "), F.col("l_partkey").cast("string")))).alias("title"), F.max(F.when(F.col("l_tax") > 0.05, F.col("l_quantity") * 3)).alias("rate"))
    merged, rejects = merge.patch_contributions(c, patches, AS_OF)
    flags = rejects.select("id", F.lit(True).alias("_r"))
    return merged.join(flags, "id", "left").select("id", "title", "rate", F.coalesce("_r", F.lit(False)).alias("rejected"))


@query("merge_fill", f"""
WITH {cte('contributions')}, x AS (SELECT {S('l_orderkey')} AS id, min(l_returnflag) AS issuer, max(l_tax) AS cap_amount, min(CASE WHEN l_linestatus = 'F' THEN '满1减1' ELSE '' END) AS rule_text FROM lineitem GROUP BY 1)
SELECT c.id, c.issuer, c.cap_amount, CASE WHEN coalesce(c.rule_text, '') = '' AND coalesce(x.rule_text, '') <> '' THEN x.rule_text ELSE c.rule_text END AS rule_text FROM contributions c LEFT JOIN x ON x.id = c.id""")
def merge_fill(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.min("l_returnflag").alias("issuer"), F.max("l_tax").alias("cap_amount"), F.min(F.when(F.col("l_linestatus") == "F", "满1减1").otherwise("")).alias("rule_text"))
    return merge.merge_extracted(adapt(spark, d, "contributions"), x).select("id", "issuer", "cap_amount", "rule_text")


@query("policy_edits", f"""
WITH {cte('policies', 'subsidy_rules')}, r1 AS (SELECT policy_id, min_by(cap_amount, id) AS cap_amount, min_by(id, id) AS rule_id, min_by(amount_type, id) AS amount_type FROM subsidy_rules GROUP BY policy_id),
x AS (SELECT concat('p', {S('l_orderkey')}) AS policy_id, max(concat('Edited ', {S('l_partkey')})) AS title, max(l_quantity) AS cap_amount FROM lineitem GROUP BY 1)
SELECT p.id, CASE WHEN x.policy_id IS NULL OR (p.effective_to <> '' AND p.effective_from > p.effective_to) THEN p.title ELSE x.title END AS title,
 CASE WHEN x.policy_id IS NULL THEN p.status WHEN p.effective_to <> '' AND p.effective_to < '{TODAY}' THEN 'expired' ELSE p.status END AS status, CASE WHEN x.policy_id IS NULL THEN r1.cap_amount ELSE x.cap_amount END AS cap_amount
FROM policies p LEFT JOIN r1 ON r1.policy_id = p.id LEFT JOIN x ON x.policy_id = p.id""")
def policy_edits(spark, d):
    empty = lambda df, names, kind="string": df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})
    p = empty(adapt(spark, d, "policies"), ("official_file_name", "doc_no", "policy_level", "funding_source", "description", "end_note", "jurisdiction_code"))
    r = ordering.first_per_key(adapt(spark, d, "subsidy_rules"), ["policy_id"], [F.col("id")], ["id", "category", "amount_type", "rate", "fixed_amount", "cap_amount", "rule_text"])
    r = empty(empty(empty(r, ("cap_unit", "rule_type", "conditions_text", "conditions_json")), ("threshold_amount", "discount_amount"), "double"), ("per_user_limit",), "int").withColumns({
        "stackable": F.lit(None).cast("boolean"), "created_at": F.lit(AS_OF).cast("timestamp")})
    patches = table(spark, d, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("policy_id")).agg(
        F.max(F.concat(F.lit("Edited "), F.col("l_partkey").cast("string"))).alias("title"), F.max("l_quantity").alias("cap_amount"))
    out = merge.apply_policy_edits(p, r, adapt(spark, d, "contributions"), patches, AS_OF)
    rules = out["rules"].select(F.col("policy_id").alias("id"), "cap_amount")
    return out["policies"].join(rules, "id", "left").select("id", "title", "status", "cap_amount")


@query("verify_policies", f"""
WITH {cte('policies')}, a AS (SELECT concat('p', {S('user_id')}) AS id, max_by({S('event_id')}, ts) AS who, max(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT p.id, CASE WHEN a.id IS NULL THEN p.verification_status ELSE 'verified' END AS verification_status, a.who AS verified_by, CAST(coalesce(a.at, p.updated_at) AS VARCHAR) AS updated_at FROM policies p LEFT JOIN a ON a.id = p.id""")
def verify_policies(spark, d):
    acts = table(spark, d, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("policy_id"), F.col("event_id").cast("string").alias("actor_id"), F.col("ts").alias("at"))
    p = adapt(spark, d, "policies").withColumns({"verified_at": F.lit(None).cast("timestamp_ntz"), "verified_by": F.lit(None).cast("string")})
    return merge.verify_policies(p, acts).select("id", "verification_status", "verified_by", F.col("updated_at").cast("string").alias("updated_at"))


@query("upsert_sources", f"""
WITH {cte('sources')}, x AS (SELECT {S('n_nationkey')} AS id, n_name AS name, concat('https://n', {S('n_nationkey')}, '.example.com/?ref=a') AS base_url FROM nation UNION ALL SELECT 'new', 'new source', 'https://x.example.com')
SELECT coalesce(s.id, x.id) AS id, coalesce(x.name, s.name) AS name, coalesce(replace(CASE WHEN x.base_url = 'https://x.example.com' THEN 'https://x.example.com/' ELSE x.base_url END, '?ref=a', ''), s.base_url) AS base_url, s.level FROM sources s FULL OUTER JOIN x ON x.id = s.id""")
def upsert_sources(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".example.com/?ref=a")).alias("base_url"))
    x = x.unionByName(spark.createDataFrame([("new", "new source", "https://x.example.com")], "id string, name string, base_url string"))
    s = adapt(spark, d, "sources").withColumn("updated_at", F.col("created_at"))
    return merge.upsert_sources(s, x, AS_OF).select("id", "name", "base_url", "level")


@query("attach_document", f"""
WITH {cte('contributions')}, l AS (SELECT {S('l_orderkey')} AS id, min(concat('d', {S('l_partkey')})) AS doc FROM lineitem GROUP BY 1) SELECT c.id, CASE WHEN c.status = 'draft' THEN c.document_id ELSE l.doc END AS document_id FROM contributions c LEFT JOIN l ON l.id = c.id""")
def attach_document(spark, d):
    c = adapt(spark, d, "contributions").withColumn("document_id", F.when(F.col("status") == "draft", F.col("document_id")))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("contribution_id"), F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("document_id"))
    return merge.attach_document(c, links).select("id", "document_id")


_GONE = "SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0"


@query("delete_parents", f"""
WITH {cte('contributions', 'users')} SELECT 'user' AS kind, id, '' AS parent FROM users WHERE id NOT IN ({_GONE}) UNION ALL SELECT 'contribution', id, CASE WHEN user_id IN ({_GONE}) THEN NULL ELSE user_id END FROM contributions
UNION ALL SELECT 'cascade', id, user_id FROM contributions WHERE user_id NOT IN ({_GONE})""")
def delete_parents(spark, d):
    users, contributions = adapt(spark, d, "users"), adapt(spark, d, "contributions")
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("id"))
    kept, cleared = merge.delete_parents(users, contributions, gone, "id", "user_id")
    _, cascaded = merge.delete_parents(users, contributions, gone, "id", "user_id", "cascade")
    row = lambda df, kind, parent: df.select(F.lit(kind).alias("kind"), "id", parent.alias("parent"))
    return row(kept, "user", F.lit("")).unionByName(row(cleared, "contribution", F.col("user_id"))).unionByName(row(cascaded, "cascade", F.col("user_id")))


@query("latest_rows", f"""
WITH f AS (SELECT {S('l_orderkey')} AS target, concat({S('l_orderkey')}, '-', {S('l_linenumber')}, '-', {S('l_partkey')}, '-', {S('l_suppkey')}) AS fid, concat('https://x/', {S('l_partkey')}) AS url, l_shipdate FROM lineitem),
l AS (SELECT target, max_by(url, (l_shipdate, fid)) AS url FROM f GROUP BY target) SELECT {S('o_orderkey')} AS id, coalesce(l.url, 'none') AS url FROM orders LEFT JOIN l ON l.target = {S('o_orderkey')}""")
def latest_rows(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("none").alias("url"), F.col("o_orderdate").alias("fetched_at"))
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    fetched = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("target_id"), F.concat_ws("-", *parts).alias("id"), F.concat(F.lit("https://x/"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_shipdate").alias("fetched_at"))
    return merge.apply_refetch(docs.unionByName(fetched.select("id", "url", "fetched_at")), fetched).select("id", "url")


@query("audit_events", f"""
WITH {cte('contributions')} SELECT 'contribution' AS entity_type, id AS entity_id, user_id AS actor_id, status AS action, concat('{{"category":"', category, '"}}') AS detail, '{AS_OF.replace('T', ' ')}' AS created_at FROM contributions""")
def audit_events(spark, d):
    out = merge.audit_events(adapt(spark, d, "contributions"), "contribution", "id", F.col("status"), AS_OF, F.col("user_id"), F.struct("category"))
    return out.drop("id").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# --- imports ---------------------------------------------------------------------------------

_SQL_KEY = lambda *cs: "list_filter([" + ", ".join(f"lower({sql_squeeze(sql_normalize(c))})" for c in cs) + "], lambda x: x <> '')"
_PLACE = "CASE " + " ".join(f"WHEN contains(title, '{s}') OR (NOT {any_contains('title', R.PROVINCE_NAMES)} AND contains(text, '{s}')) THEN '{f}'" for s, f in
                            sorted(((s, f) for f, s in R.PROVINCES), key=lambda x: -len(x[0]))) + " END"
_IMPORT = f"""{TQ._NOTICE_IN}, {TQ._sql_relevance(V.DEFAULT, 'scored_in', TQ._NOTICE_FIELDS, 'order_key, line_no, part_key, supp_key, kind, title, text')},
dated AS (SELECT *, {TQ.sql_group('text', X.DATE_RANGE, 0)} AS r, {TQ.sql_group('text', X.DATE_FROM, 0)} AS f, {TQ.sql_group('text', X.DATE_TO, 0)} AS t2 FROM relevance),
gated AS (SELECT *, CASE WHEN r IS NOT NULL THEN {TQ._sql_date('r', 1)} WHEN f IS NOT NULL THEN {TQ._sql_date('f', 1)} ELSE {TQ.sql_group('text', X.ISO_RANGE, 1)} END AS ef,
  CASE WHEN r IS NOT NULL THEN {TQ._sql_date('r', 4)} WHEN t2 IS NOT NULL THEN {TQ._sql_date('t2', 1)} ELSE {TQ.sql_group('text', X.ISO_RANGE, 2)} END AS et, {_PLACE} AS place, {TQ._ISSUER} AS issuer,
  concat_ws('-', {S('order_key')}, {S('line_no')}, {S('part_key')}, {S('supp_key')}) AS id,
  CASE WHEN NOT is_related THEN 'not related' WHEN kind NOT IN ('policy', 'implementation', 'notice') THEN 'document type needs confirmation' END AS gate FROM dated),
judged AS (SELECT *, coalesce(gate, CASE WHEN ef > et THEN '生效日期不能晚于截止日期' END) AS reject, sha256(array_to_string({_SQL_KEY('title', 'issuer', 'ef', 'place')}, '|')) AS dedup_key FROM gated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reject IS NULL, dedup_key ORDER BY line_no, id) AS rn, min_by(id, (line_no, id)) OVER (PARTITION BY reject IS NULL, dedup_key) AS first_id FROM judged)"""


def _import(spark, d):
    n = notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("order_key", "line_no", "part_key", "supp_key")])
    docs = V.score_relevance(X.extract_fields(n.withColumn("id", key)), "text", "title")
    docs = docs.withColumns({"url": F.lit(None).cast("string"), "canonical_url": F.lit(None).cast("string"), "document_title": F.lit(""), "created_at": F.col("line_no")})
    existing = spark.createDataFrame([], "id string, dedup_key string, created_at int")
    return imports.import_documents(docs, None, existing, AS_OF)


@query("import_documents", f"""
WITH {_IMPORT} SELECT id AS document_id, title, place AS jurisdiction_name, CASE WHEN place IN {in_list(R.MUNICIPALITIES)} THEN place WHEN contains(text, '甲乙市') THEN '甲乙市' ELSE '' END AS jurisdiction_city,
 CASE WHEN place NOT IN {in_list(R.MUNICIPALITIES)} AND contains(text, '甲乙市') THEN 'city' ELSE 'province' END AS policy_level, CASE WHEN et < '{TODAY}' THEN 'expired' ELSE 'active' END AS status, dedup_key
FROM ranked WHERE reject IS NULL AND rn = 1""")
def import_documents(spark, d):
    out = _import(spark, d)
    c = out["contributions"].select(F.col("id").alias("contribution_id"), "document_id", "dedup_key")
    return out["policies"].join(c, "contribution_id").select("document_id", "title", "jurisdiction_name", "jurisdiction_city", "policy_level", "status", "dedup_key")


@query("import_rejects", f"""
WITH {_IMPORT} SELECT id, reject AS reason FROM ranked WHERE reject IS NOT NULL UNION ALL SELECT id, 'duplicate' FROM ranked WHERE reject IS NULL AND rn > 1""")
def import_rejects(spark, d):
    out = _import(spark, d)
    copies = out["duplicates"].select(F.col("document_id").alias("id"), F.lit("duplicate").alias("reason"))
    return out["rejects"].select("id", F.array_join("errors", "|").alias("reason")).unionByName(copies)


@query("levels_and_status", f"""
WITH {cte('contributions')} SELECT id, CASE WHEN o_custkey % 4 = 0 THEN 'national' WHEN o_custkey % 4 = 1 THEN 'district' WHEN o_custkey % 4 = 2 THEN 'city' ELSE 'province' END AS level,
 CASE WHEN coalesce(effective_to, '') <> '' AND effective_to < '{TODAY}' THEN 'expired' ELSE 'active' END AS status FROM contributions JOIN orders ON {S('o_orderkey')} = id""")
def levels_and_status(spark, d):
    c = adapt(spark, d, "contributions")
    v = F.col("user_id").cast("bigint") % 4
    province = F.when(v == 0, "全国").otherwise("广东省")
    return c.select("id", policy_level(province, F.when(v == 2, "广州市").when(v == 3, "广东省").otherwise(""), F.when(v == 1, "天河区")).alias("level"), policy_status(F.col("effective_to"), TODAY).alias("status"))


# --- schedule --------------------------------------------------------------------------------

@query("due_sources", f"""
WITH {cte('sources')}, nx AS (SELECT {S('user_id')} AS id, max(ts) AS next_fetch_at FROM events GROUP BY 1)
SELECT s.id, CAST(n.next_fetch_at AS VARCHAR) AS next_fetch_at FROM sources s LEFT JOIN nx n ON n.id = s.id WHERE enabled AND access_method = 'scheduled' AND frequency <> 'manual' AND listing_url IS NOT NULL
 AND (n.next_fetch_at IS NULL OR n.next_fetch_at <= TIMESTAMP '2024-01-30 20:00:00') ORDER BY coalesce(n.next_fetch_at, s.created_at) NULLS FIRST, s.id LIMIT 10""")
def due_sources(spark, d):
    nx = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("ts").alias("next_fetch_at"))
    s = adapt(spark, d, "sources").withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).join(nx, "id", "left")
    return schedule.due_sources(s, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 10).select("id", F.col("next_fetch_at").cast("string").alias("next_fetch_at"))


@query("record_runs", f"""
WITH {cte('sources')}, r AS (SELECT {S('user_id')} AS id, max_by(event_type, ts) AS kind, max(ts) AS at, max(ts) FILTER (event_type <> 'error') AS ok_at FROM events GROUP BY 1)
SELECT s.id, CAST(r.ok_at AS VARCHAR) AS last_fetched_at, CAST(r.at + to_minutes(CASE WHEN s.interval_minutes IS NOT NULL THEN s.interval_minutes WHEN frequency = 'daily' THEN 1440 WHEN frequency = 'monthly' THEN 43200 ELSE 10080 END) AS VARCHAR) AS next_fetch_at,
 CASE WHEN r.kind = 'error' THEN 'failed' WHEN r.kind IS NOT NULL THEN 'success' END AS last_run_status, CASE WHEN r.kind = 'error' THEN 'error' END AS last_error FROM sources s LEFT JOIN r ON r.id = s.id""")
def record_runs(spark, d):
    none = lambda kind: F.lit(None).cast(kind)
    s = adapt(spark, d, "sources").withColumns({"last_fetched_at": none("timestamp_ntz"), "next_fetch_at": none("timestamp_ntz"), "last_run_status": none("string"), "last_error": none("string"), "updated_at": none("timestamp_ntz")})
    runs = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source_id"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("error"), F.col("ts").alias("at"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return schedule.record_runs(s, runs).select("id", text("last_fetched_at"), text("next_fetch_at"), "last_run_status", "last_error")


@query("polite_schedule", """
WITH o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, user_id, rn * 21600000000 + max(t - rn * 21600000000) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS start_us FROM o""")
def polite_schedule(spark, d):
    return schedule.polite_schedule(table(spark, d, "events"), "user_id", "ts", "event_id", 6 * 3600).select("event_id", "user_id", "start_us")


@query("throttle", """
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_id, user_id, t, rn, t AS ws, 1 AS n FROM o WHERE rn = 1
 UNION ALL SELECT o.event_id, o.user_id, o.t, o.rn, CASE WHEN w.ws + 86400000000 <= o.t THEN o.t ELSE w.ws END, CASE WHEN w.ws + 86400000000 <= o.t THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT event_id, user_id, ws AS window_start_us, CAST(n AS INTEGER) AS request_no, n <= 3 AS allowed, CASE WHEN n > 3 THEN CAST(ceil((ws + 86400000000 - t) / 1000000.0) AS BIGINT) END AS retry_after FROM w""")
def throttle(spark, d):
    out = schedule.throttle(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 86_400)
    return out.select("event_id", "user_id", "window_start_us", "request_no", "allowed", "retry_after")


@query("lines_to_records", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), k AS (SELECT doc_id, trim(line) AS v, i FROM l WHERE trim(line) <> ''),
n AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM k)
SELECT doc_id, n // 3 AS record_no, max(CASE WHEN n % 3 = 0 THEN md5(v) END) AS a, max(CASE WHEN n % 3 = 1 THEN md5(v) END) AS b, max(CASE WHEN n % 3 = 2 THEN md5(v) END) AS c FROM n GROUP BY ALL HAVING count(*) = 3""")
def records_of_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    out = lines_to_records(lines, ["a", "b", "c"], ["doc_id"], block=50)
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return out.select("doc_id", "record_no", md5("a"), md5("b"), md5("c"))
