"""Packs, seeds, examples, bulk rows, maintenance and files over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import PROVINCES, S, _case, adapt, cte
from checks.registry import query, table, write_files
from policylake import rules as R
from policylake import schemas
from policylake.functions.extract import envelope
from policylake.functions.keys import content_hash, dedup_key
from policylake.operators import exports, imports, merge
from policylake.session import new_folder
from policylake.sources import files, packs

AS_OF = "2026-06-01T00:00:00"


def _empty(spark, ddl):
    return spark.createDataFrame([], ddl)


# --- packs and seeds -------------------------------------------------------------------------

_ITEMS = """items AS (SELECT DISTINCT concat('Notice ', p_type, ' ', p_brand) AS title, concat('Office ', p_size % 7) AS issuer, concat('2026-01-', lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')) AS day,
  p_size % 28 AS n, p_type, p_brand FROM part WHERE p_size % 28 >= 5),
counts AS (SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey >= 5) AS s, (SELECT count(*) FROM items) AS p, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate >= '1995-01-01') AS a)"""


@query("import_pack", f"""
WITH {_ITEMS}
SELECT DISTINCT 'source' AS kind, concat('Source ', s_nationkey) AS a, 'province' AS b, 'weekly' AS c FROM supplier WHERE s_nationkey >= 5
UNION ALL SELECT 'policy', title, concat_ws('|', issuer, day, 'pending'), CASE WHEN n > 14 THEN 'expired' ELSE 'active' END FROM items
UNION ALL SELECT 'rule', p_type, 'percent', CAST(n AS VARCHAR) FROM items
UNION ALL SELECT 'evidence', 'rate', concat('q ', p_brand), '90' FROM items UNION ALL SELECT 'evidence', 'cap', p_type, '80' FROM items
UNION ALL SELECT DISTINCT 'aggregate', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'driven_sales', CAST(extract(DAY FROM o_orderdate) AS VARCHAR) FROM orders WHERE o_orderdate >= '1995-01-01'
UNION ALL SELECT 'run', 'pk', '7', concat('{{"pack_id":"pk","version":"7","sources":', s, ',"policies":', p, ',"aggregates":', a, ',"dry_run":false}}') FROM counts""")
def import_pack(spark, d):
    """The pack is written as files, read, validated and imported over what is stored already."""
    path = new_folder(spark, "pack")
    none = F.lit(None).cast("string")
    manifest = spark.range(1).select(F.lit("pk").alias("packId"), F.lit("7").alias("version"), F.struct(F.lit("s.json").alias("sources"), F.lit("p.json").alias("policies"), F.lit("a.json").alias("aggregates")).alias("files"))
    part, size = table(spark, d, "part"), F.col("p_size") % 28
    quote = lambda name, text, c: F.struct(F.lit(name).alias("fieldName"), text.alias("quote"), F.lit(c).alias("confidence"))
    policies = part.select(
        F.col("p_partkey").cast("string").alias("externalId"), F.concat(F.lit("Notice "), "p_type", F.lit(" "), "p_brand").alias("title"), F.lit("goods").alias("program"), F.lit("national").alias("level"),
        F.concat(F.lit("Office "), (F.col("p_size") % 7).cast("string")).alias("issuer"), F.lit("全国").alias("jurisdictionName"), F.col("p_type").alias("category"), F.lit("percent").alias("amountType"),
        size.cast("double").alias("rate"), F.concat(F.lit("2026-01-"), F.lpad((size + 1).cast("string"), 2, "0")).alias("effectiveFrom"), F.when(size > 14, "2026-03-01").otherwise("").alias("effectiveTo"),
        F.lit("https://www.gov.cn/x").alias("sourceUrl"), F.array(quote("rate", F.concat(F.lit("q "), "p_brand"), 0.9), quote("cap", F.col("p_type"), 0.8)).alias("evidence"))
    sources = table(spark, d, "supplier").select(F.concat(F.lit("Source "), F.col("s_nationkey").cast("string")).alias("name"), F.lit("province").alias("level"), F.lit("https://a.gov.cn/").alias("baseUrl"), "s_nationkey")
    day = F.col("o_orderdate").cast("date")
    aggregates = table(spark, d, "orders").select(F.lit("全国").alias("jurisdictionName"), F.lit("driven_sales").alias("metricType"), day.cast("string").alias("asOfDate"), F.lit("https://www.gov.cn/y").alias("sourceUrl"),
                                                  F.dayofmonth(day).cast("double").alias("countValue"))
    for name, rows in (("manifest.json", manifest), ("s.json", sources.drop("s_nationkey")), ("p.json", policies), ("a.json", aggregates)):
        one = F.to_json(F.struct("*"))
        many = rows.select(F.pmod(F.xxhash64(F.struct("*")), F.lit(16)).alias("k"), one.alias("row")).groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
        (rows.select(one) if name == "manifest.json" else many.repartition("k")).write.mode("overwrite").partitionBy(*[] if name == "manifest.json" else ["k"]).text(f"{path}/{name}")
    pack = packs.read_pack(spark, path)
    stored = {
        "sources": sources.filter("s_nationkey < 5").select("name"), "contributions": policies.filter(size < 5).select(dedup_key("title", "issuer", "effectiveFrom", "jurisdictionName").alias("dedup_key")),
        "aggregates": aggregates.filter("asOfDate < '1995-01-01'").select(F.col("metricType").alias("metric_type"), F.col("asOfDate").alias("as_of_date"), F.col("sourceUrl").alias("source_url"), F.col("jurisdictionName").alias("jurisdiction_name"))}
    out = imports.import_pack(pack, stored, AS_OF, path)
    row = lambda df, kind, a, b, c: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.cast("string").alias("c"))
    c = F.col
    parts = [
        row(out["sources"], "source", c("name"), c("level"), c("frequency")), row(out["policies"], "policy", c("title"), F.concat_ws("|", "issuer", "effective_from", "verification_status"), c("status")),
        row(out["rules"], "rule", c("category"), c("amount_type"), c("rate").cast("int")), row(out["evidence"], "evidence", c("field_name"), c("quote"), F.round(c("confidence") * 100).cast("int")),
        row(out["aggregates"], "aggregate", c("as_of_date"), c("metric_type"), c("count_value").cast("int")), row(out["import_runs"], "run", c("pack_id"), c("pack_version"), c("summary_json")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union


@query("import_seed", """
WITH items AS (SELECT DISTINCT concat('Seed ', p_type) AS title, p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part WHERE p_brand <> 'Brand#1')
SELECT 'policy' AS kind, title AS a, concat_ws('|', p_brand, 'national', '全国', '2026-01-01') AS b, 'active' AS c FROM items UNION ALL SELECT 'rule', 'goods', 'percent', CAST(n AS VARCHAR) FROM items
UNION ALL SELECT 'evidence', 'rate', concat('quote ', p_brand), '98' FROM items UNION ALL SELECT 'evidence', 'cap_amount', concat('quote ', p_brand), '98' FROM items""")
def import_seed(spark, d):
    c, lit = F.col, F.lit
    items = table(spark, d, "part").select(
        F.concat(lit("Seed "), "p_type").alias("title"), c("p_brand").alias("issuer"), lit("goods").alias("category"), F.substr("p_brand", lit(7)).cast("double").alias("rate"), lit(100.0).alias("cap_amount"),
        lit("https://www.gov.cn/x").alias("source_url"), lit("").alias("funding_source"), lit("n").alias("notes"), F.concat(lit("quote "), "p_brand").alias("quote"))
    stored = items.filter("issuer = 'Brand#1'").select(dedup_key("title", "issuer", lit("2026-01-01"), lit(R.NATIONAL)).alias("dedup_key"))
    out = imports.import_seed(items, stored, AS_OF)
    row = lambda df, kind, a, b, v: df.select(lit(kind).alias("kind"), a.alias("a"), b.alias("b"), v.cast("string").alias("c"))
    return row(out["policies"], "policy", c("title"), F.concat_ws("|", "issuer", "policy_level", "jurisdiction_name", "effective_from"), c("status")).union(
        row(out["rules"], "rule", c("category"), c("amount_type"), c("rate").cast("int"))).union(row(out["evidence"], "evidence", c("field_name"), c("quote"), F.round(c("confidence") * 100).cast("int")))


# Two records have a known id and patch the oldest policy of that title; of equal others the smallest id comes in, if it isn't stored.
_KNOWN = {"5": "red widget", "7": "small ring", "8": "no such title"}
_PROVINCE = _case("o_custkey", PROVINCES)


@query("import_examples", f"""
WITH records AS (SELECT {S('o_orderkey')} AS id, concat('Example ', o_custkey % 40) AS title, {_PROVINCE} AS province, o_orderkey, o_orderpriority AS funding, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
hit AS (SELECT DISTINCT p_name FROM part), known(id, title) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _KNOWN.items())}),
patched AS (SELECT r.* FROM records r JOIN known k ON k.id = r.id JOIN hit ON hit.p_name = k.title),
rest AS (SELECT * FROM records WHERE id NOT IN (SELECT id FROM patched)),
first AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY title, month, province ORDER BY id) = 1),
fresh AS (SELECT * FROM first WHERE NOT (title = 'Example 3'))
SELECT 'policy' AS kind, concat_ws('|', title, month, province) AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'notice' ELSE 'policy' END AS b, CASE o_orderkey % 2 WHEN 0 THEN 'city' ELSE 'province' END AS c FROM fresh
UNION ALL SELECT 'rule', concat_ws('|', title, month, province), CASE WHEN o_orderkey % 3 = 0 THEN 'tiered' WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'percent' END, NULL FROM fresh
UNION ALL SELECT 'patched', k.title, r.funding, NULL FROM patched r JOIN known k ON k.id = r.id
UNION ALL SELECT 'outcome', concat_ws('|', (SELECT count(*) FROM records), (SELECT count(*) FROM fresh), (SELECT count(*) FROM patched), (SELECT count(*) FROM rest) - (SELECT count(*) FROM fresh)), NULL, NULL""")
def import_examples(spark, d):
    c, lit, k = F.col, F.lit, F.col("o_orderkey")
    o = table(spark, d, "orders")
    records = o.select(
        k.cast("string").alias("externalId"), F.concat(lit("Example "), (c("o_custkey") % 40).cast("string")).alias("title"), c("o_orderpriority").alias("fundingSource"), c("o_orderstatus").alias("category"),
        F.expr(_PROVINCE).alias("province"), F.when(k % 2 == 0, "苏州市").otherwise("").alias("city"), lit("").alias("district"), F.when(k % 3 == 0, "满 2000 减 300").otherwise("x").alias("ruleText"),
        F.when(k % 5 != 0, 10.0).alias("rate"), lit(300.0).alias("capAmount"), lit("元/单").alias("capUnit"), F.date_format("o_orderdate", "yyyy-MM").alias("effectiveFrom"), lit(None).cast("string").alias("effectiveTo"),
        lit("e").alias("endNote"), lit("f").alias("officialFileName"), lit("").alias("docNo"), lit("n").alias("notes"))
    stored = records.filter("title = 'Example 3'").select(dedup_key("title", lit(imports.EXAMPLE_SOURCE), "effectiveFrom", "province").alias("dedup_key"))
    wide = lambda df, ddl: df.select(*[c(f.name) if f.name in df.columns else lit(None).cast(f.dataType).alias(f.name) for f in _empty(spark, ddl).schema])
    part = table(spark, d, "part")
    policies = wide(part.select(c("p_partkey").cast("string").alias("id"), c("p_name").alias("title"), F.timestamp_seconds("p_size").alias("created_at")), schemas.POLICIES)
    rules = wide(part.select(c("p_partkey").cast("string").alias("id"), c("p_partkey").cast("string").alias("policy_id")), schemas.SUBSIDY_RULES)
    out = imports.import_examples(records, policies, rules, stored, _KNOWN, AS_OF)
    row = lambda df, kind, a, b, v: df.select(lit(kind).alias("kind"), a.alias("a"), b.cast("string").alias("b"), v.cast("string").alias("c"))
    key, none = F.concat_ws("|", "title", "effective_from", "jurisdiction_name"), lit(None)
    named = out["new_rules"].join(out["new_policies"].select(c("id").alias("policy_id"), key.alias("_key")), "policy_id")
    return row(out["new_policies"], "policy", key, c("document_type"), c("policy_level")).union(row(named, "rule", c("_key"), c("amount_type"), none)).union(
        row(out["policies"].filter("funding_source IS NOT NULL"), "patched", c("title"), c("funding_source"), none)).union(
        row(out["outcomes"], "outcome", F.concat_ws("|", *[c(n).cast("string") for n in ("parsed", "imported", "updated", "skipped")]), none, none))


# --- bulk rows and exports -------------------------------------------------------------------

@query("bulk_rows", """
SELECT f.fmt, nullif(concat('Bulk ', c_name), '') AS title, nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END, '') AS category, CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE CAST(c_nationkey AS VARCHAR) END AS rate
FROM customer, (VALUES ('csv'), ('json')) f(fmt)""")
def bulk_rows(spark, d):
    """The same rows as CSV with padded headers and cells, and as JSON with camel-case names."""
    n = F.col("c_custkey")
    name, kind = F.concat(F.lit("Bulk "), "c_name"), F.when(n % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    rate = F.when(n % 5 == 0, "0").otherwise(F.col("c_nationkey").cast("string"))
    csv, json = new_folder(spark, "bulk"), new_folder(spark, "bulk")
    rows = table(spark, d, "customer")
    rows.select(F.concat(F.lit("  "), name, F.lit(" ")).alias(" title "), kind.alias("category "), rate.alias("rate")).write.option("header", "true").csv(csv)
    array = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(name.alias("title"), kind.alias("category"), rate.alias("rate")))), ","), F.lit("]")).alias("value")
    rows.groupBy((n % 8).alias("k")).agg(array).repartition("k").write.partitionBy("k").text(json)
    read = [packs.read_contributions(spark, path, fmt).select(F.lit(fmt).alias("fmt"), "title", "category", "rate") for path, fmt in ((csv, "csv"), (json, "json"))]
    return read[0].union(read[1])


@query("export_files", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat('{"lang":"', lang, '","n":', n_chars, '}') AS about, concat('a "', source, '", b\\c; ', lang) AS said FROM documents""")
def export_files(spark, d):
    """An export written as CSV, with quotes, commas and nested values, and read again."""
    path = new_folder(spark, "export")
    said = F.concat(F.lit('a "'), "source", F.lit('", b\\c; '), "lang")
    exports.write_export(table(spark, d, "documents").select("doc_id", F.struct("lang", F.col("n_chars").alias("n")).alias("about"), said.alias("said")), path)
    return spark.read.option("header", "true").option("escape", '"').csv(path)


# --- files -----------------------------------------------------------------------------------

@query("read_files", "SELECT DISTINCT sha256(concat(url, chr(10))) AS content_hash, CAST(strlen(url) + 1 AS BIGINT) AS length, 'text' AS kind, md5(concat(url, chr(10))) AS decoded_md5 FROM pages")
def read_files(spark, d):
    """Every page's URL as a file: listed, routed, hashed and decoded."""
    path = new_folder(spark, "files")
    write_files(table(spark, d, "pages"), "url", path)
    read = files.decode_bytes_df(files.route_documents(files.read_files(spark, path, "*.txt")))
    return read.select(content_hash("content").alias("content_hash"), F.col("length").cast("bigint").alias("length"), "kind", F.md5("decoded").alias("decoded_md5")).distinct()


# Files of three kinds in one frame; cells with quotes, commas and line ends, blank rows, a broken file.
@query("parse_documents", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('a | b', chr(10), text, ' | ', lang, chr(10), source, ' | "x" | ') WHEN 1 THEN concat('[', chr(10), '  {', chr(10), '    "lang": "', lang, '",', chr(10), '    "n": ', n_chars, chr(10), '  },', chr(10), '  null', chr(10), ']')
  WHEN 2 THEN text ELSE '' END AS text, CASE WHEN doc_id % 4 = 0 THEN 3 END AS row_count, CASE WHEN doc_id % 4 = 1 THEN 2 END AS record_count, doc_id % 4 = 3 AS failed FROM documents""")
def parse_documents(spark, d):
    n, q = F.col("doc_id") % 4, lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = F.concat(F.lit("a,b\r\n"), q(F.col("text")), F.lit(","), "lang", F.lit("\r\n\r\n"), "source", F.lit(',"""x""",'))
    docs = table(spark, d, "documents").withColumns({
        "decoded": F.when(n == 0, rows).when(n == 1, F.concat(F.lit('[{"lang":"'), "lang", F.lit('","n":'), F.col("n_chars").cast("string"), F.lit("},null]"))).when(n == 2, F.col("text")).otherwise("{broken"),
        "kind": F.when(n == 0, "csv").when(n == 2, "text").otherwise("json")}).drop("text")
    return files.parse_documents(docs).select("doc_id", "text", "row_count", "record_count", F.col("error").isNotNull().alias("failed"))


@query("envelope", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 7 = 0 OR text = '' THEN 'ocr_required' ELSE 'processed' END AS status, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS text_chars,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, 50) END AS text FROM documents""")
def envelope_query(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(n % 7 != 0, F.col("text")).alias("text"), F.when(n % 5 == 0, "broken").alias("error"))
    return envelope(docs, "text", "error", max_chars=50).select("doc_id", "status", F.col("text_chars").cast("bigint").alias("text_chars"), "text")


# --- maintenance -----------------------------------------------------------------------------

_PARSED = f"""parsed AS (SELECT {S('o_orderkey')} AS contribution_id, CASE o_orderkey % 4 WHEN 0 THEN '满 2000 减 300' WHEN 1 THEN '' END AS rule_text, CASE WHEN o_orderkey % 5 = 0 THEN '10' END AS rate,
  CASE WHEN o_orderkey % 6 = 0 THEN 'plan' END AS document_type FROM orders WHERE o_orderkey % 9 <> 0)"""


def _backfilled(spark, d):
    k = F.col("o_orderkey")
    none = lambda kind: F.lit(None).cast(kind)
    parsed = table(spark, d, "orders").filter(k % 9 != 0).select(
        k.cast("string").alias("contribution_id"), F.when(k % 4 == 0, "满 2000 减 300").when(k % 4 == 1, "").alias("rule_text"), F.when(k % 5 == 0, "10").alias("rate"), F.when(k % 6 == 0, "plan").alias("document_type"))
    policies = adapt(spark, d, "policies").withColumn("description", F.lit("d"))
    rules = adapt(spark, d, "subsidy_rules").withColumns({"rule_type": none("string"), "threshold_amount": none("double"), "discount_amount": none("double"), "per_user_limit": none("int"),
                                                         "stackable": none("boolean"), "conditions_text": none("string")})
    return merge.backfill_policies(policies, rules, adapt(spark, d, "contributions").withColumn("dedup_key", none("string")), parsed, AS_OF)


@query("backfill_policies", f"""
WITH {cte('policies')}, {_PARSED}
SELECT p.id, coalesce(e.document_type, nullif(p.document_type, ''), 'unknown') AS document_type, coalesce(p.verification_status, 'pending') AS verification_status FROM policies p LEFT JOIN parsed e ON e.contribution_id = p.contribution_id""")
def backfill_policies(spark, d):
    return _backfilled(spark, d)["policies"].select("id", "document_type", "verification_status")


@query("backfill_rules", f"""
WITH {cte('policies', 'subsidy_rules')}, {_PARSED},
x AS (SELECT r.id, r.rate, r.fixed_amount, e.rate AS erate, coalesce(nullif(e.rule_text, ''), r.rule_text, '') AS t FROM subsidy_rules r JOIN policies p ON p.id = r.policy_id LEFT JOIN parsed e ON e.contribution_id = p.contribution_id)
SELECT id, CASE WHEN t <> '' THEN 'full_reduction' WHEN erate IS NOT NULL OR rate IS NOT NULL THEN 'percentage' WHEN fixed_amount IS NOT NULL THEN 'fixed' ELSE 'unknown' END AS rule_type,
  CASE t WHEN '满1减1' THEN 1.0 WHEN '' THEN NULL ELSE 2000.0 END::DOUBLE AS threshold_amount, CASE t WHEN '满1减1' THEN 1.0 WHEN '' THEN NULL ELSE 300.0 END::DOUBLE AS discount_amount, 'd' AS conditions_text FROM x
UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM subsidy_rules WHERE policy_id NOT IN (SELECT id FROM policies)""")
def backfill_rules(spark, d):
    return _backfilled(spark, d)["rules"].select("id", "rule_type", "threshold_amount", "discount_amount", "conditions_text")


_PATCHES = {"small": {"doc_no": "No 1", "description": "first", "cap_unit": "each"}, "red": {"doc_no": None, "description": "second", "cap_unit": "set"}, "absent": {"doc_no": "No 3"}}


@query("curate", """
WITH hits AS (SELECT pattern, p_partkey FROM part JOIN (VALUES ('small'), ('red')) v(pattern) ON contains(lower(p_name), pattern) QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY p_size, CAST(p_partkey AS VARCHAR)) = 1)
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE pattern WHEN 'small' THEN 'No 1' WHEN 'red' THEN NULL ELSE 'old' END AS doc_no, CASE pattern WHEN 'small' THEN 'first' WHEN 'red' THEN 'second' END AS description,
  CASE pattern WHEN 'small' THEN 'each' WHEN 'red' THEN 'set' END AS cap_unit, CASE pattern WHEN 'small' THEN '{"curated":true,"description":"first"}' WHEN 'red' THEN '{"curated":true,"description":"second"}' END AS conditions_json
FROM part LEFT JOIN hits USING (p_partkey)""")
def curate(spark, d):
    c, none = F.col, F.lit(None).cast("string")
    part = table(spark, d, "part")
    policies = part.select(c("p_partkey").cast("string").alias("id"), c("p_name").alias("title"), F.lit(R.NATIONAL).alias("jurisdiction_name"), F.lit("old").alias("doc_no"), none.alias("description"),
                           c("p_size").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    rules = part.select(c("p_partkey").cast("string").alias("id"), c("p_partkey").cast("string").alias("policy_id"), none.alias("cap_unit"), none.alias("conditions_json"))
    out = merge.curate(policies, rules, _PATCHES, AS_OF)
    return out["policies"].join(out["rules"].select(c("policy_id").alias("id"), "cap_unit", "conditions_json"), "id").select("id", "doc_no", "description", "cap_unit", "conditions_json")
