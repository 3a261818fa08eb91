"""Exports, reasons, pack validation, splits, views and overrides over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import PROVINCES, adapt, notices
from checks.registry import query, quoted, table, write_files
from checks.table_queries import _export_sql
from checks.text_queries import _NOTICE_FIELDS, _NOTICE_IN, GEO_CITIES, GEO_DISTRICTS, _sql_relevance
from policylake.functions import extract as X
from policylake.functions import geo as G
from policylake.functions import relevance as V
from policylake.functions import text as T
from policylake.operators import exports, validation
from policylake.operators.snapshots import SnapshotTable, store_new
from policylake.session import new_folder
from policylake.sources.files import snapshot_manifest
from policylake.streaming import documents as SD
from policylake.streaming.throttle import ROCKSDB, stream_throttle

# --- exports ---------------------------------------------------------------------------------


@query("export_aggregates", _export_sql("aggregates", "aggregates", ("aggregates",)))
def export_aggregates(spark, d):
    return exports.export_aggregates(adapt(spark, d, "aggregates"))


@query("export_import_runs", _export_sql("import_runs", "import_runs", ("import_runs",)))
def export_import_runs(spark, d):
    return exports.export_import_runs(adapt(spark, d, "import_runs"))


# --- relevance reasons -----------------------------------------------------------------------

_REASON_FLAGS = {"s_title": "st", "s_head": "sh", "policy": "pol", "amount": _NOTICE_FIELDS["amount"], "date": _NOTICE_FIELDS["date"], "doc_no": _NOTICE_FIELDS["doc_no"], "neg": "negt"}
_REASONS = ", ".join(f"CASE WHEN {flag} THEN {quoted(V.REASONS[name])} END" for name, flag in _REASON_FLAGS.items())


@query("relevance_reasons", f"""
WITH {_NOTICE_IN}, {_sql_relevance(V.DEFAULT, 'scored_in', _NOTICE_FIELDS, 'order_key, line_no, part_key, supp_key')},
r AS (SELECT order_key, line_no, part_key, supp_key, st, sh, list_filter([{_REASONS}], lambda x: x IS NOT NULL) AS rs, {_NOTICE_FIELDS['doc_no']} AS has_no, {_NOTICE_FIELDS['issuer']} AS has_issuer FROM rel_done)
SELECT order_key, line_no, part_key, supp_key, st AS in_title, sh AS in_head, array_to_string(rs, '|') AS reasons, CASE WHEN len(rs) > 0 THEN array_to_string(rs, '；') END AS summary, has_no AS signal_doc_no, has_issuer AS signal_issuer FROM r""")
def relevance_reasons(spark, d):
    names = ("title", "document_type", "doc_no", "issuer", "funding_source", "category", "rate", "amount_value", "cap_amount", "rule_text", "effective_from", "effective_to")
    e = X.extract_fields(notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text"), fields=names)
    r = F.col("relevance")
    signal = lambda name: F.coalesce(F.map_contains_key(r["signals"], F.lit(name)), F.lit(False))
    return V.score_relevance(e, "text", "title").select(
        "order_key", "line_no", "part_key", "supp_key", r["strong_in_title"].alias("in_title"), r["strong_in_head"].alias("in_head"), F.array_join(r["reasons"], "|").alias("reasons"),
        F.when(F.size(r["reasons"]) > 0, r["summary"]).alias("summary"), signal("docNo").alias("signal_doc_no"), signal("issuer").alias("signal_issuer"))


@query("published_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 3 THEN NULL
  ELSE concat(lpad(CAST(o_orderkey % 90 + 1950 AS VARCHAR), 4, '0'), '-', lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0'), '-', lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0')) END AS published_at FROM orders""")
def published_date(spark, d):
    k = F.col("o_orderkey")
    day = F.concat((k % 90 + 1950).cast("string"), F.lit("年"), (k % 12 + 1).cast("string"), F.lit("月"), (k % 28 + 1).cast("string"), F.lit("日"))
    text = F.when(k % 4 == 3, F.concat(F.lit("截止"), day)).when(k % 4 == 2, F.concat(F.lit("通知\n印发日期:　"), day)).otherwise(F.concat(F.lit("发布时间： "), day, F.lit("\n正文")))
    cell = X.published_at(text, F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("o_orderpriority"))))
    return table(spark, d, "orders").select("o_orderkey", cell["value"].alias("published_at"))


# --- geography -------------------------------------------------------------------------------

_PICKED = lambda items: "([" + ", ".join(quoted(x) for x in items) + "])[c_custkey % 8 + 1]"


@query("geo_split", f"""
WITH p AS (SELECT c_custkey, c_custkey % 3 AS v, {_PICKED(PROVINCES)} AS p, {_PICKED(GEO_CITIES)} AS c, {_PICKED(GEO_DISTRICTS)} AS d FROM customer)
SELECT c_custkey, CASE WHEN v = 2 THEN '全国' WHEN p IN ('北京市', '上海市') THEN substr(p, 1, 2) ELSE p END AS province,
  CASE WHEN v = 2 THEN '' WHEN p IN ('北京市', '上海市') THEN p WHEN v = 0 THEN c ELSE '' END AS city,
  CASE WHEN v = 2 THEN '' WHEN p = '内蒙古自治区' THEN p WHEN v = 0 THEN d ELSE '' END AS district FROM p""")
def geo_split(spark, d):
    pick = lambda items: F.nullif(F.get(F.array(*map(F.lit, items)), F.col("c_custkey") % 8), F.lit(""))
    v = F.col("c_custkey") % 3
    name = F.when(v == 2, " 全国 ").when(v == 1, pick(PROVINCES)).otherwise(F.concat_ws("/", pick(PROVINCES), pick(GEO_CITIES), pick(GEO_DISTRICTS)))
    return table(spark, d, "customer").select("c_custkey", G.split_geo_name(name).alias("s")).select("c_custkey", "s.province", "s.city", "s.district")


# --- validation ------------------------------------------------------------------------------

def _rows(cases: dict[str, str], source: str, key: str) -> str:
    """One row for each message whose condition holds."""
    return " UNION ALL ".join(f"SELECT {key} AS row_index, {message} AS error FROM {source} WHERE {test}" for message, test in cases.items())


def _said(label: str, key: str, tail: str) -> str:
    return f"concat('{label}[', CAST({key} AS VARCHAR), ']{tail}')"


@query("statistics_validation", _rows({
    _said("aggregates", "o_orderkey", ".jurisdictionName 必填"): "o_orderkey % 7 = 0", _said("aggregates", "o_orderkey", ".metricType 不合法"): "o_orderkey % 5 = 0",
    _said("aggregates", "o_orderkey", ".asOfDate 格式错误"): "o_orderkey % 4 = 1", _said("aggregates", "o_orderkey", ".sourceUrl 必须是政府官网地址"): "o_orderkey % 3 = 2",
    _said("aggregates", "o_orderkey", ".amountYuan 必须是非负数"): "o_totalprice < 150000", _said("aggregates", "o_orderkey", ".countValue 必须是非负数"): "o_orderkey % 11 = 0",
}, "orders", "o_orderkey"))
def statistics_validation(spark, d):
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(
        k.alias("row_index"), F.when(k % 14 == 0, "").when(k % 7 != 0, "全国").alias("jurisdictionName"), F.when(k % 5 != 0, "driven_sales").otherwise("sales").alias("metricType"),
        F.when(k % 4 == 1, "2026-1-1").otherwise("2026-01-01").alias("asOfDate"), F.when(k % 3 == 2, "https://gov.cn.example.com/").otherwise("https://www.x.gov.cn/y").alias("sourceUrl"),
        (F.col("o_totalprice") - 150_000).alias("amountYuan"), F.when(k % 11 == 0, float("inf")).when(k % 2 == 0, 1.0).alias("countValue"))
    return validation.validate_statistics(df)


@query("source_validation", _rows({
    _said("sources", "s_suppkey", ".name 必填"): "s_suppkey % 4 = 0", _said("sources", "s_suppkey", ".level 不合法"): "s_suppkey % 3 = 0", _said("sources", "s_suppkey", ".baseUrl 必须是政府官网地址"): "s_suppkey % 5 = 0",
}, "supplier", "s_suppkey"))
def source_validation(spark, d):
    k = F.col("s_suppkey")
    df = table(spark, d, "supplier").select(
        k.alias("row_index"), F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.when(k % 3 == 0, "village").otherwise("city").alias("level"),
        F.when(k % 5 == 0, "http://gov.cn.org/").when(k % 5 == 1, "").when(k % 5 == 2, "http://a.gov.cn").alias("baseUrl"))
    return validation.validate_sources(df)


@query("pack_validation", _rows({
    _said("policies", "o_orderkey", ".title 必填"): "o_orderkey % 9 = 0", _said("policies", "o_orderkey", ".level 不合法"): "o_orderkey % 8 = 1", _said("policies", "o_orderkey", ".issuer 必填"): "o_orderkey % 10 = 3",
    _said("policies", "o_orderkey", ".rate 必须在 0-100"): "o_orderkey % 130 > 100", _said("policies", "o_orderkey", ".capAmount 必须是非负数"): "o_totalprice < 100000",
    _said("policies", "o_orderkey", ".effectiveTo 格式错误"): "o_orderkey % 6 = 2", _said("policies", "o_orderkey", ".evidence 至少需要一条引文"): "o_orderkey % 7 = 0",
    _said("policies", "o_orderkey", ".evidence[1].quote 必填"): "o_orderkey % 7 = 1",
}, "orders", "o_orderkey"))
def pack_validation(spark, d):
    k = F.col("o_orderkey")
    quote = lambda text: F.struct(F.lit("rate").alias("fieldName"), text.alias("quote"), F.lit(0.9).alias("confidence"))
    df = table(spark, d, "orders").select(
        k.alias("row_index"), k.cast("string").alias("externalId"), F.when(k % 9 != 0, F.lit("t")).alias("title"), F.lit("p").alias("program"), F.when(k % 8 == 1, "town").otherwise("city").alias("level"),
        F.when(k % 10 == 3, "").otherwise("i").alias("issuer"), F.lit("全国").alias("jurisdictionName"), F.lit("c").alias("category"), F.lit("percent").alias("amountType"),
        F.lit("https://www.a.gov.cn/").alias("sourceUrl"), F.lit("2026-01-01").alias("effectiveFrom"), F.when(k % 6 == 2, "2026").when(k % 6 == 3, "").alias("effectiveTo"),
        (k % 130).cast("double").alias("rate"), (F.col("o_totalprice") - 100_000).alias("capAmount"),
        F.when(k % 7 == 0, F.array().cast("array<struct<fieldName:string,quote:string,confidence:double>>")).otherwise(F.array(quote(F.lit("q")), quote(F.when(k % 7 == 1, "").otherwise("r")))).alias("evidence"))
    return validation.validate_policies(df)


@query("required_columns", "SELECT p_partkey AS row_index, 'p_name 必填' AS error FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'p_brand 必填' FROM part WHERE p_size % 3 = 0")
def required_columns(spark, d):
    size = F.col("p_size")
    p = table(spark, d, "part").withColumns({"row_index": F.col("p_partkey"), "p_name": F.when(size % 4 == 0, " \t").otherwise(F.col("p_name")), "p_brand": F.when(size % 3 != 0, F.col("p_brand"))})
    return validation.require_columns(p, ["p_name", "p_brand"])


# --- views and overrides ---------------------------------------------------------------------

@query("table_view", """
SELECT event_id AS "eventId", user_id AS "userId", event_type = 'error' AS "isError", CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def table_view(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", 1).alias("is_error"), "props")
    return T.to_view(e, {"props": "decoded struct<k:bigint>"}, ("is_error",)).select("eventId", "userId", "isError", "decoded.k")


@query("overrides", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(p_brand) WHEN 1 THEN '' ELSE CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END END AS title,
  CASE p_partkey % 4 WHEN 2 THEN 'x' WHEN 1 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size FROM part""")
def overrides(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    given = (F.when(k % 4 == 0, F.create_map(F.lit("title"), F.concat(F.lit(" "), "p_brand", F.lit(" ")))).when(k % 4 == 1, F.create_map(F.lit("title"), none, F.lit("size"), none))
             .when(k % 4 == 2, F.create_map(F.lit("size"), F.lit("x"))))
    p = table(spark, d, "part").withColumn("first", F.when(k % 3 != 0, F.col("p_name")).otherwise(" "))
    return T.apply_overrides(p, given, {"title": [F.col("first"), F.col("p_type")]}, {"size": F.col("p_size")}).select("p_partkey", "title", "size")


# --- tables on disk --------------------------------------------------------------------------

# The customers who ordered on the last day get that day as their comment; two new ones come.
@query("bucket_merge", """
WITH last AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) GROUP BY o_custkey)
SELECT c_custkey, c_name, CASE WHEN spent IS NULL THEN c_acctbal ELSE round(spent, 2) END AS c_acctbal, c_mktsegment FROM customer LEFT JOIN last ON o_custkey = c_custkey
UNION ALL SELECT -o_custkey, 'new', round(spent, 2), NULL FROM last""")
def bucket_merge(spark, d):
    orders = table(spark, d, "orders")
    day = orders.agg(F.max("o_orderdate").alias("o_orderdate"))
    last = orders.join(day, "o_orderdate", "left_semi").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    none = F.lit(None).cast("string")
    changes = last.select(F.col("o_custkey").alias("c_custkey"), none.alias("c_name"), "c_acctbal").union(last.select(-F.col("o_custkey"), F.lit("new"), "c_acctbal"))
    customers = SnapshotTable(new_folder(spark, "customers"), ["c_custkey"], 64)
    customers.create(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    customers.merge(changes, default="patch_if_present")
    return customers.read(spark)


@query("snapshot_store", """
WITH s AS (SELECT sha256(text) AS hash, strlen(text) AS byte_size, doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS batch FROM documents)
SELECT hash, min_by(byte_size, (batch, doc_id)) AS byte_size, min((batch, doc_id)).doc_id AS doc_id FROM s GROUP BY hash""".replace("min((batch, doc_id)).doc_id", "min_by(doc_id, (batch, doc_id))"))
def snapshot_store(spark, d):
    """English documents arrive first, then all of them, then all again."""
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id"))
    docs = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content"), F.lit("a.txt").alias("name"), F.lit("text/plain").alias("mime"), at.alias("fetched_at"), "lang")
    path = new_folder(spark, "snapshots")
    for batch in (docs.filter("lang = 'en'"), docs, docs):
        stored = store_new(snapshot_manifest(batch, "content", "name", "mime", "fetched_at"), path)
    return stored.select("hash", F.col("byte_size").cast("bigint").alias("byte_size"), (F.unix_micros("fetched_at") - 1704067200000000).alias("doc_id"))


# --- streams ---------------------------------------------------------------------------------

@query("stream_documents", """
SELECT DISTINCT sha256(concat(url, chr(10))) AS content_hash, md5(url) AS text_md5 FROM pages""")
def stream_documents(spark, d):
    """Every page's URL arrives as a file of its own, those of even pages twice; each content is recognised once."""
    arriving, out = new_folder(spark, "arriving"), new_folder(spark, "recognised")
    pages = table(spark, d, "pages").select("page_id", "url")
    copies = pages.filter("page_id % 2 = 0").select(-1 - F.col("page_id"), "url")
    write_files(pages.union(copies), "url", arriving)
    write = lambda docs, batch: docs.select("content_hash", F.md5(F.trim(F.regexp_replace("text", "\n$", ""))).alias("text_md5")).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    stream = SD.read_file_stream(spark, arriving, files_per_batch=100_000)
    SD.stream_documents(stream, write, new_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("content_hash", "text_md5")


@query("stream_throttle", """
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_id, user_id, t, rn, t AS ws, 1 AS n FROM o WHERE rn = 1
 UNION ALL SELECT o.event_id, o.user_id, o.t, o.rn, CASE WHEN w.ws + 3600000000 <= o.t THEN o.t ELSE w.ws END, CASE WHEN w.ws + 3600000000 <= o.t THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT event_id, user_id, ws AS window_start_us, CAST(n AS BIGINT) AS request_no, n <= 1 AS allowed FROM w""")
def stream_throttle_query(spark, d):
    out, name = new_folder(spark, "throttled"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        schema = table(spark, d, "events").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        decided = stream_throttle(stream, "user_id", "ts", "event_id", 1, 3600)
        decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out).select("event_id", "user_id", "window_start_us", "request_no", "allowed")
