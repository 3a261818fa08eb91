"""Driver tables seen as policy tables.

Every adapter is one SELECT list that both engines understand; Spark applies it with
``selectExpr`` and the SQL checks inline it as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import spread, table

DAY = "CAST(CAST({} AS DATE) AS STRING)"


def _case(expr: str, values: list[str]) -> str:
    branches = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {branches} END"


S = lambda c: f"CAST({c} AS STRING)"
ORDER_DAY = DAY.format("o_orderdate")
NEXT_YEAR = f"concat(CAST(extract(YEAR FROM o_orderdate) + 1 AS STRING), substr({ORDER_DAY}, 5, 6))"

PROVINCES = ["北京市", "上海市", "广东省", "江苏省", "浙江省", "内蒙古自治区", "黑龙江省", "四川省"]
SHORT = ["北京", "上海", "广东", "江苏", "浙江", "内蒙古", "黑龙江", "四川"]

ADAPTERS: dict[str, tuple[str, dict[str, str]]] = {
    "contributions": ("orders", {
        "id": S("o_orderkey"), "user_id": S("o_custkey"),
        "status": "CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'submitted' "
                  "WHEN o_orderstatus = 'O' THEN 'in_review' WHEN o_orderkey % 3 = 0 THEN 'changes_requested' WHEN o_orderkey % 3 = 1 THEN 'rejected' ELSE 'draft' END",
        "title": f"concat('Notice  ', o_orderpriority, ' for ', {S('o_custkey % 50')})",
        "program": "'consumer goods'", "policy_level": _case("o_custkey", ["national", "province", "city", "area"]),
        "issuer": f"concat('Office ', {S('o_custkey % 7')})", "funding_source": "CAST(NULL AS STRING)", "official_file_name": "CAST(NULL AS STRING)",
        "doc_no": f"CASE WHEN o_orderkey % 3 = 0 THEN concat('No ', {S('o_orderkey % 100')}) ELSE '' END",
        "description": "CAST(NULL AS STRING)", "end_note": "CAST(NULL AS STRING)", "document_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'policy' ELSE '' END",
        "jurisdiction_code": "CAST(NULL AS STRING)", "jurisdiction_name": _case("o_custkey", PROVINCES), "jurisdiction_city": "CAST(NULL AS STRING)",
        "jurisdiction_district": "CAST(NULL AS STRING)", "category": "o_orderpriority", "amount_type": _case("o_orderkey", ["percent", "fixed", "tiered", "other", "odd"]),
        "amount_value": "CASE WHEN o_orderkey % 5 = 1 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice - 5000 END",
        "rate": "CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_orderkey % 130 AS DOUBLE) END", "cap_amount": "o_totalprice",
        "cap_unit": "CAST(NULL AS STRING)", "rule_text": "CASE WHEN o_orderkey % 4 = 0 THEN '满 2000 减 300' ELSE '' END", "rule_type": "CAST(NULL AS STRING)",
        "threshold_amount": "CAST(NULL AS DOUBLE)", "discount_amount": "CAST(NULL AS DOUBLE)", "per_user_limit": "CAST(NULL AS INT)", "stackable": "CAST(NULL AS BOOLEAN)",
        "conditions_text": "CAST(NULL AS STRING)", "effective_from": f"CASE WHEN o_orderkey % 11 = 0 THEN '1998/01' ELSE {ORDER_DAY} END",
        "effective_to": f"CASE WHEN o_orderkey % 7 = 0 THEN '1990-01-01' WHEN o_orderkey % 4 = 1 THEN CAST(NULL AS STRING) ELSE {NEXT_YEAR} END",
        "source_url": f"CASE WHEN o_orderkey % 9 = 0 THEN 'ftp://files/x' WHEN o_orderkey % 9 = 1 THEN '' ELSE concat('https://www.example.com/o/', {S('o_orderkey')}, '#top') END",
        "notes": "CAST(NULL AS STRING)", "document_id": S("o_orderkey"), "created_at": "o_orderdate", "updated_at": "o_orderdate",
    }),
    "policies": ("orders", {
        "id": f"concat('p', {S('o_orderkey')})", "contribution_id": S("o_orderkey"), "title": f"concat('Notice ', o_orderpriority, ' for ', {S('o_custkey % 50')})",
        "issuer": f"concat('Office ', {S('o_custkey % 7')})", "program": "CASE WHEN o_orderkey % 2 = 0 THEN 'goods' ELSE 'vehicles' END",
        "document_type": _case("o_orderkey", ["policy", "implementation", "news", "", "unknown"]),
        "verification_status": "CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' ELSE CAST(NULL AS STRING) END",
        "jurisdiction_name": _case("o_custkey", PROVINCES), "jurisdiction_city": "CAST(NULL AS STRING)", "jurisdiction_district": "CAST(NULL AS STRING)",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'superseded' ELSE 'expired' END", "effective_from": ORDER_DAY,
        "effective_to": f"CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE {NEXT_YEAR} END",
        "source_url": f"CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('https://www.example.com/o/', {S('o_orderkey')}) END",
        "created_at": "o_orderdate", "updated_at": "o_orderdate",
    }),
    "subsidy_rules": ("lineitem", {
        "id": f"concat({S('l_orderkey')}, '-', {S('l_linenumber')}, '-', {S('l_partkey')}, '-', {S('l_suppkey')})", "policy_id": f"concat('p', {S('l_orderkey')})",
        "category": "CASE WHEN l_linenumber = 7 THEN '' ELSE concat(l_returnflag, l_linestatus) END", "amount_type": "CASE l_returnflag WHEN 'A' THEN 'percent' WHEN 'N' THEN 'fixed' ELSE 'tiered' END",
        "rate": "CASE WHEN l_returnflag = 'A' THEN CAST(round(l_discount * 100) AS DOUBLE) END", "fixed_amount": "CASE WHEN l_returnflag = 'N' AND l_quantity > 25 THEN l_quantity END",
        "cap_amount": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice END", "rule_text": "CASE WHEN l_quantity > 45 THEN '满1减1' ELSE '' END",
    }),
    "evidence": ("lineitem", {
        "id": f"concat({S('l_orderkey')}, '-', {S('l_linenumber')}, '-', {S('l_partkey')}, '-', {S('l_suppkey')})", "policy_id": f"concat('p', {S('l_orderkey')})",
        "field_name": "CASE l_linestatus WHEN 'O' THEN 'rate' ELSE 'cap_amount' END", "quote": f"concat('part ', {S('l_partkey')}, ' from ', {S('l_suppkey')})",
        "page_number": "CAST(NULL AS INT)", "confidence": "l_discount", "created_at": "l_shipdate",
    }),
    "sources": ("supplier", {
        "id": S("s_suppkey"), "name": "s_name", "level": _case("s_suppkey", ["national", "province", "city"]), "jurisdiction_name": f"concat('Region NATION_', {S('s_nationkey')})",
        "category": "'goods'", "keywords": "CAST(NULL AS STRING)", "base_url": f"concat('https://s', {S('s_suppkey')}, '.example.com/')",
        "listing_url": f"CASE WHEN s_suppkey % 10 = 0 THEN CAST(NULL AS STRING) ELSE concat('https://s', {S('s_suppkey')}, '.example.com/list') END", "source_type": "'html_listing'",
        "access_method": "CASE WHEN s_suppkey % 4 = 0 THEN 'manual' ELSE 'scheduled' END", "frequency": _case("s_suppkey", ["daily", "weekly", "monthly", "manual", "yearly"]),
        "enabled": "s_acctbal > 0", "interval_minutes": "CASE WHEN s_suppkey % 6 = 0 THEN 90 ELSE CAST(NULL AS INT) END", "created_at": "TIMESTAMP '2020-01-01 00:00:00'",
    }),
    "source_documents": ("lineitem", {"id": S("l_orderkey"), "source_id": S("l_suppkey"), "created_at": "l_shipdate"}),
    "users": ("customer", {
        "id": S("c_custkey"), "username": "lower(c_name)", "display_name": "c_name", "role": "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'reviewer' ELSE 'contributor' END",
        "status": "CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END", "created_at": f"concat('2020-01-0', {S('c_custkey % 9 + 1')})",
    }),
    "invites": ("supplier", {
        "id": S("s_suppkey"), "code": "s_name", "role": "'viewer'", "note": "CAST(NULL AS STRING)", "expires_at": "CAST(NULL AS STRING)",
        "used_by": "CASE WHEN s_suppkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE CAST(s_suppkey * 2 AS STRING) END", "used_at": "CAST(NULL AS STRING)", "disabled": "s_suppkey % 5 = 0",
        "created_by": S("s_nationkey"), "created_at": f"concat('2021-02-0', {S('s_suppkey % 9 + 1')})",
    }),
    "line_invites": ("lineitem", {
        "id": f"concat({S('l_orderkey')}, '-', {S('l_linenumber')})", "used_by": "CASE WHEN l_linenumber = 1 THEN CAST(NULL AS STRING) ELSE CAST(l_partkey AS STRING) END", "created_by": S("l_suppkey"),
    }),
    "comments": ("lineitem", {
        "id": f"concat('c', {S('l_orderkey')}, '-', {S('l_linenumber')}, '-', {S('l_partkey')})", "contribution_id": S("l_orderkey"), "user_id": S("l_suppkey"),
        "body": "concat(l_returnflag, l_linestatus)", "created_at": "l_shipdate",
    }),
    "aggregates": ("orders", {
        "jurisdiction_name": _case("o_custkey", PROVINCES), "program": "'goods'", "metric_type": _case("o_orderkey", ["driven_sales", "allocated_funds", "other"]), "amount_yuan": "o_totalprice",
        "count_value": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END", "unit": "'元'", "as_of_date": ORDER_DAY,
        "source_url": f"concat('https://www.example.com/o/', {S('o_orderkey')})", "quote": "o_orderpriority",
    }),
    "import_runs": ("events", {
        "pack_id": "event_type", "pack_version": "'1'", "pack_path": f"concat('packs/', {S('user_id')})", "summary_json": "props", "dry_run": "value > 50", "created_at": "ts",
    }),
    "audit": ("events", {
        "id": S("event_id"), "entity_type": "CASE event_type WHEN 'view' THEN 'source' ELSE 'contribution' END", "entity_id": S("user_id"), "actor_id": S("event_id % 200"),
        "action": "event_type", "detail": "props", "created_at": "ts",
    }),
}

_PCT = S("CAST(round(l_discount * 100) AS BIGINT)")
_CAP = S("CAST(floor(l_extendedprice) AS BIGINT)")
_QTY = "CAST(l_quantity AS BIGINT)"
_YEAR = S("extract(YEAR FROM o_orderdate)")


def _ymd(c: str) -> str:
    return f"concat({S(f'extract(YEAR FROM {c})')}, '年', {S(f'extract(MONTH FROM {c})')}, '月', {S(f'extract(DAY FROM {c})')}, '日')"


_PLACE = _case("l_suppkey", SHORT)
_GOODS = _case("l_partkey", ["汽车", "冰箱和空调", "手机", "拖拉机", "家具建材", "老旧电梯", "车辆及洗衣机"])
_KIND = _case("l_linenumber", ["实施细则", "补贴通知", "政策解读", "新闻发布会", "专题", "清单"])
TITLE = f"concat({_PLACE}, {_YEAR}, '年', {_GOODS}, '以旧换新', {_KIND})"
_AGENCY = _case("l_partkey", [f"商务厅发布", "财政部印发", "国家发展改革委公布", "甲乙市人民政府主办", "协会整理"])
_FUND = _case("l_suppkey", ["资金由中央财政资金承担", "资金由省财政安排", "市级财政负担", "资金来源另行公布", "另行安排"])
_AMOUNT = (
    f"CASE l_returnflag WHEN 'A' THEN concat('补贴标准为按销售价格的', {_PCT}, '%给予补贴，最高不超过', {_CAP}, '元。') "
    f"WHEN 'N' THEN concat('对购买者给出', {_PCT}, '%的价格优惠，每人每类可补贴', {S('l_linenumber')}, '件，上限为', {_CAP}, '元，不可叠加。') "
    f"ELSE concat('满 ', {S(_QTY + ' * 100')}, ' 减 ', {S(_QTY + ' * 10')}, '，满', {S(_QTY + ' * 200')}, '减', {S(_QTY + ' * 25')}, '，可叠加使用，每台补贴', {_CAP}, '元。') END"
)
_DATES = (
    f"CASE WHEN l_linestatus = 'O' THEN concat('本办法自', {_ymd('o_orderdate')}, '起施行，有效期至', {_ymd('l_shipdate')}, '。') "
    f"WHEN l_tax > 0.04 THEN concat('活动时间', {_ymd('o_orderdate')}, '起至', {_ymd('l_shipdate')}, '。') "
    f"ELSE concat('时间：', {DAY.format('o_orderdate')}, ' 至 ', {DAY.format('l_shipdate')}, '。') END"
)
_NUMBER = f"CASE WHEN l_tax > 0.02 THEN concat('商办流通函〔', {_YEAR}, '〕', {S('l_suppkey')}, '号') ELSE '无文号' END"
_END = "CASE WHEN l_tax > 0.06 THEN '资金用完即止，分档执行。' WHEN l_tax > 0.05 THEN '预算用完为止。' ELSE '长期有效。' END"
TEXT = (
    f"concat({TITLE}, '\n', {_NUMBER}, '\n', {_PLACE}, {_AGENCY}, '，', {_FUND}, '。\n申领条件：消费者须实名购买', {_GOODS}, '并保留发票。', {_AMOUNT}, '\n', {_DATES}, {_END})"
)
NOTICE = {
    "order_key": "l_orderkey", "line_no": "l_linenumber", "part_key": "l_partkey", "supp_key": "l_suppkey", "title": TITLE, "text": TEXT,
    "end_text": f"CASE WHEN l_tax > 0.06 THEN '额度用完提前截止' WHEN l_tax > 0.03 THEN concat({DAY.format('l_shipdate')}, ' 或额度用完') ELSE {DAY.format('l_shipdate')} END",
    "cap_text": f"CASE WHEN l_returnflag = 'R' THEN concat({_CAP}, ' 元 / 单') ELSE concat('每件', {_CAP}, '元') END",
    "rate_text": f"concat('家电 ', {_PCT}, '%/ 数码 ', {S('l_linenumber')}, ' %')", "month": f"substr({DAY.format('o_orderdate')}, 1, CASE WHEN l_linenumber = 3 THEN 10 ELSE 7 END)",
    "official": f"CASE WHEN l_linenumber = 1 THEN '宝山区商务局云闪付公告' WHEN l_linenumber = 2 THEN concat('商办〔2026〕', {S('l_suppkey')}, '号') ELSE '关于补贴的通知有有有有' END",
}


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = ADAPTERS[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{expr} AS {alias}" for alias, expr in columns.items()])


def notices(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Policy sentences rendered from line items and their orders (an equality join on the order)."""
    joined = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(*[f"{NOTICE[c]} AS {c}" for c in columns or NOTICE])


def cte(*names: str) -> str:
    """``name AS (SELECT ...)`` entries for a WITH clause."""
    parts = []
    for name in names:
        if name == "notices":
            body, source = NOTICE, "lineitem JOIN orders ON l_orderkey = o_orderkey"
        else:
            source, body = ADAPTERS[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{e} AS {a}" for a, e in body.items()) + f" FROM {source})")
    return ", ".join(parts)
