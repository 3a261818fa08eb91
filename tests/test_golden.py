"""Golden cases: a sample page, threshold rules, validation, dedup keys, relevance and geography."""

import pytest
from pyspark.sql import functions as F

from policylake.functions import extract as X
from policylake.functions import text as T
from policylake.functions.geo import infer_geo, normalize_city, normalize_district, normalize_province, split_geo_name
from policylake.functions.keys import dedup_key
from policylake.functions.relevance import score_relevance
from policylake.operators.validation import validate_contributions
from policylake.sources.html import page_struct, unescape

from conftest import one

PAGE = """<html><head><title>江苏省 2025 年绿色建材下乡&middot;实施方案</title>
<meta content='2025-02-07' name='PubDate'/><script>if (a < b) { document.write("</p>"); }</script></head>
<body><!-- <a href="/hidden">不算</a> --><h1>江苏省2025年绿色建材下乡实施方案</h1>
<div>省财政厅、省住建厅联合印发。资金来源：省级财政统筹。</div>
<ul><li>农村居民选购节水马桶、复合地板、节能门窗的，按成交价的12%给予补贴。</li><li>每户累计不超过3600元。</li></ul>
<div>本方案从2025年2月20日起执行，截止日期为2025年11月30日。</div>
<div>申请人须为本省户籍，凭购货单与发票到乡镇窗口登记。</div>
<a data-href="/wrong" class=more href='/zc/2025/list.html?a=1&amp;b=2'>江苏省家装厨卫&#8220;焕新&#x201D;补贴通知</a> <A HREF=/zc/index>目录</A></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(PAGE,)], "html string").select(page_struct("html").alias("p")).select("p.*")


@pytest.fixture(scope="module")
def sample(page):
    out = X.extract_fields(page.withColumnRenamed("title", "page_title"), "text", heading=F.col("heading"), title=F.col("page_title"), published=F.col("published_at_meta"))
    return score_relevance(X.envelope(out)).collect()[0].asDict(recursive=True)


def test_page_parts(page):
    got = page.first()
    assert [tuple(x) for x in got["links"]] == [("/zc/2025/list.html?a=1&b=2", "江苏省家装厨卫“焕新”补贴通知"), ("/zc/index", "目录")]
    assert got["published_at_meta"] == "2025-02-07" and got["title"] == "江苏省 2025 年绿色建材下乡·实施方案" and got["og_title"] == ""
    assert 'document.write("</p>")' in got["text"] and "不算" not in got["text"]


@pytest.mark.parametrize("raw, text", [
    ("a &amp;lt; b", "a &lt; b"), ("&#65;&#x42;&nosuch;&eacute;&", "AB&nosuch;é&"), ("&#0;&#xD800;&#1114112;", "\ufffd\ufffd\ufffd"), ("x & y; &#; &#x;", "x & y; &#; &#x;"), ("", ""),
])
def test_references(spark, raw, text):
    assert spark.createDataFrame([(raw,)], "t string").select(unescape("t")).first()[0] == text


@pytest.mark.parametrize("field, value", [
    ("status", "processed"), ("rate", 12.0), ("cap_amount", 3600.0), ("jurisdiction_name", "江苏"), ("effective_from", "2025-02-20"), ("effective_to", "2025-11-30"),
    ("title", "江苏省2025年绿色建材下乡实施方案"), ("document_type", "implementation"), ("issuer", "财政厅"), ("published_at", "2025-02-07"), ("amount_type", "percent"),
    ("rule_type", "percentage"), ("cap_unit", "元/户"), ("per_user_limit", None), ("stackable", None), ("end_note", None), ("doc_no", None),
])
def test_sample_fields(sample, field, value):
    assert sample[field] == value


def test_sample_details(sample):
    assert sample["fields"]["rate"]["confidence"] == 0.88
    names = {e["field_name"] for e in sample["evidence"]}
    assert "rate" in names and "conditions" not in names and "categories" not in names


def test_threshold_rules(spark):
    df = X.extract_fields(spark.createDataFrame([("满 2000 减 300、满 5000 减 800",)], "text string"), "text")
    got = one(df, "amount_type", "cap_amount", "threshold_amount", "discount_amount", "rule_type", "rule_text")
    assert got == ("tiered", 800.0, 2000.0, 300.0, "full_reduction", "满 2000 减 300、满 5000 减 800")


@pytest.mark.parametrize("text, dates", [
    ("自2026年1月2日起至2026年3月4日", ("2026-01-02", "2026-03-04")), ("2026年5月6日起实施", ("2026-05-06", None)),
    ("截止日期为2026年7月8日", (None, "2026-07-08")), ("2026-01-01 至 2026-02-02", ("2026-01-01", "2026-02-02")), ("无日期", (None, None)),
    ("有效期至2026年13月40日", (None, "2026-13-40")),
])
def test_dates(spark, text, dates):
    df = spark.createDataFrame([(text,)], "t string").select(X.effective_dates(F.col("t")).alias("d"))
    assert one(df, "d.from.value", "d.to.value") == dates


@pytest.mark.parametrize("text, rate", [
    ("给予增值税13%的减免", None), ("给予10.5%的支持", 10.5), ("发放 8% 额度的补贴", 8.0), ("按贷款利率3%", None), ("增值税税率按13%计", 13.0),
])
def test_rate_guard(spark, text, rate):
    got = spark.createDataFrame([(text,)], "t string").select(X.percentage(F.col("t"))["value"]).first()[0]
    assert got == rate


def test_validation_reports_range_and_order(spark):
    df = spark.createDataFrame([("测试补贴政策", "percent", 150.0, "2026-12-31", "2026-01-01")], "title string, amount_type string, rate double, effective_from string, effective_to string")
    errors = validate_contributions(df).first()["errors"]
    assert len(errors) == 2 and any("0-100" in e for e in errors) and any("生效日期" in e for e in errors)


def test_dedup_key_ignores_white_space(spark):
    df = spark.createDataFrame([(" 广东省 2026 年家电以旧换新实施细则 ",), ("广东省2026年家电以旧换新实施细则",), ("",)], "t string")
    keys = [r[0] for r in df.select(dedup_key("t", F.when(F.col("t") != "", "广东省商务厅"), F.lit(None), F.when(F.col("t") != "", "2026-04-01"))).collect()]
    assert keys[0] == keys[1] != "" and keys[2] == ""


def test_relevance_levels(spark):
    df = spark.createDataFrame([("消费品以旧换新补贴实施细则，对家电产品给予补贴。", "2026年家电以旧换新补贴通知"), ("本公司提供软件开发和技术咨询服务。", None)], "text string, title string")
    good, bad = [r["relevance"] for r in score_relevance(df).collect()]
    assert good["is_related"] and good["score"] >= 20 and not bad["is_related"] and bad["level"] == "none"
    assert bad["summary"] == "未发现国补相关关键词"


def test_filter_on_relevance_keeps_the_plan_small(spark):
    df = spark.createDataFrame([("消费品以旧换新补贴", "以旧换新通知")], "text string, title string")
    plan = score_relevance(df).filter("relevance.is_related")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000


@pytest.mark.parametrize("given, expected", [
    (("广州市广州市", "", ""), ("广东省", "广州市", "")), (("上海", "上海市", "宝山区"), ("上海市", "上海市", "宝山区")),
    (("安徽省", "安庆市", ""), ("安徽省", "安庆市", "")), (("全国", "广州市", "天河区"), ("全国", "", "")), (("浙江", "广州市", ""), ("浙江省", "", "")),
])
def test_geography(spark, given, expected):
    df = spark.createDataFrame([given], "n string, c string, d string")
    assert one(infer_geo(df, "n", "c", "d"), "province", "city", "district") == expected


def test_geo_parts(spark):
    df = spark.createDataFrame([("江苏省/苏州市人民政府",)], "n string")
    got = one(df.select(normalize_province("n").alias("p"), normalize_city("n", F.lit("江苏省")).alias("c"), normalize_district(F.lit("苏州市虎丘区")).alias("d"),
                        split_geo_name(F.lit("江苏省/苏州市/园区")).alias("s")), "p", "c", "d", "s.city", "s.district")
    assert got == ("江苏省", "苏州市", "虎丘区", "苏州市", "园区")


def test_text_functions(spark):
    df = spark.createDataFrame([("　a \t b\n\n\n\nc　",)], "t string")
    assert one(df.select(T.clean_text("t").alias("a"), T.compact("t", 4).alias("b"), T.normalize_text("t").alias("c"), T.squeeze("t").alias("d")), "a", "b", "c", "d") == ("a b\n\nc", "a b ", "a b c", "abc")
    titles = spark.createDataFrame([("家电补贴通知_政策文件_首页",), ("家电补贴通知 - 中国政府网",), ("家电 - 说明",)], "t string").select(T.clean_title("t"))
    assert [r[0] for r in titles.collect()] == ["家电补贴通知", "家电补贴通知", "家电 - 说明"]


def test_overrides(spark):
    df = spark.createDataFrame([({"a": None, "b": " x "}, "stored", "kept")], "o map<string,string>, a string, c string")
    out = T.apply_overrides(df, F.col("o"), {"b": [F.col("a")], "z": [F.lit(" "), F.col("c")], "a": [F.col("a")]}, {"v": F.lit(None).cast("string")})
    assert one(out, "a", "b", "z", "v") == ("", "x", "kept", None)


def test_view_names(spark):
    df = spark.createDataFrame([("1", 1, '{"a":2}', None)], "id string, is_on int, extracted_json string, bad_json string")
    view = T.to_view(df, {"extracted_json": "extracted struct<a:int>", "bad_json": "bad struct<a:int>"}, ("is_on",))
    assert view.columns == ["id", "isOn", "extracted", "bad"] and one(view, "isOn", "extracted.a", "bad") == (True, 2, None)


@pytest.mark.parametrize("page, text, links", [
    ('<a href="1">one <a href="2">two</a>', "one two", [("1", "one"), ("2", "two")]),
    ('<a href="1" title="a>b">one</a>', "one", [("1", "one")]),
    ('<img alt="a>b">x', "x", []),
    ("a &amp b &ampx &copy; &#38 &#x26;&#0; &nosuch; &lt", "a & b &x © & &� &nosuch; <", []),
    ('<a href="?a=1&copy=2&amp;b=3&lt">q</a>', "q", [("?a=1&copy=2&b=3<", "q")]),
    ("<a href=1>x<td>y</a>", "xy", [("1", "x")]),
    ("<a href>n</a><a HREF = 'v' href=w>m</a>x < y", "nmx < y", [("v", "m")]),
    ("\x01 keep <!-- open <a href=1>x</a>", "\x01 keep", []),
    ("<script>if (a<b) '<a href=1>'</script ><style>p>a{}</style>z", "if (a<b) '<a href=1>'p>a{}z", []),
    ('<a x="' + "y" * 9 + ' href=1>never closed', "", []),
    ("<a " + " ".join(f'a{i}="{i}>"' for i in range(50_000)) + " href=x>big</a>", "big", [("x", "big")]),
    ("<a " * 50_000, "", []),
    ("<b>" * 50_000 + "<a href=u>" * 50_000 + "end", "end", [("u", ""), ("u", "end")]),
])
def test_odd_markup(spark, page, text, links):
    got = spark.createDataFrame([(page,)], "html string").select(page_struct("html").alias("p")).select("p.*").first()
    assert (got["text"], [tuple(x) for x in got["links"]]) == (text, links)


def test_first_of_each_meta_and_title(spark):
    page = "<!-- <title>old</title> --><title>new</title><meta property=og:title><meta content='og' property='og:title'><meta content='' name=PubDate><meta name=publishdate content=d2><h1>He<b>l</b>lo"
    got = spark.createDataFrame([(page,)], "html string").select(page_struct("html").alias("p")).select("p.*").first()
    assert (got["title"], got["heading"], got["og_title"], got["published_at_meta"]) == ("new", "Hello", "og", "")


def test_cells_evaluate_their_patterns_once(spark):
    """``nullif`` in branches and lambdas ran nested patterns many times over; odd places keep the matches of the full patterns."""
    from policylake.functions import extract as X

    texts = ["商办〔2026〕12号", "文一二三四五六七八九十甲乙[2026] 第3 号", "自12026年1月2日起至2027年3月4日", "x自  　2026年1月2日至 2026年3月4日", "于\t2026年1月2日起施行，至2026年5月6日",
             "税 7.5 %，按12.5%补贴", "每户3元", "补 5元", "国家发改委财政厅", "市场监管总局", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    full = lambda pattern, i=0: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    dates = X.effective_dates(t)
    start = F.when(full(X.DATE_RANGE).isNull(), full(X.DATE_FROM))
    pairs = {"doc_no": (X.doc_number(t)["value"], full(X.DOC_NO, 1)), "issuer": (X.issuer(t)["value"], full(X.ISSUER, 1)), "fixed": (X.fixed_amount(t)["quote"], full(X.FIXED)),
             "from": (dates["from"]["quote"], X.T.compact(F.coalesce(full(X.DATE_RANGE), start))), "rate": (X.percentage(t)["quote"], F.coalesce(full(X.RATE_PREFIX), full(X.RATE_SUFFIX)))}
    for name, (got, want) in pairs.items():
        rows = df.select("t", got.alias("got"), want.alias("want")).collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows], name
    plan = df.select(X.doc_number(t).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(t#") == 1
