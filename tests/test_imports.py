"""Write path: document import with and without overrides, packs, seeds, examples, edits."""

import pytest
from pyspark.sql import functions as F

from policylake import rules as R
from policylake import schemas as S
from policylake.functions import geo as G
from policylake.functions import text as T
from policylake.operators import imports, merge, reports, validation
from policylake.plans.corpus import files_to_policies, recognise_pages
from policylake.sources import files
from policylake.streaming.documents import recognise

from conftest import rows
from test_golden import PAGE

AS_OF = "2026-06-01T00:00:00"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_files_to_policies(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.html").write_text(PAGE.replace("<body>", "<body> "))
    (tmp_path / "c.txt").write_text("本公司提供软件开发和技术咨询服务。")
    out = files_to_policies(files.read_files(spark, str(tmp_path)), empty(spark, S.CONTRIBUTIONS), AS_OF)
    policies = out["policies"].collect()
    assert len(policies) == 1 and policies[0]["title"] == "江苏省2025年绿色建材下乡实施方案"
    assert (policies[0]["jurisdiction_name"], policies[0]["policy_level"], policies[0]["status"]) == ("江苏省", "province", "expired")
    assert out["duplicates"].count() == 1
    assert [r["errors"] for r in out["rejects"].collect()] == [["not related"]]
    rule = out["rules"].first()
    assert (rule["rate"], rule["cap_amount"], rule["fixed_amount"], rule["rule_type"]) == (12.0, 3600.0, rule["fixed_amount"], "percentage")
    assert out["evidence"].filter("field_name = 'rate'").count() == 1 and out["events"].first()["action"] == "imported_as_policy"
    again = files_to_policies(files.read_files(spark, str(tmp_path)), out["contributions"], AS_OF)
    assert again["policies"].count() == 0 and again["duplicates"].count() == 2


def test_forced_import_with_overrides(spark, tmp_path):
    (tmp_path / "c.txt").write_text("本公司提供软件开发和技术咨询服务。")
    docs = recognise(files.read_files(spark, str(tmp_path))).withColumns({
        "id": F.col("content_hash"), "url": F.lit("https://x.sh.gov.cn/a#t"), "canonical_url": F.lit(None).cast("string"), "document_title": F.col("page_title"), "created_at": F.col("modificationTime")})
    values = {"force": "true", "title": "宝山区家电券", "jurisdiction_name": "上海", "jurisdiction_city": "上海市", "jurisdiction_district": "宝山区", "rate": "10", "effective_to": "2026-01-31"}
    overrides = docs.select(F.col("id").alias("document_id"), F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).alias("values"))
    out = imports.import_documents(docs, overrides, empty(spark, S.CONTRIBUTIONS), AS_OF)
    p = out["policies"].first()
    assert (p["jurisdiction_name"], p["jurisdiction_city"], p["jurisdiction_district"], p["policy_level"]) == ("上海市", "上海市", "宝山区", "district")
    assert (p["verification_status"], p["status"], p["source_url"]) == ("pending", "expired", "https://x.sh.gov.cn/a")
    assert out["evidence"].filter("field_name = 'manual_review'").count() == 1 and out["rules"].first()["rate"] == 10.0
    bad = overrides.withColumn("values", F.map_concat("values", F.create_map(F.lit("rate2"), F.lit("1")))).withColumn(
        "values", F.map_filter("values", lambda k, v: k != "rate")).withColumn("values", F.map_concat("values", F.create_map(F.lit("rate"), F.lit("150"))))
    rejected = imports.import_documents(docs, bad, empty(spark, S.CONTRIBUTIONS), AS_OF)["rejects"].first()
    assert any("0-100" in e for e in rejected["errors"])


def pack(spark, **changes):
    policy = {"externalId": "e1", "title": "家电补贴", "program": "p", "level": "national", "issuer": "商务部", "jurisdictionName": "全国", "category": "家电", "amountType": "percent",
              "rate": 15.0, "effectiveFrom": "2026-01-01", "effectiveTo": "2026-03-01", "sourceUrl": "https://www.gov.cn/x", "evidence": [("rate", "15%", 0.9), ("cap", "1500元", 0.9)]}
    policy.update(changes)
    names = [f.split(" ")[0] for f in "externalId title program level issuer jurisdictionName category amountType rate amountValue capAmount effectiveFrom effectiveTo sourceUrl notes fundingSource evidence".split()]
    one = tuple(policy.get(n) for n in names)
    return {
        "manifest": spark.createDataFrame([("pk", "1", "t", "d", "2026", "official", ("s.json", "p.json", "a.json"))], S.PACK_MANIFEST),
        "sources": spark.createDataFrame([("商务部", "national", "全国", "https://www.mofcom.gov.cn/", None, None, None, None)], S.PACK_SOURCE),
        "policies": spark.createDataFrame([one, one], S.PACK_POLICY),
        "aggregates": spark.createDataFrame([("全国", "p", "driven_sales", 1e9, None, None, "2026-02-01", "https://www.gov.cn/y", "q")], S.PACK_AGGREGATE),
    }


def test_pack_import_is_idempotent_and_dry_runs_write_nothing(spark):
    existing = {"sources": empty(spark, S.SOURCES), "contributions": empty(spark, S.CONTRIBUTIONS), "aggregates": empty(spark, S.AGGREGATES)}
    out = imports.import_pack(pack(spark), existing, AS_OF, "packs/pk")
    assert tuple(out["summary"].first())[2:] == (1, 1, 1)
    assert out["policies"].first()["status"] == "expired" and out["evidence"].count() == 2 and out["import_runs"].count() == 1
    again = imports.import_pack(pack(spark), {"sources": out["sources"], "contributions": out["contributions"], "aggregates": out["aggregates"]}, AS_OF)
    assert tuple(again["summary"].first())[2:] == (0, 0, 0)
    dry = imports.import_pack(pack(spark), existing, AS_OF, dry_run=True)
    assert tuple(dry["summary"].first())[2:] == (1, 1, 1) and dry["policies"].count() == 0 and dry["import_runs"].count() == 0


@pytest.mark.parametrize("change, message", [
    ({"sourceUrl": "https://example.com"}, "policies[0].sourceUrl 必须是政府官网地址"), ({"level": "town"}, "policies[0].level 不合法"), ({"rate": 101.0}, "policies[0].rate 必须在 0-100"),
    ({"evidence": []}, "policies[0].evidence 至少需要一条引文"), ({"evidence": [("rate", "", 0.9)]}, "policies[0].evidence[0].quote 必填"), ({"effectiveFrom": None}, "policies[0].effectiveFrom 格式错误"),
])
def test_pack_errors_abort(spark, change, message):
    broken = pack(spark, **change)
    broken["policies"] = broken["policies"].limit(1)
    existing = {"sources": empty(spark, S.SOURCES), "contributions": empty(spark, S.CONTRIBUTIONS), "aggregates": empty(spark, S.AGGREGATES)}
    with pytest.raises(validation.ValidationError) as problem:
        imports.import_pack(broken, existing, AS_OF)
    assert message in str(problem.value)


def test_pack_files(spark, tmp_path):
    import json

    from policylake.sources.packs import read_pack
    parts = pack(spark)
    (tmp_path / "manifest.json").write_text(json.dumps({"packId": "pk", "version": "1", "files": {"sources": "s.json", "policies": "p.json", "aggregates": "a.json"}}))
    for name, key in (("s.json", "sources"), ("p.json", "policies"), ("a.json", "aggregates")):
        (tmp_path / name).write_text("[" + ",\n".join(parts[key].toJSON().collect()) + "]")
    read = read_pack(spark, str(tmp_path))
    assert read["policies"].count() == 2 and read["policies"].first()["evidence"][1]["quote"] == "1500元" and read["manifest"].first()["packId"] == "pk"


def test_seed_and_examples(spark):
    items = spark.createDataFrame([("2026年家电补贴", "商务部", "家电", 15.0, 1500.0, "https://www.gov.cn/a", "中央", "n", "补贴15%")],
                                  "title string, issuer string, category string, rate double, cap_amount double, source_url string, funding_source string, notes string, quote string")
    seed = imports.import_seed(items, empty(spark, S.CONTRIBUTIONS), AS_OF)
    assert rows(seed["evidence"].select("field_name", "quote")) == [("cap_amount", "补贴15%"), ("rate", "补贴15%")]
    wide = lambda df, schema: df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])
    policies, rules = wide(seed["policies"], S.POLICIES), wide(seed["rules"], S.SUBSIDY_RULES)
    rec = lambda i, title, rule: (i, title, "市级财政", "家电", "江苏省", "苏州市", "", rule, None, 300.0, "元/单", "2026-03-01", None, "额度用完截止", "公告", "", "n")
    records = spark.createDataFrame([rec("1", "x", "满1减1"), rec("9", "苏州券", "满 2000 减 300"), rec("10", "苏州券", "满 2000 减 300")], S.EXAMPLE_RECORD)
    out = imports.import_examples(records, policies, rules, empty(spark, S.CONTRIBUTIONS), {"1": "2026年家电补贴"}, AS_OF)
    assert tuple(out["outcomes"].first()) == (3, 1, 1, 1)
    assert out["policies"].first()["funding_source"] == "市级财政" and out["rules"].first()["rule_text"] == "满1减1"
    new = out["new_policies"].first()
    assert (new["policy_level"], new["document_type"]) == ("city", "notice") and out["new_rules"].first()["amount_type"] == "tiered"
    curated = merge.curate(policies, rules, {"家电补贴": {"doc_no": "商办1号", "description": "冰箱", "cap_unit": "元/件"}}, AS_OF)
    assert curated["policies"].first()["doc_no"] == "商办1号" and curated["rules"].first()["cap_unit"] == "元/件"
    filled = merge.backfill_policies(curated["policies"], curated["rules"], empty(spark, S.CONTRIBUTIONS), spark.createDataFrame([], "contribution_id string, rate string, rule_text string"), AS_OF)
    assert filled["rules"].first()["rule_type"] == "percentage" and filled["policies"].first()["document_type"] == "unknown"


def test_recognise_pages_and_report(spark, tmp_path):
    pages = recognise_pages(spark.createDataFrame([("https://swt.gd.gov.cn/a/b.html", PAGE)], "url string, html string"))
    row = pages.first()
    assert row["candidates"][0]["url"] == "https://swt.gd.gov.cn/zc/2025/list.html?a=1&b=2" and row["rate"] == 12.0 and row["relevance"]["importable"]
    docs = pages.select("document_type", F.col("relevance.is_related").alias("is_related"), F.col("relevance.importable").alias("importable"), F.size("evidence").alias("evidence_n"))
    report = reports.document_profile(docs)
    reports.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_import_stores_only_what_it_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.html").write_text(PAGE)

    class Stored(Exception):
        pass

    def stop(df):
        raise Stored(df.columns)

    monkeypatch.setattr(imports, "materialize", stop)
    with pytest.raises(Stored) as stored:
        files_to_policies(files.read_files(spark, str(tmp_path)), empty(spark, S.CONTRIBUTIONS), AS_OF)
    columns = set(stored.value.args[0])
    assert not {"fields", "text", "categories"} & columns and {"relevance", "evidence", "conditions", "rate"} <= columns


def test_texts_cleaned_by_looking_first(spark):
    """The forms that look before they trim, replace or collapse give what the plain ones give."""
    ends = [w + "家电 补贴" + w for w in T.WHITESPACE] + [w * 3 for w in T.WHITESPACE] + ["a" + w + "b" + w + w + "c" for w in T.WHITESPACE]
    odd = ["", "x", " ", "“a”  ‘b’", "广东／广州市", "广东 省", "​", "𠮷 𠮷 ", "a\n\n\n\nb", "a\r\n", "abc ", " abc", "全国范围", "上 海", "word " * 20_000, "word " * 20_000 + "e", None]
    df = spark.createDataFrame([(x,) for x in [*ends, *odd]], "x string").repartition(2)
    x, lit = F.col("x"), F.lit
    full = lambda c: T.strip(F.when(F.replace(c, lit("　"), lit(" ")).rlike("\t|  |\n{3}"), F.regexp_replace(F.regexp_replace(F.replace(c, lit("　"), lit(" ")), "[ \t]+", " "), "\n{3,}", "\n\n"))
                             .otherwise(F.replace(c, lit("　"), lit(" "))))
    whole = lambda c: F.translate(T.squeeze(c), "／", "/")
    pairs = {
        "trimmed": (T.trimmed(x), T.strip(x)), "clean": (T.clean_text(x), full(x)), "line": (T.compact(x), F.replace(full(x), lit("\n"), lit(" "))),
        "normal": (T.normalize_text(x), T.strip(T.straight_quotes(F.regexp_replace(F.coalesce(x, lit("")), T.WS + "+", " ")))),
        "blank": (T.is_blank(x), x.isNull() | (T.strip(x) == "")), "place": (G._compact(x), whole(x)),
        "province": (G.normalize_province(x), F.when(whole(x).rlike("全国|国家层面|全国范围"), "全国").otherwise(F.coalesce(*[F.when(whole(x).contains(s), f) for f, s in R.PROVINCES], lit("")))),
    }
    for name, (got, want) in pairs.items():
        assert df.filter(~got.eqNullSafe(want)).count() == 0, name
