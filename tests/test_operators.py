"""Operators against brute force on small frames, hot-key paths forced with low thresholds."""

import csv
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from policylake import rules as R
from policylake import schemas as S
from policylake.functions import extract as X
from policylake.functions import relevance as V
from policylake.operators import dictionary, exports, imports, links, merge, ordering, schedule, search, validation
from policylake.operators.scan import in_blocks
from policylake.operators.snapshots import SnapshotTable, store_new
from policylake.session import materialize, path_exists, staging
from policylake.sources import catalog, files, packs

from conftest import rows


def test_skew_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("left", "inner"):
        salted = ordering.skew_join(big, small, ["k"], how, ["id"], hot_rows=50).select("id", "k", "v")
        assert rows(salted.fillna(0)) == rows(big.join(small, "k", how).select("id", "k", "v").fillna(0))


def test_number_rows(spark):
    rng = random.Random(1)
    data = [(g, at) for g in "ab" for at in sorted(rng.sample(range(1000), 200))]
    got = ordering.number_rows(spark.createDataFrame(data, "g string, at int"), ["g"], "at", block=64)
    want = []
    for g in "ab":
        want += [(g, at, n) for n, at in enumerate([a for x, a in data if x == g], start=1)]
    assert rows(got.select("g", "at", "row_no")) == sorted(want)


def brute_duplicates(data):
    groups = {}
    for i, key, at in data:
        groups.setdefault(key, []).append((at, i))
    out = {}
    for i, key, at in data:
        others = sorted(x for x in groups[key] if x[1] != i)
        out[i] = others[0][1] if key and others else None
    return out


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_mark_duplicates(spark, hot_rows):
    rng = random.Random(2)
    data = [(f"{i:03d}", "hot" if i % 3 == 0 else rng.choice(["", "a", "b", f"u{i}"]), rng.randrange(50)) for i in range(200)]
    got = merge.mark_duplicates(spark.createDataFrame(data, "id string, dedup_key string, created_at int"), hot_rows=hot_rows)
    assert {r["id"]: r["duplicate_of"] for r in got.collect()} == brute_duplicates(data)


def test_content_dedup(spark):
    new = spark.createDataFrame([("n1", "h1", 5), ("n2", "h1", 4), ("n3", "h2", 1), ("n4", "h3", 1)], "id string, content_hash string, created_at int")
    old = spark.createDataFrame([("o1", "h2", 0)], "id string, content_hash string, created_at int")
    fresh, mapping = merge.content_dedup(new, old, hot_rows=1)
    assert rows(fresh.select("id")) == [("n2",), ("n4",)]
    assert rows(mapping) == [("n1", "n2", True), ("n2", "n2", False), ("n3", "o1", True), ("n4", "n4", False)]


def brute_throttle(events, limit, window):
    state, out = {}, {}
    for t, i, k in sorted(events):
        reset, n = state.get(k, (None, 0))
        if reset is None or reset <= t:
            state[k] = (t + window, 1)
        else:
            state[k] = (reset, n + 1)
        reset, n = state[k]
        out[i] = (reset - window, n, n <= limit, None if n <= limit else -(-(reset - t) // 1_000_000))
    return out


def random_events(rng, kind):
    """Times in microseconds, ids and keys: one hot key, only one key, bursts of equal times in one window, null keys."""
    if kind == "hot":
        return [(rng.randrange(0, 4000) * 500_000, i, "hot" if i % 3 else rng.choice(["k1", "k2", None, "z"])) for i in range(600)]
    if kind == "one":
        return [(rng.randrange(0, 4000) * 500_000, i, "only") for i in range(500)]
    return [(rng.randrange(0, 8) * 1_000_000 + (40_000_000 if i % 5 == 0 else 0), i, "only") for i in range(400)]


def event_frame(spark, events):
    return spark.createDataFrame([(i, k, t) for t, i, k in events], "id int, k string, us bigint").withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("kind, blocks", [("hot", 1), ("hot", 7), ("hot", 70), ("one", 9), ("burst", 12), ("burst", 40)])
def test_throttle_matches_sequential_rule(spark, kind, blocks):
    events = random_events(random.Random(blocks), kind)
    got = schedule.throttle(event_frame(spark, events), "k", "ts", "id", 3, 20, blocks=blocks).select("id", "window_start_us", "request_no", "allowed", "retry_after")
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == brute_throttle([(t, i, k or "") for t, i, k in events], 3, 20_000_000)
    empty = schedule.throttle(event_frame(spark, events).filter("id < 0"), "k", "ts", "id", 3, 20, blocks=blocks)
    assert empty.count() == 0 and set(empty.columns) == {"id", "k", "us", "ts", "window_start_us", "request_no", "allowed", "retry_after"}


def test_step_functions_compose_as_blocks_do():
    rng = random.Random(4)
    for _ in range(60):
        window, times = rng.choice([3, 10, 200]), sorted(rng.randrange(0, 60) for _ in range(rng.randrange(2, 40)))
        cut = rng.randrange(1, len(times))
        both = schedule._compose(*[schedule._step_table(np.array(x), window) for x in (times[:cut], times[cut:])])
        for reset in [schedule.NEVER, *range(times[0] + window + 1)]:
            want = reset
            for t in times:
                want = t + window if want <= t else want
            assert schedule._apply(*both, np.array([reset]))[0] == want


@pytest.mark.parametrize("kind, blocks", [("hot", 1), ("hot", 30), ("one", 9), ("burst", 12)])
def test_polite_schedule_matches_sequential_rule(spark, kind, blocks):
    events = random_events(random.Random(7), kind)
    last, want = {}, {}
    for t, i, k in sorted(events, key=lambda e: e[:2]):
        last[k] = max(t, last[k] + 30_000_000) if k in last else t
        want[i] = last[k]
    got = schedule.polite_schedule(event_frame(spark, events), "k", "ts", "id", 30, blocks=blocks)
    assert {r["id"]: r["start_us"] for r in got.collect()} == want


def test_one_key_is_spread_over_blocks(spark):
    """All events of one key: every block has its share, and no task gets more than a block."""
    df = event_frame(spark, random_events(random.Random(1), "burst"))
    sizes = [r["count"] for r in in_blocks(df, ["k"], ["us", "id"], 8).groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 400 / 8 * 2


@pytest.mark.parametrize("blocks", [1, 6, 25])
def test_reviews_apply_one_after_the_other(spark, blocks):
    rng = random.Random(blocks)
    names = ["start_review", "request_changes", "reject", "approve", "archive", None]
    actions = [(f"c{rng.choice([1, 1, 1, 1, 2, 3, 9])}", rng.choice(names), rng.choice(["please", " ", None]), "r", rng.randrange(50), i) for i in range(300)]
    status, want = {"c1": "submitted", "c2": "draft", "c3": "approved"}, []
    for c, a, comment, _, _, i in sorted(actions, key=lambda x: (x[4], x[5])):
        if c not in status:
            want.append((c, a, "not found"))
        elif a not in merge.TRANSITIONS:
            want.append((c, a, "action not allowed"))
        elif a == "request_changes" and not (comment or "").strip():
            want.append((c, a, "comment required"))
        elif a == "approve" and status[c] not in merge.R.SUBMITTABLE_STATUSES:
            want.append((c, a, "state cannot be submitted"))
        else:
            status[c] = merge.TRANSITIONS[a]
    contributions = spark.createDataFrame([(c, s, None, None, None) for c, s in (("c1", "submitted"), ("c2", "draft"), ("c3", "approved"))], "id string, status string, reviewer_id string, reviewed_at int, updated_at int")
    after, rejects = merge.apply_reviews(contributions, spark.createDataFrame(actions, "contribution_id string, action string, comment string, actor_id string, at int, id int"), blocks=blocks)
    assert {r["id"]: r["status"] for r in after.collect()} == status
    assert sorted(map(str, map(tuple, rejects.collect()))) == sorted(map(str, want))


def test_merge_rules(spark):
    cur = spark.createDataFrame([("1", "a", "", None, "x"), ("2", "b", "s", 5, "y")], "id string, keep string, fill string, patch int, over string")
    new = spark.createDataFrame([("1", "z", "f", None, None), ("3", "n", "n", 9, "n")], "id string, keep string, fill string, patch int, over string")
    rules = {"keep": "keep", "fill": "fill_if_blank", "patch": "patch_if_present"}
    assert rows(merge.merge_snapshot(cur, new, "id", rules).fillna({"patch": -1, "over": "NULL"})) == [
        ("1", "a", "f", -1, "NULL"), ("2", "b", "s", 5, "y"), ("3", "n", "n", 9, "n")]
    once = merge.merge_snapshot(cur, new, "id", rules)
    assert rows(merge.merge_snapshot(once, new, "id", rules).select("id", "keep", "fill")) == rows(once.select("id", "keep", "fill"))


def test_insert_if_absent_twice_adds_nothing(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    first = search.insert_if_absent(old, new, ["k"])
    assert rows(first) == [("b", 3)]
    assert search.insert_if_absent(old.union(first), new, ["k"]).count() == 0


def test_lookup_contains(spark):
    needles = spark.createDataFrame([("江苏",), ("浙",), ("x",), ("",), (None,), ("省南京",), ("JIANG su",), ("absent",)], "n string")
    dim = spark.createDataFrame([("1", "江苏省南京"), ("2", "浙江和江苏"), ("3", None), ("4", ""), ("5", "in Jiang SU"), ("5", "in jiang su")], "id string, name string")
    got = dictionary.lookup_contains(needles, "n", dim, "name", [-F.col("id").cast("int")], ["id"])
    assert rows(got.fillna("-")) == [("", "-"), ("-", "-"), ("JIANG su", "5"), ("absent", "-"), ("x", "-"), ("江苏", "2"), ("浙", "2"), ("省南京", "1")]


def test_dictionary_of_any_size_equals_plain_search(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé江", k=rng.randrange(1, 7)))
    words = sorted({word() for _ in range(400)})
    texts = ["".join(rng.choices("abcdé江 ", k=rng.randrange(0, 80))) for _ in range(120)] + ["", None, "a"]
    rules = [(i // 7, i % 7, f"L{i // 7}", w, rng.randrange(1, 9)) for i, w in enumerate(rng.sample(words, len(words)))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = spark.createDataFrame(rules + [(99, 0, "none", None, 3), (99, 1, "none", "", 3)], "rule_no int, keyword_no int, label string, keyword string, points int")
    held = {i: [r for r in rules if r[3] in (t or "")] for i, t in enumerate(texts)}
    assert rows(dictionary.find_words(df, "id", "t", table, "keyword")) == sorted((i, r[3]) for i, h in held.items() for r in h)
    assert rows(dictionary.first_label(df, "id", "t", table).select("id", "label", "keyword")) == sorted((i, *min(h)[2:4]) for i, h in held.items() if h)
    assert rows(dictionary.weighted_hits(df, "id", "t", table)) == sorted((i, len(h), sum(r[4] for r in h)) for i, h in held.items() if h)


def test_long_words_meet_the_texts_that_hold_them(spark):
    words = ["abcdefgh", "以旧换新", "bcd", "换新", "é"]
    texts = ["abc bcd cde def efg fgh bcdefgh", "xabcdefghx", "以旧 旧换 换新", "x以旧换新", "", None]
    body = spark.createDataFrame(list(enumerate(texts)), "_id int, _text string")
    keys, sizes = dictionary._word_keys(spark.createDataFrame([(w,) for w in words], "word string"), "word")
    assert sizes == [2, 3, 6, 7]
    met = dictionary._key_rows(body, sizes).join(keys, "_gram").select("_id", "_word")
    assert rows(met) == sorted((i, w) for i, t in enumerate(texts) for w in words if w in (t or ""))  # 3-grams alone meet more
    column = pa.array([*texts, "ab" * 9, "éé"] * 3).slice(2, 20)
    for size in dictionary.SIZES:
        want = [sorted({int.from_bytes(t[i: i + size], "little") | size << 56 for i in range(len(t) - size + 1)}) for t in ((x.as_py() or "").encode() for x in column)]
        assert dictionary._byte_keys(column, size).to_pylist() == want
    found = dictionary.find_words(body, "_id", "_text", keys, "_word").withColumnRenamed("_word", "keyword")
    rules = spark.createDataFrame([(i, 0, w, w, 2) for i, w in enumerate(words)], "rule_no int, keyword_no int, label string, keyword string, points int")
    assert rows(dictionary.first_label(body, "_id", "_text", rules, found)) == rows(dictionary.first_label(body, "_id", "_text", rules))
    assert rows(dictionary.weighted_hits(body, "_id", "_text", rules, found)) == [(0, 1, 2), (1, 2, 4), (2, 1, 2), (3, 2, 4)]


def test_dictionary_table_equals_the_literal_form(spark):
    rng = random.Random(3)
    words = [w for rule in R.CATEGORY_RULES for w in rule.keywords]
    df = spark.createDataFrame([(i, "".join(rng.choices([*words, "无", "关", "的"], k=rng.randrange(0, 5)))) for i in range(200)], "id int, t string")
    table = spark.createDataFrame([(i, k, rule.label, w) for i, rule in enumerate(R.CATEGORY_RULES) for k, w in enumerate(rule.keywords)], "rule_no int, keyword_no int, label string, keyword string")
    literal = F.coalesce(*[F.when(F.col("t").contains(w), rule.label) for rule in R.CATEGORY_RULES for w in rule.keywords])
    assert rows(dictionary.first_label(df, "id", "t", table).select("id", "label")) == rows(df.select("id", literal.alias("l")).filter("l IS NOT NULL"))


def test_table_forms_of_cells_and_points(spark):
    rng = random.Random(12)
    words = [w for rule in R.FUNDING_RULES for w in rule.keywords]
    scored = [r.word for r in R.RELEVANCE_RULES]
    text = lambda: "".join(rng.choices([*words, *scored, "无", "关 ", "的", "文\n"], k=rng.randrange(0, 30)))
    df = spark.createDataFrame([(i, text(), text()[:20]) for i in range(150)] + [(900, None, None), (901, "", None)], "id int, t string, title string")
    rules = spark.createDataFrame([(i, k, rule.label, w) for i, rule in enumerate(R.FUNDING_RULES) for k, w in enumerate(rule.keywords)], "rule_no int, keyword_no int, label string, keyword string")
    got = dictionary.label_cells(df, "id", "t", rules, 40, 80, 0.72).select("id", "cell.value", "cell.quote")
    assert rows(got.fillna("-")) == rows(df.select("id", X.funding_source(F.col("t")).alias("c")).select("id", "c.value", "c.quote").fillna("-"))
    weights = spark.createDataFrame([(r.word, r.weight) for r in R.RELEVANCE_RULES], "word string, weight int")
    literal = V.keyword_score(df, "t", "title").select("id", "keyword_points").filter("keyword_points > 0")
    assert rows(dictionary.keyword_points(df, "id", "title", "t", weights).select("id", "points")) == rows(literal)


def test_robots(spark):
    text = "User-agent: PolicyBot\nUser-agent: x\nDisallow: /private\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nAllow: /private\nDisallow: /*.pdf$\nDisallow:\n"
    urls = ["/", "/a", "/a/b", "/private", "/z.pdf", "/z.pdf?x=1", "/other"]
    df = spark.createDataFrame([(u, "https://h.example" + u) for u in urls], "p string, url string")
    robots = spark.createDataFrame([("https://h.example", text)], "origin string, text string")
    got = {r["p"]: r["allowed"] for r in links.robots_filter(df, robots, "policybot", hot_rows=2).collect()}
    assert got == {"/": True, "/a": False, "/a/b": True, "/private": True, "/z.pdf": False, "/z.pdf?x=1": True, "/other": True}


def test_robots_of_many_rules(spark):
    rng = random.Random(6)
    path = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5)))
    rules = [(rng.choice(["Allow", "Disallow"]), path() + rng.choice(["", "", "/", "*c", "$", "*/b$"])) for _ in range(300)]
    text = "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rules)
    urls = [path() for _ in range(200)]

    def score(p, u):
        body = p.rstrip("$") if p.endswith("$") else p
        pattern = ".*".join(map(re.escape, body.split("*"))) + ("$" if p.endswith("$") else "")
        return len(body) if re.match(pattern, u) else 0

    df = spark.createDataFrame([(i, "https://h.example" + u) for i, u in enumerate(urls)], "i int, url string")
    other = spark.createDataFrame([(900, "https://other.example/a"), (901, None), (902, "nonsense")], "i int, url string")
    got = {r["i"]: r["allowed"] for r in links.robots_filter(df.union(other), spark.createDataFrame([("https://h.example", text)], "origin string, text string"), "bot").collect()}
    assert got == {i: max([(score(p, u), k == "Allow") for k, p in rules] + [(0, True)])[1] for i, u in enumerate(urls)} | {900: True, 901: True, 902: True}


def test_screen_urls(spark):
    urls = ["https://a.gov.cn/x", "http://gov.cn/", "ftp://a.gov.cn/", "https://u:p@a.gov.cn/", "https://a.com/", "https://b.gov.cn/", "https://c.gov.cn/", "nonsense"]
    addresses = spark.createDataFrame([("a.gov.cn", "8.8.8.8"), ("GOV.cn", "1.1.1.1"), ("b.gov.cn", "8.8.4.4"), ("b.gov.cn", "10.0.0.1")], "host string, address string")
    got = {r["url"]: r["reject_reason"] for r in links.screen_urls(spark.createDataFrame([(u,) for u in urls], "url string"), addresses).collect()}
    assert got == {urls[0]: None, urls[1]: None, urls[2]: "scheme not allowed", urls[3]: "credentials in url", urls[4]: "not an official host",
                   urls[5]: "private or reserved address", urls[6]: "host does not resolve", urls[7]: "invalid url"}


def test_files_are_parsed_and_bad_ones_do_not_fail_the_job(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<title>标题</title><h1>头</h1><a href='/x'>链接</a>正文".encode())
    (tmp_path / "b.csv").write_bytes("h1,h2\n\"x,1\",y\n,\n".encode("utf-8-sig"))
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.txt").write_bytes("补贴".encode("gb18030"))
    (tmp_path / "f.doc").write_bytes(b"\xd0\xcf")
    parsed = files.parse_documents(files.decode_bytes_df(files.route_documents(files.read_files(spark, str(tmp_path)))))
    got = {r["path"].rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert got["a.html"]["kind"] == "html" and got["a.html"]["heading"] == "头" and got["a.html"]["links"][0]["href"] == "/x"
    assert got["b.csv"]["text"] == "h1 | h2\nx,1 | y" and got["b.csv"]["row_count"] == 2
    assert got["c.json"]["record_count"] == 2 and got["d.json"]["error"] and got["d.json"]["record_count"] is None
    assert got["e.txt"]["text"] == "补贴" and got["f.doc"]["warnings"]


def test_bulk_import_aliases_and_limit(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"title": "t", "policyLevel": "city", "policy_level": "x", "amountValue": 0}, {"title": "u", "policy_level": "province"}]')
    (tmp_path / "r.csv").write_text(" title ,policyLevel\n a , city \n")
    got = packs.read_contributions(spark, str(tmp_path / "r.json"), "json")
    assert rows(got.select("title", "policy_level", "amount_value").fillna("-")) == [("t", "city", "0"), ("u", "province", "-")]
    assert rows(packs.read_contributions(spark, str(tmp_path / "r.csv"), "csv").select("title", "policy_level")) == [("a", "city")]
    assert validation.require_rows(got, 1).count() == 1 and validation.require_rows(got, 2).count() == 0
    assert validation.require_columns(got.withColumn("row_index", F.lit(0)), ["title", "issuer"]).count() == 2


def test_catalog(spark):
    t = {"b": spark.range(3), "a": spark.range(1)}
    assert [tuple(r) for r in catalog.table_counts(t, {"a": "first"}).collect()] == [("a", "first", 1), ("b", "", 3)]
    assert catalog.preview(t, "b", 0).count() == 1
    catalog.register({"preview_b": t["b"]})
    assert catalog.run_readonly_sql(spark, " select * from preview_b ").count() == 3
    spark.sql("CREATE TABLE IF NOT EXISTS guarded (x INT) USING parquet")
    assert catalog.run_readonly_sql(spark, "WITH q AS (SELECT 1 AS x) SELECT x FROM q -- end").count() == 1
    for bad in ("drop table preview_b", "select 1; drop table x", "WITH q AS (SELECT 1 AS x) INSERT INTO guarded SELECT x FROM q", "with q as (select 1) from q insert into guarded select *",
                "select 1) insert into guarded (select 1"):
        with pytest.raises(ValueError):
            catalog.run_readonly_sql(spark, bad)
    assert spark.table("guarded").count() == 0
    spark.sql("DROP TABLE guarded")
    with pytest.raises(ValueError):
        catalog.preview(t, "zz", 1)


def test_line_dump_to_examples(spark):
    head = ["ID"] + [f"h{i}" for i in range(11)]
    one = ["7", "券", "区级财政", "家电", "江苏省", "苏州市", "虎丘区", "满 2000 减 300", "300 元 / 单", "2026-03", "额度用完", "园区公告"]
    two = ["1", "家电", "中央", "家电", "全国试点省份", "浙江省", "家电 15%/ 数码 10%", "每件1500元", "2026-01-01", "2026-12-31 提前额度用完", "商办〔2025〕1号"]
    lines = head + one + ["tail", ""] + ["ID"] + [f"g{i}" for i in range(10)] + two
    df = packs.split_header_groups(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    first = packs.lines_to_records(df.filter("section = 1 and line_no >= 12"), imports.DISTRICT_NAMES)
    start = lines.index("ID", 1)
    second = packs.lines_to_records(df.filter(f"section = 2 and line_no >= {start + 11}"), imports.GENERAL_NAMES)
    district, general = imports.example_records(first), imports.example_records(second)
    literal = spark.createDataFrame([("Q1", "默认") + (None,) * 6 + (None, None) + (None,) * 7], S.EXAMPLE_RECORD)
    records = imports.with_default_record(district, general, literal)
    got = {r["externalId"]: r for r in records.collect()}
    assert set(got) == {"7", "1", "Q1"}
    assert (got["7"]["capAmount"], got["7"]["capUnit"], got["7"]["effectiveFrom"], got["7"]["endNote"]) == (300.0, "元/单", "2026-03-01", "额度用完截止")
    assert (got["1"]["province"], got["1"]["city"], got["1"]["rate"], got["1"]["effectiveTo"], got["1"]["docNo"]) == ("全国", "", 15.0, "2026-12-31", "商办〔2025〕1号")


def test_quoted_csv_export(spark, tmp_path):
    users = spark.createDataFrame([("u1", 'a "b"', "admin", "active", "2"), ("u2", None, "viewer", "active", "1")], "username string, display_name string, role string, status string, created_at string")
    exports.write_export(exports.export_users(users).coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines()[0].startswith('"用户名"') and '"a ""b"""' in text and text.index("u2") < text.index("u1")


def test_merge_rewrites_only_the_buckets_of_changed_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    store = SnapshotTable(path, ["id"], 32)
    store.create(spark.range(1000).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w")))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([(5, -1), (700, -2), (5000, -3)], "id bigint, v bigint")
    touched = store.merge(changes)
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    assert len(touched) <= 3 and {f.split("_bucket=")[1].split("/")[0] for f in set(before) - same} == {str(b) for b in touched} - ({str(b) for b in touched} - {f.split("_bucket=")[1].split("/")[0] for f in before})
    want = {i: (2 * i, "x") for i in range(1000)} | {5: (-1, "x"), 700: (-2, "x"), 5000: (-3, None)}
    assert {r["id"]: (r["v"], r["w"]) for r in store.read(spark).collect()} == want
    assert store.merge(changes) == touched and store.merge(changes.filter("id < 0")) == []
    assert {r["id"]: (r["v"], r["w"]) for r in store.read(spark).collect()} == want
    plan = store.part(spark, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan


def test_store_new_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    rows_ = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), "id")
    assert store_new(rows_.filter("id < 20"), path).count() == 20
    first = {str(f) for f in (tmp_path / "s").rglob("*.parquet")}
    assert rows(store_new(rows_, path).select("id")) == [(i,) for i in range(50)]
    again = {str(f) for f in (tmp_path / "s").rglob("*.parquet")}
    assert store_new(rows_.withColumn("id", -F.col("id")), path).agg(F.min("id")).first()[0] == 0
    assert first < again and {str(f) for f in (tmp_path / "s").rglob("*.parquet")} == again


def test_staged_tables_go_with_their_owner(spark):
    with staging(spark):
        kept = materialize(spark.range(3))
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 3 and path_exists(spark, path)
    assert not path_exists(spark, path)
    later = materialize(spark.range(3))
    assert path_exists(spark, later.inputFiles()[0])


def test_csv_cells_as_a_csv_reader_has_them(spark):
    rng = random.Random(8)
    texts = ["", "a", "a\n", "\n\n", 'x,"y, ""z""",\r\n,\n"multi\nline",b', '"a"b,c"d"e', ",", '""', '"open, to the\nend', " , \nq", "a,b\n\n\nc"]
    texts += ["".join(rng.choices(['a', 'é', '"', '""', ',', '\n', '\r\n', ' ', '"x",'], k=rng.randrange(0, 25))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", files.csv_struct("t").alias("s")).select("i", "s.*")
    want = {}
    for i, t in enumerate(texts):
        records = list(csv.reader(io.StringIO(t, newline="")))
        want[i] = ("\n".join(" | ".join(r) for r in records if any(c.strip() for c in r)), max(0, len(records) - 1))
    assert {r["i"]: (r["text"], r["row_count"]) for r in got.collect()} == want
