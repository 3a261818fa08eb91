"""Text, URL, page, extraction, relevance and geography queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.adapters import PROVINCES, SHORT, cte, notices
from checks.registry import (
    any_contains, in_list, query, quoted, sql_clean, sql_compact, sql_first_keyword, sql_group, sql_normalize, sql_squeeze, sql_strip, sql_unescape, table,
)
from policylake import rules as R
from policylake.functions import extract as X
from policylake.functions import geo as G
from policylake.functions import relevance as V
from policylake.functions import text as T
from policylake.functions import urls as U
from policylake.functions.keys import dedup_key
from policylake.operators.links import candidate_links, plan_expansion, robots_filter, screen_urls, triage_links
from policylake.plans.corpus import level_histogram, scored_documents
from policylake.sources.files import snapshot_manifest
from policylake.sources.html import extract_links, inner_text, page_links, page_struct, page_titles

# --- URLs ------------------------------------------------------------------------------------

_BEFORE = "split_part(split_part(url, '#', 1), '?', 1)"
_QUERY = f"substr(split_part(url, '#', 1), length({_BEFORE}) + 2)"
_PATHED = f"CASE WHEN regexp_matches({_BEFORE}, '^https?://[^/]+$') THEN concat({_BEFORE}, '/') ELSE {_BEFORE} END"


def _pruned(extra: str) -> str:
    """A query that loses a key is written as a form writes it."""
    decoded = lambda part: f"url_decode(replace({part}, '+', ' '))"
    form = lambda part: f"replace(replace(replace(url_encode({part}), '%20', '+'), '~', '%7E'), '%2A', '*')"
    pairs = f"list_transform(list_filter(string_split({_QUERY}, '&'), lambda p: p <> ''), lambda p: {{'k': {decoded("split_part(p, '=', 1)")}, 'v': {decoded("substr(p, length(split_part(p, '=', 1)) + 2)")}}})"
    kept = f"list_filter({pairs}, lambda p: NOT (lower(p.k) IN {in_list(R.TRACKING_KEYS)}{extra}))"
    written = f"array_to_string(list_transform({kept}, lambda p: concat({form('p.k')}, '=', {form('p.v')})), '&')"
    return f"""CASE WHEN NOT contains(url, '?') THEN {_PATHED} WHEN len({kept}) = len({pairs}) THEN concat({_PATHED}, '?', {_QUERY}) WHEN len({kept}) = 0 THEN {_PATHED}
      ELSE concat({_PATHED}, '?', {written}) END"""


_UTM = " OR starts_with(lower(p.k), 'utm_')"


# What a URL parser makes of case, default port, dots, quotes, angles, braces, backslash and blanks.
_ODD = ("HTTPS://A.gov.cn:443/d/../", "/x\"<y>\\z{`}/./é?q={1}'<&utm_x=1 2&p=\\#f")
_ODD_NORMAL = ("https://a.gov.cn/", "/x%22%3Cy%3E/z%7B%60%7D/%C3%A9?q={1}%27%3C&utm_x=1%202&p=\\")


# Coded keys, a name without a value, blanks, a lone percent sign; a query that keeps its keys; an empty query; all keys gone.
_CODED = (("http://a.cn/?x=%20y&flag&&s%70m=1&%66ROM=b&z=~*'(é+%zz&id=", "#f"), ("http://a.cn/p?x=%20y&flag&&z=~*'(+%zz&id=", ""), ("http://a.cn?#", ""), ("https://a.cn/?utm_=1&REF=", ""))
_CODED_NORMAL = ("http://a.cn/?x=+y&flag=&z=%7E*%27%28%C3%A9+%25zz&id=", "http://a.cn/p?x=%20y&flag&&z=~*%27(+%zz&id=", "http://a.cn/?", "https://a.cn/")


@query("url_normalize", f"""SELECT page_id, {_pruned('')} AS normalized, {_pruned(_UTM)} AS without_utm,
  concat({quoted(_ODD_NORMAL[0])}, CAST(page_id AS VARCHAR), {quoted(_ODD_NORMAL[1])}) AS odd,
  concat({quoted(_CODED_NORMAL[0])}, page_id, ' ', {quoted(_CODED_NORMAL[1])}, page_id, ' ', {quoted(_CODED_NORMAL[2])}, ' ', {quoted(_CODED_NORMAL[3])}) AS coded FROM pages""")
def url_normalize(spark, d):
    n = F.col("page_id").cast("string")
    odd = F.concat(F.lit(_ODD[0]), n, F.lit(_ODD[1]))
    coded = [F.concat(F.lit(a), n if "id=" in a or "REF=" in a else F.lit(""), F.lit(b)) for a, b in _CODED]
    return table(spark, d, "pages").select(
        "page_id", U.normalize_url("url").alias("normalized"), U.normalize_url("url", True).alias("without_utm"), U.normalize_url(odd).alias("odd"),
        F.concat_ws(" ", *map(U.normalize_url, coded)).alias("coded"))


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query("host_screen", f"""
SELECT page_id, {_HOST} AS host, ends_with({_HOST}, '.example.org') AS official, {_HOST} LIKE 'www.%' AS www FROM pages""")
def host_screen(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.url_host("url").alias("host"), U.is_official_host("url", ".example.org").alias("official"), U.url_host("url").startswith("www.").alias("www"))


# The pages with all forms of attributes and references: double, single and no quotes, another attribute before, numbers.
_FORMS = r"""
forms AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN h WHEN 1 THEN replace(h, '&amp;', '&#38;') ELSE replace(h, '&amp;', '&#x26;') END AS html FROM (
  SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN regexp_replace(html, '<a href="([^"]*)"', concat('<a href=', chr(39), '\1', chr(39)), 'g')
    WHEN 2 THEN regexp_replace(html, '<a href="([^"\s>]+)"', '<a href=\1', 'g') ELSE replace(html, '<a href=', '<a data-href="/wrong" class=x href=') END AS h FROM pages))"""


def _forms(spark, d):
    h, k = F.col("html"), F.col("page_id")
    h = (F.when(k % 4 == 0, h).when(k % 4 == 1, F.regexp_replace(h, '<a href="([^"]*)"', "<a href='$1'"))
         .when(k % 4 == 2, F.regexp_replace(h, r'<a href="([^"\s>]+)"', "<a href=$1")).otherwise(F.replace(h, F.lit("<a href="), F.lit('<a data-href="/wrong" class=x href='))))
    h = F.when(k % 3 == 0, h).when(k % 3 == 1, F.replace(h, F.lit("&amp;"), F.lit("&#38;"))).otherwise(F.replace(h, F.lit("&amp;"), F.lit("&#x26;")))
    return table(spark, d, "pages").withColumn("html", h)


_TAG = r"(?is)<a\s[^>]*>.*?</a>"
_IN_TAG = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
_HREF_OF = f"trim(regexp_extract(tag, {quoted(_IN_TAG)}, 1), concat(chr(34), chr(39)))"
_BODY_OF = "regexp_replace(tag, '(?s)<[^>]*>', '', 'g')"
_LINKS = f"""{_FORMS},
raw AS (SELECT page_id, url AS page_url, regexp_extract_all(html, {quoted(_TAG)}) AS tags FROM forms),
flat AS (SELECT page_id, page_url, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag FROM raw),
cells AS (SELECT page_id, page_url, i, {sql_clean(sql_unescape(_HREF_OF))} AS href, {sql_compact(sql_unescape(_BODY_OF))} AS link_text FROM flat),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, href, link_text ORDER BY i) AS rn FROM cells
           WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:') AND NOT starts_with(href, 'mailto:')),
links AS (SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position, href, link_text FROM firsts WHERE rn = 1)"""
_RESOLVED = r"""CASE WHEN regexp_matches(href, '^https?://[^/?#]+$') THEN concat(href, '/') WHEN regexp_matches(href, '^https?://') THEN href
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(href, '/') THEN concat(regexp_extract(page_url, '^(https?://[^/?#]+)', 1), href)
  ELSE concat(regexp_replace(split_part(split_part(page_url, '#', 1), '?', 1), '[^/]*$', ''), href) END"""
_ESCAPED = f"array_to_string(list_transform(string_split({_RESOLVED}, ''), lambda ch: CASE WHEN regexp_matches(ch, '[^\\x00-\\x7F]') OR ch = ' ' THEN url_encode(ch) ELSE ch END), '')"


@query("page_titles", f"""
SELECT page_id, {sql_clean(sql_unescape("regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')"))} AS title,
  {sql_clean(sql_unescape("regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')"))} AS heading FROM pages""")
def titles(spark, d):
    return page_titles(table(spark, d, "pages")).select("page_id", "title", "heading")


@query("page_links", f"WITH {_LINKS} SELECT page_id, position, href, link_text FROM links")
def links_of_pages(spark, d):
    return extract_links(_forms(spark, d), keep=("page_id",))


# Markup as it is in the wild, before every page: comments, raw elements, ">" in values, missing semicolons and end tags.
# What a page parser makes of it is written by hand.
_ODD_PAGE = (
    "<!-- <title>old</title><a href='/c'>c</a> --><title>T", " &amp more</title><script>var s = \"<a href='/s'>s</a>\";</script><img alt=\"a>b\" src=x><p title='1>0' "
    + " ".join(f"a{i}='{i}>'" for i in range(1200)) + ">odd &lt 5</p><a href=\"/q?id=", "&copy=1&amp;x\" title=\"x>y\">one <a data-x=\"href=\" href='/r'>two &#38 three</a><a href>none</a><a HREF = /u",
    "/>four<table><tr><td>five")
_ODD_TEXT = ("T", " & morevar s = \"<a href='/s'>s</a>\";odd < 5one two & threenonefourfive")


@query("page_odd_markup", f"""
SELECT page_id, concat('T', page_id, ' & more') AS title, concat('/q?id=', page_id, '&copy=1&x one|/r two & three|/u', page_id, '/ four') AS links,
  concat('T', page_id, {quoted(_ODD_TEXT[1])}) AS head FROM pages""")
def page_odd_markup(spark, d):
    parts = [x for i, text in enumerate(_ODD_PAGE) for x in (F.lit(text), *([F.col("page_id").cast("string")] if i < len(_ODD_PAGE) - 1 else []))]
    page = table(spark, d, "pages").select("page_id", page_struct(F.concat(*parts, "html")).alias("p"))
    first = F.array_join(F.transform(F.slice("p.links", 1, 3), lambda x: F.concat_ws(" ", x["href"], x["text"])), "|")
    head = F.substring("p.text", 1, F.length("page_id") + sum(map(len, _ODD_TEXT)))
    return page.select("page_id", F.col("p.title").alias("title"), first.alias("links"), head.alias("head"))


SCORE_WORDS = ("th", "tion", "an", "eau", "the", "ou")
STRONG, TOPICS, MECHANISMS = ("tion",), ("th", "eau", "sch"), ("an", "er", "ou")


def _triaged(spark, d):
    links = extract_links(_forms(spark, d), keep=("page_id", "url")).withColumnRenamed("url", "page_url")
    return triage_links(links, "href", "link_text", "page_url", SCORE_WORDS, strong=STRONG, topics=TOPICS, mechanisms=MECHANISMS)


_SCORE = " + ".join(f"CAST(contains(link_text, '{w}') AS INTEGER)" for w in SCORE_WORDS)
_POLICY = f"({any_contains('link_text', STRONG)} OR ({any_contains('link_text', TOPICS)} AND {any_contains('link_text', MECHANISMS)}))"


@query("link_triage", f"WITH {_LINKS} SELECT page_id, position, {_ESCAPED} AS url, {_SCORE} AS link_score, {_POLICY} AS is_policy_link FROM links")
def link_triage(spark, d):
    return _triaged(spark, d).select("page_id", "position", "url", "link_score", "is_policy_link")


@query("link_candidates", f"""
WITH {_LINKS}, abs AS (SELECT page_id, position, {_ESCAPED} AS url, trim(link_text) AS t FROM links),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY position) AS rn FROM abs WHERE url IS NOT NULL AND ({any_contains('t', SCORE_WORDS)} OR {any_contains('url', SCORE_WORDS)}))
SELECT page_id, url, CASE WHEN t = '' THEN url ELSE t END AS title FROM kept WHERE rn = 1""")
def link_candidates(spark, d):
    pages = _forms(spark, d)
    found = candidate_links(page_links("html"), F.col("url"), SCORE_WORDS)
    return pages.select("page_id", F.explode(found).alias("c")).select("page_id", "c.url", "c.title")


# As a crawler would go: document after document, newest first, each past the URLs already taken.
@query("link_expansion", f"""
WITH RECURSIVE {_LINKS}, tri AS (SELECT page_id, position, {_ESCAPED} AS url, link_text, {_SCORE} AS link_score, {_POLICY} AS fit FROM links),
ok AS (SELECT * FROM tri WHERE fit AND url IS NOT NULL AND regexp_matches(url, '^https?://[^/?#]*\\.example\\.org([/?#]|$)') AND url NOT IN (SELECT url FROM pages)
       QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY link_score DESC, position) = 1),
lists AS (SELECT page_id, row_number() OVER (ORDER BY page_id DESC) AS n, list(url ORDER BY link_score DESC, position, url) AS urls FROM ok GROUP BY page_id),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS page_id, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS chosen
  UNION ALL SELECT n, page_id, list_concat(taken, c), c FROM (
    SELECT l.n, l.page_id, w.taken, list_filter(l.urls, lambda u: NOT list_contains(w.taken, u))[1:3] AS c FROM walk w JOIN lists l ON l.n = w.n + 1)),
picks AS (SELECT page_id, unnest(chosen) AS url, unnest(range(1, len(chosen) + 1)) AS rank_in_doc FROM walk)
SELECT p.page_id AS doc_id, p.url, o.link_score, p.rank_in_doc FROM picks p JOIN ok o ON o.page_id = p.page_id AND o.url = p.url ORDER BY p.page_id DESC, p.rank_in_doc LIMIT 80""")
def link_expansion(spark, d):
    links = _triaged(spark, d).withColumns({"doc_id": F.col("page_id"), "doc_at": F.timestamp_seconds("page_id")})
    plan = plan_expansion(links, table(spark, d, "pages").select("url"), 3, 80, official_suffix=".example.org")
    return plan.select("doc_id", "url", "link_score", "rank_in_doc")


ROBOTS = (
    "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n",
    "# none for others\nUser-agent: LakeBot\nUser-agent: other\nDisallow: /\nAllow: /fr # french\n\nUser-agent: *\nAllow: /de/\nDisallow: /de/5\n",
    "Disallow: /*page=\nUser-agent: another\nDisallow: /en\n",
)
_ROBOT_RULES = """(VALUES (0, false, '^/en/', 4), (0, true, '^/en/1', 5), (0, false, '^/.*\\.html$', 7), (1, false, '^/', 1), (1, true, '^/fr', 3), (1, true, '^/de/', 4),
 (1, false, '^/de/5', 5), (2, false, '^/.*page=', 7)) AS r(v, allow, pattern, score)"""
_PATH = "regexp_replace(split_part(url, '#', 1), '^https?://[^/?#]+', '')"


@query("robots_filter", f"""
WITH p AS (SELECT page_id, length({_HOST}) % 4 AS v, {_PATH} AS path FROM pages),
s AS (SELECT p.page_id, max(CASE WHEN regexp_matches(p.path, r.pattern) THEN r.score * 2 + CAST(r.allow AS INTEGER) ELSE 1 END) AS best FROM p LEFT JOIN {_ROBOT_RULES} ON p.v = r.v GROUP BY p.page_id)
SELECT page_id, coalesce(best, 1) % 2 = 1 AS allowed FROM s""")
def robots(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    variant = F.char_length(U.url_host("url")) % 4
    text = F.when(variant == 0, ROBOTS[0]).when(variant == 1, ROBOTS[1]).when(variant == 2, ROBOTS[2])
    files = pages.select(U.url_origin("url").alias("origin"), text.alias("text")).filter(F.col("text").isNotNull()).distinct()
    return robots_filter(pages, files, "lakebot").select("page_id", "allowed")


_ADDR = ["10.1.2.3", "8.8.8.8", "192.168.7.7", "fe80::1", "100.64.3.4", "172.32.0.1", "2001:db8::1", "::1", "198.19.255.255", "192.0.1.1"]
_BLOCKED = [a for a in _ADDR if a in ("10.1.2.3", "192.168.7.7", "fe80::1", "100.64.3.4", "::1", "198.19.255.255")]


@query("url_screen", f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages)
SELECT page_id, CASE WHEN starts_with(url, 'https') AND page_id % 10 = 3 THEN 'scheme not allowed' WHEN page_id % 10 = 4 THEN 'credentials in url'
  WHEN NOT (ends_with(host, '.example.org') OR ends_with(host, '.example.com')) THEN 'not an official host' WHEN length(host) % 11 = 10 THEN 'host does not resolve'
  WHEN list_contains([{', '.join(quoted(a) for a in _BLOCKED)}], ([{', '.join(quoted(a) for a in _ADDR)}])[length(host) % 11 + 1]) THEN 'private or reserved address' END AS reject_reason FROM p""")
def url_screen(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    host = U.url_host("url")
    address = F.get(F.array(*[F.lit(a) for a in _ADDR]), F.char_length(host) % 11)
    addresses = pages.select(host.alias("host"), address.alias("address")).filter(F.col("address").isNotNull()).distinct()
    changed = (
        F.when((F.col("page_id") % 10 == 3) & F.col("url").startswith("https"), F.regexp_replace("url", "^https", "ftp"))
        .when(F.col("page_id") % 10 == 4, F.regexp_replace("url", "://", "://me:pw@")).otherwise(F.col("url"))
    )
    org = screen_urls(pages.withColumn("url", F.regexp_replace(changed, r"\.example\.com", ".example.org")), addresses.withColumn("host", F.regexp_replace("host", r"\.example\.com$", ".example.org")), suffix=".example.org")
    return org.select("page_id", "reject_reason")


@query("url_resolve", f"WITH {_LINKS} SELECT page_id, position, {_ESCAPED} AS url FROM links")
def url_resolve(spark, d):
    links = extract_links(_forms(spark, d), keep=("page_id", "url"))
    return links.select("page_id", "position", U.resolve_url("href", "url").alias("url"))


_RAW = r"(?is)^<(?:script|style)\b[^>]*>(.*?)</(?:script|style)\s*>"
_REST = f"regexp_replace(substr(q, length(regexp_extract(q, {quoted(_RAW)}, 0)) + 1), '(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>', '', 'g')"
_PIECE = f"concat(regexp_extract(q, {quoted(_RAW)}, 1), {sql_unescape(_REST)})"
_STRING_VALUE = sql_clean(f"array_to_string(list_transform(qs, lambda q: {_PIECE}), '')")


@query("page_text", f"""
WITH {_LINKS}, marked AS (SELECT page_id, string_split(regexp_replace(html, '(?i)<(script|style)\\b', concat(chr(1), '<\\1'), 'g'), chr(1)) AS qs FROM forms),
texts AS (SELECT page_id, {_STRING_VALUE} AS t FROM marked),
counts AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
SELECT t.page_id, md5(t.t) AS text_md5, length(t.t) AS text_chars, coalesce(c.n, 0) AS link_count FROM texts t LEFT JOIN counts c ON c.page_id = t.page_id""")
def page_text(spark, d):
    """String value of every page, script and style included, and its links."""
    text = T.clean_text(inner_text("html"))
    return _forms(spark, d).select("page_id", F.md5(text.cast("binary")).alias("text_md5"), F.char_length(text).cast("bigint").alias("text_chars"), F.size(page_links("html")).cast("bigint").alias("link_count"))


# --- text ------------------------------------------------------------------------------------

@query("text_normalize", f"""
SELECT doc_id, md5({sql_normalize('text')}) AS normalized_md5, {sql_compact('text', 60)} AS head, length({sql_clean('text')}) AS clean_chars, length({sql_squeeze('text')}) AS squeezed_chars FROM documents""")
def text_normalize(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.normalize_text("text").cast("binary")).alias("normalized_md5"), T.compact("text", 60).alias("head"),
        F.char_length(T.clean_text("text")).cast("bigint").alias("clean_chars"), F.char_length(T.squeeze("text")).cast("bigint").alias("squeezed_chars"))


_NL = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_TITLE_CTE = f"""
lines AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, {quoted(_NL)}), lambda l: {sql_strip('l')} <> '') AS ls FROM documents),
titled AS (SELECT doc_id, text, list_filter(list_transform(ls, lambda l: {sql_clean('l')}), lambda t: length(t) BETWEEN 6 AND 100)[1] AS plain,
  list_filter(list_transform(ls, lambda l: {sql_clean('l')}), lambda t: length(t) BETWEEN 6 AND 100 AND {any_contains('t', R.TITLE_LINE_WORDS)})[1] AS named FROM lines)"""


@query("title_infer", f"WITH {_TITLE_CTE} SELECT doc_id, coalesce(named, plain) AS title FROM titled")
def title_infer(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", X.infer_title(F.col("text"), none, none, none)["value"].alias("title"))


def _sql_class(t: str) -> str:
    return (f"CASE WHEN {any_contains(t, R.NEWS_TITLE_WORDS)} THEN 'news' WHEN {any_contains(t, R.INTERPRETATION_TITLE_WORDS)} THEN 'interpretation' "
            f"WHEN {any_contains(t, R.IMPLEMENTATION_TITLE_WORDS)} THEN 'implementation' WHEN {any_contains(t, R.POLICY_TITLE_WORDS)} THEN 'policy' "
            f"WHEN regexp_matches({t}, '(栏目|专题|首页|政策文件|通知公告)$') THEN 'listing' ELSE 'unknown' END")


@query("doc_class", f"WITH {cte('notices')} SELECT order_key, line_no, part_key, title AS clean, {_sql_class('title')} AS document_type FROM notices")
def doc_class(spark, d):
    n = notices(spark, d, "order_key", "line_no", "part_key", "title", "text")
    dressed = F.concat("title", F.when(F.col("line_no") % 2 == 0, "  _ 通知公告 栏").otherwise(" - 甲乙市人民政府"))
    clean = T.clean_title(dressed)
    return n.select("order_key", "line_no", "part_key", clean.alias("clean"), X.classify_document(clean, F.col("text")).alias("document_type"))


@query("scalar_numbers", rf"""
WITH {cte('notices')}
SELECT order_key, line_no, part_key, supp_key, greatest(CAST(regexp_extract(rate_text, '(\d+)%', 1) AS DOUBLE), CAST(line_no AS DOUBLE)) AS rate,
  CAST(regexp_extract(cap_text, '\d+', 0) AS DOUBLE) AS cap_amount, CASE WHEN contains(cap_text, '单') THEN '元/单' ELSE '元/件' END AS cap_unit,
  CASE WHEN length(month) = 7 THEN concat(month, '-01') ELSE month END AS effective_from, nullif(regexp_extract(end_text, '20\d\d-\d\d-\d\d', 0), '') AS effective_to,
  CASE WHEN contains(end_text, '提前') THEN '额度用完提前截止' WHEN contains(end_text, '额度用完') THEN '额度用完截止' ELSE '' END AS end_note,
  CASE line_no WHEN 1 THEN '宝山区商务委云闪付公告' WHEN 2 THEN official ELSE '关于补贴的通知' END AS official_file, CASE line_no WHEN 2 THEN official ELSE '' END AS doc_no,
  len(string_split(text, '补贴')) - 1 AS mentions, CASE WHEN line_no % 3 = 0 THEN NULL ELSE CAST(line_no AS DOUBLE) END AS number_or_null, line_no IN (1, 3, 4) AS flag,
  CASE WHEN line_no % 2 = 0 THEN title ELSE official END AS first_filled
FROM notices""")
def scalar_numbers(spark, d):
    n = notices(spark, d)
    odd = F.when(F.col("line_no") % 3 == 0, "NaN").otherwise(F.concat(F.lit(" "), F.col("line_no").cast("string")))
    flag = F.get(F.array(*[F.lit(x) for x in ("off", "Yes", "0", "on", "TRUE", "no", "x", "2")]), F.col("line_no"))
    official = T.clean_official_file("official")
    return n.select(
        "order_key", "line_no", "part_key", "supp_key", T.parse_rate("rate_text").alias("rate"), T.parse_cap_amount("cap_text").alias("cap_amount"),
        T.parse_cap_unit("cap_text").alias("cap_unit"), T.parse_effective_from("month").alias("effective_from"), T.parse_effective_to("end_text").alias("effective_to"),
        T.parse_end_note("end_text").alias("end_note"), official.alias("official_file"), T.official_doc_no(official).alias("doc_no"),
        T.count_occurrences("text", "补贴").cast("bigint").alias("mentions"), T.to_number(odd).alias("number_or_null"), T.to_boolean(flag).alias("flag"),
        T.first_text(F.when(F.col("line_no") % 2 == 1, F.lit("  ")).otherwise(F.lit(None)), F.when(F.col("line_no") % 2 == 0, F.col("title")), F.col("official")).alias("first_filled"))


@query("json_fields", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS cell,
  event_id % 3 <> 0 AS has_rate, CASE WHEN event_id % 5 = 0 THEN 'a；b' ELSE event_type END AS description, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS amount_type, '元' AS cap_unit FROM events""")
def json_fields(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    rate = F.when(F.col("event_id") % 3 == 0, F.lit('"unknown"')).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"value":'), k, F.lit("}"))).otherwise(k)
    cond = F.when(F.col("event_id") % 5 == 0, F.lit('{"value":["a","b"]}')).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    kind = F.when(F.col("event_type") == "error", F.lit('""')).otherwise(F.concat(F.lit('{"value":"'), F.col("event_type"), F.lit('"}')))
    envelope = F.concat(F.lit('{"fields":{"rate":'), rate, F.lit(',"conditions":'), cond, F.lit(',"amount_type":'), kind, F.lit("}}"))
    e = e.withColumn("envelope", envelope)
    summary = T.json_field_summary("envelope")
    parsed = T.safe_json("props", "k bigint")
    return e.select(
        "event_id", parsed["k"].alias("k"), F.nullif(T.field_value("envelope", "rate"), F.lit("unknown")).alias("cell"), T.has_field("envelope", "rate").alias("has_rate"),
        summary["description"].alias("description"), summary["amount_type"].alias("amount_type"), summary["cap_unit"].alias("cap_unit"))


# --- extraction ------------------------------------------------------------------------------

DOC_RULES = (R.Rule("english", ("the ", "with ")), R.Rule("french", ("les ", "des ")), R.Rule("german", ("der ", "sch")), R.Rule("spanish", ("que ", "los ")))
_LABEL, _LABEL_QUOTE = sql_first_keyword("text", DOC_RULES, 35, 45)


@query("category_labels", f"""
SELECT doc_id, {' + '.join(f"(CASE WHEN {any_contains('text', r.keywords)} THEN 1 ELSE 0 END)" for r in DOC_RULES)} AS label_count,
  array_to_string([x FOR x IN [{', '.join(f"CASE WHEN {any_contains('text', r.keywords)} THEN '{r.label}' END" for r in DOC_RULES)}] IF x IS NOT NULL], '、') AS labels, {_LABEL_QUOTE} AS quote FROM documents""")
def category_labels(spark, d):
    c = X.categories(F.col("text"), DOC_RULES)
    df = table(spark, d, "documents").withColumn("c", c)
    return df.select("doc_id", F.size("c.labels").alias("label_count"), F.array_join("c.labels", "、").alias("labels"), F.col("c.quote").alias("quote"))


_PROGRAM, _PROGRAM_QUOTE = sql_first_keyword("text", R.PROGRAM_RULES, 40, 60)
_UNIT, _ = sql_first_keyword("text", R.CAP_UNIT_RULES, 40, 40)


@query("program_label", f"""
WITH {cte('notices')} SELECT order_key, line_no, part_key, supp_key, {_PROGRAM} AS program, {sql_compact('(' + _PROGRAM_QUOTE + ')')} AS quote, coalesce({_UNIT}, '元') AS cap_unit FROM notices""")
def program_label(spark, d):
    n = notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text").withColumns({"p": X.program(F.col("text")), "u": X.cap_unit(F.col("text"))})
    return n.select("order_key", "line_no", "part_key", "supp_key", F.col("p.value").alias("program"), F.col("p.quote").alias("quote"), F.col("u.value").alias("cap_unit"))


_RATE_M = f"coalesce({sql_group('text', X.RATE_PREFIX, 0)}, {sql_group('text', X.RATE_SUFFIX, 0)})"
_CAP_M, _FIX_M = sql_group("text", X.CAP, 0), sql_group("text", X.FIXED, 0)
_RED = f"list_distinct(regexp_extract_all(text, {quoted(X.REDUCTION)}, 0))"
_AMOUNTS = f"""
m AS (SELECT order_key, line_no, part_key, supp_key, text, {_RATE_M} AS rm, {_CAP_M} AS cm, {_FIX_M} AS fm, regexp_extract_all(text, {quoted(X.REDUCTION)}, 0) AS reds FROM notices),
a AS (SELECT *, CASE WHEN NOT {any_contains('rm', R.RATE_EXCLUDED)} THEN CAST(regexp_extract(rm, '(\\d+)\\s*%', 1) AS DOUBLE) END AS rate,
  CASE WHEN NOT {any_contains('cm', R.CAP_EXCLUDED)} THEN CAST(regexp_extract(cm, '(\\d+)\\s*元', 1) AS DOUBLE) END AS cap, CAST(regexp_extract(fm, '(\\d+)\\s*元', 1) AS DOUBLE) AS fixed,
  list_max(list_transform(reds, lambda r: CAST(regexp_extract(r, '减\\s*(\\d+)', 1) AS DOUBLE))) AS best,
  CASE WHEN len(reds) = 0 THEN NULL WHEN len(reds) = 1 OR reds[1] = reds[2] THEN reds[1] ELSE concat(reds[1], '、', reds[2]) END AS rule_text FROM m)"""


@query("amount_extract", f"""
WITH {cte('notices')}, {_AMOUNTS}
SELECT order_key, line_no, part_key, supp_key, rate, coalesce(cap, best) AS cap_amount, fixed AS amount_value, rule_text,
  CASE WHEN {any_contains('text', R.TIER_WORDS)} THEN 'tiered' WHEN rate IS NOT NULL THEN 'percent' WHEN len(reds) > 0 THEN 'tiered' WHEN cap IS NOT NULL OR fixed IS NOT NULL THEN 'fixed' ELSE 'unknown' END AS amount_type
FROM a""")
def amount_extract(spark, d):
    names = ("rate", "cap_amount", "amount_value", "rule_text", "amount_type")
    e = X.extract_fields(notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text"), fields=names)
    return e.select("order_key", "line_no", "part_key", "supp_key", *names)


_END_LABEL, _ = sql_first_keyword("text", R.END_NOTE_RULES, 40, 50)


@query("rule_struct", f"""
WITH {cte('notices')}, {_AMOUNTS}
SELECT order_key, line_no, part_key, supp_key, CASE WHEN rule_text IS NOT NULL THEN 'full_reduction' WHEN rate IS NOT NULL THEN 'percentage' WHEN fixed IS NOT NULL THEN 'fixed' ELSE 'unknown' END AS rule_type,
  CAST(regexp_extract(rule_text, '满\\s*(\\d+)', 1) AS DOUBLE) AS threshold_amount, CAST(regexp_extract(rule_text, '减\\s*(\\d+)', 1) AS DOUBLE) AS discount_amount,
  CASE WHEN contains(text, '每人每类可补贴') THEN CAST(regexp_extract(text, '每人每类可补贴(\\d+)件', 1) AS INTEGER) END AS per_user_limit,
  CASE WHEN contains(text, '不可叠加') THEN false WHEN contains(text, '可叠加') THEN true END AS stackable, {_END_LABEL} AS end_note FROM a""")
def rule_struct(spark, d):
    names = ("rule_type", "threshold_amount", "discount_amount", "per_user_limit", "stackable", "end_note")
    e = X.extract_fields(notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text"), fields=names)
    return e.select("order_key", "line_no", "part_key", "supp_key", "rule_type", "threshold_amount", "discount_amount", "per_user_limit", "stackable", "end_note")


def _sql_date(match: str, first: int) -> str:
    parts = [f"regexp_extract({match}, '(\\d+)年(\\d+)月(\\d+)日.*?(?:(\\d+)年(\\d+)月(\\d+)日)?$', {i})" for i in range(first, first + 3)]
    return f"concat(lpad({parts[0]}, 4, '0'), '-', lpad({parts[1]}, 2, '0'), '-', lpad({parts[2]}, 2, '0'))"


@query("date_extract", f"""
WITH {cte('notices')}, m AS (SELECT order_key, line_no, part_key, supp_key, {sql_group('text', X.DATE_RANGE, 0)} AS r, {sql_group('text', X.DATE_FROM, 0)} AS f, {sql_group('text', X.DATE_TO, 0)} AS t,
  {sql_group('text', X.ISO_RANGE, 1)} AS i1, {sql_group('text', X.ISO_RANGE, 2)} AS i2 FROM notices)
SELECT order_key, line_no, part_key, supp_key, CASE WHEN r IS NOT NULL THEN {_sql_date('r', 1)} WHEN f IS NOT NULL THEN {_sql_date('f', 1)} ELSE i1 END AS effective_from,
  CASE WHEN r IS NOT NULL THEN {_sql_date('r', 4)} WHEN t IS NOT NULL THEN {_sql_date('t', 1)} ELSE i2 END AS effective_to FROM m""")
def date_extract(spark, d):
    n = notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text").withColumn("e", X.effective_dates(F.col("text")))
    return n.select("order_key", "line_no", "part_key", "supp_key", F.col("e.from.value").alias("effective_from"), F.col("e.to.value").alias("effective_to"))


_FUND, _FUND_QUOTE = sql_first_keyword("text", R.FUNDING_RULES, 40, 80)
_DOC_NO, _ISSUER = sql_group("text", X.DOC_NO), sql_group("text", X.ISSUER)


@query("funding_issuer_docno", f"""
WITH {cte('notices')}, m AS (SELECT *, {_ISSUER} AS iss FROM notices)
SELECT order_key, line_no, part_key, supp_key, {_DOC_NO} AS doc_no, iss AS issuer,
  CASE WHEN iss IS NOT NULL THEN {sql_compact("substr(text, greatest(strpos(text, iss) - 30, 1), strpos(text, iss) - greatest(strpos(text, iss) - 30, 1) + length(iss) + 50)")} END AS issuer_quote,
  {_FUND} AS funding_source, {sql_compact('(' + _FUND_QUOTE + ')')} AS funding_quote FROM m""")
def funding_issuer_docno(spark, d):
    t = F.col("text")
    n = notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text").withColumns({"n": X.doc_number(t), "i": X.issuer(t), "f": X.funding_source(t)})
    return n.select("order_key", "line_no", "part_key", "supp_key", F.col("n.value").alias("doc_no"), F.col("i.value").alias("issuer"), F.col("i.quote").alias("issuer_quote"),
                    F.col("f.value").alias("funding_source"), F.col("f.quote").alias("funding_quote"))


COND_WORDS = ("the ", "que ", "der ", "los ")


@query("conditions", f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。；\n]'), lambda x: {sql_clean('x')}), lambda v: length(v) BETWEEN 12 AND 220 AND {any_contains('v', COND_WORDS)}) AS c FROM documents)
SELECT doc_id, len(c) AS condition_count, md5(array_to_string(c, '；')) AS conditions_md5 FROM s""")
def conditions(spark, d):
    df = table(spark, d, "documents").withColumn("c", X.conditions(F.col("text"), COND_WORDS))
    return df.select("doc_id", F.size("c").cast("bigint").alias("condition_count"), F.md5(F.array_join("c", "；").cast("binary")).alias("conditions_md5"))


EVIDENCE_FIELDS = ("rate", "cap_amount", "effective_to", "doc_no", "funding_source")
_TO_QUOTE = f"coalesce({sql_group('text', X.DATE_RANGE, 0)}, {sql_group('text', X.DATE_TO, 0)}, {sql_group('text', X.ISO_RANGE, 0)})"


@query("evidence_unpivot", f"""
WITH {cte('notices')}, {_AMOUNTS}, cells AS (
  SELECT order_key, line_no, part_key, 'rate' AS field_name, CASE WHEN rate IS NOT NULL THEN {sql_compact('rm')} END AS quote, 0.88 AS confidence FROM a
  UNION ALL SELECT order_key, line_no, part_key, 'cap_amount', CASE WHEN cap IS NOT NULL THEN {sql_compact('cm')} WHEN best IS NOT NULL THEN {quoted(R.REDUCTION_CAP_QUOTE)} END, CASE WHEN cap IS NOT NULL THEN 0.9 ELSE 0.68 END FROM a
  UNION ALL SELECT order_key, line_no, part_key, 'effective_to', {sql_compact(_TO_QUOTE)}, CASE WHEN {sql_group('text', X.DATE_RANGE, 0)} IS NOT NULL THEN 0.86 WHEN {sql_group('text', X.DATE_TO, 0)} IS NOT NULL THEN 0.78 ELSE 0.82 END FROM a
  UNION ALL SELECT order_key, line_no, part_key, 'doc_no', {_DOC_NO}, 0.94 FROM a
  UNION ALL SELECT order_key, line_no, part_key, 'funding_source', {sql_compact('(' + _FUND_QUOTE + ')')}, 0.72 FROM a)
SELECT order_key, line_no, part_key, field_name, quote, CAST(confidence AS DOUBLE) AS confidence FROM cells WHERE quote IS NOT NULL""")
def evidence_unpivot(spark, d):
    e = X.extract_cells(notices(spark, d, "order_key", "line_no", "part_key", "text"), fields=EVIDENCE_FIELDS)
    return X.evidence_rows(e, ["order_key", "line_no", "part_key"], EVIDENCE_FIELDS).drop("page_number")


# --- relevance -------------------------------------------------------------------------------

DOC_VOCABULARY = V.Vocabulary(
    rules=(R.Weighted("tion", 18), R.Weighted("the", 5), R.Weighted("eau", 13), R.Weighted("sch", 11), R.Weighted("ing", 8), R.Weighted("que", 7), R.Weighted("worthless", 16)),
    strong=("eaueau", "sch"), topics=("with", "les"), companion="ment", policy_types=("policy", "implementation", "notice"),
    negative_title=("|", "###"), negative_body=("spam", "click"), mechanism=r"th.*ing|\d+\s*%")


def _sql_relevance(v: V.Vocabulary, source: str, fields: dict[str, str], keys: str) -> str:
    """Scoring in integer hundredths over a relation with title and text."""
    occur = lambda c, w: f"(length({c}) - length(replace({c}, {quoted(w)}, ''))) // {len(w)}"
    points = []
    for w, weight in v.rules:
        hit = f"contains(t, {quoted(w)}) OR contains(text, {quoted(w)})"
        points.append(f"CASE WHEN {hit} THEN {weight} * (CASE WHEN contains(t, {quoted(w)}) THEN 145 ELSE 100 END) + {45 * weight} * least(2, {occur('head', w)}) + {8 * weight} * least(1, {occur('text', w)}) ELSE 0 END")
    f = lambda n: fields.get(n, "false")
    strong = lambda c: f"({any_contains(c, v.strong)} OR ({any_contains(c, v.topics)} AND contains({c}, {quoted(v.companion)})))"
    amount = f("amount")
    return f"""
rel_base AS (SELECT *, coalesce(title, '') AS t, text AS head FROM {source}),
rel_flags AS (SELECT *, {' + '.join(points)} AS points, kind IN {in_list(v.policy_types)} AS pol, {any_contains('t', v.negative_title)} AS negt, {any_contains('head', v.negative_body)} AS negb,
  {strong('t')} AS st, {strong('head')} AS sh, regexp_matches(head, {quoted(v.mechanism)}) AS mech FROM rel_base),
rel_raw AS (SELECT *, points + 100 * ((CASE WHEN pol THEN 18 ELSE 0 END) + (CASE WHEN {f('doc_no')} THEN 12 ELSE 0 END) + (CASE WHEN {f('issuer')} THEN 7 ELSE 0 END) + (CASE WHEN {f('funding')} THEN 5 ELSE 0 END)
  + (CASE WHEN {f('category')} THEN 5 ELSE 0 END) + (CASE WHEN {amount} THEN 12 ELSE 0 END) + (CASE WHEN {f('date')} THEN 7 ELSE 0 END) - (CASE WHEN negt THEN 24 ELSE 0 END)
  - (CASE WHEN kind IN ('news', 'interpretation') THEN 16 ELSE 0 END) - (CASE WHEN kind = 'listing' THEN 22 ELSE 0 END) - (CASE WHEN negb AND NOT {f('doc_no')} AND NOT {amount} THEN 12 ELSE 0 END)) AS raw FROM rel_flags),
rel_score AS (SELECT *, CAST(greatest(0, least(1000, floor((raw + 5) / 10.0))) AS BIGINT) AS score_tenths FROM rel_raw),
rel_strong AS (SELECT *, st OR (sh AND score_tenths >= 300) AS strong FROM rel_score),
rel_done AS (SELECT *, (strong OR pol OR {f('doc_no')} OR {f('issuer')}) AND mech AND NOT (negt AND NOT strong) AS related FROM rel_strong),
relevance AS (SELECT {keys}, score_tenths, CASE WHEN score_tenths >= 550 THEN 'high' WHEN score_tenths >= 280 THEN 'medium' WHEN score_tenths >= 120 THEN 'low' ELSE 'none' END AS level, related AS is_related,
  related AND pol AND (strong OR {f('doc_no')} OR {amount} OR {f('date')} OR {f('issuer')}) AND NOT negt AS importable,
  CAST(least(98, floor((2 * (392 + score_tenths) + 14) / 28.0)) AS BIGINT) AS confidence_pct FROM rel_done)"""


def _relevance_columns(*keys):
    r = F.col("relevance")
    return [*keys, F.round(r["score"] * 10).cast("bigint").alias("score_tenths"), r["level"].alias("level"), r["is_related"].alias("is_related"), r["importable"].alias("importable"),
            F.round(r["confidence"] * 100).cast("bigint").alias("confidence_pct")]


_DOC_SCORES = f"{_TITLE_CTE}, scored_in AS (SELECT doc_id, text, coalesce(named, plain) AS title, 'unknown' AS kind FROM titled), {_sql_relevance(DOC_VOCABULARY, 'scored_in', {}, 'doc_id')}"


@query("keyword_relevance", f"WITH {_DOC_SCORES} SELECT * FROM relevance")
def keyword_relevance(spark, d):
    return scored_documents(table(spark, d, "documents"), vocabulary=DOC_VOCABULARY).select(*_relevance_columns("doc_id"))


@query("relevance_levels", f"WITH {_DOC_SCORES} SELECT level, count(*) AS documents, count(*) FILTER (is_related) AS related, CAST(sum(score_tenths) AS BIGINT) AS score_tenths FROM relevance GROUP BY level")
def relevance_levels(spark, d):
    return level_histogram(scored_documents(table(spark, d, "documents"), vocabulary=DOC_VOCABULARY))


_NOTICE_FIELDS = {"doc_no": f"({_DOC_NO} IS NOT NULL)", "issuer": f"({_ISSUER} IS NOT NULL)", "funding": f"(({_FUND}) IS NOT NULL)", "category": "true",
                  "amount": "(rate IS NOT NULL OR cap IS NOT NULL OR fixed IS NOT NULL OR rule_text IS NOT NULL)", "date": f"({_TO_QUOTE} IS NOT NULL)"}
_FIT = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_clean('l')}), lambda t: length(t) BETWEEN 6 AND 100)"
_NOTICE_TITLE = f"coalesce(list_filter({_FIT}, lambda t: {any_contains('t', R.TITLE_LINE_WORDS)})[1], {_FIT}[1])"
_NOTICE_IN = (f"{cte('notices')}, {_AMOUNTS}, with_title AS (SELECT a.*, {_NOTICE_TITLE} AS title FROM a), scored_in AS (SELECT *, CASE WHEN {_sql_class('title')} = 'unknown' "
              f"AND contains(title, '政策') AND length(text) < 500 THEN 'listing' ELSE {_sql_class('title')} END AS kind FROM with_title)")


@query("notice_relevance", f"WITH {_NOTICE_IN}, {_sql_relevance(V.DEFAULT, 'scored_in', _NOTICE_FIELDS, 'order_key, line_no, part_key, supp_key')} SELECT * FROM relevance")
def notice_relevance(spark, d):
    names = ("title", "document_type", "doc_no", "issuer", "funding_source", "category", "rate", "amount_value", "cap_amount", "rule_text", "effective_from", "effective_to")
    e = X.extract_fields(notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "text"), fields=names)
    return V.score_relevance(e, "text", "title").select(*_relevance_columns("order_key", "line_no", "part_key", "supp_key"))


# --- geography -------------------------------------------------------------------------------

_TITLE_PROVINCES = sorted(R.PROVINCE_NAMES, key=len, reverse=True)


@query("jurisdiction", f"""
WITH {cte('notices')} SELECT order_key, line_no, part_key, supp_key, (SELECT p FROM (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(_TITLE_PROVINCES))}) v(i, p) WHERE contains(title, p) ORDER BY i LIMIT 1) AS jurisdiction_name,
  list_filter(regexp_extract_all(concat(title, '\n', text), '[\\x{{4E00}}-\\x{{9FFF}}]{{2,6}}市', 0), lambda x: NOT {any_contains('x', R.CITY_EXCLUDED)})[1] AS city,
  list_filter(regexp_extract_all(concat(title, '\n', text), '[\\x{{4E00}}-\\x{{9FFF}}]{{2,8}}(?:区|县|旗)', 0), lambda x: NOT {any_contains('x', R.CITY_EXCLUDED)})[1] AS district FROM notices""")
def jurisdiction(spark, d):
    t = F.col("text")
    n = notices(spark, d, "order_key", "line_no", "part_key", "supp_key", "title", "text").withColumns({"j": X.jurisdiction(t, F.col("title")), "g": X.city_district(t, F.col("title"))})
    return n.select("order_key", "line_no", "part_key", "supp_key", F.col("j.value").alias("jurisdiction_name"), F.col("g.city").alias("city"), F.col("g.district").alias("district"))


GEO_CITIES = ["", "", "广州市", "苏州市", "杭州市", "", "", "成都市"]
GEO_DISTRICTS = ["海淀区", "宝山区", "天河区", "虎丘区", "西湖区", "阿荣旗", "巴彦县", "锦江区"]
GEO_HOSTS = ["beijing", "shanghai", "guangdong", "jiangsu", "zhejiang", "nmg", "hlj", "sichuan"]
_PICK = lambda items: "([" + ", ".join(quoted(x) for x in items) + "])[c_custkey % 8 + 1]"


@query("geo_infer", f"""
WITH b AS (SELECT c_custkey, c_custkey % 5 AS v, {_PICK(PROVINCES)} AS p, {_PICK(GEO_CITIES)} AS c, {_PICK(GEO_DISTRICTS)} AS dd, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN v = 4 THEN '全国' ELSE p END AS province, CASE WHEN v = 4 THEN '' WHEN p IN {in_list(R.MUNICIPALITIES)} THEN p WHEN v = 3 THEN '' ELSE c END AS city,
  CASE WHEN v IN (3, 4) THEN '' ELSE dd END AS district, n_nationkey % 2 = 0 AS even FROM b""")
def geo_infer(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pick = lambda items: F.get(F.array(*[F.lit(x) for x in items]), F.col("c_custkey") % 8)
    v = F.col("c_custkey") % 5
    c = c.withColumns({"p": pick(PROVINCES), "s": pick(SHORT), "ct": pick(GEO_CITIES), "dd": pick(GEO_DISTRICTS), "h": pick(GEO_HOSTS)})
    # v: 0 all parts given, 1 one joined name, 2 from the title, 3 only the URL, 4 national
    name = F.when(v == 0, F.concat(F.lit(" "), F.col("s"))).when(v == 1, F.concat("p", "ct")).when(v == 4, F.lit("全国范围")).otherwise("")
    city = F.when(v == 0, F.concat("ct", F.when(F.col("ct") != "", "人民政府").otherwise(""))).otherwise("")
    district = F.when(v == 0, F.concat("s", "dd")).when(v == 1, F.col("dd")).otherwise("")
    title = F.when(v == 2, F.concat("p", F.lit("："), "ct", F.lit("、"), "dd", F.lit("，补贴清单"))).otherwise("")
    url = F.when(v == 3, F.concat(F.lit("https://swt."), F.col("h"), F.lit(".gov.cn/x"))).otherwise("")
    c = c.withColumns({"n": name, "cc": city, "ds": district, "tt": title, "uu": url})
    out = G.infer_geo(c, "n", "cc", "ds", "tt", "uu")
    return out.select("c_custkey", "province", "city", "district", (F.col("n_nationkey") % 2 == 0).alias("even"))


@query("province_lookup", f"""
SELECT c_custkey, ([{', '.join(quoted(f) for f, _ in R.PROVINCES)}])[c_custkey % 34 + 1] AS province, c_custkey % 34 < 4 AS municipality,
  CASE WHEN c_custkey % 34 = 31 THEN '' ELSE 'x' END AS marker FROM customer""")
def province_lookup(spark, d):
    short = F.get(F.array(*[F.lit(s) for _, s in R.PROVINCES]), F.col("c_custkey") % 34)
    name = F.concat(F.lit("关于 "), F.substring(short, 1, 1), F.lit(" "), F.substr(short, F.lit(2)), F.lit("地区"))
    return table(spark, d, "customer").select(
        "c_custkey", G.normalize_province(name).alias("province"), G.is_municipality(name).alias("municipality"), F.when(F.col("c_custkey") % 34 == 31, "").otherwise("x").alias("marker"))


_FIXES = ["北京", "河北", None, "全国", None]


@query("jurisdiction_fix", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '内蒙古' WHEN 1 THEN '浙江' WHEN 2 THEN NULL WHEN 3 THEN '全国' ELSE NULL END AS jurisdiction FROM pages""")
def jurisdiction_fix(spark, d):
    p = table(spark, d, "pages")
    v = F.col("page_id") % 5
    title = F.when(v == 0, "内 蒙古通知").when(v == 3, "商务部 通知").otherwise(F.lit("补贴"))
    host = F.when(v == 1, "swt.zj.gov.cn").when(v == 3, "www.gov.cn").when(v == 4, "www.gov.cn").otherwise(U.url_host("url"))
    return p.select("page_id", G.corrected_jurisdiction(title, host).alias("jurisdiction"))


# --- keys and snapshots ----------------------------------------------------------------------

@query("dedup_key", f"""
WITH p AS (SELECT doc_id, list_filter([{', '.join(f"lower({sql_squeeze(sql_normalize(c))})" for c in ('text', "CASE WHEN doc_id % 3 = 0 THEN lang END", "CASE WHEN doc_id % 2 = 0 THEN source END"))}], lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, CASE WHEN len(parts) < 2 THEN '' ELSE sha256(array_to_string(parts, '|')) END AS dedup_key FROM p""")
def dedup_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", dedup_key("text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("dedup_key"))


@query("snapshot_manifest", """
WITH s AS (SELECT sha256(text) AS hash, strlen(text) AS byte_size, CASE WHEN doc_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END AS mime_type,
  CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.html' ELSE '.bin' END AS extension, doc_id FROM documents)
SELECT hash, min_by(byte_size, doc_id) AS byte_size, min_by(mime_type, doc_id) AS mime_type, min_by(extension, doc_id) AS extension, '2024' AS year, '01' AS month FROM s GROUP BY hash""")
def manifest(spark, d):
    docs = table(spark, d, "documents").select(
        F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 3 == 0, "A/b.TXT").otherwise("noext").alias("name"),
        F.when(F.col("doc_id") % 2 == 0, "Text/html; charset=utf-8").alias("mime"), F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id")).alias("fetched_at"))
    out = snapshot_manifest(docs, "content", "name", "mime", "fetched_at")
    return out.select("hash", F.col("byte_size").cast("bigint").alias("byte_size"), F.lower("mime_type").alias("mime_type"), "extension", "year", "month")
