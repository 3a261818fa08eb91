"""Field extraction from policy text: every cell is ``struct<value, confidence, quote>`` or null.

All cells are native Column expressions over one text column. ``extract_fields`` stages them in
three projections so that shared intermediate values (title, matches) are computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake import rules as R
from policylake.functions import text as T
from policylake.functions.text import NUMBER, col, contains_any, filled, fmt_date, has_word, let

S = r"[\s\x{A0}\x{3000}]*"
HAN = r"[\x{4E00}-\x{9FFF}]"

# The patterns that define the fields.
DOC_CORE = rf"[〔\[]\d{{4}}[〕\]]{S}第?{S}\d+{S}号"
DOC_PREFIX = rf"{HAN[:-1]}A-Za-z]{{0,10}}\z"
DOC_NO = rf"({HAN[:-1]}A-Za-z]{{0,10}}{DOC_CORE})"
ISSUER = (
    "(国务院|财政部|商务部|国家发展改革委|国家发改委|工业和信息化部|农业农村部|市场监管总局|省(?:人民)?政府"
    "|市(?:人民)?政府|商务厅|财政厅|发展改革委|农业农村厅|商务局|财政局)"
)
PUBLISHED = rf"(?:发布日期|发布时间|印发日期)[：: ]*{S}(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日"
REDUCTION = rf"满{S}\d+(?:\.\d+)?{S}减{S}\d+(?:\.\d+)?"
REDUCTION_THRESHOLD = rf"满{S}{NUMBER}"
REDUCTION_DISCOUNT = rf"减{S}{NUMBER}"
RATE_PREFIX = rf"(?:补贴|补助|按|比例(?:为|不超过)?|给予)[^\d%]{{0,18}}{NUMBER}{S}%"
RATE_SUFFIX = rf"{NUMBER}{S}%[^。；\n]{{0,35}}(?:补贴|补助|优惠)"
CAP = rf"(?:最高|上限|最高不超过|不超过)[^\d]{{0,12}}{NUMBER}{S}元"
FIXED = rf"(?:补贴|补助|每件|每台|每人|每户|每辆|每部)[^\d\n]{{0,16}}{NUMBER}{S}元"
DATE = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
DATE_RANGE = rf"(?:自|从)?{S}{DATE}{S}(?:起)?{S}(?:至|到|-|—|~|～){S}{DATE}"
DATE_FROM = rf"(?:自|从|于)?{S}{DATE}(?:起|开始)?(?:施行|执行|生效|实施)"
DATE_TO = rf"(?:有效期至|截止(?:日期)?(?:为)?|至){S}{DATE}"
ISO_RANGE = rf"(20\d{{2}}-\d{{2}}-\d{{2}}){S}(?:至|到|—|~|～){S}(20\d{{2}}-\d{{2}}-\d{{2}})"
LIMITS = (r"每人每类(?:产品)?可补贴(\d+)件", r"每人可补贴(\d+)次", r"每个消费者每类可补贴(\d+)件")
ANY_LIMIT = "|".join(LIMITS)
REGION = rf"({HAN}{{2,8}}(?:市|州|盟|地区))"
CITY = rf"({HAN}{{2,6}}市)"
DISTRICT = rf"({HAN}{{2,8}}(?:区|县|旗))"
# The same matches as the patterns above, with fewer branches to try at every place of a text.
FAST_RATE_PREFIX = rf"(?:补[贴助]|按|比例(?:为|不超过)?|给予)[^\d%]{{0,18}}{NUMBER}{S}%"
FAST_RATE_SUFFIX = rf"\d++(?:\.\d++)?+{S}%[^。；\n]{{0,35}}(?:补贴|补助|优惠)"
FAST_FIXED = rf"(?:补[贴助]|每[件台人户辆部])[^\d\n]{{0,16}}{NUMBER}{S}元"
FAST_ISSUER = (
    "(国(?:务院|家发(?:展改革委|改委))|财政[部厅局]|商务[部厅局]|市(?:(?:人民)?政府|场监管总局)|省(?:人民)?政府|发展改革委"
    "|工业和信息化部|农业农村[部厅])"
)
DAY = r"\d{4}年\d{1,2}月\d{1,2}日"
RANGE_CORE = rf"{DAY}{S}(?:起)?{S}[至到\-—~～]{S}{DAY}"
FROM_CORE = rf"{DAY}(?:起|开始)?(?:[施执]行|生效|实施)"
LISTING_TITLE = rf"(栏目|专题|首页|政策文件|通知公告){S}$"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """Captured group, null instead of '' when there is no match."""
    return filled(F.regexp_extract(c, pattern, index))


def cell(value: Column, confidence: float | Column, quote: Column | str | None = None) -> Column:
    """Field cell; null when the value is null. Blank quotes are null, others one line."""
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    if quote is None:
        quoted = F.lit(None).cast("string")
    else:
        raw = F.lit(quote) if isinstance(quote, str) else quote
        quoted = filled(T.compact(raw))
    built = lambda v: F.struct(v.alias("value"), confidence.cast("double").alias("confidence"), quoted.alias("quote"))
    return let(value, lambda v: F.when(v.isNotNull(), built(v)))


def number(c: Column) -> Column:
    return c.try_cast("double")


def _window(text: Column, at: Column, length: Column, before: int, after: int) -> Column:
    start = F.greatest(at - before, F.lit(1))
    return F.substr(text, start, at - start + length + after)


def infer_title(text: Column, heading: Column | None, og_title: Column | None, title: Column | None, named_lines: int | None = None, plain_lines: int | None = None) -> Column:
    """``struct<value, raw>``: page titles (those there are) first, then a policy-like line, then any line.

    Looks through all lines, unless the first ones to look for either kind in are given.
    """
    top = lambda lines, n: lines if n is None else F.slice(lines, 1, n)

    def from_meta(c: Column) -> Column:
        return let(T.clean_title(c), lambda t: F.when(F.char_length(t) >= 6, F.struct(t.alias("value"), T.clean_text(c).alias("raw"))))

    def from_lines(lines: Column) -> Column:
        fits = lambda x: F.char_length(x).between(6, 100)
        none = F.lit(None).cast("string")
        first = lambda n, good: F.aggregate(top(lines, n), none, lambda found, x: F.coalesce(found, let(T.clean_text(x), lambda c: F.when(good(c), c))))
        named = first(named_lines, lambda c: fits(c) & contains_any(c, R.TITLE_LINE_WORDS))
        plain = first(plain_lines, fits)
        return let(F.coalesce(named, plain), lambda t: F.when(t.isNotNull(), F.struct(t.alias("value"), t.alias("raw"))))

    lines = F.filter(F.split(text, LINE_BREAK), lambda x: T.trimmed(x) != "")
    return F.coalesce(*[F.when(c != "", from_meta(c)) for c in (heading, og_title, title) if c is not None], let(lines, from_lines))


def classify_title(title: Column | str) -> Column:
    """Document class from the title alone."""
    t = F.coalesce(col(title), F.lit(""))
    return (
        F.when(has_word(t, R.NEWS_TITLE_WORDS), "news")
        .when(has_word(t, R.INTERPRETATION_TITLE_WORDS), "interpretation")
        .when(has_word(t, R.IMPLEMENTATION_TITLE_WORDS), "implementation")
        .when(has_word(t, R.POLICY_TITLE_WORDS), "policy")
        .when(t.rlike(LISTING_TITLE), "listing")
        .otherwise("unknown")
    )


def classify_document(title: Column | str, text: Column | str) -> Column:
    """``classify_title``, and a short text under a policy-named title is a listing."""
    t, body = F.coalesce(col(title), F.lit("")), col(text)
    kind = classify_title(t)
    short = t.contains("政策") & (F.char_length(body) < 500)
    return F.when((kind == "unknown") & short, "listing").otherwise(kind)


def _doc_no(text: Column) -> Column:
    """First match of ``DOC_NO``: its bracket is looked for, then the characters before it.

    A prefix holds no bracket, so the first bracket that matches is that of the leftmost match; the pattern
    itself would try a prefix of ten characters at every place of the text.
    """
    def build(core: Column) -> Column:
        head = F.right(F.call_function("substring_index", text, core, F.lit(1)), F.lit(10))
        return F.when(core.isNotNull(), F.concat(F.regexp_extract(head, DOC_PREFIX, 0), core))
    found = F.when(text.contains("〔") | text.contains("["), F.regexp_extract(text, DOC_CORE, 0))
    return let(filled(found), build)


def doc_number(text: Column) -> Column:
    return let(_doc_no(text), lambda n: cell(n, 0.94, n))


def issuer(text: Column) -> Column:
    """Leftmost agency name, which need not be the most specific one."""
    def build(name: Column) -> Column:
        return cell(name, 0.72, let(F.position(name, text), lambda at: _window(text, at, F.char_length(name), 30, 50)))
    return let(group(text, FAST_ISSUER), lambda n: F.when(n.isNotNull(), build(n)))


def keyword_cell(text: Column, rule_set: Sequence[R.Rule], before: int, after: int, confidence: float) -> Column:
    return let(T.first_keyword_match(text, rule_set, before, after), lambda h: cell(h["value"], confidence, h["quote"]))


def funding_source(text: Column, rule_set: Sequence[R.Rule] = R.FUNDING_RULES) -> Column:
    return keyword_cell(text, rule_set, 40, 80, 0.72)


def program(text: Column, rule_set: Sequence[R.Rule] = R.PROGRAM_RULES) -> Column:
    return keyword_cell(text, rule_set, 40, 60, 0.88)


def end_note(text: Column, rule_set: Sequence[R.Rule] = R.END_NOTE_RULES) -> Column:
    return keyword_cell(text, rule_set, 40, 50, 0.72)


def cap_unit(text: Column, rule_set: Sequence[R.Rule] = R.CAP_UNIT_RULES) -> Column:
    default = cell(F.lit(R.DEFAULT_CAP_UNIT), 0.65, R.DEFAULT_CAP_UNIT_QUOTE)
    return F.coalesce(keyword_cell(text, rule_set, 40, 40, 0.65), default)


def published_at(text: Column, meta_date: Column) -> Column:
    stated = F.when(text.rlike(PUBLISHED), fmt_date(*[F.regexp_extract(text, PUBLISHED, i) for i in (1, 2, 3)]))
    value = F.coalesce(F.nullif(T.strip(F.coalesce(meta_date, F.lit(""))), F.lit("")), stated)
    return let(value, lambda v: cell(v, 0.72, v))


def jurisdiction(text: Column, title: Column, provinces: Sequence[str] = R.PROVINCE_NAMES) -> Column:
    """Province in title, then text (longest names first); national words; first region."""
    ordered = [R.Rule(p, (p,)) for p in sorted(provinces, key=len, reverse=True)]
    title = F.coalesce(title, F.lit(""))
    find = lambda c: T.first_keyword_match(c, ordered, 20, 45)
    national = F.when(has_word(title, R.NATIONAL_TITLE_WORDS), F.struct(F.lit(R.NATIONAL).alias("value"), title.alias("quote")))
    region = let(group(text, REGION), lambda r: F.when(r.isNotNull(), F.struct(r.alias("value"), r.alias("quote"))))
    hit = F.coalesce(find(title), find(text), national, region)
    return let(hit, lambda h: cell(h["value"], 0.68, h["quote"]))


def city_district(text: Column, title: Column) -> Column:
    """``struct<city, district>``: first admissible names in the title and the text."""
    source = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text)
    reject = R.any_of(R.CITY_EXCLUDED)

    def first(source: Column, pattern: str, ends: Sequence[str]) -> Column:
        found = F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
        return F.when(contains_any(source, ends), F.get(F.filter(found, lambda x: ~x.rlike(reject)), 0))

    return let(source, lambda s: F.struct(first(s, CITY, ["市"]).alias("city"), first(s, DISTRICT, ["区", "县", "旗"]).alias("district")))


def categories(text: Column, rule_set: Sequence[R.Rule] = R.CATEGORY_RULES, before: int = 35, after: int = 45) -> Column:
    """``struct<labels array, quote>`` of all matching labels; the quote is the first label's."""
    def build(hits: Column) -> Column:
        first = F.get(hits, 0)["keyword"]
        at = F.position(first, text)
        return F.struct(F.transform(hits, lambda h: h["label"]).alias("labels"), let(at, lambda a: _window(text, a, F.char_length(first), before, after)).alias("quote"))

    def tried(r: R.Rule) -> Column:
        hit = lambda k: F.struct(F.lit(r.label).alias("label"), F.lit(k).alias("keyword"))
        return F.coalesce(*[F.when(text.contains(F.lit(k)), hit(k)) for k in r.keywords])

    return let(F.array_compact(F.array(*[tried(r) for r in rule_set])), build)


def reductions(text: Column) -> Column:
    """Distinct threshold-reduction phrases in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(REDUCTION), F.lit(0)))
    return F.when(text.contains("满") | text.isNull(), found).otherwise(F.array().cast("array<string>"))


def max_discount(rule_text: Column) -> Column:
    return T.max_number(rule_text, REDUCTION_DISCOUNT)


def percentage(text: Column) -> Column:
    def build(m: Column) -> Column:
        value = number(F.coalesce(group(m, FAST_RATE_PREFIX), group(m, RATE_SUFFIX)))
        return F.when(~has_word(m, R.RATE_EXCLUDED), cell(value, 0.88, m))
    match = F.when(text.contains("%"), F.coalesce(group(text, FAST_RATE_PREFIX, 0), group(text, FAST_RATE_SUFFIX, 0)))
    return let(match, lambda m: F.when(m.isNotNull(), build(m)))


def cap_amount(text: Column) -> Column:
    return let(group(text, CAP, 0), lambda m: F.when(~has_word(m, R.CAP_EXCLUDED), cell(number(group(m, CAP)), 0.9, m)))


def fixed_amount(text: Column) -> Column:
    return let(group(text, FAST_FIXED, 0), lambda m: cell(number(group(m, FAST_FIXED)), 0.78, m))


def amount_type(text: Column, has_reduction: Column, reduction_quote: Column, rate: Column, cap: Column, fixed: Column) -> Column:
    """Tier words override all; then percent, threshold reduction, cap, fixed amount, unknown."""
    lit = lambda v, conf, q: cell(F.lit(v), conf, q)
    return (
        F.when(contains_any(text, R.TIER_WORDS), lit("tiered", 0.72, R.TIER_QUOTE))
        .when(rate.isNotNull(), lit("percent", 0.86, rate["quote"]))
        .when(has_reduction, lit("tiered", 0.82, reduction_quote))
        .when(cap.isNotNull(), lit("fixed", 0.62, cap["quote"]))
        .when(fixed.isNotNull(), lit("fixed", 0.72, fixed["quote"]))
        .otherwise(lit("unknown", 0.25, None))
    )


def structured_rule_type(rule_text: Column, rate: Column, fixed: Column) -> Column:
    lit = lambda v, conf, q: cell(F.lit(v), conf, q)
    return (
        F.when(rule_text.isNotNull(), lit("full_reduction", 0.9, rule_text))
        .when(rate.isNotNull(), lit("percentage", 0.9, rate["quote"]))
        .when(fixed.isNotNull(), lit("fixed", 0.82, fixed["quote"]))
        .otherwise(lit("unknown", 0.3, None))
    )


def per_user_limit(text: Column) -> Column:
    match = group(text, ANY_LIMIT, 0)
    return let(match, lambda m: cell(F.coalesce(*[group(m, ANY_LIMIT, i) for i in (1, 2, 3)]).try_cast("int"), 0.82, m))


def stackable(text: Column) -> Column:
    return (
        F.when(contains_any(text, R.NOT_STACKABLE_WORDS), cell(F.lit(False), 0.82, "不可叠加"))
        .when(contains_any(text, R.STACKABLE_WORDS), cell(F.lit(True), 0.75, "可叠加"))
    )


BLANKS = " \t\n\x0b\x0c\r\xa0\u3000"  # the characters of S
DATE_CELL = "struct<value:string,confidence:double,quote:string>"


def _led(text: Column, core: str, leads: Sequence[str]) -> Column:
    """First match of ``core`` with the optional lead word and blanks before it, as ``(?:lead)?S core`` matches; null without one.

    A pattern that begins with optional parts is tried at length at every place of a text; ``core`` begins with a digit.
    """
    def build(match: Column) -> Column:
        def before(head: Column) -> Column:
            bare = F.rtrim(head, F.lit(BLANKS))
            lead = let(bare, lambda b: F.char_length(b) - F.when(F.right(b, F.lit(1)).isin(*leads), 1).otherwise(0))
            return F.substr(head, lead + 1)
        return F.when(match.isNotNull(), F.concat(let(F.call_function("substring_index", text, match, F.lit(1)), before), match))
    return let(group(text, core, 0), build)


def effective_dates(text: Column) -> Column:
    """``struct<from, to>`` of cells: a full range wins, then single dates, then an ISO range."""
    def date_cell(match: Column, first: int, confidence: float) -> Column:
        numbers = F.regexp_extract_all(match, F.lit(r"\d+"), F.lit(0))
        return cell(let(numbers, lambda n: fmt_date(*[F.get(n, i) for i in range(first, first + 3)])), confidence, match)

    def single(m: Column) -> Column:
        start, end, iso = m["start"], m["end"], m["iso"]
        when = lambda match, c: F.when(match.isNotNull(), c)
        return F.struct(
            F.coalesce(when(start, date_cell(start, 0, 0.78)), when(iso, cell(group(iso, ISO_RANGE, 1), 0.82, iso))).alias("from"),
            F.coalesce(when(end, date_cell(end, 0, 0.78)), when(iso, cell(group(iso, ISO_RANGE, 2), 0.82, iso))).alias("to"),
        )

    singles = F.struct(
        _led(text, FROM_CORE, ("自", "从", "于")).alias("start"), group(text, DATE_TO, 0).alias("end"), group(text, ISO_RANGE, 0).alias("iso"),
    )
    both = lambda full: F.struct(date_cell(full, 0, 0.86).alias("from"), date_cell(full, 3, 0.86).alias("to"))
    dates = let(_led(text, RANGE_CORE, ("自", "从")), lambda full: F.when(full.isNotNull(), both(full)).otherwise(let(singles, single)))
    return F.when(text.contains("20") | text.contains("年"), dates).otherwise(F.struct(*[F.lit(None).cast(DATE_CELL).alias(n) for n in ("from", "to")]))


def conditions(text: Column, condition_words: Sequence[str] = R.CONDITION_WORDS, limit: int | None = None) -> Column:
    """Sentences of 12 to 220 characters holding a condition word; with ``limit`` the first ones."""
    sentences = F.transform(F.split(text, r"[。；\n]"), T.clean_text)
    kept = F.filter(sentences, lambda s: F.char_length(s).between(12, 220) & has_word(s, condition_words))
    return kept if limit is None else F.slice(kept, 1, limit)


# The extracted fields in output order; the last two carry lists.
FIELDS = R.words(
    """
    title official_file_name document_type doc_no issuer funding_source published_at jurisdiction_name
    jurisdiction_city jurisdiction_district category program rule_text amount_type discount_amount cap_amount
    rate amount_value rule_type threshold_amount per_user_limit stackable cap_unit end_note effective_from
    effective_to conditions_text
    """
)
LIST_FIELDS = R.words("categories conditions")


def extract_cells(df: DataFrame, text: str = "text", heading: Column | None = None, og_title: Column | None = None,
                  title: Column | None = None, published: Column | None = None, prefix: str = "f_",
                  fields: Sequence[str] | None = None) -> DataFrame:
    """Adds one cell column per (wanted) field, named ``<prefix><field>``."""
    none = F.lit(None).cast("string")
    t = F.col(text)
    df = df.withColumns({
        "_title": infer_title(t, heading, og_title, title),
        "_red": reductions(t), "_rate": percentage(t), "_cap": cap_amount(t), "_fixed": fixed_amount(t),
        "_dates": effective_dates(t), "_cats": categories(t), "_cond": conditions(t),
    })
    ttl = F.col("_title")
    df = df.withColumns({
        "_geo": city_district(t, ttl["value"]),
        "_rule_text": F.when(F.size("_red") > 0, F.array_join("_red", "、")),
        "_red_quote": F.array_join("_red", "；"),
    })
    rule_text, red_quote = F.col("_rule_text"), F.col("_red_quote")
    rate, cap, fixed = F.col("_rate"), F.col("_cap"), F.col("_fixed")
    discount = max_discount(rule_text)
    red_cap = cell(discount, 0.68, R.REDUCTION_CAP_QUOTE)
    df = df.withColumn("_cap_all", F.coalesce(cap, red_cap))
    cats, cond, geo = F.col("_cats"), F.col("_cond"), F.col("_geo")
    first_cond = F.get(cond, 0)
    geo_quote = F.coalesce(geo["city"], geo["district"])
    joined = lambda arr, sep: F.when(F.size(arr) > 0, F.array_join(arr, sep))
    cells = {
        "title": lambda: cell(ttl["value"], 0.82, ttl["raw"]),
        "official_file_name": lambda: cell(ttl["value"], 0.8, ttl["raw"]),
        "document_type": lambda: cell(classify_document(ttl["value"], t), 0.82, ttl["raw"]),
        "doc_no": lambda: doc_number(t),
        "issuer": lambda: issuer(t),
        "funding_source": lambda: funding_source(t),
        "published_at": lambda: published_at(t, published if published is not None else none),
        "jurisdiction_name": lambda: jurisdiction(t, ttl["value"]),
        "jurisdiction_city": lambda: cell(geo["city"], 0.62, geo_quote),
        "jurisdiction_district": lambda: cell(geo["district"], 0.62, geo_quote),
        "category": lambda: cell(joined(cats["labels"], "、"), 0.78, cats["quote"]),
        "categories": lambda: cell(F.when(F.size(cats["labels"]) > 0, cats["labels"]), 0.68, cats["quote"]),
        "program": lambda: program(t),
        "rule_text": lambda: cell(rule_text, 0.88, red_quote),
        "amount_type": lambda: amount_type(t, rule_text.isNotNull(), red_quote, rate, F.col("_cap_all"), fixed),
        "discount_amount": lambda: F.when(rule_text.isNotNull(), cell(number(group(rule_text, REDUCTION_DISCOUNT)), 0.9, rule_text)),
        "cap_amount": lambda: F.col("_cap_all"),
        "rate": lambda: rate,
        "amount_value": lambda: fixed,
        "rule_type": lambda: structured_rule_type(rule_text, rate, fixed),
        "threshold_amount": lambda: cell(number(group(rule_text, REDUCTION_THRESHOLD)), 0.9, rule_text),
        "per_user_limit": lambda: per_user_limit(t),
        "stackable": lambda: stackable(t),
        "cap_unit": lambda: cap_unit(t),
        "end_note": lambda: end_note(t),
        "effective_from": lambda: F.col("_dates")["from"],
        "effective_to": lambda: F.col("_dates")["to"],
        "conditions": lambda: cell(F.when(F.size(cond) > 0, cond), 0.62, first_cond),
        "conditions_text": lambda: cell(joined(cond, "；"), 0.62, first_cond),
    }
    wanted = FIELDS + LIST_FIELDS if fields is None else fields
    df = df.withColumns({prefix + name: cells[name]() for name in wanted})
    return df.drop("_title", "_red", "_rate", "_cap", "_fixed", "_dates", "_cats", "_cond", "_geo", "_rule_text", "_red_quote", "_cap_all")


def field_map(prefix: str = "f_") -> Column:
    """``map<field, struct<value string, confidence, quote, page>>`` of the present cells."""
    def entry(name: str) -> Column:
        c = F.col(prefix + name)
        value = F.to_json(c["value"]) if name in LIST_FIELDS else c["value"].cast("string")
        body = F.struct(value.alias("value"), c["confidence"].alias("confidence"), c["quote"].alias("quote"), F.lit(None).cast("int").alias("page"))
        return F.when(c.isNotNull(), F.struct(F.lit(name).alias("key"), body.alias("value")))
    return F.map_from_entries(F.array_compact(F.array(*[entry(n) for n in FIELDS + LIST_FIELDS])))


def evidence_array(prefix: str = "f_", fields: Sequence[str] = FIELDS) -> Column:
    """Array of the cells that have a quote (list fields excluded)."""
    def entry(name: str) -> Column:
        c = F.col(prefix + name)
        return F.when(c["quote"].isNotNull(), F.struct(
            F.lit(name).alias("field_name"), c["quote"].alias("quote"),
            F.lit(None).cast("int").alias("page_number"), c["confidence"].alias("confidence")))
    return F.array_compact(F.array(*[entry(n) for n in fields]))


def evidence_rows(df: DataFrame, key: str | Sequence[str], fields: Sequence[str] = FIELDS, prefix: str = "f_") -> DataFrame:
    """One row per field with a quote."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.explode(evidence_array(prefix, fields)).alias("e")).select(*keys, "e.*")


def extract_fields(df: DataFrame, text: str = "text", fields: Sequence[str] | None = None, **meta: Column) -> DataFrame:
    """Adds the plain value of each field as its own column, plus ``fields`` (map of cells) and
    ``evidence`` (array of quotes) when all fields are wanted."""
    wanted = FIELDS + LIST_FIELDS if fields is None else fields
    out = extract_cells(df, text, fields=wanted, **meta)
    columns = {name: F.col("f_" + name)["value"] for name in wanted}
    if fields is None:
        columns.update(fields=field_map(), evidence=evidence_array())
    return out.withColumns(columns).drop(*["f_" + n for n in wanted])


def envelope(df: DataFrame, text: str = "text", error: str | None = None, max_chars: int | None = None) -> DataFrame:
    """Adds ``status`` and ``text_chars``; ``max_chars`` cuts the *stored* text (fields see the whole text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return df.withColumns({
        "status": F.when(failed, "failed").when(t == "", "ocr_required").otherwise("processed"),
        "text_chars": F.char_length(t),
        text: t if max_chars is None else F.substring(t, 1, max_chars),
    })
