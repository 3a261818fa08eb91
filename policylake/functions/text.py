"""Scalar text, number and JSON functions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake import rules as R

# Unicode white space; the Java class \s is ASCII only, so it is written out.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUMBER = r"(\d+(?:\.\d+)?)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Keeps the expression tree linear where a sub-expression is referenced repeatedly.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(c: Column) -> Column:
    """Null instead of ''. ``nullif`` repeats its argument inside branches and lambdas, this evaluates it once."""
    return let(c, lambda v: F.when(v != "", v))


def contains_any(c: Column, items: Sequence[str]) -> Column:
    """True when any literal word occurs in a long text: byte search per word, stops at a hit."""
    return reduce(lambda a, b: a | b, [c.contains(F.lit(w)) for w in items])


def has_word(c: Column, items: Sequence[str]) -> Column:
    """Same for short strings such as titles: one regular expression."""
    return c.rlike(R.any_of(items))


def words_in(c: Column, items: Sequence[str]) -> Column:
    """The words that occur, in vocabulary order."""
    return F.filter(F.expr(R.array_literal(items)), lambda w: c.contains(w))


def first_value(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Value of the first pair whose key occurs in ``c``; null without one."""
    start = F.lit(None).cast("string")
    return F.aggregate(F.expr(R.pairs_literal(pairs)), start, lambda acc, p: F.coalesce(acc, F.when(c.contains(p["key"]), p["value"])))


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def trimmed(c: Column | str) -> Column:
    """``strip`` for lambdas: it looks at the first and last character before it trims, as trimming compares each end with all of ``WHITESPACE``."""
    blank = lambda x: x.isin(*WHITESPACE)
    return let(col(c), lambda v: F.when(blank(F.left(v, F.lit(1))) | blank(F.right(v, F.lit(1))), F.btrim(v, F.lit(WHITESPACE))).otherwise(v))


def _untidy(x: Column) -> Column:
    """Whether ``_tidied`` would change the text: blanks in it, or white space at an end."""
    ends = [at(x, F.lit(1)).isin(*WHITESPACE) for at in (F.left, F.right)]
    return contains_any(x, ("　", "\t", "  ", "\n\n\n")) | ends[0] | ends[1]


def _tidied(x: Column) -> Column:
    runs = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("　"), F.lit(" ")), "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(runs, F.lit(WHITESPACE))


def clean_text(c: Column | str) -> Column:
    """Ideographic space to space, runs of blanks to one, three or more newlines to two, trim."""
    return let(col(c), lambda x: F.when(_untidy(x), _tidied(x)).otherwise(x))


def compact(c: Column | str, limit: int | None = None) -> Column:
    """``clean_text`` on one line; with ``limit`` its first characters."""
    line = let(col(c), lambda x: F.when(x.contains("\n") | _untidy(x), F.replace(_tidied(x), F.lit("\n"), F.lit(" "))).otherwise(x))
    return line if limit is None else F.substring(line, 1, limit)


# Section names after a separator and site names after a dash.
SECTION_SUFFIX = WS + r"*[_|｜]" + WS + r"*(?:其他政策文件|政策文件|通知公告|政务公开|政府信息公开|首页)(?s:.*)$"
SITE_SUFFIX = WS + r"*-" + WS + r"*(?:中国政府网|.*?人民政府|.*?商务厅|.*?财政厅|.*?商务局|.*?财政局)$"


def clean_title(c: Column | str) -> Column:
    """Drop everything from the first section separator, then a trailing site name."""
    out = F.regexp_replace(clean_text(c), SECTION_SUFFIX, "")
    return clean_text(F.regexp_replace(out, SITE_SUFFIX, ""))


# Text that normalising leaves as it is: ASCII and Han words with one space between them.
_PLAIN_WORD = r"[\x21-\x7E\x{4E00}-\x{9FFF}]++"
PLAIN_TEXT = rf"\A(?:{_PLAIN_WORD}(?: {_PLAIN_WORD})*+)?+\z"


def normalize_text(c: Column | str) -> Column:
    """White space runs to one space, curly quotes to straight, trim; null becomes ''."""
    text = F.coalesce(col(c), F.lit(""))
    return F.when(text.rlike(PLAIN_TEXT), text).otherwise(strip(straight_quotes(F.regexp_replace(text, WS + "+", " "))))


def straight_quotes(c: Column | str) -> Column:
    return F.translate(col(c), "“”‘’", "\"\"''")


def squeeze(c: Column | str) -> Column:
    """Remove all white space; null becomes ''."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), WS + "+", "")


def fmt_date(year: Column, month: Column, day: Column) -> Column:
    """Zero-padded YYYY-MM-DD text without calendar check."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def to_boolean(c: Column | str) -> Column:
    return F.coalesce(F.lower(col(c).cast("string")).isin("1", "true", "on", "yes"), F.lit(False))


def to_number(c: Column | str) -> Column:
    """Number or null; blank, NaN and infinities are null."""
    value = strip(col(c).cast("string"))
    number = value.try_cast("double")
    finite = ~F.isnan(number) & ~number.isin(float("inf"), float("-inf"))
    return F.when(finite, number)


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.cast("string").rlike("[^" + WS[1:])


def first_text(*cols: Column | str) -> Column:
    """First value that is not blank, else ''."""
    picks = [F.when(~is_blank(col(c)), col(c).cast("string")) for c in cols]
    return F.coalesce(*picks, F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def policy_level(province: Column, city: Column, district: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(province == R.NATIONAL, "national")
        .when(filled(district), "district")
        .when(filled(city) & ~city.eqNullSafe(province), "city")
        .when(filled(province), "province")
        .otherwise("other")
    )


def policy_status(effective_to: Column, as_of: str | Column, previous: Column | None = None) -> Column:
    """``expired`` when the end date text is before ``as_of``, else ``previous`` or ``active``."""
    today = F.lit(as_of) if isinstance(as_of, str) else as_of
    ended = (F.coalesce(effective_to, F.lit("")) != "") & (effective_to < today)
    rest = F.lit("active") if previous is None else first_text(previous, F.lit("active"))
    return F.when(ended, "expired").otherwise(rest)


# Fixed value: a threshold-reduction rule.
REDUCTION_HINT = rf"满{WS}*\d+.*减{WS}*\d+"


def rule_type(stored: Column, rule_text: Column, rate: Column, amount: Column) -> Column:
    return (
        F.when(F.coalesce(stored, F.lit("")) != "", stored)
        .when(F.coalesce(rule_text, F.lit("")).rlike(REDUCTION_HINT), "full_reduction")
        .when(rate.isNotNull(), "percentage")
        .when(amount.isNotNull(), "fixed")
        .otherwise("unknown")
    )


def parse_cap_amount(c: Column | str) -> Column:
    return F.regexp_extract(col(c), NUMBER, 1).try_cast("double")


def parse_cap_unit(c: Column | str) -> Column:
    return F.when(F.coalesce(col(c), F.lit("")).rlike(rf"元{WS}*/{WS}*单"), "元/单").otherwise("元/件")


def max_number(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Largest of all matches of ``pattern`` read as numbers; null without a match."""
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))
    return F.array_max(F.transform(found, lambda x: x.try_cast("double")))


def parse_rate(c: Column | str) -> Column:
    return max_number(c, NUMBER + WS + "*%")


def parse_effective_from(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)


def parse_effective_to(c: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(c), r"20\d{2}-\d{2}-\d{2}", 0))


def parse_end_note(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return (
        F.when(~text.contains("额度用完"), "")
        .when(text.contains("提前"), "额度用完提前截止")
        .otherwise("额度用完截止")
    )


def clean_official_file(c: Column | str, renames: Sequence[tuple[Sequence[str], str]] = ((("宝山区商务", "云闪付公告"), "宝山区商务委云闪付公告"),)) -> Column:
    """Drop paste noise; a name holding all words of a rename entry becomes its canonical form."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "有{3,}", "")
    out = text
    for needed, name in reversed(list(renames)):
        hit = reduce(lambda a, b: a & b, [text.contains(w) for w in needed])
        out = F.when(hit, name).otherwise(out)
    return out


def official_doc_no(c: Column | str) -> Column:
    """The file name itself when it looks like a document number, else ''."""
    return F.when(col(c).rlike(rf"〔|\[|号{WS}*$"), col(c)).otherwise("")


def count_occurrences(text: Column | str, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    text = F.coalesce(col(text), F.lit(""))
    if not word:
        return F.lit(0)
    removed = F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))
    return (removed / F.lit(len(word))).cast("int")


def safe_json(c: Column | str, schema: str, fallback: Column | None = None) -> Column:
    """Parsed JSON; ``fallback`` (or null) for null, blank and malformed text."""
    valid = F.try_parse_json(col(c)).isNotNull()
    parsed = F.when(valid, F.from_json(col(c), schema))
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def field_value(json: Column | str, name: str) -> Column:
    """``fields.<name>`` of an envelope: its ``value`` when it is an object, else itself."""
    cell = F.get_json_object(col(json), f"$.fields.{name}")
    inner = F.get_json_object(col(json), f"$.fields.{name}.value")
    return F.when(cell.startswith("{"), inner).otherwise(cell)


def has_value(c: Column) -> Column:
    """Neither null, blank nor the word ``unknown``."""
    text = strip(c.cast("string"))
    return c.isNotNull() & ~text.isin("", "unknown")


def has_field(json: Column | str, name: str) -> Column:
    return F.coalesce(has_value(field_value(json, name)), F.lit(False))


# Summary columns and what an absent value reads as.
SUMMARY_DEFAULTS: Mapping[str, str | None] = {
    "title": "", "official_file_name": "", "doc_no": "", "document_type": "unknown", "issuer": "",
    "funding_source": "", "jurisdiction_name": "", "jurisdiction_city": "",
    "jurisdiction_district": "", "category": "", "program": "", "amount_type": "unknown",
    "amount_value": None, "rate": None, "cap_amount": None, "cap_unit": "元", "rule_text": "",
    "rule_type": "unknown", "threshold_amount": None, "discount_amount": None,
    "per_user_limit": None, "stackable": None, "conditions_text": "", "description": "",
    "end_note": "", "effective_from": "", "effective_to": "",
}


def field_summary(read: Callable[[str], Column]) -> dict[str, Column]:
    """The 27 summary columns; ``read(name)`` yields the raw value of a field (or null)."""
    out = {}
    for name, default in SUMMARY_DEFAULTS.items():
        value = read("conditions") if name == "description" else read(name)
        if name == "official_file_name":
            value = F.coalesce(F.nullif(value, F.lit("")), F.nullif(read("title"), F.lit("")))
        if default is None:
            out[name] = value
        else:
            out[name] = F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
    return out


def json_field_summary(json: Column | str) -> dict[str, Column]:
    """Summary over envelope JSON; an array of conditions is joined with a full-width semicolon."""
    def read(name: str) -> Column:
        value = field_value(json, name)
        if name == "conditions":
            items = F.from_json(value, "array<string>")
            return F.when(value.startswith("["), F.array_join(items, "；")).otherwise(value)
        return value
    return field_summary(read)


def format_metric(metric: Column, amount: Column, count: Column) -> Column:
    """Display text of a published statistic."""
    hundred_million = F.lit(100_000_000)
    plain = F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(
        F.regexp_replace(F.format_number(amount, 3), r"\.?0+$", "")
    )
    return (
        F.when(metric == "beneficiary_count", F.concat(F.format_string("%.2f", count / hundred_million), F.lit(" 亿人次")))
        .when(amount >= hundred_million, F.concat(F.format_string("%.2f", amount / hundred_million), F.lit(" 亿元")))
        .otherwise(F.concat(plain, F.lit(" 元")))
    )


def metric_label(metric: Column) -> Column:
    out = metric
    for key, label in reversed(R.METRIC_LABELS):
        out = F.when(metric == key, label).otherwise(out)
    return out


def coverage(numerator: Column, denominator: Column) -> Column:
    """Ratio to four decimals, 0 when the denominator is 0."""
    return F.when(denominator > 0, F.round(numerator / denominator, 4)).otherwise(F.lit(0.0))


def first_keyword_match(text: Column, rule_set: Sequence[R.Rule], before: int, after: int) -> Column:
    """First rule, then first keyword, that occurs: ``struct<value, quote>`` or null.

    Keywords are tried in order until the first hit, in compiled code; the quote window is cut once.
    """
    pairs = [(rule.label, keyword) for rule in rule_set for keyword in rule.keywords]
    hit = F.coalesce(*[F.when(text.contains(F.lit(k)), F.struct(F.lit(label).alias("value"), F.lit(k).alias("keyword"))) for label, k in pairs])

    def window(b: Column) -> Column:
        h, at = b["h"], b["at"]
        start_at = F.greatest(at - before, F.lit(1))
        length = at - start_at + F.char_length(h["keyword"]) + after
        return F.when(h.isNotNull(), F.struct(h["value"].alias("value"), F.substr(text, start_at, length).alias("quote")))

    placed = lambda h: let(F.struct(h.alias("h"), F.position(h["keyword"], text).alias("at")), window)
    return let(hit, placed)


def apply_overrides(df: DataFrame, overrides: Column, text: Mapping[str, Sequence[Column]], values: Mapping[str, Column] | None = None) -> DataFrame:
    """Fill columns from an override map: a present key wins even when null (text reads '').

    ``text`` maps a column to its fallbacks (first non-blank); ``values`` keeps nulls as they are.
    """
    out = {}
    for name, fallbacks in text.items():
        given = F.map_contains_key(overrides, F.lit(name))
        out[name] = F.when(F.coalesce(given, F.lit(False)), strip(F.coalesce(F.element_at(overrides, name), F.lit("")))).otherwise(first_text(*fallbacks))
    for name, fallback in (values or {}).items():
        given = F.map_contains_key(overrides, F.lit(name))
        out[name] = F.when(F.coalesce(given, F.lit(False)), F.element_at(overrides, name)).otherwise(fallback.cast("string"))
    return df.withColumns(out)


def to_view(df: DataFrame, decode: Mapping[str, str] | None = None, flags: Sequence[str] = ()) -> DataFrame:
    """API shape of a table: camelCase names, JSON text decoded, 0/1 flags as booleans.

    ``decode`` maps a JSON column to ``new_name schema``.
    """
    decode = decode or {}

    def camel(name: str) -> str:
        head, *tail = name.split("_")
        return head + "".join(part.capitalize() for part in tail)

    out = []
    for name in df.columns:
        if name in decode:
            alias, schema = decode[name].split(" ", 1)
            out.append(safe_json(name, schema).alias(alias))
        elif name in flags:
            out.append(F.coalesce(F.col(name).cast("boolean"), F.lit(False)).alias(camel(name)))
        else:
            out.append(F.col(name).alias(camel(name)))
    return df.select(*out)
