"""URL normalisation, resolution and screening as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake import rules as R
from policylake.functions.text import col, let, strip

PLAIN = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*+(?:(?:/[A-Za-z0-9_~%-][A-Za-z0-9_~%.-]*+)++/?+|/)(?:[?#][A-Za-z0-9_~.%=&+/:,;!*-]*+)?+$"  # prints as it is
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
WEB = r"^(?i)https?://[^/?#\s]+"
AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def url_host(c: Column | str) -> Column:
    """Lower-case host of an absolute URL, null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(col(c), HOST, 1)), F.lit(""))


def url_origin(c: Column | str) -> Column:
    """Scheme and authority in lower case, default port dropped."""
    return F.nullif(_authority(F.regexp_extract(col(c), AUTHORITY, 1)), F.lit(""))


def url_path_query(c: Column | str) -> Column:
    """Path (at least ``/``) plus query, without fragment."""
    rest = F.regexp_replace(F.substring_index(col(c), "#", 1), AUTHORITY, "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _authority(c: Column) -> Column:
    user = F.regexp_extract(c, r"^[^/]*//([^@]*@)", 1)
    bare = F.lower(F.regexp_replace(c, r"//[^@]*@", "//"))
    bare = F.regexp_replace(bare, r"^(http://.*):80$", "$1")
    bare = F.regexp_replace(bare, r"^(https://.*):443$", "$1")
    return F.when(user == "", bare).otherwise(
        F.concat(F.substring_index(bare, "//", 1), F.lit("//"), user, F.substring_index(bare, "//", -1))
    )


# Characters that a URL parser escapes in a path and in a query.
PATH_ESCAPED = r"""[^\x21-\x7E]|["<>`{}]"""
QUERY_ESCAPED = r"""[^\x21-\x7E]|["<>']"""


def _percent_encode(c: Column, escaped: str) -> Column:
    """Escape the characters of a class; everything else is kept."""
    def one(ch: Column) -> Column:
        return F.when(ch == " ", "%20").when(ch.rlike(escaped), F.url_encode(ch)).otherwise(ch)
    return F.when(c.rlike(escaped), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    def step(acc: Column, seg: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(F.array_append(acc, seg))

    def walk(segments: Column) -> Column:
        kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
        tail = F.element_at(segments, -1).isin(".", "..")
        return F.when(tail, F.array_append(kept, F.lit(""))).otherwise(kept)

    walked = F.array_join(walk(F.split(path, "/")), "/")
    walked = F.when(walked == "", "/").otherwise(walked)
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), walked).otherwise(path)


def canonical_url(c: Column | str) -> Column:
    """Serialised form of an absolute web URL (what a URL parser prints), null if not one.

    Tabs and line ends go, backslashes before the query are slashes. Every part is bound once.
    """
    def slashes(text: Column) -> Column:
        before = F.regexp_extract(text, r"^[^?#]*", 0)
        turned = let(before, lambda b: F.concat(F.replace(b, F.lit("\\"), F.lit("/")), F.substr(text, F.char_length(b) + 1)))
        return F.when(text.contains("\\"), turned).otherwise(text)

    def build(text: Column) -> Column:
        return let(F.regexp_extract(text, AUTHORITY, 1), lambda a: let(F.substr(text, F.char_length(a) + 1), lambda rest: let(F.regexp_extract(rest, r"^[^?#]*", 0), lambda path: F.concat(
            _authority(a), _percent_encode(F.when(path == "", "/").when(path.contains("/."), _dot_segments(path)).otherwise(path), PATH_ESCAPED),
            _percent_encode(F.substr(rest, F.char_length(path) + 1), QUERY_ESCAPED)))))

    clean = F.translate(strip(col(c)), "\t\n\r", "")
    return let(clean, lambda raw: F.when(raw.rlike(PLAIN), raw).otherwise(let(slashes(raw), lambda t: F.when(t.rlike(WEB), build(t)))))


def _pair(text: Column) -> Column:
    """Decoded ``struct<name, value>`` of one part of a query; a lone percent sign is itself."""
    def decoded(part: Column) -> Column:
        return F.when(part.rlike("[%+]"), F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(part)

    name = F.substring_index(text, "=", 1)
    return F.struct(decoded(name).alias("name"), decoded(F.substr(text, F.char_length(name) + 2)).alias("value"))


def normalize_url(c: Column | str, strip_utm_prefix: bool = False, keys: Sequence[str] = R.TRACKING_KEYS) -> Column:
    """Drop the fragment and the tracking keys; text that is no URL is returned as it is.

    A query that loses a key is written anew from its decoded names and values, as a form is; any
    other stays as the parser prints it. Keys match decoded and exactly (``utm_source`` survives) unless ``strip_utm_prefix``.
    """
    names = [k for k in keys]

    def dropped(pair: Column) -> Column:
        key = F.lower(pair["name"])
        hit = key.isin(names)
        return hit | key.startswith("utm_") if strip_utm_prefix else hit

    def rewrite(base: Column) -> Column:
        before = F.substring_index(base, "?", 1)
        pairs = F.transform(F.filter(F.split(F.substr(base, F.char_length(before) + 2), "&"), lambda p: p != ""), _pair)
        return let(pairs, lambda all: let(F.filter(all, lambda p: ~dropped(p)), lambda kept: F.when(F.size(kept) == F.size(all), base).when(F.size(kept) == 0, before).otherwise(
            F.concat(before, F.lit("?"), F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")))))

    def prune(url: Column) -> Column:
        return let(F.substring_index(url, "#", 1), lambda base: F.when(base.contains("?"), rewrite(base)).otherwise(base))

    def apply(text: Column) -> Column:
        web = canonical_url(text)
        other = F.when(text.rlike(SCHEME) & ~text.rlike(r"^(?i)https?:"), text)
        return F.coalesce(let(F.coalesce(web, other), lambda u: F.when(u.isNotNull(), prune(u))), text)

    return let(strip(F.coalesce(col(c), F.lit(""))), apply)


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute http(s) URL of ``href`` seen on page ``base``; null when invalid or other scheme."""
    def join(pair: Column) -> Column:
        h, b = pair["h"], pair["b"]
        page = F.substring_index(b, "#", 1)
        no_query = F.substring_index(page, "?", 1)
        origin = F.regexp_extract(b, AUTHORITY, 1)
        folder = F.regexp_replace(F.regexp_replace(no_query, AUTHORITY, ""), r"[^/]*$", "")
        folder = F.when(folder == "", "/").otherwise(folder)
        absolute = (
            F.when(h.rlike(SCHEME), h)
            .when(h.startswith("//"), F.concat(F.substring_index(b, "//", 1), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(no_query, h))
            .when(h.startswith("#"), F.concat(page, h))
            .when(h == "", page)
            .otherwise(F.concat(origin, folder, h))
        )
        return canonical_url(absolute)

    pair = F.struct(strip(F.coalesce(col(href), F.lit(""))).alias("h"), strip(col(base)).alias("b"))
    return let(pair, join)


def is_official_host(c: Column | str, suffix: str = ".gov.cn", allow_apex: bool = True) -> Column:
    """Host ends with ``suffix``; the bare domain counts only with ``allow_apex``."""
    host = url_host(c)
    ok = host.endswith(suffix)
    if allow_apex:
        ok = ok | (host == suffix.lstrip("."))
    return F.coalesce(ok, F.lit(False))


def ipv4_number(c: Column) -> Column:
    """Dotted address as a number, null when it is not one."""
    parts = F.split(c, r"\.")
    value = sum((parts[i].try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), parts[0].try_cast("bigint") * 256**3)
    return F.when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def _range(network: str, bits: int) -> tuple[int, int]:
    number = reduce(lambda acc, part: acc * 256 + int(part), network.split("."), 0)
    size = 2 ** (32 - bits)
    low = number - number % size
    return low, low + size - 1


def is_private_address(c: Column | str) -> Column:
    """Address inside a reserved IPv4 network or with a reserved IPv6 prefix."""
    address = F.lower(col(c))
    number = ipv4_number(address)
    v4 = reduce(lambda a, b: a | b, [number.between(*_range(n, b)) for n, b in R.RESERVED_IPV4])
    v6 = address.isin(*R.RESERVED_IPV6_EXACT)
    for prefix in R.RESERVED_IPV6_PREFIXES:
        v6 = v6 | address.startswith(prefix)
    return F.when(number.isNotNull(), v4).otherwise(v6)
