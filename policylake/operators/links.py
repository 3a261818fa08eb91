"""Link triage, expansion planning, URL screening and robots rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake import rules as R
from policylake.functions.relevance import is_policy_link, link_score
from policylake.functions.text import contains_any, let
from policylake.functions.urls import SCHEME, is_official_host, is_private_address, resolve_url, url_host, url_origin, url_path_query
from policylake.operators.ordering import HOT_ROWS, first_per_key, skew_join
from policylake.session import materialize


def candidate_links(links: Column, base_url: Column, words: Sequence[str] = R.DISCOVERY_WORDS, n: int | None = None) -> Column:
    """Array of ``struct<url, title>`` worth crawling, from an array of ``struct<href, text>``.

    First occurrence per absolute URL with a word in its text or URL; with ``n`` the first ones.
    Works in the row: no shuffle.
    """
    absolute = F.transform(links, lambda x: F.struct(resolve_url(x["href"], base_url).alias("url"), F.trim(F.coalesce(x["text"], F.lit(""))).alias("text")))
    kept = F.filter(absolute, lambda x: x["url"].isNotNull() & (contains_any(x["text"], words) | contains_any(x["url"], words)))

    def first(found: Column) -> Column:
        ranked = F.sort_array(F.transform(found, lambda x, i: F.struct(x["url"].alias("url"), i.alias("i"), x["text"].alias("text"))))
        firsts = F.filter(ranked, lambda x, j: ~F.get(ranked, j - 1)["url"].eqNullSafe(x["url"]))
        ordered = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["url"].alias("url"), x["text"].alias("text"))))
        return ordered if n is None else F.slice(ordered, 1, n)

    titled = lambda x: F.struct(x["url"].alias("url"), F.when(x["text"] == "", x["url"]).otherwise(x["text"]).alias("title"))
    return F.transform(let(kept, first), titled)


def triage_links(links: DataFrame, href: str, text: str, base_url: str, score_words: Sequence[str] = R.LINK_SCORE_WORDS, **policy_words: Sequence[str]) -> DataFrame:
    """Adds ``url`` (absolute or null), ``link_score`` and ``is_policy_link``."""
    return links.withColumns({"url": resolve_url(href, base_url), "link_score": link_score(text, score_words), "is_policy_link": is_policy_link(text, **policy_words)})


def plan_expansion(links: DataFrame, known: DataFrame, per_doc: int, total: int | None = None, official_suffix: str = ".gov.cn") -> DataFrame:
    """URLs to fetch next: ``doc_id, url, link_text, link_score, rank_in_doc``.

    ``links``: doc_id, doc_at, position, url, link_text, link_score, is_policy_link. From the newest
    document on, each takes its ``per_doc`` best links that no newer one has taken; ``total``: how
    many are planned in that order. Worked out in rounds: every open URL is offered to the newest
    document that has not turned it down; a document that holds enough turns down all links below
    its worst, offered or not; until none does. Rounds are written tables.
    """
    fit = links.filter(F.col("is_policy_link") & F.col("url").isNotNull() & is_official_host("url", official_suffix, allow_apex=False))
    best = first_per_key(fit, ["doc_id", "url"], [-F.col("link_score"), F.col("position")], ["doc_at", "position", "link_text", "link_score"])
    fresh = best.join(known.select("url").distinct(), "url", "left_anti")
    age = F.struct((-F.unix_micros(F.col("doc_at").cast("timestamp"))).alias("at"), F.col("doc_id").alias("id"))
    merit = F.struct((-F.col("link_score")).alias("s"), F.col("position").alias("p"), F.col("url").alias("u"))
    pairs = materialize(fresh.withColumns({"_age": age, "_merit": merit}))
    left = pairs.count()
    while True:
        newest_doc = pairs.groupBy("url").agg(F.min("_age").alias("_age"))
        held = pairs.join(newest_doc, ["url", "_age"], "left_semi").withColumn("rank_in_doc", F.row_number().over(Window.partitionBy("doc_id").orderBy("_merit")))
        bars = held.filter(F.col("rank_in_doc") == per_doc).select("doc_id", F.col("_merit").alias("_bar"))
        kept = materialize(pairs.join(bars, "doc_id", "left").filter(F.col("_bar").isNull() | (F.col("_merit") <= F.col("_bar"))).select(*pairs.columns))
        before, left = left, kept.count()
        if left == before:
            break
        pairs = kept
    chosen = held.orderBy("_age", "rank_in_doc")
    return (chosen if total is None else chosen.limit(total)).select("doc_id", "url", "link_text", "link_score", "rank_in_doc")


def screen_urls(urls: DataFrame, addresses: DataFrame, url: str = "url", suffix: str = ".gov.cn", official_only: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``reject_reason`` (null when admissible) given ``addresses``: host, address.

    Reserved networks are tested per address with range comparisons; one folded row per host is
    then looked up, salted for hosts with very many URLs.
    """
    per_host = addresses.groupBy(F.lower("host").alias("_host")).agg(F.count("address").alias("_n"), F.max(is_private_address("address")).alias("_private"))
    staged = urls.withColumn("_host", F.regexp_replace(F.coalesce(url_host(url), F.lit("")), r"\.$", ""))
    spread = [c for c in urls.columns]
    joined = skew_join(staged, per_host, ["_host"], "left", spread, hot_rows)
    u = F.coalesce(F.trim(url), F.lit(""))
    official = is_official_host(F.concat(F.lit("http://"), F.col("_host")), suffix)
    reason = (
        F.when(~u.rlike(SCHEME) | (F.col("_host") == ""), "invalid url")
        .when(~u.rlike(r"^(?i)https?:"), "scheme not allowed")
        .when(u.rlike(r"^[^/]*//[^/?#]*@"), "credentials in url")
        .when(F.lit(official_only) & ~official, "not an official host")
        .when(F.col("_host") == "localhost", "local host")
        .when(F.coalesce("_n", F.lit(0)) == 0, "host does not resolve")
        .when(F.col("_private"), "private or reserved address")
    )
    return joined.withColumn("reject_reason", reason).drop("_host", "_n", "_private")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, rules array<struct<allow, path>>`` that apply to the agent, from ``origin, text``.

    Groups start at a user-agent line that follows a rule; rules of groups naming the agent and
    of wildcard groups apply together. The window runs over the lines of one robots file.
    """
    lines = robots.select("origin", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter(F.col("line").contains(":"))
    key = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("origin", "at", key.alias("key"), value.alias("value")).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("origin").orderBy("at")
    opens = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(False))
    lines = lines.withColumn("_opens", opens.cast("int")).withColumn("group_no", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    is_agent = F.col("key") == "user-agent"
    name = F.lower("value")
    groups = lines.groupBy("origin", "group_no").agg(
        F.count_if(is_agent).alias("_agents"), F.count_if(is_agent & (name.contains(agent.lower()) | (name == "*"))).alias("_named"),
        F.collect_list(F.when(~is_agent, F.struct((F.col("key") == "allow").alias("allow"), F.col("value").alias("path")))).alias("rules"))
    applying = groups.filter((F.col("_named") > 0) | (F.col("_agents") == 0))
    return applying.groupBy("origin").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def robots_score(rule_path: Column, path: Column) -> Column:
    """Length of a matching pattern (``*`` and a final ``$`` supported), 0 without a match."""
    pattern = F.regexp_replace(rule_path, r"\*+", "*")
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substr(pattern, F.lit(1), F.char_length(pattern) - 1)).otherwise(pattern)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))
    return F.when(pattern == "", 0).when(pattern == "/", path.startswith("/").cast("int")).when(F.regexp_like(path, regex), F.char_length(body)).otherwise(0)


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``allowed``: the longest matching rule decides, ties allow, no rules allow.

    A rule without ``*`` or ``$`` is a prefix: a path meets it in an equality join on the path's
    beginnings of the lengths that its origin's rules have. Only rules with wildcards are tried one by
    one, by the paths of their origin; so URLs are never multiplied by rules.
    """
    staged = urls.withColumns({"origin": url_origin(url), "_path": url_path_query(url)})
    rules = materialize(robots_rules(robots, agent).select("origin", F.explode("rules").alias("r")).select("origin", "r.allow", "r.path").filter("path <> ''"))
    wild = rules.filter(F.col("path").rlike("[*$]")).groupBy("origin").agg(F.collect_list(F.struct("allow", "path")).alias("wild"))
    plain = rules.filter(~F.col("path").rlike("[*$]")).groupBy("origin", "path").agg(F.max("allow").alias("allow"))
    shape = wild.join(plain.groupBy("origin").agg(F.collect_set(F.char_length("path")).alias("lengths")), "origin", "full_outer")
    paths = skew_join(staged.filter("origin IS NOT NULL").select("origin", "_path").distinct(), shape, ["origin"], "inner", ["_path"], hot_rows)
    starts = F.transform(F.filter("lengths", lambda n: n <= F.char_length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    met = paths.select("origin", "_path", F.explode(starts).alias("path")).join(plain, ["origin", "path"]).select("origin", "_path", F.struct(F.char_length("path").alias("score"), "allow").alias("m"))
    tried = paths.filter("wild IS NOT NULL").select("origin", "_path", F.array_max(F.transform("wild", lambda r: F.struct(robots_score(r["path"], F.col("_path")).alias("score"), r["allow"].alias("allow")))).alias("m"))
    none = F.struct(F.lit(0).alias("score"), F.lit(True).alias("allow"))
    best = met.union(tried.filter("m.score > 0")).groupBy("origin", "_path").agg(F.max("m").alias("_m"))
    joined = skew_join(staged, best, ["origin", "_path"], "left", [url], hot_rows)
    return joined.withColumn("allowed", F.coalesce("_m", none)["allow"]).drop("_path", "_m", "origin")
