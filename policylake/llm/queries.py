"""Queries of the training-data operators over the driver tables, with their SQL where it can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.llm import collocations, decontaminate, infill, jaccard, lm, mixing, quality, repeats, shards, simhash, tokens, toxicity, urls
from policylake.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the place that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer())
    return tokens.read_tokens(spark, path)


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


MIX_SQL = """
WITH sized AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS bytes FROM documents),
sizes AS (SELECT source, CAST(sum(bytes) AS BIGINT) AS size FROM sized GROUP BY source),
totals AS (SELECT sum(size) AS all_bytes, sum(pow(CAST(size AS DOUBLE), 0.5)) AS all_weights FROM sizes),
means AS (SELECT source, pow(CAST(size AS DOUBLE), 0.5) * (all_bytes / all_weights) / size AS mean FROM sizes, totals),
rates AS (SELECT source, draws, mean / draws AS rate FROM (SELECT *, CAST(greatest(1, ceil(mean / 32)) AS BIGINT) AS draws FROM means)),
terms AS (SELECT source, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(CAST(k AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k)) AS p
          FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k FROM rates)),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS step FROM terms),
hashed AS (SELECT doc_id, text, lang, source, n_chars, md5(concat_ws('|', '1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS h FROM documents),
draws AS (SELECT h.doc_id, h.source, h.h, unnest(generate_series(0, r.draws - 1)) AS k FROM hashed h JOIN rates r ON r.source IS NOT DISTINCT FROM h.source),
drawn AS (SELECT doc_id, source, h, CAST(concat('0x', substr(CASE WHEN k = 0 THEN h ELSE md5(concat_ws('|', h, 'draw', CAST(k AS VARCHAR))) END, 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM draws),
counted AS (SELECT d.doc_id, d.h, count(s.k) AS n FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.step <= d.u GROUP BY d.doc_id, d.h),
copies AS (SELECT doc_id, h, unnest(generate_series(0, n - 1)) AS replica FROM counted)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.replica AS INTEGER) AS replica, md5(concat_ws('|', c.h, CAST(c.replica AS VARCHAR))) AS shuffle_key
FROM copies c JOIN hashed d ON d.h = c.h AND d.doc_id IS NOT DISTINCT FROM c.doc_id
"""


@query("op4_mixing", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


JUMP_SQL = """
WITH RECURSIVE keyed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16)) AS UBIGINT) AS key FROM documents),
jump(key, n, state, b, j) AS (
  SELECT DISTINCT key, n, CAST(key AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM keyed, (VALUES (16), (17)) t(n)
  UNION ALL
  SELECT key, n, s, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((s >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT key, n, j, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s FROM jump WHERE j < n))
SELECT k.doc_id, CAST(k.size AS BIGINT) AS size, a.b AS shard, c.b AS grown_shard, 'key' AS law
FROM keyed k JOIN jump a ON a.key = k.key AND a.n = 16 AND a.j >= 16 JOIN jump c ON c.key = k.key AND c.n = 17 AND c.j >= 17
"""


@query("op5_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, rhost, rpath) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS v
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id
"""


@query("op8_url_filters", URL_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


@query("op9_lm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(table(spark, sf_dir, "documents"), min_count=1)  # every n-gram counts


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_ngram_jaccard")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


PHRASE_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counts AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places, (VALUES (1), (2), (3), (4)) sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
found AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
sides AS MATERIALIZED (SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM found)),
cuts AS (SELECT s.lang, s.phrase, s.a, s.cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * s.a // (l.f + r.f) AS BIGINT) AS score
    FROM sides s JOIN counts l ON l.lang = s.lang AND l.phrase = s.head JOIN counts r ON r.lang = s.lang AND r.phrase = s.rest),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
starts AS MATERIALIZED (SELECT *, unnest(range(1, k)) AS i FROM found WHERE k > 2),
spans AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS over FROM (SELECT *, unnest(range(2, k)) AS n FROM starts) WHERE i + n - 1 <= k GROUP BY ALL),
kept AS (SELECT x.* FROM weakest x LEFT JOIN spans s ON s.lang = x.lang AND s.phrase = x.phrase WHERE s.over IS NULL OR 100 * s.over < 80 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


FIM_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
drawn AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1,
    CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM hashed),
ranked AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM ranked)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cut
"""


@query("op13_fill_in_middle", FIM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))
