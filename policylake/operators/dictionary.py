"""Many words against many texts: dictionaries and substring lookups by n-grams, as joins of tables.

A word that occurs in a text has all its n-grams there, so one rare n-gram of the word is a join key
for both sides; what meets is verified by ``contains``. Nothing is compiled into the plan, so a
dictionary may have any number of words, and texts are never multiplied by words.

Dictionaries meet texts by n-grams of UTF-8 bytes, up to seven of them in one number: the longer the
key, the fewer texts hold it without the word. Tasks find them with array operations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.extract import cell
from policylake.functions.relevance import rule_points
from policylake.functions.text import compact, let
from policylake.operators.ordering import first_per_key
from policylake.session import materialize

GRAM = 3
SIZES = (7, 6, 3, 2, 1)  # bytes of a key; two Han characters have six
SLICE_BYTES = 2 << 20  # of text at a time in a task


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of these lengths (characters); one pass over the text for each length."""
    def of(chars: Column) -> Column:
        def run(n: int) -> Column:
            joined = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
            return F.when(F.size(chars) >= n, joined).otherwise(F.array().cast("array<string>"))
        return F.filter(F.array_distinct(F.concat(*[run(n) for n in sizes])), lambda g: g != "")
    return let(F.split(text, ""), of)


def word_grams(word: Column) -> Column:
    """N-grams of a word, the whole word if it is shorter."""
    return F.coalesce(*[F.when(F.char_length(word) == n, F.array(word)) for n in range(1, GRAM)], grams(word, [GRAM]))


def _gram_rows(words: DataFrame, word: str) -> tuple[DataFrame, list[int]]:
    """``_word, _gram`` of the distinct words, and the lengths of n-grams they need (3 at most)."""
    rows = materialize(words.select(F.col(word).alias("_word")).filter("_word <> ''").distinct().select("_word", F.explode(word_grams(F.col("_word"))).alias("_gram")))
    sizes = rows.agg(F.collect_set(F.char_length("_gram"))).first()[0]
    return rows, sorted(sizes) or [GRAM]


def _byte_keys(texts: pa.Array, size: int) -> pa.ListArray:
    """The runs of ``size`` bytes of each text, those of a text in ascending order and once; the number's high byte is the size."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the 8 bytes from each place
    inside = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data)) >= size
    keys = (eight[inside] & np.uint64((1 << 8 * size) - 1) | np.uint64(size << 56)).view(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - size + 1, 0))])
    new = np.ones(len(keys), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        keys[a:b].sort()
    new[1:] = keys[1:] != keys[:-1]
    new[bounds[:-1][bounds[:-1] < len(keys)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])[bounds]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(keys[new]))


def _slices(batch: pa.RecordBatch, column: int):
    """Rows of a batch, about ``SLICE_BYTES`` of text at a time."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def _key_rows(texts: DataFrame, sizes: Sequence[int], own: bool = False) -> DataFrame:
    """``_id, _gram`` of ``_id, _text``: the keys of these sizes in each text; with ``own`` only those of the largest size that fits."""
    def task(batches):
        for batch in batches:
            for few in _slices(batch, 1):
                lengths = pc.binary_length(few.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
                left = np.ones(len(lengths), bool)
                for size in sizes:
                    fits = left & (lengths >= size)
                    if own:
                        left &= ~fits
                    some = few.filter(pa.array(fits))
                    if some.num_rows:
                        yield pa.RecordBatch.from_arrays([some.column(0), _byte_keys(some.column(1), size)], ["_id", "_grams"])

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.select("_id", "_text").mapInArrow(task, f"_id {kind}, _grams array<bigint>").select("_id", F.explode("_grams").alias("_gram"))


def _word_keys(words: DataFrame, word: str) -> tuple[DataFrame, list[int]]:
    """``_word, _gram`` of the distinct words, the key of each being the one that the fewest words share; and the keys' sizes."""
    named = words.select(F.col(word).alias("_id"), F.col(word).alias("_text")).filter("_text <> ''").distinct()
    rows = materialize(_key_rows(named, SIZES, own=True).withColumnRenamed("_id", "_word"))
    shared = rows.groupBy("_gram").agg(F.count("*").alias("_n"))
    keys = materialize(rows.join(shared, "_gram").groupBy("_word").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram")))
    sizes = keys.select(F.shiftright("_gram", 56).alias("n")).distinct().collect()  # at most one row for each of SIZES
    return keys, sorted(r["n"] for r in sizes)


def _meetings(texts: DataFrame, id: str, text: Column, words: DataFrame, word: str, keep: Sequence[str] = ()) -> DataFrame:
    """``_id, _text, _word`` and ``keep`` of each text and dictionary word that occurs in it."""
    keys, sizes = _word_keys(words, word)
    body = texts.select(F.col(id).alias("_id"), text.alias("_text"), *keep)
    pairs = _key_rows(body, sizes).join(keys, "_gram").select("_id", "_word")
    return pairs.join(body, "_id").filter(F.contains("_text", "_word"))


def find_words(texts: DataFrame, id: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """``id, word``: which words of a dictionary occur in which texts, each pair once.

    ``id`` is unique. The key of a word is that of its n-grams which the fewest words share. Null and
    empty words and texts meet nothing.
    """
    return _meetings(texts, id, F.col(text), words, word).select(F.col("_id").alias(id), F.col("_word").alias(word))


def first_label(texts: DataFrame, id: str, text: str, rules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``id, label, keyword``: of the rules ``rule_no, keyword_no, label, keyword`` the first whose keyword occurs, for texts with one.

    ``found`` is what ``find_words`` gave for these texts and keywords, if it is there already.
    """
    hits = (find_words(texts, id, text, rules, "keyword") if found is None else found).join(rules, "keyword")
    return first_per_key(hits, [id], [F.col("rule_no"), F.col("keyword_no"), F.col("keyword"), F.col("label")], ["label", "keyword"])


def weighted_hits(texts: DataFrame, id: str, text: str, rules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``id, hits, points``: how many of the rules ``keyword, points`` a text meets and their sum, for texts that meet one; ``found`` as above."""
    return (find_words(texts, id, text, rules, "keyword") if found is None else found).join(rules.select("keyword", "points"), "keyword").groupBy(id).agg(F.count("*").alias("hits"), F.sum("points").alias("points"))


def label_cells(texts: DataFrame, id: str, text: str, rules: DataFrame, before: int, after: int, confidence: float) -> DataFrame:
    """``id, cell`` as ``keyword_cell`` gives for literal rules: the first label with the words around its keyword; null cells without one."""
    found = texts.select(id, text).join(first_label(texts, id, text, rules), id, "left")

    def quote(b: Column) -> Column:
        at = F.position(b["k"], b["t"])
        start = F.greatest(at - before, F.lit(1))
        return compact(F.substring(b["t"], start, at - start + F.char_length(b["k"]) + after))

    around = let(F.struct(F.col(text).alias("t"), F.col("keyword").alias("k")), quote)
    return found.select(id, cell(F.col("label"), confidence, around).alias("cell"))


def keyword_points(texts: DataFrame, id: str, title: str, text: str, words: DataFrame) -> DataFrame:
    """``id, hits, points``: the relevance points (hundredths) of the table ``word, weight``, as ``keyword_score`` adds them for literal rules; texts without a hit have no row."""
    both = texts.select(F.col(id).alias("_key"), F.coalesce(title, F.lit("")).alias("_title"), F.coalesce(text, F.lit("")).alias("_body"))
    met = _meetings(both, "_key", F.concat_ws("\n", "_title", "_body"), words, "word", ("_title", "_body")).join(words.withColumnRenamed("word", "_word"), "_word")
    rule = F.struct(F.col("_word").alias("word"), F.col("weight").alias("weight"))
    scored = met.withColumn("_points", let(F.struct(rule.alias("r"), "_title", "_body"), lambda b: rule_points(b["r"], b["_title"], b["_body"], b["_body"])))
    return scored.groupBy(F.col("_id").alias(id)).agg(F.count("_points").alias("hits"), F.sum("_points").alias("points")).filter("hits > 0")  # a filter on the points would find them twice


def lookup_contains(needles: DataFrame, needle: str, dim: DataFrame, haystack: str, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """For each needle the first ``dim`` row whose haystack contains it, whatever the case.

    The haystacks' n-grams that needles have are a written posting table; a needle meets the rows of
    its rarest n-gram there, and ``contains`` decides. Needles shorter than an n-gram are looked up whole.
    """
    wanted = needles.select(needle).distinct().withColumn("_key", F.lower(needle))
    rows, sizes = _gram_rows(wanted, "_key")
    ordered = [f"_o{i}" for i in range(len(order))]
    dim = materialize(dim.select(F.lower(haystack).alias("_text"), *keep, *[o.alias(name) for o, name in zip(order, ordered)]).withColumn("_row", F.monotonically_increasing_id()))
    posts = dim.select("_row", F.explode(grams(F.col("_text"), sizes)).alias("_gram"))
    posts = materialize(posts.join(rows.select("_gram").distinct(), "_gram", "left_semi"))
    counts = posts.groupBy("_gram").agg(F.count("*").alias("_n"))
    rare = rows.join(counts, "_gram", "left").groupBy("_word").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    found = rare.join(posts, "_gram").select("_word", "_row").join(dim, "_row").filter(F.contains("_text", "_word"))
    first = first_per_key(found.withColumnRenamed("_word", "_key"), ["_key"], [F.col(o) for o in ordered], keep)
    return wanted.join(first, "_key", "left").drop("_key")
