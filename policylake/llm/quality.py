"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Rules look at cheap features of a text and vote good, bad or not at all. Votes are conditionally
independent given the unknown quality; expectation-maximisation estimates, from the counts of vote
patterns of all documents, how often each rule is right about good and about bad texts and the
share of good ones. Two floors (few words, many repeated words) reject whatever the rules say.

All of it is DataFrame operations: the patterns are at most 3**rules rows, and an EM step is one
aggregate over them whose sums become the next step's constants.

Defined cases: a null text has no words and fails; an empty table gives an empty result; repeated
rows count and come back as often as they come; extra columns are ignored by ``scores`` and kept by
``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.session import materialize

WS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
GRAM = 5  # words of a repeated window
MIN_WORDS, MAX_REPEATED = 10, 20  # words; percent of words
GOOD, BAD, ABSTAIN = 1, -1, 0

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "de", "la", "le", "les", "et", "un", "une", "que", "el", "los", "las", "en", "y", "der", "die", "das", "und", "von", "zu", "den", "ist")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _removed(text: Column, chars: str) -> Column:
    """How often the text has one of the characters; removing them one by one is far cheaper than a pattern."""
    rest = text
    for char in chars:
        rest = F.replace(rest, F.lit(char), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("bigint")


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words inside windows of ``gram`` words that the array holds twice or more, first ones included."""
    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    def covered(ranked: Column) -> Column:
        again = F.filter(ranked, lambda x, j: F.get(ranked, j - 1)["h"].eqNullSafe(x["h"]) | F.get(ranked, j + 1)["h"].eqNullSafe(x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-gram).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(places, start, lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(gram), i - s["last"])).alias("sum")), lambda s: s["sum"])

    def windows(keys: Column) -> Column:
        return F.transform(keys, lambda h, i: F.xxhash64(h, *[F.get(keys, i + k) for k in range(1, gram)]))  # the last ones are shorter, so equal to none

    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda keys: _let(windows(keys), count))
    return F.when(F.size(words) < gram, F.lit(0)).otherwise(hashed).cast("bigint")


@dataclass(frozen=True)
class Rule:
    """Votes bad from one bound on, good up to another and abstains between (or the other way round)."""

    feature: Callable[[Column], Column]
    good: float
    bad: float
    least: int = 0  # words; shorter texts get no vote

    def vote(self, features: Column) -> Column:
        x = self.feature(features)
        good, bad = (x <= self.good, x >= self.bad) if self.good < self.bad else (x >= self.good, x <= self.bad)
        return F.when(features["n_words"] < self.least, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


#: Votes of the production rules over the features below.
RULES: Mapping[str, Rule] = {
    "length": Rule(lambda f: f["n_words"], 20, MIN_WORDS - 1),
    "symbols": Rule(lambda f: _per(f["n_symbols"], f["n_words"]), 0.02, 0.2),
    "duplicate_lines": Rule(lambda f: _per(f["n_dup_lines"], f["n_lines"]), 0.05, 0.3),
    "capitals": Rule(lambda f: _per(f["n_capitals"], f["word_chars"]), 0.15, 0.4),
    "shouting": Rule(lambda f: _per(f["n_shouts"], f["n_words"]), 0.05, 0.3),
    "word_length": Rule(lambda f: _per(f["word_chars"], f["n_words"]), 10, 14),
    "function_words": Rule(lambda f: _per(f["n_function"], f["n_words"]), 0.05, 0.01, least=40),
}


def with_features(docs: DataFrame, text: Column, repeats: bool) -> DataFrame:
    """``docs`` (its columns without a leading underscore) with a struct ``_f``; ``repeats`` adds the costly count."""
    words = F.array_remove(F.split(F.col("_text"), WS + "+", -1), "")
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumns({"_words": words, "_lines": lines})
    c = F.col
    cells = {
        "n_words": F.size("_words").cast("bigint"), "word_chars": F.length(F.array_join("_words", "")).cast("bigint"), "n_symbols": _removed(c("_text"), SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "n_lines": F.size("_lines"),
        "n_capitals": F.length(F.regexp_replace("_text", r"\P{Lu}+", "")), "n_shouts": _removed(c("_text"), "!"), "n_function": F.size(F.filter("_words", lambda w: w.isin(*FUNCTION_WORDS))),
    }
    if repeats:
        cells["n_repeat_words"] = repeated_words(c("_words"))
    return split.withColumn("_f", F.struct(*[v.alias(k) for k, v in cells.items()])).drop("_text", "_words", "_lines")


@dataclass(frozen=True)
class Model:
    """Share of good texts, and for each rule how often its votes are right on good and on bad ones."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text is good, given its votes."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, good, bad in zip(votes, self.right_on_good, self.right_on_bad):
            odds = odds + F.when(vote == GOOD, math.log(good / (1 - bad))).when(vote == BAD, math.log((1 - good) / bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str], steps: int = 25, tolerance: float = 1e-4) -> Model:
    """EM over ``patterns``: a column of votes for each rule and ``n``, the documents that vote so.

    Votes of good texts are right more often than not and so are those of bad texts that a rule is
    made for: rates stay above 0.7 and 0.05, which also tells the two classes apart.
    """
    n = len(names)
    model = Model(0.8, (0.95,) * n, (0.3,) * n)
    votes = [F.col(x) for x in names]
    for _ in range(steps):
        p, c = F.col("p"), F.col("n")
        sums = [F.sum(c), F.sum(c * p)]
        for v in votes:
            sums += [F.sum(F.when(v == GOOD, c * p)), F.sum(F.when(v != ABSTAIN, c * p)), F.sum(F.when(v == BAD, c * (1 - p))), F.sum(F.when(v != ABSTAIN, c * (1 - p)))]
        total, good, *rest = [float(x or 0) for x in patterns.withColumn("p", model.posterior(votes)).agg(*sums).first()]
        rate = lambda hits, of, low: min(max((hits + 1) / (of + 2), low), 0.999)
        found = Model(rate(good, total, 0.5), tuple(rate(rest[4 * k], rest[4 * k + 1], 0.7) for k in range(n)), tuple(rate(rest[4 * k + 2], rest[4 * k + 3], 0.05) for k in range(n)))
        change = max(abs(x - y) for x, y in zip((found.prior, *found.right_on_good, *found.right_on_bad), (model.prior, *model.right_on_good, *model.right_on_bad)))
        model = found
        if change < tolerance:
            break
    return model


def learn(docs: DataFrame, text: str = "text", rules: Mapping[str, Rule] = RULES) -> Model:
    """The model of the rules over all documents."""
    featured = with_features(docs.select(F.col(text).alias("_raw")), F.col("_raw"), False)
    votes = featured.select(*[rule.vote(F.col("_f")).cast("tinyint").alias(name) for name, rule in rules.items()])
    return fit(materialize(votes.groupBy(*rules).agg(F.count("*").alias("n"))), list(rules))


def _judged(docs: DataFrame, text: Column, rules: Mapping[str, Rule], model: Model, threshold: float) -> DataFrame:
    f = F.col("_f")
    rows = with_features(docs, text, True)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEATED * f["n_words"])
    rows = rows.withColumns({"_failed": failed, "_good": model.posterior([rule.vote(f) for rule in rules.values()])})
    kept = ~F.col("_failed") & (F.col("_good") >= threshold)
    # Not deterministic for the optimizer, so that a filter isn't pushed below, where each use of a feature would compute it anew.
    return rows.withColumn("_kept", F.when(F.spark_partition_id() >= 0, kept))


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Mapping[str, Rule] = RULES, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """``id``, the base features, ``base_failed``, ``kept`` and the posterior ``quality`` of every row."""
    model = model or learn(docs, text, rules)
    rows = _judged(docs.select(F.col(id).alias("_id"), F.col(text).alias("_raw")), F.col("_raw"), rules, model, threshold)
    base = [F.col(f"_f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select(F.col("_id").alias(id), *base, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.round("_good", 6).alias("quality"))


def keep_good(docs: DataFrame, text: str = "text", rules: Mapping[str, Rule] = RULES, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the floors and whose posterior reaches ``threshold``."""
    model = model or learn(docs, text, rules)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col(text).alias("_raw"))
    return _judged(rows, F.col("_raw"), rules, model, threshold).filter("_kept").select("_row.*")
