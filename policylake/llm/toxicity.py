"""Toxicity as an ordinal grade: cumulative-link regression over sparse text features.

A text's features, present or not and hashed, are the character sequences of its words (``GRAM``
bytes, the start of a word being one of them), its words that are too short for one, and its pairs of
neighbouring words of at most ``GRAM`` bytes each. Features are chosen for speaking for toxicity, and no weight is negative: a text
can't buy off a toxic word with harmless ones. One weight a feature and ordered thresholds give
``P(grade <= k) = 1 / (1 + exp(score - threshold[k]))``: the weights are shared by all thresholds.
The expected grade is the sum of ``P(grade > k)``.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, the only bound here): the
rows with the smallest hash of their id, so that any run takes the same ones. All rows are scored.

Where labels only say toxic or not, a toxic text's grade is how many of its words hold a feature far
more frequent in toxic texts than in clean ones, cut into ``levels`` equal parts of the sample.

Defined cases: null and blank texts have no features and the grade that the thresholds alone give;
labels without a document and null labels are ignored; without a toxic or without a clean label the
model says grade 0 for all; repeated rows come back as often as they come; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.words import ALNUM, by_bytes, mix, split_words, word_keys

GRAM = 5
BITS = 22  # features are hashed to so many bits
_BYTE, _SPACE = np.uint64(8), np.uint64(0x20)
SUPPORT, ODDS = 8, 2.5  # labelled texts that hold a feature, and its log odds for toxic ones, at least


def text_features(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each feature: its document and its number; the words of each document; each feature's word (of a pair, the first)."""
    words = split_words(column, ALNUM)
    lengths = words.ends - words.starts
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the 8 bytes from each place
    mask = np.uint64((1 << (8 * GRAM)) - 1)
    inner = np.maximum(lengths - GRAM + 1, 0)
    of = np.repeat(np.arange(len(words)), inner)
    grams = eight[words.starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(inner) - inner, inner)] & mask
    long, short = np.flatnonzero(lengths >= GRAM - 1), np.flatnonzero(lengths < GRAM - 1)
    heads = ((eight[words.starts[long]] << _BYTE) | _SPACE) & mask
    size = lengths[short].astype(np.uint64) * _BYTE
    alone = ((eight[words.starts[short]] & ((np.uint64(1) << size) - np.uint64(1))) << _BYTE) | _SPACE | (_SPACE << (size + _BYTE))
    follows = np.ones(len(words), bool)
    follows[words.first[:-1][words.counts() > 0]] = False
    follows[1:] &= (lengths[1:] <= GRAM) & (lengths[:-1] <= GRAM)
    second = np.flatnonzero(follows)
    known = word_keys(words)
    pairs = mix(known[second - 1], known[second])
    numbers = ((np.concatenate([grams, heads, alone, pairs]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    places = np.concatenate([of, long, short, second - 1])
    return np.searchsorted(words.first, places, side="right") - 1, numbers, words.counts(), places


@dataclass
class Model:
    weights: np.ndarray  # one for each feature number
    thresholds: np.ndarray  # ascending

    def scores(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        documents, numbers, words, _ = text_features(column)
        known = np.flatnonzero((self.weights != 0)[numbers])
        pairs = np.unique(documents[known] << BITS | numbers[known])  # present or not
        return np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], len(words)).astype(np.float64)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def _regress(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, size: int, penalty: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps with a decreasing length (Adam); thresholds as a first one and positive gaps."""
    n, levels = len(grades), int(grades.max())
    weigh = np.where(grades > 0, 0.5 / np.mean(grades > 0), 0.5 / np.mean(grades == 0))  # toxic and clean texts weigh the same
    shares = np.array([np.average(grades > k, weights=weigh) for k in range(levels)])
    first = np.log((1 - shares) / shares)
    values = np.concatenate([np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    moment, spread = np.zeros_like(values), np.zeros_like(values)
    low, high = np.maximum(grades - 1, 0), np.minimum(grades, levels - 1)
    for step in range(1, steps + 1):
        weights, gaps = values[:size], np.exp(values[size + 1:])
        thresholds = values[size] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, weights[features], n)
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -50, 50)))  # P(grade > k)
        pick = np.arange(n)
        upper, lower = np.where(grades > 0, p[pick, low], 1.0), np.where(grades < levels, p[pick, high], 0.0)
        mass = np.maximum(upper - lower, 1e-12) / weigh
        up, down = np.where(grades > 0, upper * (1 - upper), 0) / mass, np.where(grades < levels, lower * (1 - lower), 0) / mass
        slope_t = np.zeros((levels,))
        np.add.at(slope_t, low, np.where(grades > 0, up, 0))
        np.add.at(slope_t, high, -np.where(grades < levels, down, 0))
        slope = np.concatenate([np.bincount(features, (down - up)[rows], size) / n + penalty * weights, [slope_t.sum() / n], [slope_t[k:].sum() * gaps[k - 1] / n for k in range(1, levels)]])
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        values = values - 0.1 / np.sqrt(1 + step / 50) * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
        values[:size] = np.maximum(values[:size], 0)  # chosen features only speak for toxicity
    return values[:size], values[size] + np.concatenate([[0], np.cumsum(np.exp(values[size + 1:]))])


def fit(texts: pa.Array | pa.ChunkedArray, toxic: np.ndarray, grades: np.ndarray | None = None, levels: int = 3, keep: int = 4096, penalty: float = 1e-4) -> Model:
    """Fit on labelled texts: ``grades`` from 0, or None to derive them from ``toxic`` (0 or 1)."""
    nothing = Model(np.zeros(1 << BITS), np.array([50.0]))
    if not len(toxic) or toxic.min() == toxic.max():
        return nothing
    parts = list(by_bytes(pa.table({"text": texts}), 0))
    begins = np.concatenate([[0], np.cumsum([p.num_rows for p in parts])])
    pairs = []
    for begin, part in zip(begins, parts):
        documents, numbers, _, _ = text_features(part["text"])
        pairs.append(np.unique((documents + begin) << BITS | numbers))
    pairs = np.concatenate(pairs)
    row, feature = pairs >> BITS, pairs & ((1 << BITS) - 1)
    bad = np.bincount(feature, toxic[row], 1 << BITS)
    good = np.bincount(feature, minlength=1 << BITS) - bad
    n_bad, n_good = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    chosen = np.argsort(np.where((bad + good >= SUPPORT) & (odds > ODDS), -odds * bad, 0), kind="stable")[:keep]
    chosen = chosen[(odds[chosen] > ODDS) & ((bad + good)[chosen] >= SUPPORT)]
    if not len(chosen):
        return nothing
    if grades is None:
        telling = np.zeros(1 << BITS, bool)
        telling[chosen] = True
        amount = np.zeros(len(toxic))
        for begin, part in zip(begins, parts):
            documents, numbers, _, word = text_features(part["text"])
            first = np.unique(word[telling[numbers]], return_index=True)[1]  # a word counts once
            amount[begin: begin + part.num_rows] = np.bincount(documents[telling[numbers]][first], minlength=part.num_rows)
        cuts = np.quantile(amount[toxic == 1], np.arange(1, levels) / levels)
        grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, amount, side="left"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # no empty grade
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[feature] >= 0
    weights, thresholds = _regress(row[used], place[feature[used]], grades, len(chosen), penalty)
    all_weights = np.zeros(1 << BITS)
    all_weights[chosen] = weights
    return Model(all_weights, thresholds)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 8_000, levels: int = 3) -> Model:
    """The model of a sample of labelled rows; one task fits it, the driver gets its weights."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("double").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IS NOT NULL").groupBy("_id").agg((F.max("_toxic") > 0).cast("double").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id").select("_text", "_toxic", F.lit(0).alias("_all"))

    def task(table: pa.Table) -> pa.Table:
        order = table.append_column("_at", pa.array(range(table.num_rows))).sort_by([("_toxic", "ascending"), ("_text", "ascending")])
        model = fit(order["_text"], order["_toxic"].to_numpy(), levels=levels)
        at = np.flatnonzero(model.weights)
        return pa.table({"features": pa.array([at.tolist()], pa.list_(pa.int64())), "weights": pa.array([model.weights[at].tolist()], pa.list_(pa.float64())), "thresholds": pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))})

    found = rows.groupBy("_all").applyInArrow(task, "features array<bigint>, weights array<double>, thresholds array<double>").first()
    weights = np.zeros(1 << BITS)
    if found is None:
        return Model(weights, np.array([50.0]))
    weights[found["features"]] = found["weights"]
    return Model(weights, np.array(found["thresholds"]))


def severity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score, expected_severity, grade, toxic`` of every row; ``toxic``: a grade above 0 is likelier than not."""
    kind = docs.schema[id].dataType.simpleString()
    at = np.flatnonzero(model.weights)
    small = (at, model.weights[at], model.thresholds)  # a few thousand numbers

    def task(batches):
        weights = np.zeros(1 << BITS)
        weights[small[0]] = small[1]
        known = Model(weights, small[2])
        for batch in batches:
            for part in by_bytes(batch, 1):
                scores = known.scores(part.column(1))
                above = known.above(scores)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32))], ["_id", "score", "expected_severity", "grade"])

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(task, f"_id {kind}, score double, expected_severity double, grade int")
    return rows.select(F.col("_id").alias(id), F.round("score", 6).alias("score"), F.round("expected_severity", 6).alias("expected_severity"), "grade", (F.col("grade") > 0).alias("toxic"))
