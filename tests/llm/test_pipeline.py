"""The pipeline's rows against a plain Python version of all its stages."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF
from policylake.llm import quality, queries
from test_llm_operators import ALNUM, UPPER, brute_components, brute_em, brute_fingerprint, brute_quality, hits, split


def plain_votes(text):
    text = text or ""
    words = split(text)
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if split(x)]
    chars = sum(map(len, words))
    upper = sum(c.isupper() and c.lower() != c or c in "ǅǈǋǲ" for c in text)
    vote = lambda x, good, bad: (-1 if x >= bad else 1 if x <= good else 0) if good < bad else (-1 if x <= bad else 1 if x >= good else 0)
    per = lambda x, y: x / y if y else 0.0
    return (
        vote(len(words), 20, 9), vote(per(len(re.findall(r"[#*$%&|<>]", text)), len(words)), 0.02, 0.2), vote(per(len(lines) - len(set(lines)), len(lines)), 0.05, 0.3),
        vote(per(upper, chars), 0.15, 0.4), vote(per(text.count("!"), len(words)), 0.05, 0.3), vote(per(chars, len(words)), 10, 14),
        0 if len(words) < 40 else vote(sum(w in quality.FUNCTION_WORDS for w in words) / n, 0.05, 0.01))


def good_ones(docs):
    votes = [plain_votes(t) for _, t, _ in docs]
    prior, good, bad = brute_em(list(collections.Counter(votes).items()), len(votes[0]), 25)
    kept = []
    for doc, vote in zip(docs, votes):
        odds = math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0 for v, g, b in zip(vote, good, bad))
        if odds >= 0 and not brute_quality(doc[1])[5]:
            kept.append(doc)
    return kept


@pytest.fixture(scope="module")
def expected():
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    stages = [docs, good_ones(docs)]
    prints = [brute_fingerprint(t) for _, t, _ in stages[-1]]
    names = brute_components([d[0] for d in stages[-1]], prints)
    stages.append([d for d, name in zip(stages[-1], names) if d[0] == name])
    sought = collections.defaultdict(set)
    for i, text in bench:
        found = split((text or "").translate(UPPER), ALNUM)
        for k in range(max(len(found) - 12, bool(found))):
            sought[tuple(found[k: k + 13])].add(str(i))
    stages.append([d for d in stages[-1] if not hits(d[1], sought)[3]])
    size = collections.Counter()
    for _, text, source in stages[-1]:
        size[source] += len(text.encode()) + 1
    scale = sum(size.values()) / sum(math.sqrt(n) for n in size.values())
    mixed = []
    for doc in stages[-1]:
        h = hashlib.md5("|".join(["1", str(doc[0]), hashlib.md5(doc[1].encode()).hexdigest()]).encode()).hexdigest()
        rate, u, count = math.sqrt(size[doc[2]]) * scale / size[doc[2]], int(h[:13], 16) / 2**52, 0
        term = total = math.exp(-rate)
        while u >= total:
            count += 1
            term *= rate / count
            total += term
        mixed += [doc] * count
    stages.append(mixed)
    return stages


def test_pipeline(spark, expected):
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer()), 0, []
    for i, text, _ in sorted(expected[-1]):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want and len(got) > 50


def test_stages(spark, expected):
    """Each stage but the last returns the columns of documents and what the plain version keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], expected[1:]):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(d[0] for d in want)
    assert len({len(x) for x in expected}) > 3


def test_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
