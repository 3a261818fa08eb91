"""Cases in which an operator once did less than the whole job."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa

from conftest import SF
from policylake.llm import decontaminate, queries, simhash, tokens
from test_llm_operators import brute_components, brute_fingerprint, brute_scores


def test_one_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(12)]
    ids = [None, None, None, 1, 1, 1, 2, 3, None, 4, 4, None]
    rows = list(zip(ids, texts)) + [(None, texts[6]), (None, texts[0]), (9, texts[6]), (1, texts[3]), (5, texts[3]), (None, None), (None, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    roots = brute_components(range(len(rows)), [brute_fingerprint(t) for _, t in rows])
    groups = collections.defaultdict(list)
    for root, (i, t) in zip(roots, rows):
        groups[root].append((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest()))
    want = collections.Counter(min(g) for g in groups.values())
    assert len(groups) == 13
    got = collections.Counter((r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in simhash.keep_one(docs).collect())
    assert got == want and got[(False, 1, hashlib.md5(texts[4].encode()).hexdigest())] == 1


def test_marks_that_compose_with_small_letters_only():
    from tokenizers import Tokenizer

    known, mine, rng = Tokenizer.from_file(queries.tokenizer()), tokens.Encoder(queries.tokenizer()), random.Random(7)
    texts = ["H\u0331ebron", "T\u0308a", "xW\u030a", "Y\u030a.", "J\u030c"] + ["".join(rng.choices("AHJTWYhjtwy1 .,=\u0331\u0308\u030a\u030c\u0338\u00e9", k=rng.randrange(1, 12))) for _ in range(2000)]
    got = [np.frombuffer(ids, mine.id_type).tolist() for ids in mine.encode_column(pa.array(texts))]
    assert got == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_scores_use_ngrams_that_occur_once(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute_scores([r["text"] for r in rows], least=1))}
    got = queries.QUERIES["op9_lm_scores"](spark, SF).collect()
    assert len(got) == len(rows) == len(want)
    assert all(r["n_words"] == want[r["doc_id"]][0] and abs(r["log_score"] - want[r["doc_id"]][1]) < 1e-3 for r in got)


def test_proximity_ends_with_the_document(spark):
    docs = spark.createDataFrame([(1, "red blue green"), (2, "red x blue green"), (3, "red x x x blue green"), (4, "blue green"), (5, "red")], "doc_id int, text string")
    sought = decontaminate.windows(spark.createDataFrame([(1, "red blue green")], "item_id int, text string"))
    index = decontaminate.build_index(docs.coalesce(1))
    for slack in (4, 9):
        assert {r["ord"] + 1 for r in decontaminate.matches(index, sought, slack).collect()} == {1, 2, 3}
