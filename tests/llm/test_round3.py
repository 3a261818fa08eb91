"""Jaccard join, collocations and fill-in-middle against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from policylake.llm import infill, jaccard, lm, parts
from test_llm_operators import SCHEMA, UPPER, WORD, bag, brute_components, docs, empty, rows  # noqa: F401  fixtures too

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# fill-in-middle

def brute_fim(i, text):
    text = text or ""
    tokens, h = TOKEN.findall(text), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return i, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [" ", "  a", "a  ", "a\u0085b   c", "\ta\x0b\x0c\nb\r", "<", "x<P", "P> x <S", "a <P> b", "<M>", "\U0001F600 \U0001F601́ é z", "\x00 \x1c a", "a<S<S", ">a"]


def test_fill_in_middle(spark, docs, rows, empty):  # noqa: F811
    extra = [(1000 + i, t, None, 1, "x", "y", 7, "z") for i, t in enumerate(ODD * 12)] + [(None, "a b c", None, 1, "", "", 1, "")] * 2
    table = docs.union(spark.createDataFrame(extra, SCHEMA))
    out = infill.fill_in_middle(table)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    got = collections.Counter(tuple(r[c] for c in names) for r in out.collect())
    assert got == collections.Counter(brute_fim(r[0], r[1]) for r in rows + extra)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}
    back = out.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text"))
    assert bag(back, "doc_id", "text") == collections.Counter((r[0], r[1] or "") for r in rows + extra)
    assert infill.fill_in_middle(empty).count() == 0


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 255, 256, 257, 5000):
        widths = rng.integers(1, 9, n)
        lanes, before = infill.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
        assert [lanes.seek(k) for k in range(n + 1)] == before.tolist()
        assert len(lanes.lanes) == 1 + sum(n > 16 ** k for k in (1, 2, 3))


# n-gram Jaccard join

def brute_sets(texts):
    out = []
    for t in texts:
        words = WORD.findall((t or "").translate(UPPER))
        out.append(frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def brute_jaccard(ids, texts):
    sets = brute_sets(texts)
    distinct = sorted({s for s in sets if s}, key=sorted)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(a)] = root(b)
    names = collections.defaultdict(list)
    for i, s in zip(ids, sets):
        if s and i is not None:
            names[root(s)].append(i)
    return collections.Counter((i, len(s), i if not s else min(names[root(s)], default=None)) for i, s in zip(ids, sets))


def near_texts(rng):
    """Families of edited copies at similarities around the threshold, with passages shared by unlike texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(vocabulary, k=n)
    passage, texts = text(40), []
    for size, copies in ((30, 12), (80, 60), (200, 8), (6, 5), (9, 9), (14, 9)):
        base = text(size)
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(new))
                new[at: at + rng.randrange(0, 2)] = text(rng.randrange(0, 2))
            texts.append(" ".join(new))
    texts += [" ".join(text(rng.randrange(3, 60)) + passage + text(rng.randrange(3, 12))) for _ in range(40)]
    texts += [" ".join(text(k)) for k in (1, 2, 3, 4, 5, 5)] + ["a b c d", "A  b c D", "a b c", "x", "X ", "so " * 30, "SO " * 8, " ", None]
    return texts


@pytest.mark.parametrize("part_bytes, block_bytes", [(4 << 20, 8 << 20), (3000, 8 << 20), (3000, 9000), (2000, 2500)])
def test_jaccard_join(spark, part_bytes, block_bytes):
    texts = near_texts(random.Random(block_bytes))
    ids = list(range(500, 500 + len(texts)))
    for k in (3, 14, 15, 100):
        ids[k] = None
    ids[20] = ids[21]
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(6)
    got = bag(jaccard.similar_documents(table, part_bytes=part_bytes, block_bytes=block_bytes), "doc_id", "n_shingles", "component_id")
    assert got == collections.Counter({k: v for k, v in brute_jaccard(ids, texts).items()})


def test_jaccard_join_defined_cases(docs, rows, empty):  # noqa: F811
    got = bag(jaccard.similar_documents(docs), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard([r[0] for r in rows], [r[1] for r in rows])
    out = jaccard.similar_documents(empty)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_prefix_tree_gives_all_components():
    rng = random.Random(2)
    for percent in (50, 80, 95):
        sets = sorted({tuple(sorted(rng.sample(range(60), rng.randrange(1, 30)))) for _ in range(30)} | {tuple(x for x in range(40) if rng.random() < 0.93) for _ in range(80)})
        names = [str(i) for i in range(len(sets))]
        links = jaccard.trie_links(names, np.array([len(s) for s in sets]), [np.array(s, np.uint64) for s in sets], percent)
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(map(set, sets)):
            for j, b in enumerate(map(set, sets[:i])):
                if 100 * len(a & b) >= percent * len(a | b):
                    parent[root(i)] = root(j)
        true = len({root(i) for i in range(len(sets))})
        for a, b in links:
            x, y = set(sets[int(a)]), set(sets[int(b)])
            assert 100 * len(x & y) >= percent * len(x | y)
        assert len(links) == len(sets) - true


# phrase collocations

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
PLAIN_WORD = re.compile(r"[^\x20\x09]+")


def brute_phrases(rows, min_count, top=2000):
    """rows: (lang, text)."""
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(UPPER)):
            words = PLAIN_WORD.findall(piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i: i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found, over = {}, collections.Counter()
    for key, a in counts.items():
        if len(key) > 2 and a >= min_count:
            lang, *w = key
            cuts = [(2000000 * a // (counts[(lang, *w[:k])] + counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[key] = (score, a, counts[(lang, *w[:k])], counts[(lang, *w[k:])])
            for n in range(2, len(w)):
                for i in range(len(w) - n + 1):
                    inner = (lang, *w[i: i + n])
                    over[inner] = max(over[inner], a)
    kept = [(key[0], " ".join(key[1:]), *v) for key, v in found.items() if 100 * over[key] < 80 * v[1]]
    out = set()
    for lang in totals:
        best = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[2], -x[3], x[1].encode()))[:top]
        out |= {(lang, i + 1, p, a, left, right, totals[lang], score) for i, (_, p, score, a, left, right) in enumerate(best)}
    return out


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("part_bytes, hot_words, top", [(4 << 20, 1 << 21, 2000), (900, 1 << 21, 7), (900, 40, 2000), (300, 200, 2000)])
def test_collocations(spark, part_bytes, hot_words, top):
    from policylake.llm import collocations

    rng = random.Random(hot_words)
    common = ["the", "of", "Of", "é", "new", "york", "city", "x\u0085y", "\x1c", "#1"]
    texts = []
    for _ in range(150):
        words = rng.choices(common, [9, 8, 2, 3, 3, 3, 2, 1, 1, 1], k=rng.randrange(0, 60))
        words = [w if rng.random() < 0.9 else f"rare{rng.randrange(500)}" for w in words]
        texts.append("".join(w + rng.choice([" ", " ", " ", " ", "\t ", ", ", ".", "\n", "?!\x0b"]) for w in words))
    texts += ["New York City hall of fame"] * 45 + ["so so so so so so so so"] * 9 + [None, "", " \t", ".,;", "of the"]
    rows = [(rng.choice(["en", "en", "fr", None, "und", ""]), t) for t in texts]  # noqa: F811
    rows += rows[:30]
    table = spark.createDataFrame([(i, t, lang, 3, "p") for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, part int, word string").repartition(5)
    out = collocations.collocations(table, min_count=12, top=top, part_bytes=part_bytes, hot_words=hot_words)
    assert out.columns == list(PHRASE_COLUMNS) and dict(out.dtypes)["score"] == "bigint"
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, 12, top) and len(got) > 20


def test_collocations_defined_cases(spark, docs, rows, empty):  # noqa: F811
    from policylake.llm import collocations

    lang = lambda df: df.withColumn("lang", F.lit(None).cast("string"))
    assert {tuple(r) for r in collocations.collocations(lang(docs)).collect()} == brute_phrases([(None, r[1]) for r in rows], 30)
    assert collocations.collocations(lang(empty)).count() == 0


def test_filters_give_back_what_they_counted():
    from policylake.llm.collocations import Packing, _sorted_sums

    rng = np.random.default_rng(1)
    for bits, group_bits in ((1, 0), (8, 0), (17, 5), (30, 3), (32, 0), (32, 12)):
        packing = Packing(bits, group_bits)
        w = rng.integers(0, 1 << bits, (4, 3000)).astype(np.uint64)
        for rule in (2, 3, 4):
            (head, tail), counts = _sorted_sums(list(packing.permute(w, rule)), rng.integers(1, 1 << 40, 3000))
            back = packing.invert(head, tail, rule)
            assert set(map(tuple, back.T.tolist())) == set(map(tuple, w.T.tolist()))
            of = packing.groups(head)
            for g in np.unique(of):
                mine = of == g
                again = packing.unpack(int(g), packing.pack(head[mine], tail[mine], counts[mine]))
                assert all((x == y[mine]).all() for x, y in zip(again, (head, tail, counts)))


def test_shards_as_sql_computes_them(spark):
    """Jump hashing written as a recursive query."""
    import duckdb

    from conftest import SF
    from policylake.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, size, shard, grown_shard FROM ({queries.JUMP_SQL})").fetchall()
    got = queries.QUERIES["op5_shards"](spark, SF).select("doc_id", "size", "shard", "grown_shard")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_texts_and_keys_travel_deflated():
    texts = ["the same words again and again " * 40, "", "Grüße 江 \u0000", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array(range(4)), pa.array(texts), pa.array(range(4))], ["part", "_id", "_text", "_hash"])
    sent = pa.Table.from_batches(list(lm._deflated([batch])))
    assert lm._texts(sent["_text"]).to_pylist() == texts and sent.nbytes < batch.nbytes / 5
    for n in (0, 1, 5000):
        keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (lm._unpack(lm._pack(keys)) == keys).all()
    assert len(lm._pack(keys)) < 7 * len(keys) < len(parts.pack_sorted(keys))
