"""Each operator against brute force on a small table with nulls, blanks, ties, repeats, long texts and clashing names."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from policylake.llm import decontaminate, lm, mixing, parts, quality, queries, repeats, shards, simhash, tokens, toxicity, urls, words

SCHEMA = "doc_id bigint, text string, source string, part int, _id string, n_words string, replica int, `_row` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
BENCH = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, "too short"), (3, None), (4, ""), (2, "short TOO"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "é", "Über", "x" * 90, "a" * 70_000, "don't,", "##", "12", "naïve", "\u00a0"]
    text = lambda n: " ".join(rng.choices(vocabulary, [9] * 60 + [9] * 4 + [1, 0.02] + [4] * 5, k=n))
    passage = text(60)
    texts = [text(rng.choice([1, 3, 12, 40, 200])) for _ in range(40)]
    texts += [f"{text(9)}\n{passage} {text(5)}" for _ in range(4)] + [passage, passage, texts[3], None, None, "", " \t\n ", "one", "a b c d", "A B c d", "e f g h i j k l", "Too  short\x0bthing"]
    texts += ["so so so so so so so so so so " * 12, BENCH[0][1].upper() + "! end", text(300) + "\n" + BENCH[0][1], "zeta eta theta iota kappa lambda", text(20_000)]
    ids = list(range(100, 100 + len(texts)))
    ids[7] = ids[8] = None
    out = [(i, t, rng.choice(["a", "a", "b", None]), 1, "x", "y", 7, "z") for i, t in zip(ids, texts)]
    return out + out[:2] + out[43:45]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


def bag(df, *columns):
    return collections.Counter(tuple(json.dumps(v, default=list) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def split(text, pattern=WORD):
    return pattern.findall(text or "")


def test_word_arrays(rows):
    column = pa.chunked_array([pa.array([r[1] for r in rows[:30]]), pa.array([r[1] for r in rows[30:]])])
    for table, pattern, lower in ((words.SAME, WORD, False), (words.ALNUM, ALNUM, True)):
        got = words.split_words(column, table)
        found = [got.data[a:b].tobytes().decode() for a, b in zip(got.starts, got.ends)]
        want = [split(r[1].translate(UPPER) if lower and r[1] else r[1], pattern) for r in rows]
        assert got.counts().tolist() == list(map(len, want)) and found == sum(want, [])
    keys = words.word_keys(got)
    assert len(set(keys.tolist())) == len(set(found)) and len({(k, w) for k, w in zip(keys.tolist(), found)}) == len(set(found))
    for n in (1, 2, 5, 8, 35):
        sequences = words.sequence_keys(keys, n)
        assert len(set(sequences.tolist())) == len({tuple(found[i: i + n]) for i in range(len(found) - n + 1)})


def test_blobs():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (parts.unpack_sorted(parts.pack_sorted(keys)) == keys).all() and len(parts.unpack_sorted(parts.pack_sorted(keys[:0]))) == 0
    values = np.concatenate([rng.integers(0, 1 << k, 50) for k in range(1, 50)])
    assert (parts.numbers(parts.varints(values)[0].tobytes()) == values).all()
    assert (np.diff(parts.key_group(keys, 7)) >= 0).all() and parts.key_group(keys, 7).max() == 6


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (1, 9), (5, 3), (2000, 1 << 20), (3000, 3001), (700, 0)):
        values = np.sort(rng.integers(0, top + 1, n))
        packed = tokens.EliasFano.of(values)
        assert (packed.select(np.arange(n)) == values).all()
        pick = rng.integers(0, n, 40)
        assert (packed.select(pick) == values[pick]).all()
        assert len(packed.low) + len(packed.high) <= n * (3 + math.log2(top / n + 2)) / 8 + 16
    assert tokens.EliasFano.of(np.empty(0, np.int64)).size == 0


@pytest.mark.parametrize("chunk_tokens", [1 << 20, 50])
def test_tokens(spark, docs, rows, tmp_path, chunk_tokens):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer())
    tokens.write_tokens(docs, str(tmp_path / "t"), queries.tokenizer(), chunk_tokens=chunk_tokens, part_bytes=20_000)
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t"), ids=True).collect(), key=lambda r: r["start"])
    encoded = collections.defaultdict(collections.Counter)
    for r in rows:
        encoded[r[0]][tuple(known.encode(r[1] or "", add_special_tokens=False).ids + [2])] += 1
    start = 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    for r in got:
        encoded[r["doc_id"]][tuple(r["ids"])] -= 1
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += len(r["ids"])
    assert not any(n for c in encoded.values() for n in c.values())


def test_encoder_memory_is_exact():
    from tokenizers import Tokenizer

    known, rng = Tokenizer.from_file(queries.tokenizer()), random.Random(3)
    mine = tokens.Encoder(queries.tokenizer())
    mine.REMEMBER = 40
    alphabet = ["a", "B", "é", "É", "ß", "İ", "1", "'", "'s", "'LL", ",", ".", "!", "&", "«", "’", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "e\u0301", "\u0301", "中", "ｱ", " ", " ", "\n", "\x0b", "\u00a0", "\u3000", "\x1c", "_", "-"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(25)))
        assert np.frombuffer(mine.encode_column(pa.array([text]))[0], mine.id_type).tolist() == known.encode(text, add_special_tokens=False).ids, text


def test_encoder_encodes_pieces_once_and_together():
    from tokenizers import Tokenizer

    known, mine = Tokenizer.from_file(queries.tokenizer()), tokens.Encoder(queries.tokenizer())
    sent: list[int] = []
    ids = mine._ids
    mine._ids = lambda texts: sent.append(len(texts)) or ids(texts)
    mine.REMEMBER = 500
    for k in range(12):  # a memory that turns over keeps the words of every column
        texts = [" ".join(f"{w}{chr(97 + k)}{chr(97 + i)}{chr(97 + j)}" for w in ("red", "blüe") for j in range(20)) + " the of" * 9 for i in range(10)]
        got = mine.encode_column(pa.array(texts))
        assert [np.frombuffer(x, mine.id_type).tolist() for x in got] == [known.encode(t, add_special_tokens=False).ids for t in texts]
        assert b"the" in mine.pieces and b"of" in mine.pieces and len(mine.pieces) + len(mine.older) <= 2 * (500 + 402)
    assert sum(sent) == 12  # 402 new words in the first column, 400 in the others, each time one text


def test_encoder_marks_long_pieces_and_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    known, rng = Tokenizer.from_file(queries.tokenizer()), random.Random(5)
    alphabet = ["a", "B", "é", "1", "'s", ".", "~", " ~ ", "~~", "中" * 30, "x" * 70, "<|endoftext|>", "<|", "\u0301", "\u0338", " ", " ", "\n", "\u00a0", "\u3000", "\x1c", "\u0085", "\x00", "\n\u0308"]
    words = Tokenizer(models.WordLevel({"the": 0, "?": 1}, unk_token="?"))  # the mark's id is that of all unknown pieces
    words.normalizer, words.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "words.json"))
    mine = tokens.Encoder(str(tmp_path / "words.json"))
    texts = ["The end of the 9th.", "", "the ~ of it", "end. the"]
    assert [np.frombuffer(x, mine.id_type).tolist() for x in mine.encode_column(pa.array(texts))] == [words.encode(t).ids for t in texts]
    for single in (True, False):
        mine = tokens.Encoder(queries.tokenizer())
        mine.REMEMBER, mine.mark = 30, mine.mark if single else []
        for _ in range(300):
            mine.GROUP = rng.choice((1, 2, 3, 1024))
            texts = [None if rng.random() < 0.1 else "".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(rng.randrange(6))]
            got = [np.frombuffer(x, mine.id_type).tolist() for x in mine.encode_column(pa.array(texts, pa.string()))]
            assert got == [known.encode(t or "", add_special_tokens=False).ids for t in texts], texts
        assert all(len(p) <= mine.SHORT for p in mine.pieces)  # the memory is bounded in bytes too


def test_tokens_of_nothing(spark, empty, tmp_path):
    tokens.write_tokens(empty, str(tmp_path / "t"), queries.tokenizer())
    assert tokens.read_tokens(spark, str(tmp_path / "t")).collect() == []


def hits(text, sought):
    found, hit, items = split((text or "").translate(UPPER), ALNUM), set(), set()
    for window, ids in sought.items():
        for k in range(len(found) - len(window) + 1):
            if tuple(found[k: k + len(window)]) == window:
                hit |= set(range(k, k + len(window)))
                items |= ids
    return len(found), len(hit), json.dumps(sorted(items)), bool(hit) and 20 * len(hit) >= len(found)


def test_contamination(spark, docs, rows, empty):
    bench = spark.createDataFrame(BENCH, "item_id int, text string").withColumn("window", F.lit("clash"))
    sought = collections.defaultdict(set)
    for i, text in BENCH:
        found = split((text or "").translate(UPPER), ALNUM)
        for k in range(max(len(found) - 12, bool(found))):
            sought[tuple(found[k: k + 13])].add("null" if i is None else str(i))
    got = decontaminate.contamination(docs, bench)
    want = [(r[0], *hits(r[1], sought)) for r in rows]
    assert bag(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == collections.Counter(want)
    assert sum(w[4] for w in want) >= 2
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and bag(clean, *docs.columns) == collections.Counter(r for r, w in zip(rows, want) if not w[4])
    assert decontaminate.contamination(empty, bench).collect() == []
    assert {r["n_hit"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red blue green"), (2, "red x blue green"), (3, "red x x x blue green"), (4, "blue green"), (5, "red")], "doc_id int, text string")
    sought = decontaminate.windows(spark.createDataFrame([(1, "red blue green")], "item_id int, text string"))
    index = decontaminate.build_index(docs.coalesce(1))
    for slack, want in ((0, {1}), (1, {1, 2}), (3, {1, 2, 3})):
        assert {r["ord"] + 1 for r in decontaminate.matches(index, sought, slack).collect()} == want


def brute_fingerprint(text):
    found = split((text or "").translate(UPPER))
    shingles = [found[i: i + 4] for i in range(max(len(found) - 3, bool(found)))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("blocks", [6, 7])
def test_near_duplicates(docs, rows, empty, blocks):
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints))]
    assert bag(simhash.near_duplicates(docs, blocks=blocks), "doc_id", "fingerprint", "component_id") == collections.Counter(want)
    if blocks == 7:
        kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
        assert sorted(i for i in kept if i is not None) == sorted({w[2] for w in want if w[2] is not None})
        assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).columns == docs.columns


def test_links_and_components(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(8):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))
            prints.add(base - (1 << 64) if base >> 63 else base)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    pairs = simhash.links(df)
    assert {tuple(r) for r in pairs.collect()} == want
    roots = dict(simhash.components(pairs).collect())
    unsigned = [p & (1 << 64) - 1 for p in prints]
    brute = dict(zip(prints, brute_components(prints, unsigned)))
    assert all(brute[p] == roots.get(p, p) for p in prints)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_mixing(spark, docs, rows, empty):
    weights = {"a": 3.0, "b": 1.0}
    got = mixing.mix(docs, weights=weights, repeat=3.0)
    assert got.columns == [c for c in docs.columns if c != "replica"] + ["replica", "shuffle_key"]
    size = collections.Counter()
    for r in rows:
        size[r[2]] += len((r[1] or "").encode()) + 1
    rates = {s: weights.get(s, 0) / 4 * 3 * sum(size.values()) / n for s, n in size.items()}
    want = collections.Counter()
    for r in rows:
        h = hashlib.md5("|".join(["1", str(r[0]) if r[0] is not None else "", hashlib.md5((r[1] or "").encode()).hexdigest()]).encode()).hexdigest()
        u, k, p = int(h[:13], 16) / 2**52, 0, math.exp(-rates[r[2]])
        total = p
        while u >= total and rates[r[2]]:
            k += 1
            p *= rates[r[2]] / k
            total += p
        want.update((r[0], i) for i in range(k))
    assert bag(got, "doc_id", "replica") == want and None not in {r["source"] for r in got.collect()}
    assert mixing.mix(empty).collect() == [] and mixing.mix(docs, weights={}).collect() == []
    means = {r["_source"]: r["_rate"] for r in mixing.source_rates(docs, alpha=1.0).collect()}
    assert all(abs(m - 1) < 1e-9 for m in means.values()) and len(means) == 3


def test_mixing_large_rates(spark):
    rows = [(i, f"text {i}", "small" if i < 6 else "large") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mixing.mix(docs, weights={"small": 9.0, "large": 1.0}, repeat=7.0)
    size = collections.Counter()
    for r in rows:
        size[r[2]] += len(r[1]) + 1
    want = collections.Counter()
    for i, text, source in rows:
        rate = {"small": 0.9, "large": 0.1}[source] * 7 * sum(size.values()) / size[source]
        draws = max(1, math.ceil(rate / 32))
        h = hashlib.md5(f"1|{i}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        for d in range(draws):
            u = int((hashlib.md5(f"{h}|draw|{d}".encode()).hexdigest() if d else h)[:13], 16) / 2**52
            p = total = math.exp(-rate / draws)
            k = 0
            while u >= total:
                k += 1
                p *= rate / draws / k
                total += p
            want[i] += k
    assert collections.Counter(r["doc_id"] for r in got.select("doc_id").collect()) == +want
    assert bag(got, "doc_id", "replica") == collections.Counter((i, k) for i, n in want.items() for k in range(n))
    steps = {r["_source"]: (r["_rate"], r["_draws"], len(r["_steps"])) for r in mixing.source_rates(docs, weights={"small": 1.0}, repeat=50_000.0).collect()}
    assert steps["small"][0] > 900_000 and steps["small"][1] > 30_000 and steps["small"][2] < 160 and steps["large"][:2] == (0, 1)


def test_poisson_steps(spark):
    for mean in (0.3, 4.0, 900.0):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(mean)).alias("s")).first()["s"]
        u = np.random.default_rng(0).random(20_000)
        assert abs(np.searchsorted(steps, u, side="right").mean() - mean) < 5 * math.sqrt(mean / 20_000) and steps[-1] > 1 - 1e-9


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_shards(docs, rows, empty):
    got = shards.assign(docs, shards=5, block_rows=4).collect()
    key = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:16], 16)
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), brute_jump(key(r[0]), 5), brute_jump(key(r[0]), 6)) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got) and shards.assign(empty).collect() == []


def test_shards_hot_key_and_equal_rows(spark):
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 2 = 0, 'same', concat('text ', id)) AS text", "id AS slot")
    got = shards.assign(rows, shards=3, block_rows=100)
    assert bag(got, "doc_id", "size", "text_crc32") == bag(rows.selectExpr("doc_id", "octet_length(text) + 1 AS size", "crc32(text) AS text_crc32"), "doc_id", "size", "text_crc32")
    for s, n, least, most, distinct in got.groupBy("shard").agg(F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")).collect():
        assert (least, most, distinct) == (0, n - 1, n)
    assert got.filter("doc_id IS NULL").agg(F.countDistinct("shard")).first()[0] == 1


def test_write_shards(spark, docs, rows, tmp_path):
    shards.write_shards(docs, str(tmp_path / "s"), shards=4, files=2)
    assert bag(spark.read.parquet(str(tmp_path / "s")), *docs.columns) == collections.Counter(rows)


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    bad, clean = ["vilgar", "scurn"], [f"word{i}" for i in range(50)]
    data = [(i, " ".join(rng.choices(clean, k=rng.randrange(5, 30)) + rng.choices(bad, k=rng.randrange(1, 6)) * (i % 5 == 0))) for i in range(600)]
    texts = spark.createDataFrame(data + [(None, None), (9_000, ""), (9_001, "vilgar " * 40_000)], "doc_id int, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None), (77_777, 1)], "doc_id int, toxic int")
    model = toxicity.learn(texts, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.severity(texts, model).collect()}
    assert len(got) == 603 and all(got[i]["toxic"] == (i % 5 == 0) for i in range(300, 600)) and got[9_001]["toxic"] and not got[9_000]["toxic"] and not got[None]["toxic"]
    few, many = ([got[i]["expected_severity"] for i, t in data if i % 5 == 0 and lo <= len(re.findall("vilgar|scurn", t)) <= hi] for lo, hi in ((1, 1), (4, 5)))
    assert few and many and sum(few) / len(few) < sum(many) / len(many)
    nothing = toxicity.learn(texts, labels.filter("toxic = 0"))
    assert {r["grade"] for r in toxicity.severity(texts, nothing).collect()} == {0}
    assert toxicity.severity(empty, model).collect() == [] and toxicity.learn(empty, labels).weights.sum() == 0


def brute_features(text):
    """Distinct features of a text, spelled out: ("gram", 5 bytes) or ("pair", two words)."""
    found = [w.encode() for w in ALNUM.findall((text or "").translate(UPPER))]
    out = set()
    for w in found:
        out |= {w[i: i + 5] for i in range(len(w) - 4)} | {b" " + w[:4] if len(w) > 3 else b" " + w + b" "}
    return out | {(a, b) for a, b in zip(found, found[1:]) if len(a) <= 5 and len(b) <= 5}


def feature_number(feature):
    wrap = (1 << 64) - 1
    if isinstance(feature, tuple):
        a, b = (int(words.word_keys(words.split_words(pa.array([w.decode()])))[0]) for w in feature)
        h = (a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F & wrap
        h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 & wrap
        key = h ^ h >> 32
    else:
        key = int.from_bytes(feature, "little")
    return (key * 0x9E3779B97F4A7C15 & wrap) >> (64 - toxicity.BITS)


def test_toxicity_scores_against_brute_force(spark, docs, rows):
    wanted = sorted({f for r in rows[:45] for f in brute_features(r[1])} | {b" so ", (b"so", b"so"), (b"too", b"short")}, key=str)
    telling = random.Random(9).sample(wanted, 300) + [b" so ", (b"so", b"so"), (b"too", b"short")]
    weights = np.zeros(1 << toxicity.BITS)
    for i, feature in enumerate(telling):
        weights[feature_number(feature)] = (i % 7 + 1) / 8  # sums are exact
    model = toxicity.Model(weights, np.array([1.0, 3.0, 9.0]))

    def brute(text):
        score = sum(weights[n] for n in {feature_number(f) for f in brute_features(text)})
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        return round(score, 6), sum(p >= 0.5 for p in above)

    want = {t: brute(t) for t in {r[1] for r in rows}}
    got = toxicity.severity(docs, model)
    assert len({grade for _, grade in want.values()}) == 4
    assert bag(got, "doc_id", "score", "grade", "toxic") == collections.Counter((r[0], *want[r[1]], want[r[1]][1] > 0) for r in rows)


@pytest.mark.parametrize("bad", ["oaf", "x", "go eat rot", "you are it"])
def test_toxic_short_words_and_phrases(bad):
    rng = random.Random(6)
    clean = ["go", "eat", "rot", "you", "are", "it"] + [f"w{i}" for i in range(40)]

    def text(toxic):
        while True:
            found = rng.choices(clean, k=rng.randrange(8, 30))
            at = rng.randrange(len(found))
            out = " ".join(found[:at] + bad.split() * toxic + found[at:])
            if toxic or not any(" ".join(p) in out for p in zip(bad.split(), bad.split()[1:])):
                return out

    data = [(text(i % 4 == 0), float(i % 4 == 0)) for i in range(1200)]
    model = toxicity.fit(pa.array([t for t, _ in data[:600]]), np.array([y for _, y in data[:600]]))
    grades = (model.above(model.scores(pa.array([t for t, _ in data[600:]]))) >= 0.5).sum(1)
    assert np.mean((grades > 0) == [y > 0 for _, y in data[600:]]) > 0.97


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 800)
    texts = pa.array([" ".join(["plain"] * 5 + ["mildly"] * (g > 0) + ["harshly"] * (g > 1) + ["utterly"] * (g > 2)) for g in grades.tolist()])
    model = toxicity.fit(texts, (grades > 0).astype(float), grades)
    assert ((model.above(model.scores(texts)) >= 0.5).sum(1) == grades).mean() > 0.99


def brute_quality(text):
    text = text or ""
    found = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    windows = collections.Counter(tuple(found[i: i + 5]) for i in range(len(found) - 4))
    again = {j for i in range(len(found) - 4) if windows[tuple(found[i: i + 5])] > 1 for j in range(i, i + 5)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(found) < 10 or 100 * len(again) > 20 * len(found)


def test_quality(docs, rows, empty):
    got = quality.scores(docs)
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert all(not r["kept"] for r in got.collect() if r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and bag(kept, "doc_id") == bag(got.filter("kept"), "doc_id")
    assert quality.scores(empty).collect() == [] and not [n for n in got._jdf.queryExecution().executedPlan().toString().split() if "Python" in n or "Arrow" in n]


def brute_em(patterns, n, steps=25):
    prior, good, bad = 0.8, [0.95] * n, [0.3] * n
    clip = lambda x, low: min(max(x, low), 0.999)
    for _ in range(steps):
        weight = []
        for votes, c in patterns:
            a, b = prior, 1 - prior
            for k, v in enumerate(votes):
                a *= {1: good[k], -1: 1 - good[k], 0: 1}[v]
                b *= {1: 1 - bad[k], -1: bad[k], 0: 1}[v]
            weight.append(a / (a + b))
        rows = list(zip(patterns, weight))
        prior = clip((sum(c * w for (_, c), w in rows) + 1) / (sum(c for _, c in patterns) + 2), 0.5)
        good = [clip((sum(c * w for (v, c), w in rows if v[k] == 1) + 1) / (sum(c * w for (v, c), w in rows if v[k]) + 2), 0.7) for k in range(n)]
        bad = [clip((sum(c * (1 - w) for (v, c), w in rows if v[k] == -1) + 1) / (sum(c * (1 - w) for (v, c), w in rows if v[k]) + 2), 0.05) for k in range(n)]
    return prior, good, bad


def test_em(spark):
    rng = random.Random(6)
    counts = collections.Counter()
    for _ in range(3000):
        truth = rng.random() < 0.85
        counts[tuple(0 if rng.random() < 0.2 else (1 if rng.random() < 0.97 else -1) if truth else (-1 if rng.random() < 0.5 else 1) for _ in range(4))] += 1
    model = quality.fit(spark.createDataFrame([(*v, c) for v, c in counts.items()], "a int, b int, c int, d int, n int"), list("abcd"), tolerance=0)
    prior, good, bad = brute_em(list(counts.items()), 4)
    assert np.allclose([model.prior, *model.right_on_good, *model.right_on_bad], [prior, *good, *bad], atol=1e-6)
    assert abs(model.prior - 0.85) < 0.1


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(UPPER)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_urls(spark):
    rules = queries.URL_RULES + [("block", "odd.org", "/adm"), ("allow", "odd.org", "/admin"), ("block", "odd.org", ""), ("block", "b.c.d", "/"), ("allow", "c.d", "/ab")]
    made = [None, "", "no scheme", "http://", "x://COM", "https://a.COM/", "http://example.com/en/x?q#f", "http://www.EXAMPLE.com/en/", "http://xexample.com/en/", "ftp://m.net/es/", "http://net/fr/a", "http://net/fr", "a://odd.org/administer", "a://odd.org/adm",
            "a://odd.org?x", "a://w.odd.org#y", "a://b.c.d/abc", "a://a..com/", "http://.com/", "x://y://z.com/", "http://com/" + "p/" * 30_000, "http://" + "a." * 30_000 + "net/es/", "http://h.com\n/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(made)] + [(3, "http://net/es/"), (3, "http://net/es/"), (None, "http://net/es/")][:0] + [(3, made[5], "c"), (None, made[5], "c"), (3, made[5], "c")], "page_id int, url string, host string")
    given = [(r["page_id"], r["url"]) for r in pages.collect()]
    got = urls.judge(pages, urls.rule_table(spark, rules))
    assert bag(got, "page_id", "host", "path", "rule", "verdict") == collections.Counter((i, *brute_judge(u, rules)) for i, u in given)
    assert {r["verdict"] for r in urls.judge(pages, urls.rule_table(spark, []), default="block").collect()} == {"block"} and urls.judge(pages.limit(0), urls.rule_table(spark, rules)).collect() == []


def brute_scores(texts, order=3, least=2, backoff=0.4):
    found = [split(t) for t in texts]
    counts = [None] + [collections.Counter(tuple(w[k: k + n]) for w in found for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total, out = sum(map(len, found)), []
    for w in found:
        score = 0.0
        for k in range(len(w)):
            most = min(k, order - 1) + 1
            for n in range(most, 0, -1):
                gram = tuple(w[k - n + 1: k + 1])
                if n == 1 or counts[n][gram] >= least:
                    score += math.log10(counts[n][gram] / (counts[n - 1][gram[:-1]] if n > 1 else total)) + (most - n) * math.log10(backoff)
                    break
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order, least", [(1, None), (2, 2), (3, 2), (3, None)])
def test_lm(docs, rows, empty, order, least):
    given = {} if least is None else {"min_count": least}  # by default every n-gram counts
    want = brute_scores([r[1] for r in rows], order, least or 1)
    for scores in (lambda df: lm.backoff_scores(df, order=order, part_bytes=30_000, **given), lambda df: lm.backoff_scores_by_rows(df, order=order, **given)):
        got = scores(docs)
        pairs = zip(sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in got.collect()), sorted((str(r[0]), *w) for r, w in zip(rows, want)))
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in pairs)
        assert got.count() == len(rows) and scores(empty).collect() == []



@pytest.mark.parametrize("frequent", [1 << 16, 1])
def test_repeats(docs, rows, empty, frequent, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    found = [split(r[1]) for r in rows]
    counts = collections.Counter(tuple(w[k: k + 35]) for w in found for k in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(rows, found):
        gone = {j for k in range(len(w) - 34) if counts[tuple(w[k: k + 35])] > 1 for j in range(k, k + 35)}
        want[(r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    got = repeats.remove_repeats(docs, part_bytes=30_000)
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_text") == want
    assert all(sum(s["words"] for s in r["spans"]) == r["n_removed"] for r in got.collect()) and repeats.remove_repeats(empty).collect() == []
