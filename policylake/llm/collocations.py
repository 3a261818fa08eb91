"""Phrase collocations: n-grams counted in quotient filters, scored at their weakest cut.

1. *Words.* Texts are dealt into parts (equal ones of a task once, with their number). Every part sends
   its distinct words with counts to hash groups; words of at least ``min_count`` get an id, which goes
   back to the parts. No phrase with a rarer word can be a candidate, so those end a run of words.
2. *Filters.* From each place of a part goes one n-gram of up to four words, shorter only where the run
   ends, so longer ones hold the counts of their beginnings. Its ids are packed into bits and permuted
   by an invertible network; the top bits are the quotient (the group, then the slot in it, written in
   unary), the others the remainder, kept in full. So a filter gives back exactly the n-grams it
   counted, sorted; the filters that all parts send to a group are merged in that order.
3. *Groups.* A group holds all n-grams that begin with the same two words, so it counts those too. Where
   both words are so frequent (``hot_words``) that they could overfill a group, the third word, and then the
   fourth, also decide the group; counts of beginnings then are partial sums that Spark adds up.
4. *Scores.* From here on frequent n-grams are rows: cuts, counts of both sides, phrases inside longer
   ones and the best of each language are joins and aggregates. Products are decimals, never 64-bit.

Words are compared as strings and n-grams as their ids: counts are exact. Ids take up to 32 bits, enough
for 4 * 10**9 words that each occur ``min_count`` times.

Defined cases: a null language is ``und``; null and blank texts hold no words; repeated rows count as often
as they come; equal scores and counts go by phrase in byte order; a phrase found in two languages is a
phrase of each; an empty table gives an empty result; ids and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm.parts import PART_BYTES, key_group, numbers, part_count, varints
from policylake.llm.words import LOWER, Words, by_bytes, flat, mix, split_words, word_keys
from policylake.session import materialize

MIN_COUNT, LONGEST, TOP, COVER_PERCENT = 30, 4, 2000, 80
HOT_WORDS = 1 << 19  # occurrences of a word; a group holds 1 to 2 million n-grams
SALTS = 64
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_SEPARATORS = LOWER.copy()  # words end at these too
_SEPARATORS[list(PIECE_ENDS)] = 0x20
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True

MESSAGE = "part int, grp int, lang string, words binary, counts binary"
REPLY = "kind int, part int, grp int, lang string, codes binary, word string, id bigint, f bigint"
FILTER = "grp int, rule int, slots binary"
GRAMS = "w1 bigint, w2 bigint, w3 bigint, w4 bigint, f bigint, partial boolean"


def _dealt(docs: DataFrame, text: str, lang: str, parts: int) -> DataFrame:
    """``part, lang, _text, copies``: texts of one language and task once, with their number."""
    def task(batches):
        for batch in batches:
            for rows in by_bytes(batch, 1):
                copies: dict[tuple[str, bytes], list[int]] = {}
                for i, (name, value) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist())):
                    copies.setdefault((name, hashlib.md5(value).digest()), [i, 0])[1] += 1
                first = pa.array([i for i, _ in copies.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([int.from_bytes(d[:4], "big") % parts for _, d in copies], pa.int32()), rows.column(0).take(first), rows.column(1).take(first),
                    pa.array([n for _, n in copies.values()], pa.int64())], ["part", "lang", "_text", "copies"])

    body = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return body.mapInArrow(task, "part int, lang string, _text string, copies bigint")


class _Language:
    """The words of a part's texts in one language, and its distinct words in the order of their groups."""

    def __init__(self, lang: str, table: pa.Table, groups: int):
        self.lang = lang
        words = split_words(table["_text"], _SEPARATORS)
        data, _ = flat(table["_text"])
        piece, doc = np.concatenate([[0], np.cumsum(_ENDS[data])])[words.starts], np.repeat(np.arange(table.num_rows), words.counts())
        self.goes_on = np.zeros(len(words), bool)  # the next word is in the same piece
        self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        self.copies = np.asarray(table["copies"])[doc]
        lengths = words.ends - words.starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        inside = words.data[np.repeat(words.starts - ends[:-1], lengths) + np.arange(ends[-1])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(inside)]).dictionary_encode()
        names = coded.dictionary
        offsets = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
        held = Words(np.frombuffer(names.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:], np.array([0, len(names)]))
        salt = np.uint64(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "big"))
        group = key_group(mix(word_keys(held), np.full(len(names), salt)), groups) if len(names) else np.empty(0, np.int64)
        order = np.asarray(pc.sort_indices(names))
        order = order[np.argsort(group[order], kind="stable")]
        self.group, self.names = group[order], names.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at = place[np.asarray(coded.indices)]  # which distinct word stands at each place

    def message(self, part: int, groups: int) -> pa.Table:
        order = np.argsort(self.at, kind="stable")
        counts = np.add.reduceat(self.copies[order], np.searchsorted(self.at[order], np.arange(len(self.names)))) if len(self.names) else np.empty(0, np.int64)
        cuts = np.searchsorted(self.group, np.arange(groups + 1))
        full = np.flatnonzero(np.diff(cuts))
        ends = [(int(cuts[g]), int(cuts[g + 1])) for g in full]
        return pa.table({
            "part": pa.array([part] * len(full), pa.int32()), "grp": pa.array(full, pa.int32()), "lang": pa.array([self.lang] * len(full), pa.string()),
            "words": pa.array([b" ".join(self.names[a:b].to_pylist()) for a, b in ends], pa.binary()), "counts": pa.array([varints(counts[a:b])[0].tobytes() for a, b in ends], pa.binary())})

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of four words from each place on (0 behind the end of a run), of those with two at least, and copies."""
        code = codes[self.at]
        after = np.zeros(len(code) + LONGEST, np.uint64)
        after[: len(code)][self.goes_on] = code[1:][self.goes_on[:-1]]
        w = [code]
        for k in range(1, LONGEST):
            w.append(np.where(w[-1] > 0, after[k - 1: k - 1 + len(code)], np.uint64(0)))
        keep = w[1] > 0
        return np.stack([x[keep] for x in w]), self.copies[keep]


def _languages(table: pa.Table, groups: int):
    for lang in sorted(pc.unique(table["lang"]).to_pylist()):
        yield _Language(lang, table.filter(pc.equal(table["lang"], lang)), groups)


def _word_counts(table: pa.Table, groups: int) -> pa.Table:
    return pa.concat_tables([x.message(table["part"][0].as_py(), groups) for x in _languages(table, groups)])


def _vocabulary(table: pa.Table, groups: int, min_count: int, hot_words: int) -> pa.Table:
    """Of one group: the codes that answer each message (kind 0), its frequent words (1) and all occurrences of a language (2).

    A code is twice the id, plus 1 if the word is hot; 0 for a rare word.
    """
    rows = {name.split()[0]: [] for name in REPLY.split(", ")}

    def add(**values) -> None:
        for name, column in rows.items():
            column.append(values.get(name))

    grp, given = table["grp"][0].as_py(), 0
    for lang in sorted(pc.unique(table["lang"]).to_pylist()):
        mine = table.filter(pc.equal(table["lang"], lang))
        lists = [x.split(b" ") for x in mine["words"].to_pylist()]
        coded = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
        at, names = np.asarray(coded.indices), coded.dictionary
        counts = np.concatenate([numbers(x) for x in mine["counts"].to_pylist()])
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(counts[order], np.searchsorted(at[order], np.arange(len(names))))
        by_name = np.asarray(pc.sort_indices(names))
        frequent = by_name[sums[by_name] >= min_count]
        ids = (given + np.arange(len(frequent))) * groups + grp + 1
        given += len(frequent)
        code = np.zeros(len(names), np.int64)
        code[frequent] = 2 * ids + (sums[frequent] >= hot_words)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).tolist()
        for part, a, b in zip(mine["part"].to_pylist(), ends, ends[1:]):
            add(kind=0, part=part, grp=grp, lang=lang, codes=varints(code[at[a:b]])[0].tobytes())
        for i, word, f in zip(ids.tolist(), names.take(pa.array(frequent)).to_pylist(), sums[frequent].tolist()):
            add(kind=1, lang=lang, word=word.decode(), id=i, f=f)
        add(kind=2, lang=lang, f=int(sums.sum()))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.table({name: pa.array(rows[name], kinds[kind]) for name, kind in (c.split() for c in REPLY.split(", "))})


class Packing:
    """Four word ids of ``bits`` bits: an invertible permutation, and filters of the sorted results.

    ``rule`` 2: the first two words decide the permuted head, whose top ``group_bits`` are the group; 3
    and 4: the third, or the third and the fourth, are mixed into it.
    """

    def __init__(self, bits: int, group_bits: int):
        if bits > 32:
            raise ValueError("more than 2**32 frequent words")
        self.bits, self.group_bits = max(8, 4 * -(-bits // 4)), group_bits  # whole bytes for two ids
        self.mask, self.width = np.uint64((1 << self.bits) - 1), 2 * self.bits
        self.head_mask = np.uint64((1 << self.width) - 1)

    def _round(self, half: np.ndarray, k: int) -> np.ndarray:
        return mix(half, np.uint64(0x5851F42D4C957F2D + k)) & self.mask

    def _tail_hash(self, w3: np.ndarray, w4: np.ndarray, rule: int) -> np.ndarray | np.uint64:
        return np.uint64(0) if rule == 2 else mix(w3, np.uint64(3)) & self.head_mask if rule == 3 else mix(mix(w3, np.uint64(4)), w4) & self.head_mask

    def permute(self, w: np.ndarray, rule: int) -> tuple[np.ndarray, np.ndarray]:
        """Head and tail of columns of four ids."""
        left, right = w[0], w[1]
        for k in range(4):
            left, right = right, left ^ self._round(right, k)
        b = np.uint64(self.bits)
        return ((left << b) | right) ^ self._tail_hash(w[2], w[3], rule), (w[2] << b) | w[3]

    def invert(self, head: np.ndarray, tail: np.ndarray, rule: int) -> np.ndarray:
        b = np.uint64(self.bits)
        w3, w4 = tail >> b, tail & self.mask
        head = head ^ self._tail_hash(w3, w4, rule)
        left, right = head >> b, head & self.mask
        for k in reversed(range(4)):
            left, right = right ^ self._round(left, k), left
        return np.stack([left, right, w3, w4])

    def groups(self, head: np.ndarray) -> np.ndarray:
        return (head >> np.uint64(self.width - self.group_bits)).astype(np.int64)

    def pack(self, head: np.ndarray, tail: np.ndarray, counts: np.ndarray) -> bytes:
        """Filter of sorted distinct entries of one group: unary quotients, full remainders, counts above 1."""
        m, width = len(head), self.width - self.group_bits
        rest = min(width // 8, -(-(width - (m.bit_length() - 1)) // 8))  # bytes of a head's remainder: m slots or fewer
        low = head & np.uint64((1 << width) - 1)
        quotient = (low >> np.uint64(8 * rest)).astype(np.int64) if rest < 8 else np.zeros(m, np.int64)
        unary = np.zeros(m + int(quotient[-1]) + 1, bool)
        unary[quotient + np.arange(m)] = True
        many = counts > 1
        planes = low.view(np.uint8).reshape(-1, 8)[:, :rest].T.tobytes() + tail.view(np.uint8).reshape(-1, 8)[:, : self.width // 8].T.tobytes()
        return struct.pack("<IIB", m, len(unary), rest) + np.packbits(unary).tobytes() + planes + np.packbits(many).tobytes() + varints(counts[many] - 2)[0].tobytes()

    def unpack(self, group: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, bits, rest = struct.unpack_from("<IIB", blob)
        raw, at = np.frombuffer(blob, np.uint8), 9

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return raw[at - n: at]

        quotient = (np.flatnonzero(np.unpackbits(take(-(-bits // 8)))[:bits]) - np.arange(m)).astype(np.uint64)
        columns = []
        for size in (rest, self.width // 8):
            eight = np.zeros((m, 8), np.uint8)
            eight[:, :size] = take(size * m).reshape(size, m).T
            columns.append(eight.reshape(-1).view("<u8"))
        many = np.unpackbits(take(-(-m // 8)))[:m].astype(bool)
        counts = np.ones(m, np.int64)
        counts[many] = numbers(raw[at:].tobytes()) + 2
        head = columns[0] | ((quotient << np.uint64(8 * rest)) if rest < 8 else np.uint64(0))
        return head | (np.uint64(group) << np.uint64(self.width - self.group_bits) if self.group_bits else np.uint64(0)), columns[1], counts


def _sorted_sums(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in ascending order, the first column first, and the sums of their counts."""
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts, first) if len(first) else counts


def _filters(left: pa.Table, right: pa.Table, groups: int, packing: Packing) -> pa.Table:
    """The filters of one part: of each rule and group."""
    rows: tuple[list, list, list] = ([], [], [])
    replies: dict[str, list] = {}
    for grp, lang, codes in zip(right["grp"].to_pylist(), right["lang"].to_pylist(), right["codes"].to_pylist()):
        replies.setdefault(lang, []).append((grp, codes))
    found = [x.windows(numbers(b"".join(c for _, c in sorted(replies[x.lang]))).astype(np.uint64)) for x in _languages(left, groups) if len(x.names)] if left.num_rows else []
    if found:
        codes, copies = np.concatenate([c for c, _ in found], 1), np.concatenate([n for _, n in found])
        ids, hot = codes >> np.uint64(1), (codes & np.uint64(1)).astype(bool)
        rule = np.where(~(hot[0] & hot[1]), 2, np.where(hot[2], 4, 3))
        for r in (2, 3, 4):
            mine = rule == r
            (head, tail), counts = _sorted_sums(list(packing.permute(ids[:, mine], r)), copies[mine])
            of = packing.groups(head)
            cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist() + [len(of)]
            for a, b in zip(cuts, cuts[1:]):
                for column, value in zip(rows, (int(of[a]), r, packing.pack(head[a:b], tail[a:b], counts[a:b]))):
                    column.append(value)
    return pa.table({"grp": pa.array(rows[0], pa.int32()), "rule": pa.array(rows[1], pa.int32()), "slots": pa.array(rows[2], pa.binary())})


def _merged(table: pa.Table, packing: Packing, min_count: int) -> pa.Table:
    """Merge a group's filters; its frequent n-grams, and partial sums of beginnings that other groups hold too."""
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for rule in (2, 3, 4):
        mine = table.filter(pc.equal(table["rule"], rule))
        if not mine.num_rows:
            continue
        filters = [packing.unpack(g, blob) for g, blob in zip(mine["grp"].to_pylist(), mine["slots"].to_pylist())]
        (head, tail), counts = _sorted_sums([np.concatenate([f[k] for f in filters]) for k in (0, 1)], np.concatenate([f[2] for f in filters]))
        w = packing.invert(head, tail, rule)
        for n in range(2, LONGEST + 1):
            long = w[n - 1] > 0
            grams, sums = _sorted_sums(list(w[:n, long]), counts[long])
            partial = n < rule
            keep = slice(None) if partial else sums >= min_count
            grams = np.stack([g[keep] for g in grams] + [np.zeros(len(sums[keep]), np.uint64)] * (LONGEST - n))
            out.append((grams, sums[keep], partial))
    grams = np.concatenate([g for g, _, _ in out], 1).astype(np.int64)
    return pa.table({f"w{k + 1}": pa.array(grams[k], pa.int64()) for k in range(LONGEST)} | {
        "f": pa.array(np.concatenate([f for _, f, _ in out]), pa.int64()), "partial": pa.array(np.concatenate([np.full(len(f), p) for _, f, p in out]), pa.bool_())})


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, part_bytes: int = PART_BYTES, hot_words: int = HOT_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: ``lang, word, id, f`` of frequent words, ``w1, w2, w3, w4, f`` of frequent phrases (ids, 0 behind the last word) and ``lang, n`` of all occurrences."""
    parts = part_count(docs, text, part_bytes)
    group_bits = max(0, (parts // 3).bit_length() - 1)
    groups = 1 << group_bits
    dealt = _dealt(docs, text, lang, parts)
    counted = dealt.groupBy("part").applyInArrow(lambda t: _word_counts(t, groups), MESSAGE)
    replies = materialize(counted.groupBy("grp").applyInArrow(lambda t: _vocabulary(t, groups, min_count, hot_words), REPLY))
    words = replies.filter("kind = 1").select("lang", "word", "id", "f")
    packing = Packing(int(words.agg(F.max("id")).first()[0] or 1).bit_length(), group_bits)
    codes = replies.filter("kind = 0").select("part", "grp", "lang", "codes")
    filters = dealt.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(lambda a, b: _filters(a, b, groups, packing), FILTER)
    merged = materialize(filters.groupBy("grp").applyInArrow(lambda t: _merged(t, packing, min_count), GRAMS))
    ids = ["w1", "w2", "w3", "w4"]
    sums = merged.filter("partial").groupBy(*ids).agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    totals = replies.filter("kind = 2").groupBy("lang").agg(F.sum("f").alias("n"))
    return words, materialize(merged.filter("NOT partial").select(*ids, "f").union(sums)), totals


def _phrase(*ids: Column) -> Column:
    return F.struct(*[(ids[k] if k < len(ids) else F.lit(0).cast("bigint")).alias(f"w{k + 1}") for k in range(LONGEST)])


def _wide(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(19,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP,
                 part_bytes: int = PART_BYTES, hot_words: int = HOT_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two to four words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its sides at the cut with the lowest score,
    ``floor(2000000 a / (l + r))``; phrases that mostly occur inside one longer phrase are left out.
    """
    words, grams, totals = phrase_counts(docs, text, lang, min_count, part_bytes, hot_words)
    w = [F.col(f"w{k + 1}") for k in range(LONGEST)]
    size = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    phrases = grams.select(_phrase(*w).alias("p"), *w, F.col("f").alias("a"), size.alias("size"))
    known = grams.select(_phrase(*w).alias("side"), "f").union(words.select(_phrase(F.col("id")), "f"))

    cuts = [F.when(F.col("size") == n, F.array(*[F.struct(F.lit(k).alias("cut"), F.lit(left).alias("left"), _phrase(*(w[:k] if left else w[k:n])).alias("side")) for k in range(1, n) for left in (True, False)])) for n in range(2, LONGEST + 1)]
    sides = phrases.select("p", "a", F.explode(F.coalesce(*cuts)).alias("c")).select("p", "a", "c.*").join(known, "side")
    side = lambda k, left: F.max(F.when((F.col("cut") == k) & (F.col("left") == left), F.col("f")))
    both = sides.groupBy("p").agg(F.first("a").alias("a"), *[side(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, LONGEST) for left in (True, False)])
    score = lambda k: F.expr(f"CAST(2000000 * CAST(a AS DECIMAL(19,0)) DIV (CAST(l{k} AS DECIMAL(19,0)) + CAST(r{k} AS DECIMAL(19,0))) AS BIGINT)")
    cut = F.least(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)])

    inside = [F.when(F.col("size") == n, F.array(*[_phrase(*w[i: i + k]) for k in range(2, n) for i in range(n - k + 1)])) for n in range(3, LONGEST + 1)]
    longer = phrases.filter("size > 2").select(F.explode(F.coalesce(*inside)).alias("p"), F.col("a").alias("over")).groupBy("p").agg(F.max("over").alias("over"))
    scored = both.select("p", "a", cut.alias("c")).join(longer, "p", "left")
    kept = scored.filter(F.col("over").isNull() | (_wide(100) * _wide(F.col("over")) < _wide(cover_percent) * _wide(F.col("a")))).select("p", "a", "c.*")

    spelled = kept.select("*", F.posexplode(F.filter(F.array("p.w1", "p.w2", "p.w3", "p.w4"), lambda x: x > 0)).alias("at", "id")).join(words.select("id", "word", F.col("lang").alias("lang")), "id")
    named = spelled.groupBy("p").agg(*[F.first(c).alias(c) for c in ("lang", "a", "l", "r", "score")], F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = named.select("lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "score", F.pmod(F.xxhash64("p"), F.lit(SALTS)).alias("_salt"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = named.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).filter(F.col("_r") <= top).drop("_r", "_salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
