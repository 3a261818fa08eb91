"""Benchmark decontamination with a positional inverted index in blocks of documents.

The index is a written table. Each block of documents has one row for each of its terms, with the
delta-coded places of the term in the block, and one row about its documents. A block's postings
never leave it whole, so a frequent term is spread over all blocks.

A window is so many consecutive words of a benchmark item, or a shorter item as a whole. Its terms
are ranked by how rare they are in the whole index. The postings of the two rarest, each moved back
by the term's offset in the window, meet first, inside their block; what is left of them asks for
the postings of the other terms, block by block. Phrases match exactly, proximity within ``slack``.

Defined cases: null texts have no words; items without words match nothing; equal windows are
searched once for all their items; a null item id counts as "null"; rows with equal id and text get
equal results; repeated rows come back as often as they come; empty tables are fine; other columns
are ignored by ``contamination`` and kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm.parts import numbers, varints
from policylake.llm.words import ALNUM, by_bytes, per_document, split_words, word_keys
from policylake.session import materialize

WINDOW = 13
SHARE = 20  # a document is contaminated from one hit word in so many on
BLOCK_BYTES = 8 << 20


def places(postings: bytes) -> np.ndarray:
    """The ascending places whose differences a posting list holds."""
    return np.cumsum(numbers(postings))


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, term, n, postings`` for each term of a block; with a null term the block's documents.

    Documents of a block follow each other with a gap of one place, so no run of places crosses them.
    """
    kind = docs.schema[id].dataType.simpleString()

    def task(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in (block for whole in batches for block in by_bytes(whole, 1, block_bytes)):
            words = split_words(batch.column(1), ALNUM)
            keys, counts = word_keys(words), words.counts()
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
            place = (np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts))[order]
            gaps = np.diff(place, prepend=0)
            gaps[first] = place[first]
            data, begins = varints(gaps)
            cuts = begins[np.concatenate([first, [len(order)]])].astype(np.int32)
            raw = words.data.tobytes()
            heads = order[first]
            terms = [raw[a:b] for a, b in zip(words.starts[heads].tolist(), words.ends[heads].tolist())]
            n = len(terms)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), pa.array(terms, pa.binary()), pa.array(np.diff(np.concatenate([first, [len(order)]])).astype(np.int64)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]),
                pa.nulls(n, pa.list_(batch.column(0).type)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.nulls(1, pa.binary()), pa.array([len(words)]), pa.nulls(1, pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(2)), pa.array([counts.tolist()], pa.list_(pa.int64()))], names)
            block += 1

    names = ["block", "term", "n", "postings", "doc_ids", "hashes", "counts"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_hash"))
    return rows.mapInArrow(task, f"block bigint, term binary, n bigint, postings binary, doc_ids array<{kind}>, hashes array<bigint>, counts array<bigint>")


def windows(bench: DataFrame, id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``window, terms, items``: each distinct window with the ids of the items that hold it."""
    def task(batches):
        for batch in batches:
            words = split_words(batch.column(1), ALNUM)
            raw = words.data.tobytes()
            terms = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
            out = []
            for item, a, b in zip(batch.column(0).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                out += [(terms[i: min(i + size, b)], item) for i in range(a, max(b - size + 1, a + (b > a)))]
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.md5(b" ".join(t)).hexdigest() for t, _ in out], pa.string()), pa.array([t for t, _ in out], pa.list_(pa.binary())), pa.array([i for _, i in out], pa.string())], ["window", "terms", "item"])

    rows = bench.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("_item"), F.col(text).alias("_text"))
    found = rows.mapInArrow(task, "window string, terms array<binary>, item string")
    return found.groupBy("window").agg(F.first("terms").alias("terms"), F.collect_set("item").alias("items"))


def ranked_windows(index: DataFrame, sought: DataFrame) -> DataFrame:
    """``sought`` with ``order``: offset and term, the rarest in the index first; windows with an unknown term go."""
    offsets = sought.select("window", F.posexplode("terms").alias("off", "term"))
    known = index.filter("term IS NOT NULL").select("term", "n").join(offsets.select("term").distinct(), "term")
    counts = known.groupBy("term").agg(F.sum("n").alias("total"))
    ranked = offsets.join(counts, "term", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "off", "term"))).alias("order"))
    return sought.join(ranked.filter(F.element_at("order", 1)["total"] > 0), "window").select("window", "items", F.transform("order", lambda x: F.struct(x["off"].alias("off"), x["term"].alias("term"))).alias("order"))


def _meet(starts: np.ndarray, found: np.ndarray, slack: int) -> np.ndarray:
    """Mask: a place within ``slack`` of the start."""
    if not len(found):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(found, starts - slack)
    return (at < len(found)) & (found[np.minimum(at, len(found) - 1)] <= starts + slack)


def candidates(index: DataFrame, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """``block, window, starts``: where the two rarest terms of a window stand as they should."""
    seeds = materialize(ranked.select("window", F.size("order").alias("terms"), F.posexplode(F.slice("order", 1, 2)).alias("rank", "t")).select("window", "terms", "rank", "t.off", "t.term"))
    rows = index.filter("term IS NOT NULL").join(seeds, "term").select("block", "window", "terms", "rank", "off", "postings")

    def task(table: pa.Table) -> pa.Table:
        out, halves = [], {}
        for row in table.to_pylist():
            halves.setdefault(row["window"], [None, None])[row["rank"]] = row
        for window, (first, second) in halves.items():
            if first is None or (second is None and first["terms"] > 1):
                continue
            starts = places(first["postings"]) - first["off"]
            if second is not None:
                starts = starts[_meet(starts, places(second["postings"]) - second["off"], slack)]
            if len(starts):
                out.append((window, starts.astype("<i8").tobytes()))
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(out), pa.int64()), "window": pa.array([w for w, _ in out], pa.string()), "starts": pa.array([s for _, s in out], pa.binary())})

    return rows.groupBy("block").applyInArrow(task, "block bigint, window string, starts binary")


def matches(index: DataFrame, sought: DataFrame, slack: int = 0) -> DataFrame:
    """``block, ord, n_hit, items, spans`` of documents with matches: ``ord`` counts in the block from 0.

    ``n_hit``: words inside any match; ``spans``: first word and words of each match, distinct. With
    ``slack`` each term may stand so many words from its place in the window, in the same document.
    """
    ranked = materialize(ranked_windows(index, sought))
    found = materialize(candidates(index, ranked, slack))
    asked = found.join(ranked, "window").select("block", "window", "starts", "order", "items")
    sought_terms = materialize(ranked.select(F.explode("order.term").alias("term")).distinct())
    lists = index.filter("term IS NOT NULL").join(sought_terms, "term").select("block", "term", "postings", F.lit(None).cast("array<bigint>").alias("counts"))
    docs = index.filter("term IS NULL").select("block", "term", "postings", "counts")
    rows = lists.union(docs).join(found.select("block").distinct(), "block", "left_semi")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        postings, counts = {}, []
        for row in right.to_pylist():
            if row["term"] is None:
                counts = row["counts"]
            else:
                postings[row["term"]] = row["postings"]
        first = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])  # with the gaps
        hit = np.zeros(int(first[-1]) + 1, np.int64)
        items: dict[int, set] = {}
        spans: dict[int, set] = {}
        for row in left.to_pylist() if len(first) > 1 else []:
            starts = np.frombuffer(row["starts"], "<i8")
            order, size = row["order"], len(row["order"])
            lead = np.clip(starts + order[0]["off"], 0, len(hit) - 2)
            doc = np.searchsorted(first, lead, side="right") - 1
            good = np.ones(len(starts), bool)
            for t in order[1 if slack else 2:]:  # with slack, the second may have met in another document
                if not good.any():
                    break
                found = postings.get(t["term"])
                if isinstance(found, bytes):  # opened where it is asked for
                    found = postings[t["term"]] = places(found)
                if found is None or not len(found):
                    good[:] = False
                    break
                at = np.searchsorted(found, np.maximum(starts + t["off"] - slack, first[doc]))  # in the lead's document only
                good &= (at < len(found)) & (found[np.minimum(at, len(found) - 1)] <= np.minimum(starts + t["off"] + slack, first[doc + 1] - 2))
            low = np.maximum(starts - slack, first[doc])
            high = np.minimum(starts + size + slack, first[doc + 1] - 1)
            if not slack:
                good &= (starts >= first[doc]) & (starts + size <= first[doc + 1] - 1)
            np.add.at(hit, low[good], 1)
            np.add.at(hit, high[good], -1)
            for d, a, b in zip(doc[good].tolist(), (low - first[doc])[good].tolist(), (high - low)[good].tolist()):
                items.setdefault(d, set()).update(row["items"])
                spans.setdefault(d, set()).add((a, b))
        inside = np.cumsum(hit[:-1]) > 0
        words = per_document(inside, first) if len(first) > 1 else []
        at = sorted(items)
        block = left["block"][0].as_py() if left.num_rows else right["block"][0].as_py()
        span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
        return pa.table({"block": pa.array([block] * len(at), pa.int64()), "ord": pa.array(at, pa.int64()), "n_hit": pa.array([int(words[d]) for d in at], pa.int64()), "items": pa.array([sorted(items[d]) for d in at], pa.list_(pa.string())),
                         "spans": pa.array([[{"first": a, "words": b} for a, b in sorted(spans[d])] for d in at], span)})

    cogrouped = asked.groupBy("block").cogroup(rows.groupBy("block"))
    return cogrouped.applyInArrow(task, "block bigint, ord bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,words:bigint>>")


def _documents(index: DataFrame) -> DataFrame:
    """``block, ord, _id, _hash, n_words`` of every indexed row."""
    cells = F.arrays_zip("doc_ids", "hashes", "counts")
    return index.filter("term IS NULL").select("block", F.posexplode(cells).alias("ord", "d")).select("block", F.col("ord").cast("bigint").alias("ord"), F.col("d.doc_ids").alias("_id"), F.col("d.hashes").alias("_hash"), F.col("d.counts").alias("n_words"))


def _is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def _joined(docs: DataFrame, bench: DataFrame, id: str, text: str, item: str, item_text: str, size: int) -> DataFrame:
    index = materialize(build_index(docs, id, text))
    sought = materialize(windows(bench, item, item_text, size))
    return _documents(index).join(matches(index, sought), ["block", "ord"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))


def contamination(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """``id, n_words, n_hit, items, spans, contaminated`` of every row."""
    rows = _joined(docs, bench, id, text, item, item_text, size)
    return rows.select(F.col("_id").alias(id), "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def keep_clean(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    rows = _joined(docs, bench, id, text, item, item_text, size)
    bad = materialize(rows.filter(_is_contaminated(F.col("n_hit"), F.col("n_words"))).select("_id", "_hash").distinct())
    boxed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col(id).alias("_own"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_xx"))
    return boxed.join(bad, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_xx") == F.col("_hash")), "left_anti").select("_row.*")
