"""Fill-in-middle transformation: texts cut at two token ranks found in an indexable skip list.

A token is a word with the white space before it; white space at the end of the text is one more.
The tokens of a text form the lowest lane of a skip list; every ``FANOUT``-th link of a lane rises to
the lane above, and every link carries how many tokens and how many code points it skips. A cut rank
is reached from the top lane down, adding widths while they don't pass it, so a text of n tokens takes
O(log n) steps a cut and gives the code point where the token begins.

The two ranks, whether a text is cut and in which order its parts are written come from the SHA-256
of the seed and the id, so a rerun or another partitioning gives the same rows.

Defined cases: null texts are empty; empty texts and texts that hold a marker stay plain, with null
widths; a null id hashes as the empty string; rows with equal ids are cut by the same draws; repeated
rows come back as often as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm.words import by_bytes, flat, split_words

FANOUT = 16
MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle


class SkipList:
    """Lanes of links over tokens; a link has a width in tokens and one in code points."""

    def __init__(self, chars: np.ndarray):
        units = np.ones(len(chars), np.int64)
        self.lanes = [(units, chars)]
        while len(units) > FANOUT:
            at = np.arange(0, len(units), FANOUT)
            units, chars = np.add.reduceat(units, at), np.add.reduceat(chars, at)
            self.lanes.append((units, chars))

    def seek(self, rank: int) -> int:
        """Code points before the token of this rank (the number of tokens: all of them)."""
        node = units = chars = 0
        for unit_width, char_width in reversed(self.lanes):
            node *= FANOUT
            while node < len(unit_width) and units + unit_width[node] <= rank:
                units += int(unit_width[node])
                chars += int(char_width[node])
                node += 1
        return chars


def _token_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all tokens in code points of the batch, first token of each text, and where each text begins."""
    data, offsets = flat(texts)
    words = split_words(texts)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    last = np.concatenate([[0], words.ends])[words.first[1:]]  # byte after the last word before the text's end
    tail = offsets[1:] > np.maximum(last, offsets[:-1])  # white space is left
    ends = np.insert(words.ends, words.first[1:][tail], offsets[1:][tail])
    return points[ends], words.first + np.concatenate([[0], np.cumsum(tail)]), points[offsets]


def draws(digest: str) -> list[int]:
    return [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 42, cut_percent: int = 50, suffix_first_percent: int = 80,
                   markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``form`` is ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first);
    each part stands behind its marker, and ``restore`` gives the text back.
    """
    kind = docs.schema[id].dataType.simpleString()
    head, foot, mid = markers
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    schema = f"_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def transform(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, first, begins = _token_ends(batch.column(1))
        counts = np.diff(first)
        forms, prefixes, middles, outputs = [], [], [], []
        for d, (value, drawn) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            value, (h1, h2, h3, h4), n = value or "", draws(drawn), int(counts[d])
            if not value or h3 % 100 >= cut_percent or any(m in value for m in markers):
                forms.append("plain"), prefixes.append(None), middles.append(None), outputs.append(value)
                continue
            lanes = SkipList(np.diff(ends[first[d]: first[d + 1]], prepend=begins[d]))
            a, b = sorted(lanes.seek(h % (n + 1)) for h in (h1, h2))
            prefix, middle, suffix = head + value[:a], mid + value[a:b], foot + value[b:]
            spm = h4 % 100 < suffix_first_percent
            forms.append("spm" if spm else "psm"), prefixes.append(a), middles.append(b - a)
            outputs.append(suffix + prefix + middle if spm else prefix + suffix + middle)
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
            pa.array(outputs, pa.string())], ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def task(batches):
        for batch in batches:
            for rows in by_bytes(batch, 1):
                yield transform(rows)

    out = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), digest.alias("_digest")).mapInArrow(task, schema)
    return out.select(F.col("_id").alias(id), "n", "form", "prefix_chars", "middle_chars", "output")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text that ``fill_in_middle`` cut: no part holds a marker, so the markers alone tell the parts."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers))
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
