"""Collection schedule: due sources, polite spacing per host, request throttling, run records."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from policylake.operators.merge import merge_snapshot
from policylake.operators.ordering import newest
from policylake.operators.scan import BLOCK, carried, in_blocks, with_carried, within
from policylake.session import materialize

# Minutes per named frequency; anything else counts as weekly.
FREQUENCY_MINUTES = {"daily": 1440, "weekly": 7 * 1440, "monthly": 30 * 1440}


def interval_minutes(interval: Column, frequency: Column) -> Column:
    out = F.when(F.coalesce(interval, F.lit(0)) != 0, interval)
    for name, minutes in FREQUENCY_MINUTES.items():
        out = out.when(frequency == name, minutes)
    return out.otherwise(FREQUENCY_MINUTES["weekly"])


def next_fetch_at(now: Column, interval: Column, frequency: Column) -> Column:
    minutes = interval_minutes(interval, frequency)
    return now + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def due_sources(sources: DataFrame, as_of: str | Column, n: int | None = None) -> DataFrame:
    """Enabled, scheduled, not manual sources with a listing URL whose time has come, oldest first."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    c = F.col
    due = sources.filter(
        c("enabled") & (c("access_method") == "scheduled") & (c("frequency") != "manual") & c("listing_url").isNotNull()
        & (c("next_fetch_at").isNull() | (c("next_fetch_at") <= now)))
    return newest(due, [F.coalesce("next_fetch_at", "created_at").asc_nulls_first(), c("id").asc()], n)


def record_runs(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Last-run columns from ``source_id, ok, error, at``.

    The latest outcome per source sets next fetch, status and error; the latest success sets the
    fetch time, also when failures follow it. One partial aggregate gives both.
    """
    last = outcomes.groupBy(F.col("source_id").alias("id")).agg(F.max_by(F.struct("ok", "error", "at"), F.struct("at", "ok", "error")).alias("_r"), F.max(F.when(F.col("ok"), F.col("at"))).alias("_ok_at"))
    side = sources.select("id", "interval_minutes", "frequency", F.col("last_fetched_at").alias("_last")).join(last, "id")
    at, ok = F.col("_r.at"), F.col("_r.ok")
    changes = side.select(
        "id", F.coalesce("_ok_at", "_last").alias("last_fetched_at"), next_fetch_at(at, F.col("interval_minutes"), F.col("frequency")).alias("next_fetch_at"),
        F.when(ok, "success").otherwise("failed").alias("last_run_status"), F.when(~ok, F.col("_r.error")).alias("last_error"), at.alias("updated_at"))
    return merge_snapshot(sources, changes, "id", insert=False).select(*sources.columns)


def polite_schedule(requests: DataFrame, key: str, ts: str, tie: str, gap_seconds: int, blocks: int | None = None, out: str = "start_us") -> DataFrame:
    """Adds ``start_us``: max(request time, previous start of the key + gap), in epoch microseconds.

    Closed form: the start of request i is ``i*gap + max over j<=i of (t_j - j*gap)``. Counts and
    running maxima combine, so it is a prefix scan over blocks of equal size: a host with all
    requests of a day is spread over all blocks. Requests without a time start at no time (null).
    """
    gap = gap_seconds * 1_000_000
    ranged = in_blocks(requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))), [key], ["_t", tie], blocks)
    inside = within([key], ["_t", tie])
    local = ranged.withColumn("_rn", F.count("_t").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_max", F.max(F.col("_t") - F.col("_rn") * gap).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    hand = carried(
        local, [key], [F.count("_t").alias("_n"), F.max("_max").alias("_peak")],
        lambda earlier: {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))},
        lambda earlier: {"_carried": F.max(F.col("_peak") - F.col("_before") * gap).over(earlier)})
    joined = with_carried(local, hand, [key])
    best = F.greatest(F.col("_max") - F.col("_before") * gap, F.col("_carried"))
    start = F.when(F.col("_t").isNotNull(), (F.col("_rn") + F.col("_before")) * gap + best)
    return joined.withColumn(out, start).drop("_t", BLOCK, "_rn", "_max", "_before", "_carried")


NEVER = -(2**62)  # no window is open


def _jump(times: np.ndarray, window: int) -> np.ndarray:
    """For each event as a window start: the reset time left behind when the block ends."""
    exits = times + window
    following = np.searchsorted(times, exits, side="left")
    n = len(times)
    target = np.append(following, n)
    exits = np.append(exits, 0)
    while True:  # pointer doubling: log2(windows per block) vectorised rounds
        inner = target[:n] < n
        if not inner.any():
            return exits[:n]
        at = np.flatnonzero(inner)
        hop = target[at]
        exits[at], target[at] = exits[hop], target[hop]


def _step_table(times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A block of one key as a step function: a reset time in (previous entry, entry] on entry leaves exit.

    What is open on entry ends within a window of the first event, so later entries don't matter; a
    reset time behind all entries goes through unchanged.
    """
    times = np.unique(times)
    exits = _jump(times, window)
    near = int(np.searchsorted(times, times[0] + window, side="left")) + 1
    times, exits = times[:near], exits[:near]
    last = np.append(exits[1:] != exits[:-1], True)
    return times[last], exits[last]


def _apply(entry: np.ndarray, exits: np.ndarray, reset: np.ndarray) -> np.ndarray:
    at = np.searchsorted(entry, reset, side="left")
    return np.where(at < len(entry), np.append(exits, 0)[at], reset)


def _compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two blocks in a row: no more steps than both have."""
    entry = np.unique(np.concatenate([first[0], second[0][second[0] > first[0][-1]]]))
    exits = _apply(*second, _apply(*first, entry))
    last = np.append(exits[1:] != exits[:-1], True)
    return entry[last], exits[last]


def _windows(times: np.ndarray, reset: int, window: int) -> np.ndarray:
    """Start of the window of each (sorted) event, given the open reset time on entry."""
    starts = np.empty(len(times), dtype=np.int64)
    at = int(np.searchsorted(times, reset, side="left"))
    starts[:at] = reset - window  # empty when no window is open
    while at < len(times):
        end = int(np.searchsorted(times, times[at] + window, side="left"))
        starts[at:end] = times[at]
        at = end
    return starts


FAN = 32  # step tables that one call composes


def _runs(table: pa.Table, key: str, *order: str) -> tuple[pa.Table, np.ndarray]:
    """A block's rows in order, nulls first as in the block's cuts, and where each key begins."""
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (key, *order)], null_placement="at_start"))
    codes = np.asarray(table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices)
    return table, np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))


def _ordered_tables(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = sorted(zip(table["_place"].to_pylist(), table["_entry"].to_pylist(), table["_exit"].to_pylist()))
    return [(np.array(a, np.int64), np.array(b, np.int64)) for _, a, b in rows]


def _resets(ranged: DataFrame, key: str, window: int) -> DataFrame:
    """``key, _block, _reset``: the reset time on entry to a block, of the keys at its edges.

    Only the first and the last key of a block reach into others. Their step tables are composed in
    a tree, ``FAN`` at a time, and the reset times go down the same tree.
    """
    keyed = f"{key} {ranged.schema[key].dataType.simpleString()}"
    level_schema = f"{keyed}, _place int, _entry array<bigint>, _exit array<bigint>"

    def row(table: pa.Table, places: list, tables: list) -> pa.Table:
        return pa.table({key: table[key], "_place": pa.array(places, pa.int32()), "_entry": pa.array([a for a, _ in tables], pa.list_(pa.int64())), "_exit": pa.array([b for _, b in tables], pa.list_(pa.int64()))})

    def edges(block: pa.Table) -> pa.Table:
        block, begins = _runs(block, key, "_t")
        times, of = np.asarray(block["_t"]), sorted({0, len(begins) - 2})
        return row(block.take(pa.array(begins[:-1][of])), [block[BLOCK][0].as_py()] * len(of), [_step_table(times[begins[k]: begins[k + 1]], window) for k in of])

    def compose(group: pa.Table) -> pa.Table:
        return row(group.slice(0, 1), [group["_place"][0].as_py() // FAN], [reduce(_compose, _ordered_tables(group))])

    def down(group: pa.Table, given: pa.Table) -> pa.Table:
        """Reset time before each of a node's children."""
        reset, out = given["_reset"][0].as_py() if given.num_rows else NEVER, []
        for entry, exits in _ordered_tables(group):
            out.append(reset)
            reset = int(_apply(entry, exits, np.array([reset]))[0])
        return pa.table({key: group[key], "_place": pa.array(sorted(group["_place"].to_pylist()), pa.int32()), "_reset": pa.array(out, pa.int64())})

    parent = F.floor(F.col("_place") / FAN).cast("int")
    levels = [materialize(ranged.select(key, "_t", BLOCK).groupBy(BLOCK).applyInArrow(edges, level_schema))]
    width = 1 + (levels[0].agg(F.max("_place")).first()[0] or 0)
    while width > FAN:
        levels.append(materialize(levels[-1].groupBy(key, parent).applyInArrow(compose, level_schema)))
        width = -(-width // FAN)
    reset_schema = f"{keyed}, _place int, _reset bigint"
    resets = levels[-1].limit(0).select(key, "_place", F.lit(None).cast("bigint").alias("_reset"))
    for level in reversed(levels):
        resets = level.groupBy(key, parent).cogroup(resets.groupBy(key, "_place")).applyInArrow(down, reset_schema)
    return resets.withColumnRenamed("_place", BLOCK)


def throttle(events: DataFrame, key: str, ts: str, tie: str, limit: int, window_seconds: int, blocks: int | None = None) -> DataFrame:
    """Adds ``window_start_us``, ``request_no``, ``allowed`` and ``retry_after`` (seconds).

    A window opens at the first event after the previous one ran out; every event counts, also
    rejected ones, and those past ``limit`` are rejected. Events without a time are left out; null is
    a key like others.

    A prefix scan over blocks of equal size: what a block does to an open window is a step function
    from the reset time on entry to the one on exit, and these compose. Blocks then resolve their
    windows and number the events on their own; a window that reaches over several blocks gets the
    number of its events in earlier ones. So neither a key nor a window with all events is one task.
    """
    window = window_seconds * 1_000_000
    staged = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).filter("_t IS NOT NULL")
    ranged = in_blocks(staged, [key], ["_t", tie], blocks)
    resets = _resets(ranged, key, window)
    schema = StructType([*ranged.schema.fields, StructField("_start", LongType()), StructField("_no", LongType())])

    def resolve(block: pa.Table, given: pa.Table) -> pa.Table:
        block, begins = _runs(block, key, "_t", tie)
        times, keys = np.asarray(block["_t"]), block[key].take(pa.array(begins[:-1])).to_pylist()
        known = dict(zip(given[key].to_pylist(), given["_reset"].to_pylist()))
        starts = np.concatenate([_windows(times[a:b], known.get(k, NEVER), window) for k, a, b in zip(keys, begins[:-1], begins[1:])])
        opens = np.diff(starts, prepend=NEVER) != 0
        opens[begins[:-1]] = True
        first = np.maximum.accumulate(np.where(opens, np.arange(len(starts)), 0))
        return block.append_column("_start", pa.array(starts)).append_column("_no", pa.array(np.arange(len(starts)) - first + 1))

    resolved = materialize(ranged.groupBy(BLOCK).cogroup(resets.groupBy(BLOCK)).applyInArrow(resolve, schema))
    parts = resolved.groupBy(key, "_start", BLOCK).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(key, "_start")
    parts = parts.withColumns({"_all": F.count("*").over(over), "_before": F.sum("_n").over(over.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))})
    long = materialize(parts.filter("_all > 1 AND _before IS NOT NULL").select(key, "_start", BLOCK, "_before"))
    numbered = with_carried(resolved, long, [key, "_start"])
    counted = numbered.withColumn("request_no", (F.col("_no") + F.coalesce("_before", F.lit(0))).cast("int"))
    left = F.ceil((F.col("_start") + window - F.col("_t")) / 1_000_000)
    allowed = F.col("request_no") <= limit
    return counted.withColumns({
        "window_start_us": F.col("_start"), "allowed": allowed, "retry_after": F.when(~allowed, left),
    }).drop("_t", BLOCK, "_start", "_no", "_before")


def event_counts(events: DataFrame, ts: str, window: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Events per time window (and columns); works on batch and streaming frames alike."""
    grouped = events.groupBy(F.window(ts, window), *by).agg(F.count("*").alias("event_count"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "event_count")
