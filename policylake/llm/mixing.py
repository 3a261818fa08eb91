"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as an inverted Poisson distribution says, whose mean is its
source's target rate: its share of the target over its share of the input. The uniform number is
hashed from a seed and the document, so a rerun or a lost task repeats the same copies. A mean above
``LARGEST_MEAN`` is drawn as the sum of equal smaller ones, each with a hash of its own (a sum of
Poisson counts is one), so no table of steps grows with a rate. All copies are then dealt out and sorted by a hash: a global shuffle in one exchange.

Defined cases: a null source is a source of its own; sources without a weight have weight 0 and go;
empty texts weigh one byte; rows with equal id and text get equal counts; an empty table gives an
empty result; other columns travel along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.session import materialize


LARGEST_MEAN = 32  # of one draw


def row_hash(id: Column, text: Column, *salt) -> Column:
    """MD5 of a salt and the document, in hex."""
    return F.md5(F.concat_ws("|", *[s if isinstance(s, Column) else F.lit(str(s)) for s in salt], F.coalesce(id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def uniform(hashed: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hex digest."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... up to a tail that 52 bits can't hit."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30)
    zero = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("steps"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(mean) - F.ln(k.cast("double"))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"), F.concat(s["steps"], F.array(s["sum"] + F.exp(log))).alias("steps"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["steps"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: Mapping[str, float] | None = None, alpha: float = 0.5, repeat: float = 1.0) -> DataFrame:
    """``source, size, rate, draws, steps``: mean repetitions of each source, and the steps of one of its draws.

    The targets are ``weights``, or without them each source's bytes to the power ``alpha`` (1 keeps
    the shares, 0 makes all equal). ``repeat``: bytes of the mix over bytes of the input.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint").alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(float(alpha)))
    elif any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    else:
        cells = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*cells), F.col("_source")), F.lit(0.0)) if cells else F.lit(0.0)
    weighed = materialize(sizes.withColumn("_weight", weight))
    total = weighed.agg(F.sum("_size").alias("size"), F.sum("_weight").alias("weight")).first()
    scale = float(repeat) * (total["size"] or 0) / total["weight"] if total["weight"] else 0.0
    rate = F.col("_weight") * F.lit(scale) / F.col("_size")
    draws = F.greatest(F.lit(1), F.ceil(F.col("_rate") / LARGEST_MEAN))
    split = weighed.withColumn("_rate", rate).withColumn("_draws", draws)
    return materialize(split.select("_source", "_size", "_rate", "_draws", poisson_steps(F.col("_rate") / F.col("_draws")).alias("_steps")))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Mapping[str, float] | None = None,
        alpha: float = 0.5, repeat: float = 1.0, seed: int = 1, replica: str | None = "replica", order: str | None = "shuffle_key") -> DataFrame:
    """The columns of ``docs``, ``replica`` (from 0) and ``order`` (sorted within partitions), shuffled.

    The two take the place of columns of the same name; without a name they are left out.

    The rates are a written table of one row a source, so the planner sees its size: it broadcasts a
    small one and joins a large one by source, splitting hot sources.
    """
    rates = source_rates(docs, source, text, weights, alpha, repeat)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col(source).alias("_of"), row_hash(F.col(id), F.col(text), seed).alias("_hash"))
    drawn = rows.join(rates.select("_source", "_draws", "_steps"), F.col("_of").eqNullSafe(F.col("_source")))

    def passed(hashed: Column) -> Column:
        u = uniform(hashed)
        return F.size(F.filter("_steps", lambda c: c <= u))

    # Steps that u has passed; every draw after the first has its own hash
    others = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("_draws") - 1), F.lit(0), lambda n, k: n + passed(F.md5(F.concat_ws("|", F.col("_hash"), F.lit("draw"), k.cast("string")))))
    count = passed(F.col("_hash")) + F.when(F.col("_draws") > 1, others).otherwise(0)
    copies = drawn.select("_row", "_hash", count.alias("_count")).filter("_count > 0").select("_row", "_hash", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_replica"))
    dealt = copies.withColumn("_order", F.md5(F.concat_ws("|", "_hash", "_replica")))
    mixed = dealt.repartition("_order").sortWithinPartitions("_order")
    extra = {name: F.col(c) for c, name in (("_replica", replica), ("_order", order)) if name}
    return mixed.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in extra], *[c.alias(name) for name, c in extra.items()])
