"""Mixing of sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output divided by its share of the input. Each document draws
a count from the Poisson distribution of that mean by inverting it at a number hashed from seed, id and text, so counts
do not depend on partitions, order or retries. Copies are exploded and dealt over the cluster by a hash of seed, id and
copy: a global shuffle that a source with a third of all rows does not skew, since its rows differ in id and copy.

The masses of the sources are grouped sums with a map-side combine; the number of sources, a parameter of the mix, bounds
what is broadcast. The inverse is a fold over the terms of the distribution, as many as its tail needs in doubles.

Nulls: a null source is one of its own (named by a null in ``weights``, or of weight ``other``); a null text has mass
0 and is drawn like any other; a null id is hashed as such. Rows that repeat id and text draw the same count. A source of
no mass, or weight 0, has no copies. An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAW_BITS = 52  # of the hash; exact in a double


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("double") / float(2**DRAW_BITS)


def poisson_inverse(u: Column, rate: Column, steps: Column) -> Column:
    """The least k whose distribution function exceeds ``u``: a fold over the terms."""
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), first.alias("sum"), F.lit(0).alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), steps), start,
        lambda s, i: F.struct(
            (s["term"] * rate / i).alias("term"), (s["sum"] + s["term"] * rate / i).alias("sum"),
            (s["k"] + F.when(u >= s["sum"], 1).otherwise(0)).alias("k"),
        ),
        lambda s: s["k"],
    )


def rates(df: DataFrame, source_col: str, mass: Column, weights: dict[str | None, float], other: float, size: float) -> DataFrame:
    """One row a source: its mass, weight and mean repetition rate. ``size`` is the output's mass as a multiple of the
    input's. Sources that are not named share the weight ``other`` by mass."""
    masses = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(mass).cast("double").alias("mass"))
    named = F.lit(False)
    weight = F.lit(None).cast("double")
    for name, value in weights.items():
        named = named | F.col("source").eqNullSafe(F.lit(name))
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    masses = masses.withColumn("named", named).withColumn("weight", weight)
    totals = masses.agg(F.sum("mass").alias("all"), F.sum(F.when(~F.col("named"), F.col("mass"))).alias("unnamed"))
    share = F.when(F.col("named"), F.col("weight")).otherwise(other * F.col("mass") / F.col("unnamed"))
    total_weight = float(sum(weights.values()) + other)
    rate = F.when(F.col("mass") > 0, share / total_weight * size * F.col("all") / F.col("mass")).otherwise(0.0)
    return masses.crossJoin(F.broadcast(totals)).select("source", "mass", rate.alias("rate"))


def mix(
    df: DataFrame, id_col: str, source_col: str, text_col: str, weights: dict[str | None, float], other: float, size: float = 1.0, seed: int = 7
) -> DataFrame:
    """Every document as often as it is drawn, with ``__copy`` (from 0), ``__rate`` and ``__order``, dealt and sorted by
    the last within partitions. Added names begin with two underscores."""
    size_of = F.coalesce(F.length(F.col(text_col)), F.lit(0))
    by_source = rates(df, source_col, size_of, weights, other, size).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    # As many rows as the mix has sources.
    rows = df.join(F.broadcast(by_source), F.col(source_col).eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.where(F.col("__rate") > 0)
    # Rates above 32 are drawn in equal parts of at most 32, each with its own hash, whose counts add up.
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / 32.0).cast("int"))
    part_rate = F.col("__rate") / parts
    steps = F.ceil(part_rate + 12 * F.sqrt(part_rate + 1) + 24).cast("int")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = rows.withColumn("__key", key)
    counts = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0), lambda n, p: n + poisson_inverse(draw(seed, F.col("__key"), p), part_rate, steps)
    )
    rows = rows.withColumn("__n", counts).where(F.col("__n") > 0)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    order = F.xxhash64(F.lit(seed), F.col("__key"), F.col("__copy"))
    return rows.withColumn("__order", order).drop("__n", "__key").repartition("__order").sortWithinPartitions("__order")
