"""Windows of a chunked sequence table, and indels moved to their leftmost place by them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.genotype import left_shift
from strandline.session import checkpoint, written

CHUNK = 65536


def with_halo(reference: DataFrame, keys: Sequence[str], chunk_size: int = CHUNK, reach: int = 512) -> DataFrame:
    """Chunks (keys, chunk, bases) with up to ``reach`` bases of their neighbours: ``halo``, and ``lead`` of them before
    the chunk's own. Only edges move to a neighbour; ``reach`` is at most a chunk."""
    keys = list(keys)
    if not 0 < reach <= chunk_size:
        raise ValueError("a halo is at least one base and at most a chunk")
    after = reference.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.right("bases", F.lit(reach)).alias("__before"))
    before = reference.select(*keys, (F.col("chunk") - 1).alias("chunk"), F.left("bases", F.lit(reach)).alias("__after"))
    j = reference.join(after, [*keys, "chunk"], "left").join(before, [*keys, "chunk"], "left")
    lead = F.coalesce(F.length("__before"), F.lit(0))
    return j.select(*keys, "chunk", F.concat(F.coalesce("__before", F.lit("")), "bases", F.coalesce("__after", F.lit(""))).alias("halo"), lead.alias("lead"))


def reference_windows(
    spans: DataFrame, reference: DataFrame, keys: Sequence[str], span: tuple[str, str] = ("start", "end"), chunk_size: int = CHUNK,
    reach: int = 512, out: str = "bases",
) -> DataFrame:
    """The sequence under each closed 1-based span, in column ``out``; ``start`` and ``end`` are moved inside the contig.

    A window of up to ``reach`` bases lies in the halo of the chunk where it begins, so it meets one row. Longer ones are
    put together from the chunks they touch. The spans are written once below the checkpoint folder. Spans outside the contig, before its first base or without a sequence have
    an empty or null window.
    """
    keys, (s, e) = list(keys), span
    x = spans.withColumn("__s", F.greatest(F.lit(1).cast("long"), F.col(s).cast("long"))).withColumn("__e", F.col(e).cast("long"))
    x = written(x.withColumn("chunk", F.floor((F.col("__s") - 1) / chunk_size)), "spans")  # read for short and for long ones
    short = F.col("__e") - F.col("__s") < reach
    near = x.where(short).join(with_halo(reference, keys, chunk_size, reach), [*keys, "chunk"], "left")
    at = (F.col("lead") + F.col("__s") - F.col("chunk") * chunk_size).cast("int")
    length = F.greatest(F.lit(0), F.col("__e") - F.col("__s") + 1).cast("int")
    near = near.withColumn(out, F.substring("halo", at, length)).drop("halo", "lead")

    far = x.where(~short)
    key = [*keys, "__s", "__e"]
    cut = far.select(*key, F.explode(F.sequence("chunk", F.floor((F.col("__e") - 1) / chunk_size))).alias("chunk")).distinct()
    low = F.greatest("__s", F.col("chunk") * chunk_size + 1)
    high = F.least("__e", (F.col("chunk") + 1) * chunk_size)
    piece = F.substring("bases", (low - F.col("chunk") * chunk_size).cast("int"), (high - low + 1).cast("int"))
    pieces = cut.join(reference.select(*keys, "chunk", "bases"), [*keys, "chunk"]).select(*key, "chunk", piece.alias("p"))
    whole = pieces.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "p"))), lambda p: p["p"]), "").alias(out))
    far = far.join(whole, key, "left")
    done = near.unionByName(far)
    inside = F.col(out).isNotNull() & (F.length(out) > 0)
    start = F.when(inside, F.col("__s")).otherwise(F.col(s))
    end = F.when(inside, F.col("__s") + F.length(out) - 1).otherwise(F.col(e))
    return done.withColumn(s, start.cast("long")).withColumn(e, end.cast("long")).drop("__s", "__e", "chunk")


def left_normalise(
    sites: DataFrame, reference: DataFrame, keys: Sequence[str], chunk_size: int = CHUNK, reach: int = 64,
) -> DataFrame:
    """``sites`` (keys, pos, ref, alt, any more) with trimmed alleles at their leftmost place.

    Each site slides inside the ``reach`` bases before it. Sites whose repeat goes on past these take more from where
    they have come to, twice as far each time, until none is left; a long repeat costs its own site further rounds and
    stops no other.
    """
    keys, more = list(keys), [c for c in sites.columns if c not in (*keys, "pos", "ref", "alt")]
    todo, done = sites, []
    while True:
        w = todo.withColumn("__a", F.col("pos") - reach).withColumn("__z", F.col("pos") - 1)
        first = F.col("pos") <= 1
        w = reference_windows(w.where(~first), reference, keys, ("__a", "__z"), chunk_size, min(reach, chunk_size), "__up").unionByName(
            w.where(first).withColumn("__a", F.col("__a").cast("long")).withColumn("__z", F.col("__z").cast("long")).withColumn("__up", F.lit(""))
        )
        moved = w.withColumn("__s", left_shift(F.col("pos"), F.col("ref"), F.col("alt"), F.coalesce("__up", F.lit("")), strict=False))
        # Where the sequence has no base before the site, there is nowhere to go.
        moved = checkpoint(moved.select(*keys, "__s.*", *more, (F.col("__s.open") & (F.length(F.coalesce("__up", F.lit(""))) > 0)).alias("__more")).drop("open"))
        done.append(moved.where(~F.col("__more")).drop("__more"))
        todo = moved.where("__more").drop("__more")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done).select(*sites.columns)
        reach *= 2
