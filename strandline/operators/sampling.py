"""Deterministic caps and samples. Every choice is a hash of the row key and a seed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scan import BLOCK, Run, prefix_scan


def hash_order(cols: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def cap_per_start(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    n: int = 50,
    row_key: Sequence[str] = ("qname", "flag"),
    seed: int = 47,
    order_by: Sequence[Column] | None = None,
    sorted_by: Sequence[str] | None = None,
) -> DataFrame:
    """At most ``n`` rows per start. Spark's group limit trims each start before the shuffle, so one
    start holding most of the table sends ``n`` rows per task. ``n=0`` switches the cap off. With ``sorted_by``,
    rows that do not come in that order are an error."""
    if sorted_by:
        df = require_sorted(df, sorted_by)
    if n <= 0:
        return df
    order = list(order_by) if order_by else [hash_order(row_key, seed), *[F.col(c) for c in row_key]]
    w = Window.partitionBy(*keys, pos).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group in ``order`` (group limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn(rank or "__rk", F.row_number().over(w)).where(F.col(rank or "__rk") <= k)
    return x if rank else x.drop("__rk")


def numbered(df: DataFrame, order: str, keys: Sequence[str] = (), out: str = "rank", block: int = BLOCK) -> DataFrame:
    """Global 0-based row number by an integer column that is unique within ``keys``, without a global sort.

    Counts per position block, then a running count: no task sees more than one block.
    """
    keys = list(keys) or ["__one"]
    src = df if keys != ["__one"] else df.withColumn("__one", F.lit(1))
    pos = src.withColumn("__n", F.lit(1).cast("long"))
    run = prefix_scan(pos, keys, order, {out: Run("sum", "__n", inclusive=False)}, block)
    return run.drop("__n", "__one")


def systematic_sample(df: DataFrame, order: str, size: int, block: int = BLOCK) -> DataFrame:
    """Every ``total div size``-th row in ``order``, up to ``size`` rows; all rows when size >= total."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    x = numbered(df, order, out="__i", block=block).crossJoin(F.broadcast(total))
    step = F.greatest(F.lit(1), F.floor(F.col("__total") / F.lit(size)))
    keep = (F.col("__i") % step == 0) & (F.floor(F.col("__i") / step) < size)
    return x.where(keep).drop("__i", "__total")


def first_by_hash(
    df: DataFrame, keys: Sequence[str], keep: str, row_key: Sequence[str], seed: int = 47
) -> DataFrame:
    """The ``keep`` rows of each group that come first in hash order, with ``keep`` a column.

    A literal cap gets Spark's group limit; a per-group one does not. So count rows per hash bucket,
    find with a running count the one bucket the cut falls into, and rank only that bucket's rows.
    """
    keys = list(keys)
    hashed = df.withColumn("__h", hash_order(row_key, seed)).withColumn(
        "__hb", F.shiftright(F.col("__h"), 48)
    )
    counts = hashed.groupBy(*keys, "__hb").agg(F.count(F.lit(1)).alias("__c"))
    upto = prefix_scan(counts, keys, "__hb", {"__upto": Run("sum", "__c")})
    j = hashed.join(upto, [*keys, "__hb"])
    before = F.col("__upto") - F.col("__c")
    sure = j.where(F.col("__upto") <= F.col(keep))
    edge = j.where((F.col("__upto") > F.col(keep)) & (before < F.col(keep)))
    w = Window.partitionBy(*keys, "__hb").orderBy("__h", *row_key)
    edge = edge.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") + before <= F.col(keep)).drop("__rn")
    return sure.unionByName(edge).select(*df.columns)


def biased_targets(counts: Column, remove: Column) -> Column:
    """Allele counts after removing ``remove`` rows: all from one allele, or half each from two.

    The vector with the lowest ``min(max - next + rest, next + rest)`` wins; the earlier one on a tie and
    the unchanged counts when nothing is lower. Counts are one entry per allele, so the pair list is tiny.
    """

    def score(v: Column) -> Column:
        srt = F.array_sort(v)
        n = F.size(v)
        big, nxt = F.element_at(srt, -1), F.try_element_at(srt, F.lit(-2))
        rest = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x) - big - nxt
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(F.least(big - nxt + rest, nxt + rest))

    half = F.floor(remove / 2)
    idx = F.sequence(F.lit(0), F.size(counts) - 1)
    pairs = F.flatten(
        F.transform(idx, lambda i: F.transform(F.sequence(i, F.size(counts) - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )

    def apply(p: Column) -> Column:
        i, j = p["i"], p["j"]
        return F.transform(
            counts,
            lambda c, k: F.greatest(
                F.lit(0).cast("long"),
                c - F.when((i == j) & (k == i), remove).when((i != j) & ((k == i) | (k == j)), half).otherwise(0),
            ),
        )

    start = F.struct(score(counts).alias("s"), counts.alias("v"))
    best = F.aggregate(
        F.transform(pairs, lambda p: apply(p)),
        start,
        lambda acc, v: F.when(score(v) < acc["s"], F.struct(score(v).alias("s"), v.alias("v"))).otherwise(acc),
    )
    return best["v"]


def allele_biased_cap(
    df: DataFrame,
    keys: Sequence[str],
    allele: str,
    fraction: float,
    row_key: Sequence[str],
    seed: int = 47,
    exempt: Column | None = None,
) -> DataFrame:
    """Remove ``floor(total * fraction)`` rows per locus, biased as in ``biased_targets``.

    Counts are aggregated first; only (locus, allele) groups that lose rows are ranked, in hash order.
    ``exempt`` rows (unknown alleles) are neither counted nor removed.
    """
    if fraction <= 0:
        return df
    keys = list(keys)
    free = df.where(exempt) if exempt is not None else None
    body = df.where(~exempt) if exempt is not None else df
    per = body.groupBy(*keys, allele).agg(F.count(F.lit(1)).alias("__n"))
    site = per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(allele).alias("a"), F.col("__n").alias("n")))).alias("__an")
    )
    counts = F.transform("__an", lambda x: x["n"])
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    plan = site.select(
        *keys, F.col("__an"), biased_targets(counts, F.floor(total * F.lit(fraction)).cast("long")).alias("__t")
    ).select(*keys, F.explode(F.arrays_zip("__an", "__t")).alias("z")).select(
        *keys, F.col("z.__an.a").alias(allele), F.col("z.__an.n").alias("__have"), F.col("z.__t").alias("__keep")
    )
    marked = body.join(plan, [*keys, allele])
    cut = marked.where(F.col("__have") > F.col("__keep"))
    kept = first_by_hash(cut, [*keys, allele], "__keep", row_key, seed)
    out = marked.where(F.col("__have") <= F.col("__keep")).unionByName(kept).select(*df.columns)
    return out if free is None else out.unionByName(free)


def genotype_count(alleles: Column | str, ploidy: int = 2) -> Column:
    """C(n + p - 1, p) as a product, exact in BIGINT for the sizes a site can have."""
    n = F.col(alleles) if isinstance(alleles, str) else alleles
    c = F.lit(1).cast("long")
    for i in range(1, ploidy + 1):
        c = F.floor(c * (n + (i - 1)) / i).cast("long")
    return c


def max_alleles(ploidy: int = 2, limit: int = 1024) -> int:
    """Largest allele count whose genotype count stays within ``limit`` (driver arithmetic)."""
    from math import comb

    n = 1
    while comb(n + ploidy, ploidy) <= limit:
        n += 1
    return n


def ranked_alleles(
    scores: DataFrame, keys: Sequence[str], allele: str = "allele", score: str = "score", is_reference: Column | None = None,
    keep: int | None = None, ploidy: int = 2, max_genotypes: int = 1024,
) -> DataFrame:
    """Alleles (keys, allele, best, second, rank) in order of their best and second-best score, the reference first, the
    smaller allele on a tie; the first ``keep`` of them, by default as many as ``max_genotypes`` genotypes allow.

    ``scores`` has a row for each score of an allele. Two rows an allele pass the group limit before the shuffle.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, allele).orderBy(F.col(score).desc())
    two = scores.withColumn("__ref", F.lit(False) if is_reference is None else is_reference).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 2)
    per = two.groupBy(*keys, allele).agg(
        F.max(F.when(F.col("__n") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("__n") == 2, F.col(score))).alias("second"), F.max("__ref").alias("__ref")
    )
    order = [F.col("__ref").desc(), F.col("best").desc(), F.col("second").desc_nulls_last(), F.col(allele)]
    return top_k(per, keys, order, max_alleles(ploidy, max_genotypes) if keep is None else keep, "rank").drop("__ref")


def require_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same rows, or an error if they do not come in ascending ``order`` (numbers) over all partitions.

    Each partition is read once and tells its first key, its last, and whether it is in order; then neighbouring
    partitions are compared by these. Nothing is sorted or moved but one row a partition. Nulls come first.
    """
    names = list(order)
    kind = ", ".join(f"f{i} double, l{i} double" for i in range(len(names)))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        sound = True
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.nan_to_num(c.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-np.inf) for c in batch.columns]
            rows = np.stack(columns, axis=1) if last is None else np.concatenate([[last], np.stack(columns, axis=1)])
            step = np.diff(rows, axis=0)
            # The first column that changes must rise.
            changes = step != 0
            at = changes.argmax(axis=1)
            sound &= bool((~changes.any(axis=1) | (step[np.arange(len(step)), at] > 0)).all()) if len(step) else True
            first = rows[0] if first is None else first
            last = rows[-1]
        if first is not None:
            values = {f"{side}{i}": pa.array([float(v[i])]) for i in range(len(names)) for side, v in (("f", first), ("l", last))}
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sound": pa.array([sound]), **values})

    told = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(ends, f"part int, sound boolean, {kind}")
    # A row for each partition that holds rows.
    w = Window.orderBy("part")
    key = lambda side: F.struct(*[F.col(f"{side}{i}") for i in range(len(names))])
    wrong = told.withColumn("__ok", F.col("sound") & F.coalesce(F.lag(key("l")).over(w) <= key("f"), F.lit(True))).where(~F.col("__ok"))
    if not wrong.isEmpty():
        raise ValueError(f"rows are not in the order of {', '.join(names)}")
    return df
