"""Range joins over closed intervals.

Pairs come from a binned equi-join. Semi, anti, mark and count forms never build pairs: they follow
from running aggregates over the right side's starts and ends, looked up at the left side's bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scan import BLOCK, Run, prefix_scan

WIDTHS = (1 << 8, 1 << 13, 1 << 18, 1 << 23)
Span = tuple[str, str]


def _level(length: Column, widths: Sequence[int]) -> Column:
    lvl = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        lvl = F.when(length <= widths[i], F.lit(i)).otherwise(lvl)
    return lvl


def _binned(df: DataFrame, span: Span, widths: Sequence[int], own: bool, strict: bool) -> DataFrame:
    """One row per (level, bin) touched, at the row's own level or at every coarser one.

    An interval no longer than a level's width touches at most two of its bins; only rows longer than
    the top width touch more.
    """
    s, e = (F.col(c) for c in span)
    lvl = _level(e - s + 1, widths)
    top = F.lit(len(widths) - 1)
    if own:
        levels = F.array(lvl)
    else:
        first = lvl + 1 if strict else lvl
        levels = F.when(first <= top, F.sequence(first, top)).otherwise(F.array().cast("array<int>"))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in widths]), F.col("__lvl") + 1)
    return (
        df.withColumn("__lvl", F.explode(levels))
        .withColumn("__w", w)
        .withColumn("__bin", F.explode(F.sequence(F.floor(s / F.col("__w")), F.floor(e / F.col("__w")))))
    )


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: Span = ("a_start", "a_end"),
    b_span: Span = ("b_start", "b_end"),
    widths: Sequence[int] = WIDTHS,
) -> DataFrame:
    """Every overlapping pair once. Column names of the two sides must differ apart from ``keys``.

    Each row has a level: the smallest bin width that holds it. A pair meets at the coarser of its two
    levels, in the bin of the later start, so no ``distinct`` is needed and a few very long rows do not
    drag the short ones into wide bins. Hot bins are left to the adaptive skew join.
    """
    keys = list(keys)
    hit = (
        (F.col(a_span[0]) <= F.col(b_span[1]))
        & (F.col(b_span[0]) <= F.col(a_span[1]))
        & (F.col("__bin") == F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / F.col("__w")))
    )
    on = keys + ["__lvl", "__bin"]
    out = [*keys, *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys]]

    def side(x: DataFrame, span: Span, own: bool, strict: bool, keep_w: bool) -> DataFrame:
        y = _binned(x, span, widths, own, strict)
        return y if keep_w else y.drop("__w")

    first = side(a, a_span, True, False, True).join(side(b, b_span, False, False, False), on)
    if len(widths) == 1:
        return first.where(hit).select(*out)
    second = side(a, a_span, False, True, True).join(side(b, b_span, True, False, False), on)
    return first.where(hit).select(*out).unionByName(second.where(hit).select(*out))


def _lookup(
    queries: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    run: Run,
    out: str,
    block: int,
) -> DataFrame:
    """Running aggregate of ``facts`` (keys, pos, v) at each distinct query position (keys, pos)."""
    kind = {"sum": F.sum, "max": F.max, "min": F.min}[run.kind]
    known = facts.groupBy(*keys, "pos").agg(kind("v").cast("long").alias("v"))
    both = queries.select(*keys, "pos", F.lit(None).cast("long").alias("v")).unionByName(known)
    points = both.groupBy(*keys, "pos").agg(F.max("v").alias("v"))
    return prefix_scan(points, keys, "pos", {out: run}, block).select(*keys, "pos", out)


def overlap_mark(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: Span = ("start", "end"),
    b_span: Span = ("start", "end"),
    out: str = "overlaps",
    block: int = BLOCK,
) -> DataFrame:
    """``a`` plus a boolean: some row of ``b`` overlaps.

    True exactly when the furthest end among the ``b`` rows starting at or before ``a.end`` reaches
    ``a.start``. The lookup side has one row per (key, position), so a hot key in ``a`` only makes the
    probe side long, which the skew join splits.
    """
    keys = list(keys)
    q = a.select(*keys, F.col(a_span[1]).cast("long").alias("pos")).distinct()
    facts = b.select(*keys, F.col(b_span[0]).cast("long").alias("pos"), F.col(b_span[1]).alias("v"))
    reach = _lookup(q, facts, keys, Run("max", "v"), "__reach", block)
    probe = a.withColumn("__at", F.col(a_span[1]).cast("long"))
    j = probe.join(reach.withColumnRenamed("pos", "__at"), [*keys, "__at"], "left").drop("__at")
    return j.withColumn(out, F.coalesce(F.col("__reach") >= F.col(a_span[0]), F.lit(False))).drop("__reach")


def overlap_semi(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: Span = ("start", "end"),
                 b_span: Span = ("start", "end"), block: int = BLOCK) -> DataFrame:
    return overlap_mark(a, b, keys, a_span, b_span, "__hit", block).where("__hit").drop("__hit")


def overlap_anti(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: Span = ("start", "end"),
                 b_span: Span = ("start", "end"), block: int = BLOCK) -> DataFrame:
    return overlap_mark(a, b, keys, a_span, b_span, "__hit", block).where("not __hit").drop("__hit")


def overlap_count(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: Span = ("start", "end"),
    b_span: Span = ("start", "end"),
    out: str = "n_overlaps",
    block: int = BLOCK,
) -> DataFrame:
    """``a`` plus the number of overlapping ``b`` rows: starts up to ``a.end`` less ends before ``a.start``."""
    keys = list(keys)
    ones = F.lit(1).cast("long")
    q_end = a.select(*keys, F.col(a_span[1]).cast("long").alias("pos")).distinct()
    q_start = a.select(*keys, (F.col(a_span[0]).cast("long") - 1).alias("pos")).distinct()
    starts = b.select(*keys, F.col(b_span[0]).cast("long").alias("pos"), ones.alias("v"))
    ends = b.select(*keys, F.col(b_span[1]).cast("long").alias("pos"), ones.alias("v"))
    begun = _lookup(q_end, starts, keys, Run("sum", "v"), "__begun", block)
    done = _lookup(q_start, ends, keys, Run("sum", "v"), "__done", block)
    begun, done = (x.withColumnRenamed("pos", "__at") for x in (begun, done))
    probe = a.withColumn("__at", F.col(a_span[1]).cast("long")).join(begun, [*keys, "__at"], "left")
    probe = probe.withColumn("__at", F.col(a_span[0]).cast("long") - 1).join(done, [*keys, "__at"], "left")
    n = F.coalesce(F.col("__begun"), F.lit(0)) - F.coalesce(F.col("__done"), F.lit(0))
    return probe.withColumn(out, n).drop("__at", "__begun", "__done")


def covering_rows(
    points: DataFrame,
    blocks: DataFrame,
    keys: Sequence[str],
    sample: str = "sample",
    order: str = "input_ord",
    pos: str = "pos",
    span: Span = ("start", "end"),
    widths: Sequence[int] = WIDTHS,
) -> DataFrame:
    """At each point the first covering block of each sample in input order.

    ``min_by`` combines before the shuffle, so samples with stacked blocks cost no extra traffic.
    """
    keys = list(keys)
    p = points.select(*keys, F.col(pos).alias("__p0"), F.col(pos).alias("__p1"))
    payload = [c for c in blocks.columns if c not in (*keys, sample)]
    pairs = overlap_join(p, blocks, keys, ("__p0", "__p1"), span, widths)
    first = pairs.groupBy(*keys, F.col("__p0").alias("__pos"), sample).agg(
        F.min_by(F.struct(*payload), F.struct(order, span[0])).alias("__row")
    )
    return first.select(*keys, F.col("__pos").alias(pos), sample, *[F.col(f"__row.{c}").alias(c if c != pos else f"row_{c}") for c in payload])


def strict_dimension_join(
    facts: DataFrame, dim: DataFrame, key: str, value: str, required: bool = True
) -> DataFrame:
    """Left join that refuses a non-null key with no match (read group to sample)."""
    d = dim.select(F.col(key), F.col(value), F.lit(True).alias("__known"))
    j = facts.join(d, key, "left")
    if required:
        bad = F.col(key).isNotNull() & F.col("__known").isNull()
        j = j.where(~bad | F.raise_error(F.concat(F.lit(f"unknown {key} "), F.col(key))).cast("boolean"))
    return j.drop("__known")


def unknown_keys(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``facts`` that ``dim`` lacks."""
    return facts.where(F.col(key).isNotNull()).select(key).distinct().join(dim.select(key), key, "left_anti")


def mate_pairs(
    reads: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    pairable: Column | None = None,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Pair the 1st and 2nd, 3rd and 4th … rows of each name, in order; an odd last row stays alone.

    A window over the name, never a self-join. Names repeat a handful of times by construction; a name
    that does not is broken input rather than skew.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    src = reads if pairable is None else reads.where(pairable)
    row = F.struct(*payload)
    x = src.select(*group, row.alias("left"), F.row_number().over(w).alias("__rn"), F.lead(row).over(w).alias("right"))
    return x.where((F.col("__rn") % 2 == 1) & F.col("right").isNotNull()).drop("__rn")


def attach_reference_base(
    positions: DataFrame, reference: DataFrame, keys: Sequence[str], pos: str = "pos",
    chunk_size: int = 65536, out: str = "ref_base",
) -> DataFrame:
    """Base at a 1-based position from a chunked sequence table ``keys, chunk, bases``."""
    p = positions.withColumn("__chunk", F.floor((F.col(pos) - 1) / F.lit(chunk_size)))
    r = reference.select(*keys, F.col("chunk").alias("__chunk"), F.col("bases").alias("__bases"))
    j = p.join(r, [*keys, "__chunk"], "left")
    off = ((F.col(pos) - 1) % F.lit(chunk_size) + 1).cast("int")
    return j.withColumn(out, F.substring("__bases", off, F.lit(1))).drop("__chunk", "__bases")
