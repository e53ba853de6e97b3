"""Ordered work over positions that never puts a whole key into one task.

A plain window over ``partitionBy(key).orderBy(pos)`` sorts one key in one task, so a key holding a
third of the table becomes the job. Everything here works on (key, position block) instead:

* ``stitched_runs`` finds runs inside each block and joins only the runs that touch a block edge, at
  most two per block. One window per block, one window over the few edge runs, no self-join.
* ``prefix_scan`` adds running aggregates that really reach back to the start of a key: a window per
  block, one total per block, a window over those totals, and a join that adds the carry back.

Callers reduce to one row per (key, position) first, with a map-side combine, so a block holds at most
``block`` rows however many input rows share it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
_BLK = "__block"
_EDGE = -1


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` of ``col`` over the rows up to (or from) the current one."""

    kind: str  # sum | max | min
    col: str
    inclusive: bool = True
    reverse: bool = False

    def agg(self, c: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](c)

    def combine(self, carry: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return (F.greatest if self.kind == "max" else F.least)(carry, local)


def block_of(pos: str | Column, block: int) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(block)).cast("long")


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    runs: Mapping[str, Run],
    block: int = BLOCK,
) -> DataFrame:
    """Add each running aggregate of ``runs`` to ``df``, which holds one row per (keys, pos).

    ``greatest``/``least`` skip nulls, so max and min ignore rows whose column is null.
    """
    keys = list(keys)
    by_block = keys + [_BLK]
    src = df.withColumn(_BLK, block_of(pos, block))

    def frame(parts: list[str], order: str, run: Run, inclusive: bool) -> Window:
        o = F.col(order).desc() if run.reverse else F.col(order).asc()
        return Window.partitionBy(*parts).orderBy(o).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )

    local = src.select(
        "*",
        *[
            r.agg(F.col(r.col)).over(frame(by_block, pos, r, r.inclusive)).alias(f"__l_{name}")
            for name, r in runs.items()
        ],
    )
    totals = src.groupBy(*by_block).agg(
        *[r.agg(F.col(r.col)).alias(f"__t_{name}") for name, r in runs.items()]
    )
    carry = totals.select(
        *by_block,
        *[
            r.agg(F.col(f"__t_{name}")).over(frame(keys, _BLK, r, False)).alias(f"__c_{name}")
            for name, r in runs.items()
        ],
    )
    joined = local.join(carry, by_block)
    return joined.select(
        *df.columns,
        *[
            r.combine(F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name)
            for name, r in runs.items()
        ],
    )


def stitch(
    partials: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Join partial runs across block edges.

    ``partials`` has ``keys, __block, start, end, __cont, __open``: ``__cont`` says the run goes on from
    the block before, ``__open`` that it reaches its block's end. Runs with neither are finished and keep
    their block as group; the rest, at most two per block, are ordered per key. ``aggs`` maps an output
    to (kind, column) with kind min, max, sum or first.
    """
    keys = list(keys)
    edge = F.col("__cont") | F.col("__open")
    x = partials.withColumn("__grp", F.when(edge, F.lit(_EDGE)).otherwise(F.col(_BLK)))
    w = Window.partitionBy(*keys, "__grp").orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__run", F.max(F.when(~F.col("__cont"), F.col(start))).over(w))
    out = [F.min(start).alias(start), F.max(end).alias(end)]
    for name, (kind, col) in aggs.items():
        if kind == "first":
            out.append(F.min_by(F.col(col), F.col(start)).alias(name))
        else:
            out.append({"min": F.min, "max": F.max, "sum": F.sum}[kind](col).alias(name))
    # Grouping by (keys, group, run) reuses the window's partitioning.
    return x.groupBy(*keys, "__grp", "__run").agg(*out).drop("__grp", "__run")


def stitched_runs(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str | None = None,
    same: Column | None = None,
    carry: Sequence[str] = (),
    aggs: Mapping[str, tuple[str, str]] | None = None,
    block: int = BLOCK,
    out: tuple[str, str] = ("start", "end"),
) -> DataFrame:
    """Aggregate runs of touching rows: a row belongs to the run before it when it starts right after the
    previous row ends and ``same`` holds. ``same`` may use ``prev_<c>`` for the columns in ``carry``.

    A row is also shown to the block its successor would start in, so no run edge is missed; that copy
    is only looked at, never counted.
    """
    keys, aggs = list(keys), dict(aggs or {})
    s, e = F.col(start).cast("long"), F.col(end or start).cast("long")
    own_block, next_block = block_of(s, block), block_of(e + 1, block)
    needed = sorted({c for c in carry} | {c for _, c in aggs.values()})
    rows = df.select(
        *keys,
        s.alias("__s"),
        e.alias("__e"),
        *needed,
        F.explode(F.array_distinct(F.array(own_block, next_block))).alias(_BLK),
    ).withColumn("__own", block_of("__s", block) == F.col(_BLK))
    w = Window.partitionBy(*keys, _BLK).orderBy("__s")
    seen = rows.select(
        "*", F.lag("__e").over(w).alias("__pe"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in carry]
    )
    joined = F.coalesce(F.col("__pe") + 1 == F.col("__s"), F.lit(False))
    if same is not None:
        joined = joined & F.coalesce(same, F.lit(False))
    seen = seen.withColumn("__new", F.when(joined, 0).otherwise(1))
    seen = seen.withColumn("__r", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mine = F.col("__own")

    def local(kind: str, c: str) -> Column:
        v = F.when(mine, F.col(c))
        if kind == "first":
            return F.min_by(F.col(c), F.when(mine, F.col("__s")))
        return {"min": F.min, "max": F.max, "sum": F.sum}[kind](v)

    part = seen.groupBy(*keys, _BLK, "__r").agg(
        F.min(F.when(mine, F.col("__s"))).alias(out[0]),
        F.max(F.when(mine, F.col("__e"))).alias(out[1]),
        F.max(~mine).alias("__cont"),
        *[local(kind, c).alias(name) for name, (kind, c) in aggs.items()],
    )
    part = part.where(F.col(out[0]).isNotNull()).withColumn(
        "__open", block_of(F.col(out[1]) + 1, block) != F.col(_BLK)
    )
    merged = {name: (kind, name) for name, (kind, _) in aggs.items()}
    return stitch(part, keys, merged, *out)


def local_union(pieces: DataFrame, keys: Sequence[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Union of intervals already cut at block borders (``__block`` set): merge per block, then stitch.

    Cutting loses nothing, because touching intervals merge anyway.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, _BLK).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = pieces.withColumn("__reach", reach)
    x = x.withColumn("__new", F.when(F.col(start) <= F.col("__reach") + 1, 0).otherwise(1))
    x = x.withColumn("__r", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = x.groupBy(*keys, _BLK, "__r").agg(F.min(start).alias(start), F.max(end).alias(end))
    first = F.col(_BLK) * block
    edge = (F.col(start) == first) | (F.col(end) == first + block - 1)
    part = part.withColumn("__grp", F.when(edge, F.lit(_EDGE)).otherwise(F.col(_BLK)))
    we = Window.partitionBy(*keys, "__grp").orderBy(start)
    part = part.withColumn("__pe", F.lag(end).over(we))
    head = F.when(F.coalesce(F.col("__pe") + 1 == F.col(start), F.lit(False)), None).otherwise(F.col(start))
    part = part.withColumn("__run", F.max(head).over(we.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "__grp", F.col("__run")).agg(
        F.min(start).alias(start), F.max(end).alias(end)
    ).drop("__grp", "__run")


def pieces(df: DataFrame, keys: Sequence[str], start: str, end: str, block: int, *extra: str) -> DataFrame:
    """Cut intervals at block borders; most give one or two pieces."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    x = df.select(
        *keys, *extra, s.alias("__s"), e.alias("__e"),
        F.explode(F.sequence(block_of(s, block), block_of(e, block))).alias(_BLK),
    )
    lo = F.col(_BLK) * block
    return x.select(
        *keys, *extra, _BLK,
        F.greatest(F.col("__s"), lo).alias(start), F.least(F.col("__e"), lo + (block - 1)).alias(end),
        (F.col("__s") >= lo).alias("__first"), (F.col("__e") <= lo + (block - 1)).alias("__last"),
    )
