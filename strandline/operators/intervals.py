"""Closed, 1-based interval algebra on any table with key, start and end columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scan import BLOCK, local_union, pieces, stitch, stitched_runs


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", block: int = BLOCK
) -> DataFrame:
    """Union of intervals per key; touching ones (``start = previous end + 1``) become one."""
    keys = list(keys)
    cut = pieces(df, keys, start, end, block)
    longest = cut.groupBy(*keys, "__block", start).agg(F.max(end).alias(end))
    return local_union(longest, keys, start, end, block)


def _steps(df: DataFrame, keys: list[str], start: str, end: str, block: int, amounts: dict[str, Column]) -> DataFrame:
    """+amount at each piece's start and -amount right after its end, the latter only inside the block.

    A piece that covers a block border counts from the border, so running sums need no carry. An interval
    ending exactly at a border leaves a zero step in the next block, which keeps the breakpoint.
    """
    cut = pieces(df, keys, start, end, block, *[c for c in df.columns if c not in (*keys, start, end)])
    after = F.col(end) + 1
    next_block = F.floor(after / F.lit(block)).cast("long")
    inside = next_block == F.col("__block")

    def step(pos: Column, blk: Column, real: Column, sign: Column) -> Column:
        return F.struct(
            pos.alias("pos"), blk.alias("blk"), real.alias("real"),
            *[(v * sign).cast("long").alias(n) for n, v in amounts.items()],
        )

    up = step(F.col(start), F.col("__block"), F.col("__first"), F.lit(1))
    down = step(after, next_block, F.lit(True), F.when(inside, -1).otherwise(0))
    marks = F.when(inside | F.col("__last"), F.array(up, down)).otherwise(F.array(up))
    return (
        cut.select(*keys, F.explode(marks).alias("m"))
        .groupBy(*keys, F.col("m.blk").alias("__block"), F.col("m.pos").alias("pos"))
        .agg(*[F.sum(f"m.{n}").alias(n) for n in amounts], F.max("m.real").alias("real"))
    )


def _levels(steps: DataFrame, keys: list[str], names: Sequence[str], start: str, end: str, block: int) -> DataFrame:
    w = Window.partitionBy(*keys, "__block").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = (F.col("__block") + 1) * block - 1
    return steps.select(
        *keys, "__block", "real", F.col("pos").alias(start),
        F.coalesce(F.lead("pos").over(w) - 1, last).alias(end),
        *[F.sum(n).over(upto).alias(n) for n in names],
    )


def sweep(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    block: int = BLOCK,
) -> DataFrame:
    """Covered stretches between breakpoints with their depth: ``start, end, depth``.

    Cost follows the number of breakpoints, not the covered length.
    """
    keys = list(keys)
    steps = _steps(df.select(*keys, start, end), keys, start, end, block, {"depth": F.lit(1)})
    segs = _levels(steps, keys, ["depth"], "start", "end", block).where(F.col("depth") > 0)
    part = segs.withColumn("__cont", ~F.col("real")).withColumn(
        "__open", F.col("end") == (F.col("__block") + 1) * block - 1
    )
    return stitch(part, keys, {"depth": ("max", "depth")})


def _two_sided(
    a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, keep: Column, block: int
) -> DataFrame:
    keys = list(keys)
    both = a.select(*keys, start, end, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(*keys, start, end, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    steps = _steps(both, keys, start, end, block, {"in_a": F.col("__a"), "in_b": F.col("__b")})
    segs = _levels(steps, keys, ["in_a", "in_b"], start, end, block).where(keep)
    return local_union(segs.select(*keys, "__block", start, end), keys, start, end, block)


def subtract_intervals(
    include: DataFrame,
    exclude: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    block: int = BLOCK,
) -> DataFrame:
    """Positions in ``include`` and not in ``exclude``, as merged intervals."""
    return _two_sided(
        include, exclude, keys, start, end, (F.col("in_a") > 0) & (F.col("in_b") == 0), block
    )


def intersect_intervals(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    block: int = BLOCK,
) -> DataFrame:
    """Positions in both, as merged intervals."""
    return _two_sided(a, b, keys, start, end, (F.col("in_a") > 0) & (F.col("in_b") > 0), block)


def pad_intervals(
    df: DataFrame, pad: int, start: str = "start", end: str = "end", length: str | Column | None = None
) -> DataFrame:
    """Grow by ``pad`` on both sides, clamped to [1, length]."""
    hi = F.col(end) + pad
    if length is not None:
        hi = F.least(F.col(length) if isinstance(length, str) else length, hi)
    return df.withColumn(start, F.greatest(F.lit(1), F.col(start) - pad).cast("long")).withColumn(
        end, hi.cast("long")
    )


def resolve_intervals(
    df: DataFrame, contigs: DataFrame, key: str = "contig", start: str = "start", end: str = "end"
) -> DataFrame:
    """Both bounds missing means the whole contig; exactly one missing is an error; so is an unknown key.

    The dictionary side is one row per contig; Spark picks broadcast from its size.
    """
    d = contigs.select(F.col(key), F.col("length").alias("__len"))
    j = df.join(d, key, "left")
    half = F.col(start).isNull() != F.col(end).isNull()
    bad = (
        F.when(F.col("__len").isNull(), F.concat(F.lit("unknown contig "), F.col(key).cast("string")))
        .when(half, F.lit("interval needs both bounds or none"))
        .when(F.col(start) < 1, F.lit("interval start below 1"))
        .when(F.col(start) > F.col(end), F.lit("interval start after end"))
    )
    return (
        j.withColumn("__bad", bad)
        .where(F.col("__bad").isNull() | F.raise_error(F.col("__bad")).cast("boolean"))
        .select(
            *[c for c in df.columns if c not in (start, end)],
            F.coalesce(F.col(start), F.lit(1)).cast("long").alias(start),
            F.coalesce(F.col(end), F.col("__len")).cast("long").alias(end),
        )
    )


def whole_genome_intervals(contigs: DataFrame, key: str = "contig") -> DataFrame:
    return contigs.select(
        F.col(key), F.lit(1).cast("long").alias("start"), F.col("length").cast("long").alias("end")
    )


_REGION = r"^\^?([^:]+)(?::([0-9,]+)-([0-9,]+))?$"


def parse_intervals(df: DataFrame, text: str = "text", key: str = "contig") -> DataFrame:
    """``contig``, ``contig:start-end``, ``;`` lists, leading ``^`` for exclusion.

    Returns ``contig, start, end, exclude, error``; bounds are null for a whole contig.
    """
    part = df.select(F.explode(F.split(F.col(text), ";")).alias("t")).select(F.trim("t").alias("t"))
    part = part.where(F.length("t") > 0)

    def num(i: int) -> Column:
        return F.expr(f"try_cast(nullif(replace(regexp_extract(t, '{_REGION}', {i}), ',', ''), '') as bigint)")

    out = part.select(
        F.regexp_extract("t", _REGION, 1).alias(key),
        num(2).alias("start"),
        num(3).alias("end"),
        F.col("t").startswith("^").alias("exclude"),
        "t",
    )
    error = (
        F.when(F.col(key) == "", F.concat(F.lit("bad interval "), F.col("t")))
        .when(F.col("start") < 1, F.lit("interval start below 1"))
        .when(F.col("start") > F.col("end"), F.lit("interval start after end"))
    )
    return out.withColumn("error", error).drop("t")


def include_exclude(parsed: DataFrame, contigs: DataFrame, key: str = "contig") -> DataFrame:
    """Turn parsed interval text into the merged inclusion minus exclusion; exclusions alone are refused."""
    ok = parsed.where(
        F.col("error").isNull() | F.raise_error(F.col("error")).cast("boolean")
    )
    full = resolve_intervals(ok.select(key, "start", "end", "exclude"), contigs, key)
    has_include = parsed.agg(F.max(~F.col("exclude")).alias("any_include"))
    guard = full.crossJoin(F.broadcast(has_include)).where(
        F.col("any_include")
        | F.raise_error(F.lit("exclusion intervals need at least one inclusion")).cast("boolean")
    )
    inc = guard.where(~F.col("exclude")).select(key, "start", "end")
    exc = guard.where(F.col("exclude")).select(key, "start", "end")
    return subtract_intervals(inc, exc, [key])


def make_shards(
    df: DataFrame, contigs: DataFrame, key: str = "contig", pad: int = 100
) -> DataFrame:
    """Merged user spans and merged padded spans side by side: ``kind`` is ``user`` or ``padded``."""
    spans = merge_intervals(df, [key])
    d = contigs.select(F.col(key), F.col("length").alias("__len"))
    padded = pad_intervals(spans.join(d, key), pad, length="__len").drop("__len")
    padded = merge_intervals(padded, [key])
    return spans.withColumn("kind", F.lit("user")).unionByName(
        padded.withColumn("kind", F.lit("padded"))
    )


def tile(df: DataFrame, size: int = 100, start: str = "start", end: str = "end") -> DataFrame:
    """Cut each interval into tiles of ``size`` positions counted from its own start."""
    t = df.withColumn(
        "tile_start", F.explode(F.sequence(F.col(start), F.col(end), F.lit(size).cast("long")))
    )
    return t.withColumn("tile_end", F.least(F.col("tile_start") + size - 1, F.col(end)))


def position_flags(positions: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Mark each position that lies in any span (closed)."""
    from strandline.operators.joins import overlap_mark

    p = positions.withColumn("__s", F.col(pos)).withColumn("__e", F.col(pos))
    return overlap_mark(p, spans, keys, ("__s", "__e"), ("start", "end"), "inside").drop("__s", "__e")


def validate_intervals(df: DataFrame, contigs: DataFrame, key: str = "contig") -> DataFrame:
    """Rows that break the dictionary, with the reason. A ``chr`` prefix on either side is tolerated."""
    bare = F.regexp_replace(F.col(key), "^chr", "")
    d = contigs.select(bare.alias("__k"), F.col("length").alias("__len"))
    j = df.withColumn("__k", bare).join(d, "__k", "left")
    reason = (
        F.when(F.col("__len").isNull(), "unknown contig")
        .when(F.col("start") < 1, "start below 1")
        .when(F.col("end") < F.col("start"), "end before start")
        .when(F.col("end") > F.col("__len"), "end past contig")
    )
    return j.withColumn("reason", reason).where("reason is not null").select(*df.columns, "reason")


def dictionary_diff(a: DataFrame, b: DataFrame, key: str = "contig") -> DataFrame:
    """Contigs of a file header against the dictionary: missing on a side, or different length."""
    bare = F.regexp_replace(F.col(key), "^chr", "")
    x = a.select(bare.alias(key), F.col("length").alias("file_length"))
    y = b.select(bare.alias(key), F.col("length").alias("dict_length"))
    reason = (
        F.when(F.col("dict_length").isNull(), "not in dictionary")
        .when(F.col("file_length").isNull(), "not in file")
        .when(F.col("file_length") != F.col("dict_length"), "length differs")
    )
    return x.join(y, key, "full_outer").withColumn("reason", reason).where("reason is not null")


def contiguous_runs(df: DataFrame, keys: Sequence[str], pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Runs of consecutive positions as intervals."""
    return stitched_runs(df.select(*keys, pos).distinct(), keys, pos, block=block)
