"""Signal smoothing and segmentation over positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.joins import overlap_mark
from strandline.operators.scan import BLOCK, block_of, stitched_runs

# Smoothing and segmentation defaults.
FILTER_SIZE, SIGMA, MIN_TAP = 50, 17.0, 1e-5
THRESHOLD, MIN_REGION, MAX_REGION, REGION_PAD = 0.002, 50, 300, 100


def gaussian_kernel(size: int = FILTER_SIZE, sigma: float = SIGMA) -> list[float]:
    """Normalised taps of offsets -size..size."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    raw = [math.exp(-((i - size) ** 2) / (2 * sigma * sigma)) for i in range(2 * size + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def adaptive_size(kernel: Sequence[float], min_tap: float = MIN_TAP) -> int:
    """Distance of the farthest tap that, walking out from the middle, is still at least ``min_tap``."""
    mid = (len(kernel) - 1) // 2
    n = 0
    while n < mid and kernel[mid - n - 1] >= min_tap:
        n += 1
    return n


def spread_copies(clip: Column, pos: Column, length: Column | None, reach: int) -> Column:
    """How many copies a position with clip evidence stands for: those inside the contig."""
    n = F.least(clip, F.lit(reach))
    lo = F.greatest(F.lit(1), pos - n)
    hi = pos + n if length is None else F.least(length, pos + n)
    return F.when(clip.isNull(), F.lit(1)).otherwise(hi - lo + 1)


def band_pass(
    df: DataFrame,
    keys: Sequence[str],
    kernel: Sequence[float],
    pos: str = "pos",
    prob: str = "prob",
    clip: str | None = None,
    length: Column | None = None,
    block: int = 4096,
    out: str = "smoothed",
    propagation: int = 50,
) -> DataFrame:
    """Smooth each run of consecutive positions with the kernel; mass past a run's ends is lost.

    Rows go to the position block their taps fall in (twice near a block edge) and the taps are only
    opened there: the shuffle carries about one row per input row, not one per tap. A tap can only cross
    positions that are all present, which the rows of one block and its rim can tell by themselves.
    Clip evidence multiplies the mass at its own position.
    """
    keys = list(keys)
    r = (len(kernel) - 1) // 2
    taps = F.array(*[F.lit(float(k)) for k in kernel])
    mass = F.col(prob).cast("double")
    if clip:
        mass = mass * spread_copies(F.col(clip), F.col(pos), length, propagation + r)
    p = F.col(pos).cast("long")
    rows = df.select(
        *keys, p.alias("__p"), mass.alias("__m"),
        F.explode(F.sequence(block_of(p - r, block), block_of(p + r, block))).alias("__b"),
    )
    w = Window.partitionBy(*keys, "__b").orderBy("__p")
    gap = F.when(F.col("__p") - F.lag("__p").over(w) == 1, 0).otherwise(1)
    rows = rows.withColumn("__gap", gap).withColumn(
        "__run", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    shape = "array<struct<pos:bigint,v:double,own:boolean>>"
    own = F.array(F.struct(F.col("__p").alias("pos"), F.lit(0.0).alias("v"), F.lit(True).alias("own"))).cast(shape)
    spread = F.transform(
        F.sequence(
            F.greatest(F.col("__p") - r, F.col("__b") * block),
            F.least(F.col("__p") + r, (F.col("__b") + 1) * block - 1),
        ),
        lambda q: F.struct(
            q.alias("pos"),
            (F.col("__m") * F.element_at(taps, (q - F.col("__p") + r + 1).cast("int"))).alias("v"),
            F.lit(False).alias("own"),
        ),
    ).cast(shape)
    none = F.array().cast(shape)
    here = block_of("__p", block) == F.col("__b")
    opened = rows.select(
        *keys, "__b", "__run",
        F.explode(
            F.concat(F.when(here, own).otherwise(none), F.when(F.col("__m") > 0, spread).otherwise(none))
        ).alias("t"),
    )
    # (keys, block) is already the partitioning, so this aggregation does not shuffle.
    agg = opened.groupBy(*keys, "__b", "__run", F.col("t.pos").alias(pos)).agg(
        F.sum("t.v").alias(out), F.max("t.own").alias("__own")
    )
    return agg.where("__own").select(*keys, pos, out)


def segment(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    prob: str = "smoothed",
    threshold: float = THRESHOLD,
    min_size: int = MIN_REGION,
    max_size: int = MAX_REGION,
    pad: int = REGION_PAD,
    length: Column | None = None,
    block: int = BLOCK,
    cut_active: bool = True,
) -> DataFrame:
    """Active and inactive regions ``start, end, is_active, padded_start, padded_end``.

    Inactive runs are cut every ``max_size`` and short active runs kept: arithmetic on islands. An active
    run of at least ``max_size`` is cut at its lowest local minimum, each cut depending on the one before;
    those runs go through ``_cut_long``. Without ``cut_active`` every active run stays one region.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(prob).cast("double").alias("p"))
    src = src.withColumn("is_active", F.col("p") > threshold)
    runs = stitched_runs(
        src, keys, "pos", same=F.col("prev_is_active") == F.col("is_active"), carry=["is_active"],
        aggs={"is_active": ("max", "is_active")}, block=block,
    )
    long_active = F.col("is_active") & (F.col("end") - F.col("start") + 1 >= max_size) if cut_active else F.lit(False)
    step = F.when(F.col("is_active"), F.col("end") - F.col("start") + 1).otherwise(F.lit(max_size).cast("long"))
    plain = (
        runs.where(~long_active)
        .withColumn("__end", F.col("end"))
        .withColumn("start", F.explode(F.sequence(F.col("start"), F.col("end"), step)))
        .select(*keys, "start", F.least(F.col("start") + step - 1, F.col("__end")).alias("end"), "is_active")
    )
    both = plain
    if cut_active:
        longs = runs.where(long_active).select(*keys, F.col("start").alias("run"), F.col("end").alias("run_end"))
        cuts = _cut_long(src.select(*keys, "pos", "p"), longs, keys, min_size, max_size, max(min(block, 1 << 14), max_size + 1))
        both = plain.unionByName(cuts.withColumn("is_active", F.lit(True)))
    hi = F.col("end") + pad if length is None else F.least(length, F.col("end") + pad)
    return both.select(
        "*", F.greatest(F.lit(1).cast("long"), F.col("start") - pad).alias("padded_start"), hi.cast("long").alias("padded_end")
    )


def next_cuts(p: np.ndarray, n: int, min_size: int, max_size: int) -> np.ndarray:
    """For every start offset below ``n`` the offset where the following region begins.

    ``p`` may run past ``n`` (look-ahead); ``n`` counts the offsets to answer. An offset whose run has
    fewer than ``max_size`` values left answers ``len``-of-run, encoded by the caller through ``p``'s NaN tail.
    """
    size = len(p)
    left = np.r_[np.nan, p[:-1]]
    right = np.r_[p[1:], np.nan]
    with np.errstate(invalid="ignore"):
        low = (p <= right) & (p < left)
    cost = np.where(low, p, np.inf)
    width = max_size - (min_size - 1)
    padded = np.r_[cost, np.full(max_size, np.inf)]
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    starts = np.arange(n) + (min_size - 1)
    rows = view[np.minimum(starts, size)][:, ::-1]
    pick = rows.argmin(axis=1)
    best = rows[np.arange(n), pick]
    end = np.where(np.isfinite(best), max_size - 1 - pick, max_size - 1)
    return np.arange(n) + end + 1


def _cut_long(
    src: DataFrame, longs: DataFrame, keys: Sequence[str], min_size: int, max_size: int, block: int
) -> DataFrame:
    """Sequential cuts of long active runs, by blocks.

    A region is at most ``max_size`` long, and a block longer, so a cut chain enters every block within its
    first ``max_size`` offsets. Pass one maps every possible entry offset of a block to the entry offset of the next block;
    pass two chains those small maps per run; pass three walks each block from its known entry.
    """
    keys = list(keys)
    halo = max_size + 1
    run = [*keys, "run"]
    from strandline.operators.joins import overlap_join

    pts = src.withColumn("__a", F.col("pos")).withColumn("__z", F.col("pos"))
    spans = longs.select(*keys, "run", "run_end", F.col("run").alias("__rs"), (F.col("run_end") + 1).alias("__re"))
    rows = overlap_join(pts, spans, keys, ("__a", "__z"), ("__rs", "__re"), widths=(1 << 10, 1 << 16))
    off = F.col("pos") - F.col("run")
    first = F.greatest(F.lit(0), F.floor((off - halo) / block))
    rows = rows.select(
        *run, "run_end", off.alias("off"), "p", F.explode(F.sequence(first.cast("long"), F.floor(off / block).cast("long"))).alias("chunk")
    )
    ks = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema.fields)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off")
        chunk = int(pdf["chunk"].iloc[0])
        base = chunk * block
        total = int(pdf["run_end"].iloc[0] - pdf["run"].iloc[0] + 1)
        p = pdf["p"].to_numpy()
        n = min(block, total - base)
        head = pdf[[*run, "chunk"]].iloc[:1].reset_index(drop=True)
        if n <= 0:  # the single look-ahead row past the run opened this chunk
            return head.iloc[:0].assign(nexts=[], exits=[])
        nxt = next_cuts(p, n, min_size, max_size)
        nxt = np.where(base + np.arange(n) + max_size > total, total - base, nxt)
        exits = np.full(n, -1, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            exits[i] = nxt[i] - block if nxt[i] >= n and nxt[i] + base < total else (-1 if nxt[i] >= n else exits[nxt[i]])
        return head.assign(nexts=[nxt.astype("int32")], exits=[exits[:max_size].astype("int32")])

    mapped = rows.groupBy(*run, "chunk").applyInPandas(
        maps, f"{ks}, run long, chunk long, nexts array<int>, exits array<int>"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        at, out = 0, []
        for e in pdf["exits"]:
            out.append(at)
            at = int(e[at]) if at >= 0 else -1
        return pdf[[*run, "chunk"]].assign(entry=out)

    entries = mapped.select(*run, "chunk", "exits").groupBy(*run).applyInPandas(
        chain, f"{ks}, run long, chunk long, entry long"
    )

    def walk(batches):
        for pdf in batches:
            starts, ends = [], []
            for run0, chunk, nexts, entry in zip(pdf["run"], pdf["chunk"], pdf["nexts"], pdf["entry"]):
                base = int(run0) + int(chunk) * block
                s, e, at = [], [], int(entry)
                while 0 <= at < len(nexts):
                    s.append(base + at)
                    e.append(base + int(nexts[at]) - 1)
                    at = int(nexts[at])
                starts.append(s)
                ends.append(e)
            yield pdf[keys].assign(starts=starts, ends=ends)

    walked = mapped.select(*run, "chunk", "nexts").join(entries, [*run, "chunk"]).mapInPandas(
        walk, f"{ks}, starts array<long>, ends array<long>"
    )
    return walked.select(*keys, F.explode(F.arrays_zip("starts", "ends")).alias("z")).select(
        *keys, F.col("z.starts").alias("start"), F.col("z.ends").alias("end")
    )


def force_active(df: DataFrame, keys: Sequence[str], features: DataFrame | None = None, pos: str = "pos", prob: str = "prob") -> DataFrame:
    """Probability 1 everywhere, or only where a required allele's span covers the position."""
    if features is None:
        return df.withColumn(prob, F.lit(1.0))
    x = df.withColumn("__s", F.col(pos)).withColumn("__e", F.col(pos))
    x = overlap_mark(x, features, keys, ("__s", "__e"), ("start", "end"), "__forced")
    return x.withColumn(prob, F.when(F.col("__forced"), F.lit(1.0)).otherwise(F.col(prob))).drop("__s", "__e", "__forced")
