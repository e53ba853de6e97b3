"""Confidence blocks: runs of positions whose quality stays in one band."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scan import BLOCK, Run, block_of, prefix_scan, stitch, stitched_runs

# Default band bounds.
DEFAULT_BANDS = [*range(1, 61), 70, 80, 90, 99]


def _clamped(gq: Column) -> Column:
    return F.least(F.lit(99), F.greatest(F.lit(0), gq))


def band_partition(gq: Column, bands: Sequence[int]) -> tuple[Column, Column]:
    """Half-open [lower, upper) band of a quality clamped to 0..99."""
    g = _clamped(gq)
    arr = F.array(*[F.lit(int(b)) for b in bands])
    lo = F.coalesce(F.array_max(F.filter(arr, lambda b: b <= g)), F.lit(0))
    hi = F.coalesce(F.array_min(F.filter(arr, lambda b: b > g)), F.lit(100))
    return lo, hi


def band_upper(gq: Column, bands: Sequence[int]) -> Column:
    """First band bound that is at least ``gq``, else the last bound."""
    arr = F.array(*[F.lit(int(b)) for b in bands])
    return F.coalesce(F.array_min(F.filter(arr, lambda b: b >= gq)), F.lit(int(bands[-1])))


_FIELDS = {
    "band_upper": ("max", "__hi"), "min_gq": ("min", "gq"), "min_dp": ("min", "dp"), "max_dp": ("max", "dp"),
}


def gq_blocks(loci: DataFrame, keys: Sequence[str], bands: Sequence[int] = DEFAULT_BANDS, block: int = BLOCK) -> DataFrame:
    """Blocks by band partition. The band of a block is that of its first row, hence of every row: a new
    block starts exactly where the band or the position sequence breaks."""
    _, hi = band_partition(F.col("gq"), bands)
    x = loci.withColumn("__hi", hi)
    return stitched_runs(
        x, keys, "pos", same=F.col("prev___hi") == F.col("__hi"), carry=["__hi"], aggs=_FIELDS, block=block
    )


def gq_blocks_delta(
    loci: DataFrame,
    keys: Sequence[str],
    bands: Sequence[int],
    max_delta: int = 10,
    absorb_zero: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Blocks that also end when GQ strays more than ``max_delta`` from the block's running minimum.

    The only state is that minimum, a value of 0..99. Each position block is folded once from every
    possible entry minimum; the folds are chained per key over one row per block; then each block is
    replayed from its known entry. No task ever holds a whole key.
    """
    keys = list(keys)
    bands = [int(b) for b in bands]
    upper_of = np.array([next((b for b in bands if g <= b), bands[-1]) for g in range(100)])

    def joins(lo: np.ndarray, gq: int) -> np.ndarray:
        same = upper_of[lo] == upper_of[gq]
        if absorb_zero:
            same |= (lo == 0) & (gq <= max_delta)
        return same & (np.abs(gq - lo) <= max_delta)

    src = loci.select(
        *keys, F.col("pos").cast("long"), _clamped(F.col("gq")).cast("int").alias("gq"),
        F.col("dp").cast("long"), block_of("pos", block).alias("__block"),
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema.fields)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, gq = pdf["pos"].to_numpy(), pdf["gq"].to_numpy()
        state = np.arange(101)
        state[100] = -1  # no entry: the first row starts a block
        for i in range(len(pos)):
            gap = i > 0 and pos[i] != pos[i - 1] + 1
            ok = (state >= 0) & joins(np.maximum(state, 0), int(gq[i]))
            state = np.where(ok & (not gap), np.minimum(state, gq[i]), gq[i])
        head = pdf[[*keys, "__block"]].iloc[:1].reset_index(drop=True)
        return head.assign(first=pos[:1], last=pos[-1:], exits=[state.astype("int32")])

    folds = src.groupBy(*keys, "__block").applyInPandas(
        fold, f"{key_schema}, __block long, first long, last long, exits array<int>"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        entry, out, prev_last = 100, [], None
        for first, last, exits in zip(pdf["first"], pdf["last"], pdf["exits"]):
            if prev_last is None or first != prev_last + 1:
                entry = 100
            out.append(entry)
            entry, prev_last = int(exits[entry]), last
        return pdf[[*keys, "__block"]].assign(entry=out)

    entries = folds.groupBy(*keys).applyInPandas(chain, f"{key_schema}, __block long, entry int")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, gq = pdf["pos"].to_numpy(), pdf["gq"].to_numpy()
        lo = int(pdf["entry"].iloc[0])
        lo = -1 if lo == 100 else lo
        head = np.zeros(len(pos), dtype=bool)
        for i in range(len(pos)):
            gap = i > 0 and pos[i] != pos[i - 1] + 1
            if lo >= 0 and not gap and bool(joins(np.array([lo]), int(gq[i]))[0]):
                lo = min(lo, int(gq[i]))
            else:
                head[i], lo = True, int(gq[i])
        cont = not head[0]
        g = pdf.assign(r=np.cumsum(head)).groupby("r", sort=True).agg(
            start=("pos", "min"), end=("pos", "max"), min_gq=("gq", "min"), min_dp=("dp", "min"), max_dp=("dp", "max")
        )
        g["__cont"] = [cont and i == 0 for i in range(len(g))]
        for k in [*keys, "__block"]:
            g[k] = pdf[k].iloc[0]
        return g[[*keys, "__block", "start", "end", "min_gq", "min_dp", "max_dp", "__cont"]]

    part = src.join(entries, [*keys, "__block"]).groupBy(*keys, "__block").applyInPandas(
        replay,
        f"{key_schema}, __block long, start long, end long, min_gq int, min_dp long, max_dp long, __cont boolean",
    )
    part = part.withColumn("__open", block_of(F.col("end") + 1, block) != F.col("__block"))
    aggs = {"min_gq": ("min", "min_gq"), "min_dp": ("min", "min_dp"), "max_dp": ("max", "max_dp")}
    return stitch(part, keys, aggs).withColumn("band_upper", band_upper(F.col("min_gq"), bands))


def coalesce_blocks(
    blocks: DataFrame, keys: Sequence[str], bands: Sequence[int], max_delta: int = 10, block: int = BLOCK
) -> DataFrame:
    """Absorb low-quality blocks into a leading block whose minimum is 0.

    Inside a run of touching blocks that are all at most ``max_delta``, every block after the first zero
    block is absorbed and nothing else is. A block knows its run from the last break, and whether it is
    absorbed from the last zero before it: one running scan. Each block is also shown to the position
    block its successor starts in, so the break test is local.
    """
    keys = list(keys)
    own, nxt = block_of("start", block), block_of(F.col("end") + 1, block)
    shown = blocks.withColumn("__b", F.explode(F.array_distinct(F.array(own, nxt))))
    w = Window.partitionBy(*keys, "__b").orderBy("start")
    touch = (
        (F.col("start") == F.lag("end").over(w) + 1)
        & (F.col("min_gq") <= max_delta)
        & (F.lag("min_gq").over(w) <= max_delta)
    )
    x = shown.withColumn("__touch", F.coalesce(touch, F.lit(False))).where(F.col("__b") == own)
    x = x.withColumn("__brk", F.when(~F.col("__touch"), F.col("start"))).withColumn(
        "__zero", F.when(F.col("min_gq") == 0, F.col("start"))
    ).drop("__b", "__touch")
    s = prefix_scan(
        x, keys, "start", {"__run": Run("max", "__brk"), "__seen": Run("max", "__zero", inclusive=False)}, block
    )
    absorbed = F.coalesce(F.col("__seen") >= F.col("__run"), F.lit(False))
    in_zero = absorbed | (F.col("min_gq") == 0)
    merged = s.groupBy(
        *keys, in_zero.alias("__z"), F.when(in_zero, F.col("__run")).otherwise(F.col("start")).alias("__g")
    ).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("min_gq").alias("min_gq"),
        F.min("min_dp").alias("min_dp"),
        F.max("max_dp").alias("max_dp"),
        F.count(F.lit(1)).alias("__n"),
        F.max("band_upper").alias("__band"),
    )
    upper = F.when(F.col("__n") > 1, band_upper(F.col("min_gq"), bands)).otherwise(F.col("__band"))
    return merged.withColumn("band_upper", upper).drop("__n", "__band", "__z", "__g")


def no_variation_summary(loci: DataFrame, keys: Sequence[str]) -> DataFrame:
    return loci.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_loci"),
        F.min("gq").alias("min_gq"), F.max("gq").alias("max_gq"),
        F.min("dp").alias("min_dp"), F.max("dp").alias("max_dp"),
    )


def zero_fill(loci: DataFrame, spans: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("gq", "dp")) -> DataFrame:
    """Every position of the (merged) spans, with zeros where there is no evidence."""
    keys = list(keys)
    grid = spans.withColumn("pos", F.explode(F.sequence("start", "end"))).select(*keys, "pos")
    j = grid.join(loci.select(*keys, "pos", *cols), [*keys, "pos"], "left")
    return j.select(*keys, "pos", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def emit(variants: DataFrame, loci: DataFrame, keys: Sequence[str], mode: str, bands: Sequence[int] = DEFAULT_BANDS) -> DataFrame:
    """VCF: variants only. GVCF: variants and blocks. BP_RESOLUTION: variants and every position.

    Positions that carry a variant leave the reference rows.
    """
    keys = list(keys)
    cols = [*keys, "start", "end", "kind"]
    v = variants.select(*keys, F.col("pos").alias("start"), F.col("pos").alias("end"), F.lit("variant").alias("kind"))
    if mode == "VCF":
        return v
    rest = loci.join(variants.select(*keys, "pos").distinct(), [*keys, "pos"], "left_anti")
    if mode == "GVCF":
        r = gq_blocks(rest, keys, bands).withColumn("kind", F.lit("block"))
    elif mode == "BP_RESOLUTION":
        r = rest.select(*keys, F.col("pos").alias("start"), F.col("pos").alias("end"), F.lit("site").alias("kind"))
    else:
        raise ValueError(f"unknown emission mode {mode}")
    return v.select(*cols).unionByName(r.select(*cols))
