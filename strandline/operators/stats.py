"""Per-site statistics: strand bias, heterozygosity, rank sums, depth and quality summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.genotype import let
from strandline.functions.mathx import log_factorial_array
from strandline.operators.scan import BLOCK, Run, prefix_scan


def core_site_annotations(
    calls: DataFrame, keys: Sequence[str], n_alt: Column | str, gt: str = "gt", dp: str = "dp"
) -> DataFrame:
    """AN, AC, AF, NS and DP per site from one row per (site, sample).

    Alleles, sample presence and depth travel as (slot, amount) pairs, so one map-side combined group-by
    over (site, slot) does all the counting. A negative depth or an allele above the alternative count
    is an error.
    """
    keys = list(keys)
    n = F.col(n_alt) if isinstance(n_alt, str) else n_alt
    bad = F.exists(gt, lambda a: a > n) | (F.coalesce(F.col(dp), F.lit(0)) < 0)
    called = F.filter(F.col(gt), lambda a: a >= 0)
    long = lambda c: c.cast("long")
    slots = F.concat(
        F.transform(called, lambda a: F.struct(long(a).alias("slot"), F.lit(1).cast("long").alias("v"))),
        F.array(
            F.struct(F.lit(-1).cast("long").alias("slot"), long(F.coalesce(F.col(dp), F.lit(0))).alias("v")),
            F.struct(F.lit(-2).cast("long").alias("slot"), F.when(F.size(called) > 0, 1).otherwise(0).cast("long").alias("v")),
            F.struct(F.lit(-3).cast("long").alias("slot"), F.lit(0).cast("long").alias("v")),
        ),
    )
    ok = calls.where(~bad | F.raise_error(F.lit("negative depth or allele index out of range")).cast("boolean"))
    per = (
        ok.select(*keys, n.cast("long").alias("n_alt"), F.explode(slots).alias("s"))
        .groupBy(*keys, F.col("s.slot").alias("slot"))
        .agg(F.sum("s.v").alias("v"), F.max("n_alt").alias("n_alt"))
    )
    site = per.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.max("n_alt").alias("n_alt")
    )

    def get(i: Column) -> Column:
        return F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))

    alts = F.when(F.col("n_alt") > 0, F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n_alt"), F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )
    an = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n_alt")), F.lit(0).cast("long"), lambda a, i: a + get(i))
    out = site.select(
        *keys, an.alias("an"), F.transform(alts, get).alias("ac"), get(F.lit(-2).cast("long")).alias("ns"),
        get(F.lit(-1).cast("long")).alias("dp"),
    )
    return out.withColumn("af", F.transform("ac", lambda a: F.when(F.col("an") > 0, a / F.col("an")).otherwise(F.lit(0.0))))


def strand_table(
    obs: DataFrame, keys: Sequence[str], is_alt: Column, is_reverse: Column, min_total: int = 0
) -> DataFrame:
    """Allele by strand counts; all zero unless the total exceeds ``min_total``."""
    t = obs.groupBy(*keys).agg(
        *[
            F.count(F.when((is_alt if a else ~is_alt) & (is_reverse if r else ~is_reverse), 1)).alias(n)
            for n, a, r in (("ref_fw", 0, 0), ("ref_rv", 0, 1), ("alt_fw", 1, 0), ("alt_rv", 1, 1))
        ]
    )
    cells = ["ref_fw", "ref_rv", "alt_fw", "alt_rv"]
    total = F.col("ref_fw") + F.col("ref_rv") + F.col("alt_fw") + F.col("alt_rv")
    return t.select(*keys, *[F.when(total > min_total, F.col(c)).otherwise(F.lit(0)).alias(c) for c in cells])


def strand_odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = (x.cast("double") + 1.0 for x in (a, b, c, d))
    ratio = (a / b) * (d / c) + (b / a) * (c / d)
    return F.ln(ratio) + F.ln(F.least(a, b) / F.greatest(a, b)) - F.ln(F.least(c, d) / F.greatest(c, d))


def fisher_strand(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Phred two-sided exact test. Tables above 400 are scaled to 200 with truncation, so log factorials
    up to 400 suffice and the whole test stays an expression."""
    cells = [x.cast("double") for x in (a, b, c, d)]
    total = cells[0] + cells[1] + cells[2] + cells[3]
    factor = F.when(total > 400, total / 200.0).otherwise(F.lit(1.0))
    names = "abcd"
    scaled = F.struct(*[F.floor(x / factor).cast("int").alias(n) for n, x in zip(names, cells)])
    lf = log_factorial_array(401)

    def f(x: Column) -> Column:
        return F.element_at(lf, x + 1)

    def margins(t: Column) -> Column:
        m, n, k = t["a"] + t["b"], t["c"] + t["d"], t["a"] + t["c"]
        fixed = f(m) + f(n) + f(k) + f(m + n - k) - f(m + n)
        return F.struct(
            t["a"].alias("x"), m.alias("m"), n.alias("n"), k.alias("k"), fixed.alias("fixed"),
            F.greatest(F.lit(0), k - n).alias("lo"), F.least(k, m).alias("hi"),
        )

    def logp(t: Column, x: Column) -> Column:
        return t["fixed"] - f(x) - f(t["m"] - x) - f(t["k"] - x) - f(t["n"] - t["k"] + x)

    def tail(t: Column, limit: Column) -> Column:
        lps = F.transform(F.sequence(t["lo"], t["hi"]), lambda x: logp(t, x))
        return F.aggregate(lps, F.lit(0.0), lambda acc, v: acc + F.when(v <= limit, F.exp(v)).otherwise(F.lit(0.0)))

    def p_value(t: Column) -> Column:
        p = let(let(logp(t, t["x"]) * (1.0 - 1e-7), lambda limit: tail(t, limit)), lambda v: F.when(v <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), v)))
        return F.when(t["lo"] >= t["hi"], F.lit(1.0)).otherwise(p)

    p = let(let(scaled, margins), p_value)
    return F.greatest(F.lit(0.0), F.lit(-10.0) * F.log10(F.greatest(p, F.lit(1e-320))))


def excess_het(ref: Column, het: Column, hom: Column) -> Column:
    """Phred right tail of the exact heterozygosity test, the observed count included.

    Relative weights grow outwards from the expected count by a recurrence and stop below 1e-16; a tail
    under 1e-60 scores 160.
    """
    ref, het, hom = (x.cast("double") for x in (ref, het, hom))
    rare_hom, common_hom = F.least(ref, hom), F.greatest(ref, hom)
    rare = rare_hom * 2 + het
    n = het + rare_hom + common_hom
    mid0 = F.floor(rare * (n * 2 - rare) / (n * 2 - 1)).cast("double")
    mid = mid0 + F.when(mid0 % 2 != rare % 2, F.lit(1.0)).otherwise(F.lit(0.0))
    r0 = (rare - mid) / 2
    start = F.struct(
        F.lit(1.0).alias("p"), mid.alias("h"), r0.alias("r"), (n - mid - r0).alias("c"),
        F.lit(0.0).alias("sum"), F.lit(0.0).alias("tail"), F.lit(True).alias("alive"),
    )

    def walk(steps: Column, weight, shift: int) -> Column:
        def one(s: Column, _i: Column) -> Column:
            w = weight(s)
            alive = s["alive"] & (w >= 1e-16)
            h = s["h"] + shift
            return F.struct(
                w.alias("p"), h.alias("h"), (s["r"] - shift / 2).alias("r"), (s["c"] - shift / 2).alias("c"),
                (s["sum"] + F.when(alive, w).otherwise(F.lit(0.0))).alias("sum"),
                (s["tail"] + F.when(alive & (h >= het), w).otherwise(F.lit(0.0))).alias("tail"),
                alive.alias("alive"),
            )

        seq = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1.0)).cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(seq, start, one)

    down = walk(F.floor(mid / 2), lambda s: s["p"] * s["h"] * (s["h"] - 1) / ((s["r"] + 1) * (s["c"] + 1) * 4), -2)
    up = walk(r0, lambda s: s["p"] * s["r"] * s["c"] * 4 / ((s["h"] + 2) * (s["h"] + 1)), 2)

    def phred(walks: Column) -> Column:
        down, up = walks["down"], walks["up"]
        total = down["sum"] + up["sum"] + 1.0
        tail = down["tail"] + up["tail"] + F.when(mid >= het, F.lit(1.0)).otherwise(F.lit(0.0))
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail / total))
        score = F.greatest(F.lit(0.0), F.lit(-10.0) * F.log10(p))
        return F.when(n == 0, F.lit(0.0)).when(p < 1e-60, F.lit(160.0)).otherwise(score)

    # The walks are an array's only element, so that they are walked once and not at each mention of their sums.
    return F.transform(F.array(F.struct(down.alias("down"), up.alias("up"))), phred)[0]


@lru_cache(maxsize=4096)
def _exact_z(twice_ranks: tuple[int, ...], n1: int, twice_u: int) -> float:
    """Standard normal quantile of the permutation p with half weight on the observed rank sum."""
    ways = [dict() for _ in range(n1 + 1)]
    ways[0][0] = 1
    for r in twice_ranks:
        for k in range(n1, 0, -1):
            for s, w in ways[k - 1].items():
                ways[k][s + r] = ways[k].get(s + r, 0) + w
    base = n1 * (n1 + 1)
    less = sum(w for s, w in ways[n1].items() if s - base < twice_u)
    same = sum(w for s, w in ways[n1].items() if s - base == twice_u)
    p = (less + same / 2) / sum(ways[n1].values())
    return NormalDist().inv_cdf(p)


def rank_sum(
    obs: DataFrame,
    keys: Sequence[str],
    value: str,
    is_alt: Column,
    exact_below: int = 10,
    width: float = 4096.0,
    out: str = "z",
) -> DataFrame:
    """One-sided rank-sum z of the alternative values against the reference ones; null when undefined.

    Values are first counted per (site, value), so ranks come from a running count over distinct values
    split in ranges of ``width``; no site is ever sorted in one task. Sites with fewer than
    ``exact_below`` values on both sides get the exact permutation p instead.
    """
    keys = list(keys)
    hist = obs.where(F.col(value).isNotNull()).groupBy(*keys, (F.col(value).cast("double") + 0.0).alias("v")).agg(
        F.count(F.when(is_alt, 1)).alias("n_alt"), F.count(F.when(~is_alt, 1)).alias("n_ref")
    )
    hist = hist.withColumn("n", F.col("n_alt") + F.col("n_ref"))
    # One block per value range: prefix_scan floors pos / block.
    run = prefix_scan(hist, keys, "v", {"below": Run("sum", "n", inclusive=False)}, width)
    rank2 = F.col("below") * 2 + F.col("n") + 1
    n = F.col("n").cast("double")
    site = run.groupBy(*keys).agg(
        F.sum("n_alt").alias("n1"),
        F.sum("n_ref").alias("n2"),
        F.sum(F.col("n_alt") * rank2).alias("r2"),
        F.sum(n * n * n - n).alias("ties"),
        F.max("n").alias("largest"),
        F.when(
            (F.sum("n_alt") < exact_below) & (F.sum("n_ref") < exact_below), F.lit(True)
        ).otherwise(F.lit(False)).alias("small"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r2") / 2.0 - n1 * (n1 + 1) / 2.0
    # A tie that spans every value does not count as a tie.
    ties = F.when(F.col("largest") == F.col("n1") + F.col("n2"), F.lit(0.0)).otherwise(F.col("ties"))
    corr = F.when(ties == 0, F.lit(0.0)).otherwise(F.lit(-0.5))
    total = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((total + 1.0) - ties / (total * (total - 1.0))))
    z = F.when((n1 > 0) & (n2 > 0), (u - n1 * n2 / 2.0 - corr) / sigma)
    stats = site.select(*keys, "n1", "n2", u.alias("u"), z.alias("__z"), "small")

    tiny = stats.where(F.col("small") & (F.col("n1") > 0) & (F.col("n2") > 0)).select(*keys, "n1", "u")
    listed = run.select(*keys, rank2.alias("r2"), "n").join(tiny, keys)
    grouped = listed.groupBy(*keys).agg(
        F.max("n1").alias("n1"),
        F.max("u").alias("u"),
        F.flatten(F.array_sort(F.collect_list(F.array_repeat(F.col("r2"), F.col("n").cast("int"))))).alias("ranks"),
    )

    @F.pandas_udf("double")
    def exact(ranks: pd.Series, n1: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(
            [_exact_z(tuple(int(x) for x in r), int(a), int(round(2 * b))) for r, a, b in zip(ranks, n1, u)],
            dtype="float64",
        )

    fixed = grouped.select(*keys, exact("ranks", "n1", "u").alias("__e"))
    j = stats.join(fixed, keys, "left")
    val = F.when(F.col("small"), F.col("__e")).otherwise(F.col("__z"))
    return j.select(*keys, "n1", "n2", F.when(~F.isnan(val), val).alias(out))


def rms_quality(df: DataFrame, keys: Sequence[str], mapq: str = "mapq", unavailable: int = 255) -> DataFrame:
    """Root mean square over rows whose quality is known."""
    q = F.when(F.col(mapq) != unavailable, F.col(mapq).cast("double"))
    return df.groupBy(*keys).agg(F.sqrt(F.avg(q * q)).alias("rms_mq"))


def evidence_count(scored: DataFrame, filtered: DataFrame, keys: Sequence[str], read: str = "read_id") -> DataFrame:
    """Distinct reads with a score or held back by a mate filter; deduplicated before counting per site."""
    both = scored.select(*keys, read).unionByName(filtered.select(*keys, read)).distinct()
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence"))


def qual_by_depth(qual: Column, depth: Column) -> Column:
    return F.when(depth > 0, qual / depth)


def jittered_qd(qd: Column, key: Sequence[str], seed: int = 47) -> Column:
    """Values of 35 and more become 30 plus a normal draw of sd 3, hashed from the site (Box-Muller)."""
    u1 = (F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    u2 = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draw = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.when(qd < 35, qd).otherwise(F.lit(30.0) + draw * 3.0)


def inbreeding(het: Column, n: Column, minimum: int = 10) -> Column:
    return F.when(n >= minimum, F.lit(1.0) - het / n)


def allele_specific_af(af: Column, index: Column) -> Column:
    return F.when(index == 0, af).otherwise(F.lit(1.0) - af)


def quality_report(seqs: DataFrame, seq: str = "seq", qual: str = "qual", offset: int = 33) -> DataFrame:
    """One row about a set of sequences; the median comes from the quality histogram."""
    hist = quality_histogram(seqs, qual, offset)
    lens = seqs.agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.sum(F.length(seq)).cast("long").alias("total_bases"),
        F.avg(F.length(seq)).alias("mean_length"),
        F.min(F.length(seq)).cast("long").alias("min_length"),
        F.max(F.length(seq)).cast("long").alias("max_length"),
    )
    q = hist.agg(
        (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean_q"),
        F.min("q").alias("min_q"),
        F.max("q").alias("max_q"),
        F.expr("percentile(q, 0.5, n)").alias("median_q"),
    )
    return lens.crossJoin(q)  # one row by one row


def quality_histogram(seqs: DataFrame, qual: str = "qual", offset: int = 33) -> DataFrame:
    """Count and share per quality value."""
    per = (
        seqs.select(F.explode(F.split(F.col(qual), "")).alias("c"))
        .groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        .select((F.ascii("c") - offset).cast("long").alias("q"), "n")
    )
    total = per.agg(F.sum("n").alias("__t"))
    return per.crossJoin(F.broadcast(total)).select("q", "n", (F.col("n") / F.col("__t")).alias("share"))


def composition(seq: str | Column = "seq") -> dict[str, Column]:
    """Base counts and GC share of a sequence; anything but A, C, G, T counts as N."""
    # Not upper(): a case mapping may change the length of other letters.
    s = F.translate(F.col(seq) if isinstance(seq, str) else seq, "acgt", "ACGT")
    n = F.length(s)
    c = {b: n - F.length(F.replace(s, F.lit(b), F.lit(""))) for b in "ACGT"}
    return {
        **{f"n_{b.lower()}": x.cast("long") for b, x in c.items()},
        "n_n": (n - c["A"] - c["C"] - c["G"] - c["T"]).cast("long"),
        "gc": F.when(n > 0, (c["G"] + c["C"]) / n).otherwise(F.lit(0.0)),
    }


def base_histogram(chunks: DataFrame, bases: str = "bases") -> DataFrame:
    """A, C, G, T, N totals as rows, from five sums per chunk."""
    cols = composition(bases)
    sums = chunks.agg(*[F.sum(cols[f"n_{b}"]).alias(b.upper()) for b in "acgtn"])
    pairs = F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGTN"])
    return sums.select(F.explode(pairs).alias("p")).select("p.base", "p.n")
