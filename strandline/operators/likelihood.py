"""Reference-versus-anything likelihoods, activity and reference confidence per position.

All per-observation terms are plain sums, so a position holding a third of all observations is folded
map-side before anything moves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.mathx import LOG10_2, LOG10_THIRD, log10_correct, log10_error, log10_sum_pair, round_half_up


@dataclass(frozen=True)
class ActivityModel:
    """Fixed values of the activity model; priors follow from heterozygosity and its deviation."""

    min_base_quality: int = 10
    deletion_quality: int = 30
    ploidy: int = 2
    heterozygosity: float = 1e-3
    indel_heterozygosity: float = 1.0 / 8000.0
    heterozygosity_sd: float = 0.01
    clip_mean_threshold: float = 6.0

    @property
    def ref_pseudocount(self) -> float:
        return self.heterozygosity / self.heterozygosity_sd**2

    @property
    def snp_pseudocount(self) -> float:
        return self.heterozygosity * self.ref_pseudocount

    @property
    def indel_pseudocount(self) -> float:
        return self.indel_heterozygosity * self.ref_pseudocount

    def log10_priors(self) -> list[float]:
        """Beta-binomial prior of 0..ploidy alternative copies; constants, computed once."""
        p, a, b = self.ploidy, self.snp_pseudocount, self.ref_pseudocount
        return [
            (
                math.lgamma(p + 1) - math.lgamma(n + 1) - math.lgamma(p - n + 1)
                + math.lgamma(n + a) + math.lgamma(p - n + b)
            ) / math.log(10.0)
            for n in range(p + 1)
        ]


def _term(is_alt: Column, q: Column) -> tuple[Column, Column]:
    right, wrong = log10_correct(q), log10_error(q) + LOG10_THIRD
    return F.when(is_alt, wrong).otherwise(right), F.when(is_alt, right).otherwise(wrong)


def _genotype_term(is_alt: Column, q: Column, i: int, p: int) -> Column:
    """Log10 likelihood of an observation under ``i`` of ``p`` alternative copies, times ``p``."""
    ref, alt = _term(is_alt, q)
    if i in (0, p):
        return (alt if i else ref) + math.log10(p)
    return log10_sum_pair(ref + math.log10(p - i), alt + math.log10(i))


QUALITIES = 256  # whole qualities whose terms are looked up


@lru_cache(maxsize=64)
def _term_table(i: int, p: int) -> str:
    """The values of ``_genotype_term`` for whole qualities, those of the reference first, as an SQL array."""
    def term(is_alt: bool, q: int) -> float:
        right, wrong = math.log10(1.0 - 10.0 ** (-q / 10.0)) if q > 0 else -math.inf, q / -10.0 + LOG10_THIRD
        ref, alt = (wrong, right) if is_alt else (right, wrong)
        if i in (0, p):
            return (alt if i else ref) + math.log10(p)
        big, small = sorted((ref + math.log10(p - i), alt + math.log10(i)), reverse=True)
        near = small != -math.inf and big - small < 8.0
        return big + math.log10(1.0 + 10.0 ** -(math.floor((big - small) * 10000.0 + 0.5) / 10000.0)) if near else big

    values = [term(is_alt, q) for is_alt in (False, True) for q in range(QUALITIES)]
    return "array(" + ", ".join("double('-Infinity')" if v == -math.inf else f"{v!r}D" for v in values) + ")"


def _looked_up(is_alt: Column, q: Column, i: int, p: int) -> Column:
    """``_genotype_term`` by a constant table; other than whole qualities of the table are worked out. The lambda keeps
    that rare way out of the generated code, which it would make too long to be compiled."""
    whole = q.cast("int")
    inside = (whole == q) & (whole >= 0) & (whole < QUALITIES)
    found = F.get(F.expr(_term_table(i, p)), whole + F.when(is_alt, QUALITIES).otherwise(0))
    return F.when(inside, found).otherwise(F.transform(F.array(q), lambda x: _genotype_term(is_alt, x, i, p))[0])


def ref_vs_any(
    obs: DataFrame,
    keys: Sequence[str],
    is_alt: str = "is_alt",
    qual: str = "qual",
    is_deletion: str | None = "is_deletion",
    model: ActivityModel = ActivityModel(),
    extra: Sequence[Column] = (),
    weight: Column | None = None,
) -> DataFrame:
    """``gl`` (log10 likelihood of 0..ploidy alternative copies), ``dp`` and ``n_used`` per key. ``weight`` is how many
    observations a row stands for, by default one."""
    p = model.ploidy
    dele = F.col(is_deletion) if is_deletion else F.lit(False)
    q = F.when(dele, F.lit(model.deletion_quality)).otherwise(F.col(qual))
    used = dele | (q >= model.min_base_quality)
    parts = []
    for i in range(p + 1):
        t = _looked_up(F.col(is_alt), q, i, p)
        parts.append(F.sum(F.when(used, t if weight is None else t * weight)).alias(f"__g{i}"))
    agg = obs.groupBy(*keys).agg(
        *parts,
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("dp"),
        F.count(F.when(used, 1)).alias("n_used") if weight is None else F.coalesce(F.sum(F.when(used, weight)), F.lit(0)).alias("n_used"),
        *extra,
    )
    gl = F.array(
        *[F.coalesce(F.col(f"__g{i}"), F.lit(0.0)) - F.col("n_used") * math.log10(p) for i in range(p + 1)]
    )
    return agg.withColumn("gl", gl).drop(*[f"__g{i}" for i in range(p + 1)])


def gl_to_pl(gl: Column) -> Column:
    """Integer Phred scale anchored at the best genotype."""
    return F.transform(gl, lambda x: round_half_up(F.lit(-10.0) * (x - F.array_max(gl))))


def pl_to_gl(pl: Column) -> Column:
    return F.transform(pl, lambda x: x.cast("double") / F.lit(-10.0))


def non_ref_posterior(gl: Column, model: ActivityModel = ActivityModel()) -> Column:
    """1 - P(no alternative copy); 0 when the reference is already the best genotype, with or without prior."""
    priors = model.log10_priors()
    each = [gl[i] for i in range(len(priors))]
    post = [g + prior for g, prior in zip(each, priors)]

    def ref_best(v: list[Column]) -> Column:
        return v[0] >= F.greatest(*v)

    top = F.greatest(*post)
    powers = [F.pow(F.lit(10.0), x - top) for x in post]
    norm = sum(powers[1:], powers[0])
    return F.when(ref_best(each) | ref_best(post), F.lit(0.0)).otherwise(F.lit(1.0) - powers[0] / norm)


def any_non_ref(per_sample: DataFrame, keys: Sequence[str], p: str = "posterior", out: str = "any_posterior") -> DataFrame:
    """1 - product of (1 - p) over samples, through a sum of logs with certain samples set aside."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col(p)))
    agg = per_sample.groupBy(*keys).agg(
        F.max(F.when(c <= 0, 1).otherwise(0)).alias("__sure"),
        F.sum(F.when(c > 0, F.ln(c))).alias("__ln"),
    )
    return agg.select(
        *keys,
        F.when(F.col("__sure") == 1, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.coalesce("__ln", F.lit(0.0)))).alias(out),
    )


def genotype_quality(gl: Column) -> Column:
    """-10 * (second best - best), rounded, 0..99; 0 when either is infinite."""
    s = F.sort_array(gl, asc=False)
    best, second = s[0], s[1]
    q = F.least(F.lit(99), F.greatest(F.lit(0), round_half_up(F.lit(-10.0) * (second - best))))
    broken = (F.abs(best) == float("inf")) | (F.abs(second) == float("inf"))
    return F.when(F.size(gl) < 2, F.lit(0)).when(broken, F.lit(0)).otherwise(q).cast("long")


def cap_by_hom_ref(gl: Column) -> Column:
    return F.transform(gl, lambda x: F.least(x, gl[0]))


def hom_ref_quality(gl: Column, ploidy: int) -> Column:
    """``genotype_quality`` of the likelihoods capped at hom-ref: hom-ref is the best of them, and nothing is sorted."""
    best = gl[0]
    others = [F.least(gl[i], best) for i in range(1, ploidy + 1)]
    second = F.greatest(*others) if len(others) > 1 else others[0]
    q = F.least(F.lit(99), F.greatest(F.lit(0), round_half_up(F.lit(-10.0) * (second - best))))
    broken = (F.abs(best) == float("inf")) | (F.abs(second) == float("inf"))
    return F.when(broken, F.lit(0)).otherwise(q).cast("long")


def confidence_loci(obs: DataFrame, keys: Sequence[str], starts: Column | None = None, **kw) -> DataFrame:
    """Reference confidence per position: GQ from likelihoods capped at hom-ref, DP = all observations. ``starts`` marks
    the observations in which a variant starts; deleted bases left out, their likelihoods against the others are added as
    ``pl``, their number as ``n_starts``."""
    model = kw.get("model", ActivityModel())
    extra = [] if starts is None else [*_start_sums(starts, model), F.count(F.when(starts, 1)).alias("n_starts")]
    m = ref_vs_any(obs, keys, extra=extra, **kw)
    more = []
    if starts is not None:
        gl = [F.col(f"__s{i}") for i in range(model.ploidy + 1)]
        more = [F.array(*[round_half_up(F.lit(-10.0) * (g - F.greatest(*gl))) for g in gl]).alias("pl"), F.col("n_starts")]
    return m.select(*keys, hom_ref_quality(F.col("gl"), model.ploidy).alias("gq"), F.col("dp"), *more)


def _start_sums(starts: Column, model: ActivityModel) -> list[Column]:
    p, q = model.ploidy, F.col("qual")
    used = ~F.col("is_deletion") & (q >= model.min_base_quality)
    return [
        F.coalesce(F.sum(F.when(used, _looked_up(starts, q, i, p) - math.log10(p))), F.lit(0.0)).alias(f"__s{i}") for i in range(p + 1)
    ]


def activity_states(
    obs: DataFrame,
    keys: Sequence[str],
    next_to_clip: str | None = None,
    clip_bases: str | None = None,
    model: ActivityModel = ActivityModel(),
    is_alt: str = "is_alt",
    qual: str = "qual",
    is_deletion: str | None = "is_deletion",
) -> DataFrame:
    """``prob``, ``original`` (best minus hom-ref) and ``clip`` (spread evidence, null when plain)."""
    extra = []
    if next_to_clip:
        dele = F.col(is_deletion) if is_deletion else F.lit(False)
        used = dele | (F.col(qual) >= model.min_base_quality)
        extra = [F.avg(F.when(used & F.col(is_alt) & F.col(next_to_clip), F.col(clip_bases))).alias("__clip")]
    m = ref_vs_any(obs, keys, is_alt, qual, is_deletion, model, extra)
    raw = [F.col("gl")[i] for i in range(model.ploidy + 1)]
    # By way of whole Phred values, as `pl_to_gl(gl_to_pl(gl))`.
    gl = [round_half_up(F.lit(-10.0) * (g - F.greatest(*raw))).cast("double") / F.lit(-10.0) for g in raw]
    clip = (
        F.when(F.col("__clip") > model.clip_mean_threshold, F.floor("__clip").cast("int")) if next_to_clip
        else F.lit(None).cast("int")
    )
    m = m.withColumn("__gl", F.array(*gl))
    return m.select(
        *keys,
        non_ref_posterior(F.col("__gl"), model).alias("prob"),
        (F.greatest(*[F.col("__gl")[i] for i in range(model.ploidy + 1)]) - F.col("__gl")[0]).alias("original"),
        clip.alias("clip"),
        "dp",
    )


def genotype_posteriors(gl: Column) -> Column:
    """Fixed diploid prior: hom-ref 1 - 1e-3 - 5e-4, het 1e-3, hom-alt 5e-4."""
    prior = [math.log10(1 - 1e-3 - 5e-4), math.log10(1e-3), math.log10(5e-4)]
    post = F.array(*[gl[i] + prior[i] for i in range(3)])
    top = F.array_max(post)
    norm = F.aggregate(post, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top))
    return F.transform(post, lambda x: F.pow(F.lit(10.0), x - top) / norm)


__all__ = [
    "ActivityModel", "LOG10_2", "activity_states", "any_non_ref", "cap_by_hom_ref", "confidence_loci",
    "genotype_posteriors", "genotype_quality", "gl_to_pl", "hom_ref_quality", "non_ref_posterior", "pl_to_gl", "ref_vs_any",
]
