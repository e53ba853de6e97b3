"""Callset comparison and quality against a truth set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import overlap_semi

KEY = ["contig", "pos", "ref", "alt"]


def normalize_callset(
    rows: DataFrame, order: Sequence[str] = ("ord",), gt: str = "gt", fields: str = "fields"
) -> DataFrame:
    """One row per alternative: contig without ``chr``, upper-case alleles, ``.`` and ``*`` dropped, phase
    separators unified. On a repeated key the last row in ``order`` wins."""
    x = rows.where(F.col("alt") != ".").select(
        F.regexp_replace(F.trim("contig"), "^chr", "").alias("contig"), "pos", F.upper("ref").alias("ref"),
        F.explode(F.split(F.upper("alt"), ",")).alias("alt"), F.replace(F.col(gt), F.lit("|"), F.lit("/")).alias("gt"),
        F.col(fields).alias("fields"), F.struct(*order).alias("__o"),
    )
    x = x.where(~F.col("alt").isin("*", ""))
    return x.groupBy(*KEY).agg(F.max_by(F.struct("gt", "fields"), "__o").alias("v")).select(*KEY, "v.gt", "v.fields")


def _within(a: Column, b: Column, tol: int) -> Column:
    x, y = a.try_cast("long"), b.try_cast("long")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tol).otherwise(a == b)


def fields_equal(a: Column, b: Column, tol: int) -> Column:
    """Equal field maps, except that AD (element-wise) and DP may differ by up to ``tol``."""
    if tol == 0:
        return F.map_entries(a).eqNullSafe(F.map_entries(b))
    keys = F.array_union(F.map_keys(a), F.map_keys(b))

    def same(k: Column) -> Column:
        x = F.coalesce(F.try_element_at(a, k), F.lit("."))
        y = F.coalesce(F.try_element_at(b, k), F.lit("."))
        xs, ys = F.split(x, ","), F.split(y, ",")
        lists = (F.size(xs) == F.size(ys)) & F.forall(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: _within(p["x"], p["y"], tol))
        return F.when(k == "AD", lists).when(k == "DP", _within(x, y, tol)).otherwise(x == y)

    return F.forall(keys, same)


def compare_callsets(a: DataFrame, b: DataFrame, tol: int = 0) -> DataFrame:
    """One row of counts from one full outer join of two normalised callsets."""
    x = a.select(*KEY, F.struct("gt", "fields").alias("a"))
    y = b.select(*KEY, F.struct("gt", "fields").alias("b"))
    j = x.join(y, KEY, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same_gt = F.col("a.gt") == F.col("b.gt")
    same = fields_equal(F.col("a.fields"), F.col("b.fields"), tol)
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(
        n(F.col("a").isNotNull()).alias("a_sites"),
        n(F.col("b").isNotNull()).alias("b_sites"),
        n(both & same_gt & same).alias("identical"),
        n(both & ~same_gt).alias("genotype_differs"),
        n(both & same_gt & ~same).alias("fields_differ"),
        n(F.col("b").isNull()).alias("only_a"),
        n(F.col("a").isNull()).alias("only_b"),
    )


def precision_recall(
    calls: DataFrame, truth: DataFrame, key: Sequence[str], groups: Sequence[str], confident: DataFrame | None = None,
    contig: str = "contig", pos: str = "pos",
) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 per group by exact key, inside the confident spans if given."""
    key, groups = list(key), list(groups)
    if confident is not None:
        calls = overlap_semi(calls.withColumn("__p", F.col(pos)), confident, [contig], (pos, "__p")).drop("__p")
        truth = overlap_semi(truth.withColumn("__p", F.col(pos)), confident, [contig], (pos, "__p")).drop("__p")
    cols = key + [g for g in groups if g not in key]
    side = calls.select(*cols, F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(
        truth.select(*cols, F.lit(0).alias("c"), F.lit(1).alias("t"))
    )
    per = side.groupBy(*cols).agg(F.max("c").alias("c"), F.max("t").alias("t"))
    g = per.groupBy(*groups).agg(
        F.count(F.when((F.col("c") == 1) & (F.col("t") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("c") == 1) & (F.col("t") == 0), 1)).alias("fp"),
        F.count(F.when((F.col("c") == 0) & (F.col("t") == 1), 1)).alias("fn"),
    )
    tp = F.col("tp").cast("double")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return g.select(
        *groups, "tp", "fp", "fn", ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"),
        ratio(tp * 2, tp * 2 + F.col("fp") + F.col("fn")).alias("f1"),
    )


def f1_delta_gate(a: DataFrame, b: DataFrame, groups: Sequence[str], threshold: float) -> DataFrame:
    """Per group the F1 difference and whether it stays within the threshold; a missing group counts as 0."""
    groups = list(groups)
    j = a.select(*groups, F.col("f1").alias("f1_a")).join(b.select(*groups, F.col("f1").alias("f1_b")), groups, "full_outer")
    d = F.coalesce("f1_b", F.lit(0.0)) - F.coalesce("f1_a", F.lit(0.0))
    return j.select(*groups, d.alias("delta"), (F.abs(d) <= threshold).alias("passes"))


def gate_summary(gate: DataFrame) -> DataFrame:
    return gate.agg(F.max(F.abs("delta")).alias("max_abs_delta"), F.min("passes").alias("passes"))


def strict_diff(a: DataFrame, b: DataFrame, line: str = "value", volatile: str = r"^##(?:source|.*CommandLine|fileDate)") -> DataFrame:
    """Lines on one side only, after dropping volatile header lines; repeated lines count."""
    x = a.where(~F.col(line).rlike(volatile)).groupBy(line).agg(F.count(F.lit(1)).alias("n"))
    y = b.where(~F.col(line).rlike(volatile)).groupBy(line).agg(F.count(F.lit(1)).alias("m"))
    j = x.join(y, line, "full_outer").select(line, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    side = F.when(F.col("n") > F.col("m"), "a").otherwise("b")
    return j.where(F.col("n") != F.col("m")).select(side.alias("side"), line, F.abs(F.col("n") - F.col("m")).alias("n"))


def compare_sites(a: DataFrame, b: DataFrame, key: Sequence[str], qual_tol: float = 20.0) -> DataFrame:
    """Cohort comparison per site: alleles, genotypes and QUAL within a tolerance. Sides hold ``alts, gts, qual``."""
    key = list(key)
    x = a.select(*key, F.struct("alts", "gts", "qual").alias("a"))
    y = b.select(*key, F.struct("alts", "gts", "qual").alias("b"))
    status = (
        F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b")
        .when(~F.col("a.alts").eqNullSafe(F.col("b.alts")), "alleles")
        .when(~F.col("a.gts").eqNullSafe(F.col("b.gts")), "genotypes")
        .when(F.abs(F.coalesce(F.col("a.qual"), F.lit(0.0)) - F.coalesce(F.col("b.qual"), F.lit(0.0))) > qual_tol, "qual")
        .otherwise("same")
    )
    return x.join(y, key, "full_outer").select(*key, status.alias("status"))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``: an aggregate, so repeated keys fold before the shuffle."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return g.select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])
