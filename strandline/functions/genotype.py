"""Diploid genotype arrays as Column functions.

A genotype (i, j) with i <= j sits at index j*(j+1)/2 + i of a PL array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_REF, SPAN_DEL, NO_CALL = "<NON_REF>", "*", "."


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once: inside a lambda an expression is otherwise evaluated again
    for every element and every mention."""
    return F.transform(F.array(value), fn)[0]


def genotype_index(a: Column, b: Column) -> Column:
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (F.floor(hi * (hi + 1) / 2) + lo).cast("int")


def over_pairs(n: Column, fn) -> Column:
    """``fn(i, j)`` for every genotype of ``n`` alleles, in PL order."""
    top = (n - 1).cast("int")
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), top), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: fn(i, j))
        )
    )


def genotype_pairs(n: Column) -> Column:
    return over_pairs(n, lambda i, j: F.struct(i.alias("i"), j.alias("j")))


def pair_of_index(g: Column) -> Column:
    j = F.floor((F.sqrt(g.cast("double") * 8 + 1) - 1) / 2).cast("int")
    return F.array(g.cast("int") - F.floor(j * (j + 1) / 2).cast("int"), j)


def gq_from_pl(pl: Column) -> Column:
    """Gap between the two smallest values, at most 99; 0 when the minimum is tied or nothing is there."""
    gap = let(F.array_sort(pl), lambda s: F.try_element_at(s, F.lit(2)) - F.try_element_at(s, F.lit(1)))
    return F.when(F.size(pl) == 0, F.lit(0)).otherwise(F.coalesce(F.least(gap, F.lit(99)), F.lit(0)))


def gt_from_pl(pl: Column, n_alleles: Column) -> Column:
    """Genotype of the first minimum; null when the length does not fit the allele count."""
    fits = F.size(pl) == F.floor(n_alleles * (n_alleles + 1) / 2)
    return F.when(fits & (F.size(pl) > 0), pair_of_index(F.array_position(pl, F.array_min(pl)) - 1))


def pl_from_gl(gl: Column) -> Column:
    """round(-10 * (gl - max)), anchored at 0; half rounds away from zero."""
    def scaled(v: Column) -> Column:
        return let(
            F.array_max(v),
            lambda top: F.transform(v, lambda x: F.greatest(F.lit(0), F.round(F.lit(-10.0) * (x - top)).cast("int"))),
        )

    return let(gl, lambda v: anchored(scaled(v)))


def anchored(pl: Column) -> Column:
    """Shift so that the smallest value is 0."""
    return let(pl, lambda v: let(F.array_min(v), lambda low: F.transform(v, lambda x: x - low)))


def sum_ints(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)


def index_map(alleles: Column, target: Column) -> Column:
    """For each target allele its place in ``alleles`` (0-based), else the place of the symbolic allele.

    The reference maps to itself. A row without the symbolic allele is an error.
    """
    def mapped(al: Column, fallback: Column) -> Column:
        guard = F.when(fallback == 0, F.raise_error(F.lit("row lacks <NON_REF>")).cast("long")).otherwise(fallback)
        return F.transform(
            target,
            lambda t, i: F.when(i == 0, F.lit(0)).otherwise(
                (F.coalesce(F.nullif(F.array_position(al, t), F.lit(0).cast("long")), guard) - 1).cast("int")
            ),
        )

    return let(alleles, lambda al: let(F.array_position(al, NON_REF), lambda f: mapped(al, f)))


def remap_pl(pl: Column, mapping: Column) -> Column:
    return F.when(
        pl.isNotNull(),
        let(
            mapping,
            lambda m: over_pairs(F.size(m), lambda i, j: F.element_at(pl, genotype_index(m[i], m[j]) + 1)),
        ),
    )


def remap_ad(ad: Column, mapping: Column) -> Column:
    """Depths by mapped index; an index past the end is 0."""
    return F.when(ad.isNotNull(), F.transform(mapping, lambda o: F.coalesce(F.try_element_at(ad, o + 1), F.lit(0))))


def kept_index(alleles: Column) -> Column:
    """New index of each allele once the symbolic one is dropped; null for the dropped one."""
    return F.transform(
        alleles,
        lambda a, i: F.when(
            a != NON_REF, i - F.size(F.filter(F.slice(alleles, F.lit(1), i + 1), lambda x: x == NON_REF))
        ),
    )


def without_symbolic(alleles: Column) -> Column:
    return F.filter(alleles, lambda a: a != NON_REF)


def drop_symbolic_pl(pl: Column, alleles: Column) -> Column:
    """Each kept genotype takes the smallest value among the old ones that fold onto it.

    A genotype with one dropped allele folds onto hom and het-with-ref of the other; with two, onto hom-ref.
    Nothing folding there gives the largest old value. Re-anchored at 0; null on a wrong length.
    """
    def folds(x: Column, ni: Column, nj: Column) -> Column:
        a, b = x["a"], x["b"]
        one = F.coalesce(a, b)
        return (
            F.when(a.isNotNull() & b.isNotNull(), (F.least(a, b) == ni) & (F.greatest(a, b) == nj))
            .when(a.isNull() & b.isNull(), (ni == 0) & (nj == 0))
            .otherwise(((ni == one) & (nj == one)) | ((ni == 0) & (nj == one)))
        )

    def folded(z: Column) -> Column:
        return over_pairs(
            F.size(without_symbolic(alleles)),
            lambda ni, nj: F.coalesce(
                F.array_min(F.transform(F.filter(z, lambda x: folds(x, ni, nj)), lambda x: x["v"])), F.array_max(pl)
            ),
        )

    n_old = F.size(alleles)
    old = let(
        kept_index(alleles), lambda k: over_pairs(n_old, lambda i, j: F.struct(k[i].alias("a"), k[j].alias("b")))
    )
    zipped = F.zip_with(old, pl, lambda g, v: F.struct(g["a"].alias("a"), g["b"].alias("b"), v.alias("v")))
    fits = F.size(pl) == F.floor(n_old * (n_old + 1) / 2)
    return F.when(fits, anchored(let(zipped, folded)))


def drop_symbolic_ad(ad: Column, alleles: Column) -> Column:
    n_new = F.size(without_symbolic(alleles))

    def summed(kept: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n_new - 1),
            lambda i: F.coalesce(F.try_element_at(ad, F.array_position(kept, i).cast("int")), F.lit(0)),
        )

    return F.when(ad.isNotNull(), let(kept_index(alleles), summed))


def subset_alleles(pl: Column, ad: Column, gt: Column, alleles: Column) -> Column:
    """Keep the reference and the called alternatives: struct of alleles, pl (re-anchored), ad and gt."""
    def cut(keep: Column) -> Column:
        return F.struct(
            F.transform(keep, lambda i: alleles[i]).alias("alleles"),
            anchored(remap_pl(pl, keep)).alias("pl"),
            F.transform(keep, lambda i: F.coalesce(F.try_element_at(ad, i + 1), F.lit(0))).alias("ad"),
            F.transform(gt, lambda g: F.when(g < 0, g).otherwise((F.array_position(keep, g) - 1).cast("int"))).alias("gt"),
        )

    keep = F.filter(F.sequence(F.lit(0), F.size(alleles) - 1), lambda i: (i == 0) | F.array_contains(gt, i))
    return let(keep, cut)


def extend_alt(alt: Column, ref: Column, longest: Column) -> Column:
    """Bring an alternative of a shorter reference onto the longest one; symbolic alleles stay."""
    extra = F.length(longest) - F.length(ref)
    symbolic = alt.isin(NON_REF, SPAN_DEL, NO_CALL)
    return F.when(symbolic | (extra <= 0), alt).otherwise(F.concat(alt, F.right(longest, extra)))


def spanning_alt(alt: Column, ref: Column) -> Column:
    return F.when(alt == NON_REF, alt).when(F.length(alt) < F.length(ref), F.lit(SPAN_DEL)).otherwise(F.lit(NO_CALL))


def spanning_deletion(event_start: Column, site: Column, alt: Column) -> Column:
    """An event that began before the site shows there as ``*``."""
    return F.when(event_start < site, F.lit(SPAN_DEL)).otherwise(alt)


def trim_alleles(pos: Column, ref: Column, alt: Column) -> Column:
    """Strip the shared head, then the shared tail, leaving at least one base on both sides."""

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b)) - 1
        seq = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(seq, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.left(a, i) == F.left(b, i)), i).otherwise(acc))

    h = shared(ref, alt)
    r1, a1 = F.substr(ref, h + 1), F.substr(alt, h + 1)
    t = shared(F.reverse(r1), F.reverse(a1))
    return F.struct(
        (pos + h).alias("pos"), F.left(r1, F.length(r1) - t).alias("ref"), F.left(a1, F.length(a1) - t).alias("alt")
    )


def left_shift(pos: Column, ref: Column, alt: Column, upstream: Column, strict: bool = True) -> Column:
    """Trim, then slide an indel left while both alleles end in the base before them. ``upstream`` holds the bases just
    before ``pos``. A slide that reaches its start before position 1 could go on: it is an error, or, if not ``strict``,
    told by a further field ``open``.

    After trimming, alleles with a common last base x have one of them equal to x. Each slide takes one x from the
    end of the longer allele and one from the upstream run of x, so the distance is the shorter of the two runs, or
    the upstream run where the longer allele is all x.
    """
    return let(trim_alleles(pos, ref, alt), lambda t: _slid(pos, ref, t, upstream, strict))


def _slid(pos: Column, ref: Column, t: Column, upstream: Column, strict: bool) -> Column:
    r, a, up = t["ref"], t["alt"], F.concat(upstream, F.left(ref, (t["pos"] - pos).cast("int")))
    x = F.right(r, F.lit(1))
    longer = F.when(F.length(r) > F.length(a), r).otherwise(a)
    tail = F.length(longer) - F.length(F.rtrim(longer, x))
    before = F.length(up) - F.length(F.rtrim(up, x))
    far = F.when(tail == F.length(longer), before).otherwise(F.least(before, tail))
    movable = (F.length(r) != F.length(a)) & (F.right(a, F.lit(1)) == x)
    n = F.when(movable, far).otherwise(0)
    more = movable & (n == F.length(up)) & (t["pos"] - n > 1) & ((tail == F.length(longer)) | (n < tail))
    if strict:
        n = F.when(more, F.raise_error(F.lit("the upstream bases end inside the repeat")).cast("int")).otherwise(n)
    moved = lambda v: F.concat(F.repeat(x, n), F.left(v, F.length(v) - n))
    whole = lambda v: F.when(F.length(v) == F.length(longer), F.when(tail == F.length(longer), v).otherwise(moved(v))).otherwise(v)
    told = [] if strict else [more.alias("open")]
    return F.struct((t["pos"] - n).alias("pos"), whole(r).alias("ref"), whole(a).alias("alt"), *told)


def is_hom_ref(gt: Column) -> Column:
    return F.forall(gt, lambda a: a == 0)


def is_het(gt: Column) -> Column:
    return F.forall(gt, lambda a: a >= 0) & F.exists(gt, lambda a: a != gt[0])


def is_hom_var(gt: Column) -> Column:
    return F.forall(gt, lambda a: (a > 0) & (a == gt[0]))


def phasing_fields(gt: Column, enabled: Column, phase_set: Column) -> Column:
    """GT text, PGT, PID and PS: phased only when enabled, the set is known, and the call is a full diploid het."""
    phased = enabled & phase_set.isNotNull() & (F.size(gt) == 2) & (gt[0] != gt[1]) & F.forall(gt, lambda a: a >= 0)
    tokens = F.transform(gt, lambda a: F.when(a < 0, F.lit(".")).otherwise(a.cast("string")))
    text = F.when(phased, F.array_join(tokens, "|")).otherwise(F.array_join(tokens, "/"))
    return F.struct(
        text.alias("gt"),
        F.when(phased, text).alias("pgt"),
        F.when(phased, F.concat_ws("_", phase_set.cast("string"), gt[0].cast("string"), gt[1].cast("string"))).alias("pid"),
        F.when(phased, phase_set).alias("ps"),
        F.coalesce(phased, F.lit(False)).alias("phased"),
    )


def canonical_fields(keys: Column) -> Column:
    """GT, GQ, DP, AD, PL first when present, then the rest in order, without repeats or blanks."""
    lead = F.array(*[F.lit(k) for k in ("GT", "GQ", "DP", "AD", "PL")])
    have = F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.length(k) > 0)))
    return F.concat(F.array_intersect(lead, have), F.array_except(have, lead))
