"""Small worked cases: scores, fields, blocks, edges, statistics, cohort merge and joint genotypes."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from strandline.functions import genotype as G
from strandline.functions import mathx as M
from strandline.functions import strings as T
from strandline.operators import blocks as B
from strandline.operators import em as E
from strandline.operators import events as Ev
from strandline.operators import filters as X
from strandline.operators import kmers as K
from strandline.operators import pileup as P
from strandline.operators import scoring as S
from strandline.operators import stats as St
from strandline.plans import combine as C
from strandline.plans import joint as Jt


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def slow_score(r, q, h, go=1e-2, ge=1e-1, ie=0.25):
    n, w = len(r), len(h)
    m = np.zeros((n + 1, w + 1)); i_ = np.zeros_like(m); d = np.zeros_like(m)
    m[0, 0] = 1.0
    d[0, 1:] = 1.0 / w
    for a in range(1, n + 1):
        e = 10 ** (-q[a - 1] / 10)
        for b in range(1, w + 1):
            x = 0.25 if "N" in (r[a - 1], h[b - 1]) else (1 - e if r[a - 1] == h[b - 1] else e / 3)
            m[a, b] = (m[a - 1, b - 1] * (1 - 2 * go) + (i_[a - 1, b - 1] + d[a - 1, b - 1]) * go) * x
            i_[a, b] = (m[a - 1, b] * go + i_[a - 1, b] * ge) * ie
            d[a, b] = m[a, b - 1] * go + d[a, b - 1] * ge
    return math.log10((m[n, 1:] + i_[n, 1:]).sum())


def test_pair_scores(spark):
    rnd = random.Random(3)
    reads = ["".join(rnd.choice("ACGTN") for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    cands = ["".join(rnd.choice("ACGTN") for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    quals = [np.array([rnd.randint(6, 40) for _ in r]) for r in reads]
    got = S.score_batch(reads, quals, cands, S.PairModel())
    assert np.allclose(got, [slow_score(r, q, h) for r, q, h in zip(reads, quals, cands)], atol=1e-9)
    # Fixed worked pairs: ten bases of quality 32, exact and with one mismatch.
    g = S.score_batch(["ACGTACGTAC"] * 2, [np.full(10, 32.0)] * 2, ["ACGTACGTAC", "ACGTTCGTAC"], S.PairModel())
    assert abs(g[0] - -0.08934417169191465) < 1e-6 and abs(g[1] - -3.7661857661038427) < 1e-6


def test_quality_caps(spark):
    q = F.array(*[F.lit(x) for x in (5, 18, 30, 99)])
    assert one(spark, a=S.cap_qualities(q, F.lit(60), 18, False)).a == [6, 18, 30, 93]
    assert one(spark, a=S.cap_qualities(q, F.lit(25), 6)).a == [6, 18, 25, 25]
    caps = one(spark, a=F.transform(F.array(*[F.lit(x) for x in (0, 5, 20)]), lambda n: K.repeat_quality_cap(n))).a
    assert caps == [max(10, math.floor(41 - math.exp(n / (3 * math.pi)) + 0.5)) for n in (0, 5, 20)]


def test_special_functions(spark):
    for x in (0.5, 1.0, 3.25, 41.0, 1e5):
        r = one(spark, g=M.ln_gamma(F.lit(x)), d=M.digamma(F.lit(x)))
        assert abs(r.g - math.lgamma(x)) <= 1e-9 * max(1, abs(math.lgamma(x)))
        h = 1e-5 * max(1, x)
        assert abs(r.d - (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)) < 1e-4
    assert one(spark, m=M.median(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(10)))).m == 2.5
    assert one(spark, b=M.binomial_coefficient(F.lit(10), F.lit(3))).b == 120


def test_edges_and_best_paths(spark):
    reads = spark.createDataFrame([(1, [s]) for s in ["ACGTT"] * 3 + ["ACGTA"] * 2], "region int, runs array<string>")
    e = K.kmer_edges(reads, ["region"], "runs", 3)
    assert {(r.src, r.dst): r.support for r in e.collect()} == {("ACG", "CGT"): 5, ("CGT", "GTT"): 3, ("CGT", "GTA"): 2}
    ends = spark.createDataFrame([(1, "ACG", "GTT"), (1, "ACG", "GTA")], "region int, source string, sink string")
    p = K.k_best_paths(e, ends, ["region"], k=4).dropDuplicates(["path"]).orderBy("path").collect()
    assert [(r.path, round(r.score, 6)) for r in p] == [("ACGTA", round(math.log10(0.4), 6)), ("ACGTT", round(math.log10(0.6), 6))]


def test_prune_chains(spark):
    rows = [("a", "b", 5), ("b", "c", 5), ("c", "d", 1), ("d", "e", 1), ("e", "f", 5), ("c", "x", 4), ("x", "e", 1), ("p", "q", 1), ("q", "p", 1)]
    e = spark.createDataFrame([(1, *r) for r in rows], "g int, src string, dst string, support int")
    left = {(r.src, r.dst) for r in K.low_weight_prune(e, ["g"]).collect()}
    assert left == {("a", "b"), ("b", "c"), ("e", "f"), ("c", "x"), ("x", "e")}


def test_nearest_solid_and_correction(spark):
    rnd = random.Random(4)
    solid = ["".join(rnd.choice("ACGT") for _ in range(25)) for _ in range(6)]
    rows = [(1, s, 20 + i % 3) for i, s in enumerate(solid)]
    for s in solid:
        for d in (1, 2, 3):
            t = list(s)
            for i in rnd.sample(range(25), d):
                t[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[t[i]]
            rows.append((1, "".join(t), d))
    df = spark.createDataFrame(rows, "g int, kmer string, n int").groupBy("g", "kmer").agg(F.max("n").alias("n"))
    got = {r.kmer: r.solid for r in K.nearest_solid(df, ["g"], 25).collect()}
    data = [(r.kmer, r.n) for r in df.collect()]
    want = {}
    for k, n in data:
        if n >= 20:
            continue
        near = [(-c, s) for s, c in data if c >= 20 and 0 < sum(a != b for a, b in zip(k, s)) <= 2]
        if near:
            want[k] = min(near)[1]
    assert got == want
    base = "ACGTTGCAACGGTTAACCGTATTGCA"
    bad = base[:10] + "A" + base[11:] if base[10] != "A" else base[:10] + "C" + base[11:]
    reads = spark.createDataFrame([(1, i, base) for i in range(6)] + [(1, 99, bad)], "g int, read int, seq string")
    fixed = {r.read: (r.seq, r.corrected) for r in K.correct_reads(reads, ["g"], "read", "seq", k=8, minimum=5).collect()}
    assert fixed[99] == (base, [10]) and fixed[0] == (base, [])


def naive_repeat(s, o):
    def reps_back(unit, text):
        n = 0
        while text.endswith(unit) and text:
            text, n = text[: -len(unit)], n + 1
        return n

    def reps_fwd(unit, text):
        n = 0
        while text.startswith(unit) and text:
            text, n = text[len(unit):], n + 1
        return n

    bw, ub = 1, s[o]
    for u in range(1, 9):
        if o + 1 < u:
            break
        c = reps_back(s[o + 1 - u : o + 1], s[: o + 1])
        if c > 1:
            bw, ub = c, s[o + 1 - u : o + 1]
            break
    if o == len(s) - 1:
        return min(20, bw)
    fw, uf = 1, s[o + 1]
    for u in range(1, 9):
        if o + 1 + u > len(s):
            break
        c = reps_fwd(s[o + 1 : o + 1 + u], s[o + 1 :])
        if c > 1:
            fw, uf = c, s[o + 1 : o + 1 + u]
            break
    return min(20, bw + fw if uf == ub else fw + reps_back(uf, s[: o + 1]))


def test_repeats(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(60):
        s = "".join(rnd.choice(["A", "AC", "ACG", "T"]) * rnd.randint(1, 6) for _ in range(4))
        o = rnd.randrange(len(s))
        rows.append((s, o, naive_repeat(s, o)))
    df = spark.createDataFrame(rows, "s string, o int, want int")
    bad = df.withColumn("got", K.repeat_count(F.col("s"), F.col("o"))).where("got <> want").collect()
    assert not bad
    assert one(spark, n=K.longest_homopolymer(F.lit("ACCCGTTTTA"))).n == 4


def test_rank_sum_exact(spark):
    rows = [("s", True, 10.0), ("s", True, 20.0), ("s", False, 5.0), ("s", False, 6.0), ("s", False, 20.0), ("t", True, 1.0), ("u", True, 3.0), ("u", False, 3.0)]
    df = spark.createDataFrame(rows, "k string, alt boolean, v double")
    z = {r.k: r.z for r in St.rank_sum(df, ["k"], "v", F.col("alt")).collect()}
    vals, ranks = [5, 6, 10, 20, 20], [1, 2, 3, 4.5, 4.5]
    obs = 3 + 4.5 - 3
    us = [sum(c) - 3 for c in itertools.combinations(ranks, 2)]
    p = (sum(u < obs for u in us) + sum(u == obs for u in us) / 2) / len(us)
    from statistics import NormalDist

    assert abs(z["s"] - NormalDist().inv_cdf(p)) < 1e-12
    assert z["t"] is None and z["u"] == 0.0


def test_excess_het_and_fisher(spark):
    assert round(one(spark, v=St.excess_het(F.lit(0), F.lit(5), F.lit(5))).v, 6) == 2.838932
    assert one(spark, v=St.excess_het(F.lit(0), F.lit(0), F.lit(0))).v == 0.0
    assert one(spark, v=St.fisher_strand(F.lit(0), F.lit(0), F.lit(3), F.lit(4))).v == 0.0


def test_filters_and_rules(spark):
    df = spark.createDataFrame([(None, {"QD": ["1.5"]}), (50.0, {}), (50.0, {"QD": ["9", "1"]})], "qual double, info map<string,array<string>>")
    got = [r.filters for r in X.hard_filter(df, [("QD < 2.0", "QD2"), ("QUAL < 30.0", "Q30")], info="info").collect()]
    assert got == [["QD2", "Q30"], ["PASS"], ["PASS"]]
    for bad in ("QD < 2 && FS > 3", "QD", "QD < x"):
        with pytest.raises(ValueError):
            X.rule_fails(bad, ["QD"])
    with pytest.raises(ValueError):
        X.pair_rules(["QD < 1"], [])


def test_genotype_columns(spark):
    i = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(
        spark, tie=G.gq_from_pl(i(0, 0, 9)), gq=G.gq_from_pl(i(0, 120, 300)), gt=G.gt_from_pl(i(9, 4, 0, 7, 8, 9), F.lit(3)), bad=G.gt_from_pl(i(1, 0), F.lit(2)),
        pairs=F.transform(G.genotype_pairs(F.lit(3)), lambda p: F.array(p["i"], p["j"])),
        keys=G.canonical_fields(F.array(*[F.lit(x) for x in ("PS", "AD", "GT", "GT", "", "AB")])),
        trim=G.trim_alleles(F.lit(10), F.lit("CAAT"), F.lit("CAT")), shift=G.left_shift(F.lit(10), F.lit("AA"), F.lit("A"), F.lit("GTCAA")),
        hom=G.is_hom_ref(i(0, 0)), het=G.is_het(i(0, 1)), var=G.is_hom_var(i(2, 2)),
    )
    assert (r.tie, r.gq, r.gt, r.bad) == (0, 99, [1, 1], None)
    assert r.pairs == [[0, 0], [0, 1], [1, 1], [0, 2], [1, 2], [2, 2]]
    assert r["keys"] == ["GT", "AD", "AB", "PS"]
    assert (r.hom, r.het, r["var"]) == (True, True, True)
    assert r.shift.pos == 8 and r.shift.ref == "AA" and r.shift.alt == "A"
    assert len(r.trim.ref) == 2 and len(r.trim.alt) == 1


def test_string_functions(spark):
    r = one(
        spark, rc=T.reverse_complement(F.lit("AcGN")), h=T.hamming(F.lit("ACGT"), F.lit("AGGA")), n=T.hamming(F.lit("A"), F.lit("AC")),
        t=T.quality_trim(F.lit("ACGTAC"), F.lit("!I!I!!"), 20), all=T.quality_trim(F.lit("AC"), F.lit("!!"), 20), ok=T.valid_record(F.lit("ACn"), F.lit("III")),
        mq=T.mean_quality(F.lit("I!")), c=T.pattern_count(F.lit("AAAA"), "AA"), sub=T.subsequence(F.lit("ACGT"), F.lit(2), F.lit(3)), f=T.filter_bases(F.lit("AC"), F.lit("I!"), 10),
    )
    assert (r.rc, r.h, r.n, r.t.seq, r["all"].seq, r.ok, r.mq, r.c, r["sub"]) == ("NCgT", 2, None, "CGT", "AC", True, 20.0, 3, "CG")
    assert [(x.base, x.qual) for x in r.f] == [("A", 40)]


def blocks(spark, rows):
    return spark.createDataFrame(
        [("chr1", f"S{o + 1}", o, s, e, ref, alts, pl, ad, 50, 30) for o, s, e, ref, alts, pl, ad in rows],
        "contig string, sample string, input_ord long, start long, end long, ref string, alts array<string>, pl array<int>, ad array<int>, gq int, dp int",
    )


N = "<NON_REF>"


def test_combine_spanning_deletion_and_order(spark):
    b = blocks(spark, [
        (0, 10, 12, "ACG", ["A", N], [50, 0, 60, 70, 80, 90], [3, 9, 0]),
        (1, 10, 10, "A", ["T", N], [40, 0, 45, 55, 65, 75], [4, 8, 0]),
        (1, 11, 15, "C", [N], [0, 30, 300], None),
    ])
    rows = {r.start: r for r in C.combine(b).collect()}
    top = rows[10]
    assert top.ref == "ACG" and top.alts == ["TCG", "A", N]  # last sample's alternatives first
    s1, s2 = top.calls
    assert s1.pl == [50, 70, 90, 0, 80, 60, 70, 90, 80, 90] and s1.ad == [3, 0, 9, 0]
    assert s2.pl[:3] == [40, 0, 45] and s2.ad == [4, 8, 0, 0]
    assert rows[11].alts == ["*", N] and rows[11].ref == "C"
    assert rows[13].alts == [N] and rows[13].end == 15 and [c.sample for c in rows[13].calls] == ["S2"]


def test_combine_coalesces_and_rejects(spark):
    b = blocks(spark, [(0, 1, 10, "A", [N], [0, 9, 90], None), (1, 1, 4, "A", [N], [0, 8, 80], None), (1, 5, 10, "A", [N], [0, 8, 80], None)])
    rows = C.combine(b).collect()
    assert [(r.start, r.end) for r in rows] == [(1, 10)]
    with pytest.raises(Exception, match="inconsistent"):
        C.combine(blocks(spark, [(0, 1, 1, "A", [N], [0, 9, 90], None), (1, 1, 1, "C", [N], [0, 8, 80], None)])).collect()
    clip = spark.createDataFrame([("chr1", 3, 6)], "contig string, start long, end long")
    assert [(r.start, r.end) for r in C.combine(b, clip=clip).collect()] == [(3, 6)]


def test_joint_genotype(spark):
    b = blocks(spark, [(0, 10, 10, "A", ["T", N], [90, 6, 0, 95, 99, 120], [0, 30, 0]), (1, 10, 10, "A", [N], [0, 90, 900], [30, 0])])
    r = Jt.genotype(C.combine(b), confidence=10.0).collect()[0]
    # The estimated frequency outweighs the 6 Phred between het and hom-alt.
    assert r.alts == ["T"] and [c.gt for c in r.calls] == [[0, 1], [0, 0]] and [c.gq for c in r.calls] == [6, 90]
    share = E.site_em(np.array([[-9.0, -0.6, 0.0], [0.0, -9.0, -90.0]]), np.ones(2), E.pseudocounts(2), True)[0]
    f = share[1] / share.sum()
    assert -0.6 + math.log10(2 * f * (1 - f)) > 2 * math.log10(f)
    assert (r.ac, r.an, r.ns, r.dp) == ([1], 4, 2, 60) and abs(r.qd - r.qual / 30) < 1e-12
    assert Jt.genotype(C.combine(b), confidence=1e6).count() == 0
    # One sample, PL 90,6,0: the frequency always moves before the convergence test.
    counts, none, _, _ = E.site_em(np.array([[-9.0, -0.6, 0.0]]), np.ones(1), E.pseudocounts(2), True)
    assert abs(-10 * none - 78.32) < 0.01


def test_events_and_trimming(spark):
    c = spark.createDataFrame([
        (1, 0, "c", "ACGTACGT", "8M", "ACGTACGT", 100), (1, 1, "c", "ACTTACGT", "8M", "ACGTACGT", 100),
        (1, 2, "c", "ACGTGGACGT", "4M2I4M", "ACGTACGT", 100), (1, 3, "c", "ACGCGT", "3M2D3M", "ACGTACGT", 100), (1, 4, "c", "NCGTACGT", "8M", "ACGTACGT", 100),
    ], "region_id int, cand_id int, contig string, bases string, cigar string, ref_bases string, ref_start long")
    ev = Ev.candidate_events(c, ["region_id"])
    got = {(r.cand_id, r.start, r.ref, r.alt) for r in ev.collect()}
    assert got == {(1, 102, "G", "T"), (2, 103, "T", "TGG"), (3, 102, "GTA", "G")}
    reg = spark.createDataFrame([(1, 100, 107, 50, 160), (2, 300, 310, 200, 400)], "region_id int, start long, end long, padded_start long, padded_end long")
    b = {r.region_id: r for r in Ev.trim_bounds(reg, ev).collect()}
    assert (b[1].trim_start, b[1].trim_end, b[1].has_variation) == (50, 160, True) and not b[2].has_variation
    both = spark.createDataFrame([(1, 7, "c", 5, "A", "G"), (1, 7, "c", 5, "A", "ATT"), (1, 7, "c", 9, "C", "T")], "region_id int, cand_id int, contig string, start long, ref string, alt string")
    assert {(r.start, r.ref, r.alt) for r in Ev.merge_same_start(both, ["region_id"]).collect()} == {(5, "A", "GTT"), (9, "C", "T")}
    given = spark.createDataFrame([("c", 102, "G", "T"), ("c", 104, "A", "C"), ("c", 999, "A", "C")], "contig string, start long, ref string, alt string")
    regions = reg.withColumn("contig", F.lit("c"))
    e2 = Ev.add_given_alleles(ev, given, regions)
    assert {(r.start, r.alt) for r in e2.collect()} == {(102, "T"), (103, "TGG"), (102, "G"), (104, "C")}
    assert Ev.event_starts(ev).count() == 2
    sites = ev.select("region_id", "start", "ref", "alt").distinct().withColumn("allele", F.lit(1))
    al = {(r.start, r.cand_id): r.allele for r in Ev.candidate_alleles(ev, sites, c, ["region_id"]).collect()}
    assert al[102, 1] == 1 and al[102, 0] == 0 and al[103, 2] == 1
    cut = Ev.trim_candidates(c.select("region_id", "cand_id", "bases", F.lit(100).cast("long").alias("cand_start"), (F.col("cand_id") == 0).alias("is_reference")),
                             spark.createDataFrame([(1, 104, 107)], "region_id int, trim_start long, trim_end long"))
    assert cut.where("bases = 'ACGT'").first().is_reference


def test_vote_log_odds(spark):
    rows = [("c", 5, "A", 30, 20), ("c", 5, "G", 10, 2), ("c", 6, "A", 30, 10), ("c", 6, "C", 35, 9)]
    df = spark.createDataFrame(rows, "k string, pos int, base string, qual int, n long")
    got = {r.pos: r for r in P.edit_log_odds(df, ["k", "pos"]).collect()}

    def psi(x):
        h = 1e-5
        return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)

    def want(n_ref, quals):
        a = len(quals)
        f = math.exp(psi(n_ref + 1) - psi(a + 1))
        total = 0
        for q in quals:
            e = 10 ** (-q / 10)
            z = (1 - e) / (1 - e + e * f)
            total += z * (math.log(1 - e) - math.log(e)) - z * math.log(z) - (1 - z) * math.log(1 - z)
        n = n_ref + a
        return total - math.log(n + 1) - (math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n_ref + 1))

    assert got[5].plurality == "A" and abs(got[5].log_odds - want(20, [10, 10])) < 1e-4
    assert abs(got[6].log_odds - want(10, [35] * 9)) < 1e-4


def test_gates_and_emission(spark):
    s = spark.createDataFrame([([0, 0], [9, 0], 50.0), ([0, 1], [5, 4], 50.0), ([1, 1], [0, 1], 50.0), ([1, 1], [0, 2], 50.0), ([0, 1], [5, 4], 9.0)], "gt array<int>, ad array<long>, qual double")
    assert S.emission_gates(s).count() == 2
    with pytest.raises(ValueError):
        e = spark.createDataFrame([], "k string, pos long")
        B.emit(e, e, ["k"], "XYZ")


def test_left_shift_as_far_as_it_goes(spark):
    cases = [  # pos, ref, alt, upstream and the result
        (200, "AA", "A", "C" + "A" * 100, (100, "AA", "A")), (10, "CAA", "A", "GTAAA", (8, "AAC", "A")), (10, "ACG", "A", "CGCG", (10, "ACG", "A")),
        (10, "A", "AA", "TTCAA", (8, "A", "AA")), (10, "CAT", "CAAT", "GG", (12, "T", "AT")), (3, "AA", "A", "AA", (1, "AA", "A")),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, pos int, ref string, alt string, up string")
    got = df.select("i", G.left_shift(F.col("pos"), F.col("ref"), F.col("alt"), F.col("up")).alias("s")).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == [c[4] for c in cases]
    with pytest.raises(Exception):
        one(spark, s=G.left_shift(F.lit(50), F.lit("AA"), F.lit("A"), F.lit("AAAA")))


def test_best_paths_past_any_length_and_round_cycles(spark):
    n = 30
    line = [(1, f"a{i:03d}", f"a{i + 1:03d}", 1) for i in range(n)]
    cycle = [(2, "x", "y", 1), (2, "y", "x", 1), (2, "y", "z", 3)]
    e = spark.createDataFrame(line + cycle, "region int, src string, dst string, support int")
    ends = spark.createDataFrame([(1, "a000", f"a{n:03d}"), (2, "x", "z")], "region int, source string, sink string")
    p = K.k_best_paths(e, ends, ["region"], k=2).orderBy("region", "rank").collect()
    assert [r.region for r in p] == [1, 2, 2]
    assert len(p[0].path) == 4 + n and [r.path for r in p[1:]] == ["xyz", "xyxyz"]


def test_no_comparison_with_nan_holds(spark):
    from strandline.operators.filters import hard_filter

    df = spark.createDataFrame([(float("nan"),), (70.0,)], "FS double")
    rules = [("FS > 60", "high"), ("FS != 5", "other")]
    assert [r.filters for r in hard_filter(df, rules).collect()] == [["PASS"], ["high", "other"]]


def test_adaptive_prune_follows_the_heavy_chain(spark):
    from strandline.operators.pruning import adaptive_prune

    # A heavy way s-a-b-c-e-t, a bubble over d seen once, and a cycle p-q that nothing reaches.
    rows = [("s", "a", 50), ("a", "b", 50), ("b", "c", 49), ("b", "d", 1), ("c", "e", 49), ("d", "e", 1), ("e", "t", 50), ("p", "q", 1), ("q", "p", 1)]
    e = spark.createDataFrame([(1, *r) for r in rows] + [(2, "s", "a", 3)], "g int, src string, dst string, support long")
    kept = {(r.g, r.src, r.dst) for r in adaptive_prune(e, ["g"], log_odds=-6.0).collect()}
    assert (2, "s", "a") in kept and {(1, "s", "a"), (1, "a", "b"), (1, "e", "t"), (1, "b", "c"), (1, "c", "e")} <= kept
    assert not kept & {(1, "p", "q"), (1, "q", "p")}
    assert {(r.g, r.src) for r in adaptive_prune(e, ["g"]).collect() if r.g == 2} == {(2, "s")}


def test_paths_with_ties_and_cycles(spark):
    from strandline.operators.paths import k_best_paths

    # Two equal ways to t, and a loop at c that may be walked any number of times.
    rows = [("s", "a", 1), ("s", "b", 1), ("a", "c", 2), ("b", "c", 2), ("c", "c", 1), ("c", "t", 1)]
    e = spark.createDataFrame([(1, *r) for r in rows], "g int, src string, dst string, support long")
    ends = spark.createDataFrame([(1, "s", "t")], "g int, source string, sink string")
    p = k_best_paths(e, ends, ["g"], k=5).orderBy("rank").collect()
    assert [(r.path, round(r.score, 6)) for r in p] == [
        (path, round(math.log10(x), 6)) for path, x in (("sact", 0.25), ("sbct", 0.25), ("sacct", 0.125), ("sbcct", 0.125), ("saccct", 0.0625))
    ]
