"""Block edges: every operator that splits keys into position blocks against brute force, with tiny blocks
and one key that holds most of the rows."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandline.operators import blocks as B
from strandline.operators import intervals as I
from strandline.operators import joins as J
from strandline.operators import signal as G
from strandline.operators.scan import Run, prefix_scan


def spans(seed, n=250, top=300, longest=70):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rnd.randint(-20, top)
        rows.append(("hot" if rnd.random() < 0.7 else rnd.choice("ab"), s, s + int(rnd.random() ** 3 * longest)))
    return rows


def days(rows):
    return {(k, d) for k, s, e in rows for d in range(s, e + 1)}


def to_spans(points):
    out, prev = [], None
    for k, d in sorted(points):
        if prev and prev[0] == k and prev[2] == d - 1:
            prev[2] = d
        else:
            prev = [k, d, d]
            out.append(prev)
    return sorted(map(tuple, out))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_interval_algebra(spark, block):
    a, b = spans(1), spans(2, 120)
    schema = "k string, start long, end long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert got(I.merge_intervals(da, ["k"], block=block)) == to_spans(days(a))
    assert got(I.subtract_intervals(da, db, ["k"], block=block)) == to_spans(days(a) - days(b))
    assert got(I.intersect_intervals(da, db, ["k"], block=block)) == to_spans(days(a) & days(b))
    sweep = {}
    for k, s, e, d in I.sweep(da, ["k"], block=block).select("k", "start", "end", "depth").collect():
        for p in range(s, e + 1):
            assert (k, p) not in sweep
            sweep[k, p] = d
    depth = {}
    for k, s, e in a:
        for p in range(s, e + 1):
            depth[k, p] = depth.get((k, p), 0) + 1
    assert sweep == depth
    starts = {(k, s) for k, s, _ in a} | {(k, e + 1) for k, _, e in a}
    n = I.sweep(da, ["k"], block=block).count()
    assert n == len({(k, p) for k, p in starts if (k, p) in depth})


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_overlap_forms_agree(spark, block):
    a, b = spans(3, 150), spans(4, 100)
    da = spark.createDataFrame([(k, s, e, i) for i, (k, s, e) in enumerate(a)], "k string, start long, end long, i int")
    db = spark.createDataFrame(b, "k string, start long, end long")
    want = {i: sum(1 for kk, x, y in b if kk == k and x <= e and s <= y) for i, (k, s, e) in enumerate(a)}
    n = {r.i: r.n_overlaps for r in J.overlap_count(da, db, ["k"], block=block).collect()}
    assert n == want
    assert {r.i for r in J.overlap_semi(da, db, ["k"], block=block).collect()} == {i for i, c in want.items() if c}
    assert {r.i for r in J.overlap_anti(da, db, ["k"], block=block).collect()} == {i for i, c in want.items() if not c}
    for widths in ((4,), (4, 32), (16, 64, 256)):
        pairs = J.overlap_join(da, db.withColumnsRenamed({"start": "bs", "end": "be"}), ["k"], ("start", "end"), ("bs", "be"), widths)
        counts = {}
        for r in pairs.collect():
            counts[r.i] = counts.get(r.i, 0) + 1
        assert counts == {i: c for i, c in want.items() if c}


@pytest.mark.parametrize("block", [4, 32])
def test_prefix_scan(spark, block):
    rnd = random.Random(5)
    rows = [(k, p, rnd.randint(-5, 9)) for k in "ab" for p in sorted(rnd.sample(range(-50, 200), 90))]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    out = prefix_scan(df, ["k"], "pos", {
        "s": Run("sum", "v"), "m": Run("max", "v", inclusive=False), "nxt": Run("min", "pos", inclusive=False, reverse=True),
    }, block)
    for k in "ab":
        mine = [(p, v) for kk, p, v in rows if kk == k]
        res = {r.pos: r for r in out.where(F.col("k") == k).collect()}
        for i, (p, v) in enumerate(mine):
            assert res[p].s == sum(x for _, x in mine[: i + 1])
            assert res[p].m == (max(x for _, x in mine[:i]) if i else None)
            assert res[p].nxt == (mine[i + 1][0] if i + 1 < len(mine) else None)


def loci(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for k in ("hot", "b"):
        p, g = 1, 20
        for _ in range(n if k == "hot" else 60):
            p += 1 if rnd.random() < 0.95 else 3
            g = max(0, min(99, g + rnd.choice([-9, -3, 0, 0, 2, 5, 12])))
            rows.append((k, p, g, rnd.randint(0, 9)))
    return rows


def fold_blocks(rows, joins):
    out = []
    for k, p, g, d in rows:
        cur = out[-1] if out else None
        if cur and cur[0] == k and p == cur[2] + 1 and joins(cur, g):
            cur[2], cur[3], cur[4], cur[5] = p, min(cur[3], g), min(cur[4], d), max(cur[5], d)
        else:
            out.append([k, p, p, g, d, d, g])
    return sorted(tuple(r[:6]) for r in out)


COLS = ["k", "start", "end", "min_gq", "min_dp", "max_dp"]


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_gq_blocks(spark, block):
    rows = loci(6)
    df = spark.createDataFrame(rows, "k string, pos long, gq long, dp long")
    bands = [10, 20, 50, 99]

    def part(g):
        return sum(1 for b in bands if g >= b)

    assert got(B.gq_blocks(df, ["k"], bands, block).select(*COLS)) == fold_blocks(rows, lambda c, g: part(c[6]) == part(g))

    def upper(g):
        return next((b for b in bands if g <= b), bands[-1])

    for zero in (False, True):
        def joins(c, g):
            same = upper(g) == upper(c[3]) or (zero and c[3] == 0 and g <= 10)
            return same and abs(g - c[3]) <= 10

        d = B.gq_blocks_delta(df, ["k"], bands, 10, absorb_zero=zero, block=block)
        assert got(d.select(*COLS)) == fold_blocks(rows, joins)


@pytest.mark.parametrize("block", [9, 1 << 16])
def test_coalesce_blocks(spark, block):
    rnd = random.Random(8)
    rows = []
    for k in ("hot", "b"):
        p = 1
        for _ in range(200 if k == "hot" else 30):
            p += 0 if rnd.random() < 0.9 else 4
            n = rnd.randint(1, 5)
            rows.append((k, p, p + n - 1, rnd.choice([0, 0, 3, 8, 10, 15, 40]), 1, rnd.randint(1, 9), 0))
            p += n
    df = spark.createDataFrame(rows, "k string, start long, end long, min_gq long, min_dp long, max_dp long, band_upper long")
    want = []
    for k, s, e, g, lo, hi, _ in rows:
        c = want[-1] if want else None
        if c and c[0] == k and s == c[2] + 1 and c[3] == 0 and g <= 10:
            c[2], c[4], c[5] = e, min(c[4], lo), max(c[5], hi)
        else:
            want.append([k, s, e, g, lo, hi])
    assert got(B.coalesce_blocks(df, ["k"], [10, 20, 99], 10, block).select(*COLS)) == sorted(map(tuple, want))


def smooth(sig, kernel):
    r = (len(kernel) - 1) // 2
    out = {p: 0.0 for p in sig}
    for p, v in sig.items():
        for i, w in enumerate(kernel):
            q = p + i - r
            lo, hi = min(p, q), max(p, q)
            if q in sig and all(x in sig for x in range(lo, hi + 1)):
                out[q] += v * w
    return out


def segments(sig, thr, lo, hi):
    """Sequential reference: islands of contiguous positions, cut in order."""
    pos = sorted(sig)
    runs, cur = [], []
    for p in pos:
        if cur and p != cur[-1] + 1:
            runs.append(cur)
            cur = []
        cur.append(p)
    runs.append(cur)
    out = []
    for run in runs:
        v = [sig[p] for p in run]
        i = 0
        while i < len(v):
            act = v[i] > thr
            n = 0
            while i + n < len(v) and n < hi and (v[i + n] > thr) == act:
                n += 1
            if act and n == hi:
                best, cut = float("inf"), n - 1
                for j in range(n - 1, lo - 2, -1):
                    c = i + j
                    if c < len(v) - 1 and j >= 1 and v[c] <= v[c + 1] and v[c] < v[c - 1] and v[c] < best:
                        best, cut = v[c], j
                n = cut + 1
            out.append((run[i], run[i + n - 1], act))
            i += n
    return sorted(out)


@pytest.mark.parametrize("block", [16, 64, 1 << 14])
def test_smooth_and_segment(spark, block):
    rnd = random.Random(9)
    sig, p = {}, 1
    for _ in range(700):
        p += 1 if rnd.random() < 0.995 else 5
        sig[p] = rnd.random() if rnd.random() < 0.5 else 0.0
    kernel = G.gaussian_kernel(6, 2.0)
    df = spark.createDataFrame([("hot", p, v) for p, v in sig.items()], "k string, pos long, prob double")
    s = {r.pos: r.smoothed for r in G.band_pass(df, ["k"], kernel, block=block).collect()}
    want = smooth(sig, kernel)
    assert s.keys() == want.keys()
    assert np.allclose([s[p] for p in want], [want[p] for p in want], atol=1e-12)
    exact = spark.createDataFrame([("hot", p, v) for p, v in s.items()], "k string, pos long, smoothed double")
    for thr, lo, hi in ((0.05, 10, 40), (0.3, 5, 20)):
        res = G.segment(exact, ["k"], threshold=thr, min_size=lo, max_size=hi, block=block)
        assert got(res.select("start", "end", "is_active")) == segments(s, thr, lo, hi)


def test_kernel_defaults():
    k = G.gaussian_kernel()
    assert len(k) == 101 and abs(sum(k) - 1) < 1e-12 and k[50] == max(k)
    assert G.adaptive_size(k) == 50
    assert G.adaptive_size(G.gaussian_kernel(50, 5.0)) < 50
