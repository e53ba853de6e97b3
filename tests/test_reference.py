"""Windows over chunk borders, long repeats, ranked alleles and the order check, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import reference as R
from strandline.operators import sampling as S


@pytest.fixture(scope="module")
def contigs(spark):
    rnd = random.Random(4)
    text = {"a": "G" + "AC" * 60 + "".join(rnd.choice("ACGT") for _ in range(90)), "b": "T" * 205 + "G", "c": "ACGT"}
    rows = [(k, i // 16, t[i : i + 16]) for k, t in text.items() for i in range(0, len(t), 16)]
    return text, spark.createDataFrame(rows, "contig string, chunk long, bases string").repartition(3)


def test_windows(spark, contigs):
    text, ref = contigs
    rnd = random.Random(5)
    spans = [(rnd.choice("abc"), s, s + rnd.randint(0, 60)) for s in (rnd.randint(-20, 205) for _ in range(200))] + [("c", 900, 910), ("d", 1, 5), ("a", -9, -2)]
    got = R.reference_windows(spark.createDataFrame([(*x, i) for i, x in enumerate(spans)], "contig string, start long, end long, i int"), ref, ["contig"], chunk_size=16, reach=10)
    rows = {r["i"]: r for r in got.collect()}
    for i, (k, s, e) in enumerate(spans):
        want = text.get(k, "")[max(s, 1) - 1 : max(e, 0)]
        assert (rows[i]["bases"] or "") == want
        if want:
            assert (rows[i]["start"], rows[i]["end"]) == (max(s, 1), max(s, 1) + len(want) - 1)


def leftmost(text, pos, ref, alt):
    while True:
        if ref[-1] == alt[-1] and (len(ref) > 1 and len(alt) > 1):
            ref, alt = ref[:-1], alt[:-1]
        elif ref[-1] == alt[-1] and len(ref) != len(alt) and pos > 1:
            ref, alt, pos = text[pos - 2] + ref[:-1], text[pos - 2] + alt[:-1], pos - 1
        elif len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
            ref, alt, pos = ref[1:], alt[1:], pos + 1
        else:
            return pos, ref, alt


def test_long_repeats_take_more_rounds(spark, contigs):
    text, ref = contigs
    sites = [("b", 200, "TT", "T"), ("b", 150, "T", "TTT"), ("a", 130, text["a"][129], "A" if text["a"][129] != "A" else "C"), ("b", 3, "TT", "T"), ("b", 205, "TG", "T")]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(sites)], "contig string, pos long, ref string, alt string, i int")
    got = {r["i"]: (r["pos"], r["ref"], r["alt"]) for r in R.left_normalise(df, ref, ["contig"], chunk_size=16, reach=8).collect()}
    assert got == {i: leftmost(text[k], *x) for i, (k, *x) in enumerate(sites)}


def test_alleles_in_order_of_two_scores(spark):
    rows = [(0, 0.0), (1, -0.5), (2, -1.0), (3, 0.1), (3, -2.0), (1, 0.1), (2, 0.1), (2, -2.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "site int, allele int, score double")
    kept = [r["allele"] for r in S.ranked_alleles(df, ["site"], is_reference=F.col("allele") == 0, keep=2).orderBy("rank").collect()]
    assert kept == [0, 1]  # 1 and 2 and 3 share the best score; the second decides
    every = [r["allele"] for r in S.ranked_alleles(df, ["site"]).orderBy("rank").collect()]
    assert every == [1, 2, 3, 0]
    assert S.max_alleles(2, 1024) == 44 and S.max_alleles(1, 7) == 7


def test_order_is_checked_without_sorting(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.floor(F.col("id") / 100).alias("contig"), F.col("id").alias("pos"))
    assert S.require_sorted(df, ["contig", "pos"]).count() == 1000
    assert S.cap_per_start(df.withColumn("qname", F.lit("x")).withColumn("flag", F.lit(0)), ["contig"], "pos", sorted_by=["contig", "pos"]).count() == 1000
    with pytest.raises(ValueError):
        S.require_sorted(df, ["pos", "contig"]).unionByName(df)
        S.require_sorted(df.unionByName(df.limit(1)), ["contig", "pos"])
    with pytest.raises(ValueError):
        S.require_sorted(df.withColumn("pos", F.when(F.col("pos") == 500, 3).otherwise(F.col("pos"))), ["pos"])
