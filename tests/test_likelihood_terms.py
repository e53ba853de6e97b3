"""F2 F3 F4 F6: terms of whole qualities are looked up; all others are worked out."""

import math

from pyspark.sql import functions as F

from strandline.operators import likelihood as L
from strandline.operators import pileup as P


def _gl(spark, rows, kind):
    obs = spark.createDataFrame(rows, f"k int, is_alt boolean, qual {kind}")
    model = L.ActivityModel(min_base_quality=-100)
    return {r.k: r.gl for r in L.ref_vs_any(obs, ["k"], is_deletion=None, model=model).collect()}


def _want(alt, q):
    right, wrong = math.log10(1 - 10 ** (-q / 10)) if q > 0 else -math.inf, -q / 10 - math.log10(3)
    ref, al = (wrong, right) if alt else (right, wrong)
    big, small = max(ref, al), min(ref, al)
    near = small != -math.inf and big - small < 8
    het = big + math.log10(1 + 10 ** -(math.floor((big - small) * 10000 + 0.5) / 10000)) if near else big
    return [ref, het - math.log10(2), al]


def test_terms_in_and_out_of_the_table(spark):
    for kind, values in (("int", [-3, 0, 1, 10, 40, 93, 255, 256, 400]), ("double", [0.0, 10.0, 10.5, 33.25, 255.0, 300.0])):
        cases = [(alt, q) for alt in (False, True) for q in values]
        got = _gl(spark, [(i, alt, q) for i, (alt, q) in enumerate(cases)], kind)
        for i, (alt, q) in enumerate(cases):
            assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got[i], _want(alt, q))), (kind, alt, q, got[i])


def test_a_term_is_not_worked_out_for_each_observation(spark):
    obs = spark.createDataFrame([(1, True, 30, False)], "k int, is_alt boolean, qual int, is_deletion boolean")
    m = L.ref_vs_any(obs, ["k"])
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    before = plan.split("transform(")[0]
    assert "transform(" in plan and "POWER(" not in before.upper()


def test_lower_case_reads_give_the_same_observations(spark):
    cols = "contig int, pos long, cigar string, seq string, qual string, qname string, flag int, mapq int, sample string"
    rows = [(1, 5, "2M1D2M", "ACgt", "IIII", "a", 0, 60, "s"), (1, 5, "4M", "ACGT", "IIII", "b", 0, 60, "s")]
    obs = P.explode_alignment(spark.createDataFrame(rows, cols)).orderBy("qname", "pos").collect()
    assert [o.base for o in obs] == ["A", "C", "-", "G", "T", "A", "C", "G", "T"]
    plan = P.explode_alignment(spark.createDataFrame(rows, cols)).select("base")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan  # letters were raised at every position of every read
