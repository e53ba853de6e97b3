"""Per-site statistics and sequence-set summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import READS, SHIPMENTS, reads, reference_chunks, shipments, sql_ref_base
from checks.ranks import rank_tests
from checks.registry import query, table
from strandline.operators import stats as S


def _calls(spark, sf):
    """Line items of a part as calls: two alleles out of 0..2, sometimes missing."""
    li = table(spark, sf, "lineitem")
    a = (F.col("l_linenumber") % 4 - 1).cast("int")
    b = (F.col("l_orderkey") % 3).cast("int")
    return li.select(
        F.col("l_partkey").alias("pk"), F.array(F.when(a > 2, 2).otherwise(a), b).alias("gt"), F.col("l_quantity").cast("int").alias("dp")
    )


@query(
    "core_site_annotations",
    """WITH c AS (SELECT l_partkey AS pk, l_linenumber % 4 - 1 AS a, l_orderkey % 3 AS b, CAST(l_quantity AS BIGINT) AS dp FROM lineitem),
    s AS (SELECT pk, count(*) FILTER (a >= 0) + count(*) AS an, count(*) FILTER (a = 1) + count(*) FILTER (b = 1) AS ac1,
      count(*) FILTER (a = 2) + count(*) FILTER (b = 2) AS ac2, count(*) AS ns, CAST(sum(dp) AS BIGINT) AS dp FROM c GROUP BY pk)
    SELECT pk, an, ac1, ac2, ns, dp, round(ac1 / an, 6) AS af1, round(ac2 / an, 6) AS af2 FROM s""",
)
def _(spark, sf):
    a = S.core_site_annotations(_calls(spark, sf), ["pk"], F.lit(2))
    return a.select(
        "pk", "an", F.col("ac")[0].alias("ac1"), F.col("ac")[1].alias("ac2"), "ns", "dp",
        F.round(F.col("af")[0], 6).alias("af1"), F.round(F.col("af")[1], 6).alias("af2"),
    )


_TABLE = """t AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS a, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS b,
   count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS c, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS d FROM lineitem GROUP BY 1)"""


def _table(spark, sf, minimum):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k")
    return S.strand_table(li, ["k"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", minimum)


@query(
    "strand_table_sor",
    f"""WITH {_TABLE}, p AS (SELECT k, a AS ref_fw, b AS ref_rv, c AS alt_fw, d AS alt_rv, a + 1.0 AS a1, b + 1.0 AS b1, c + 1.0 AS c1, d + 1.0 AS d1 FROM t)
    SELECT k, ref_fw, ref_rv, alt_fw, alt_rv, round(ln((a1 / b1) * (d1 / c1) + (b1 / a1) * (c1 / d1)) + ln(least(a1, b1) / greatest(a1, b1))
       - ln(least(c1, d1) / greatest(c1, d1)), 6) AS sor FROM p""",
)
def _(spark, sf):
    t = _table(spark, sf, 0)
    return t.withColumn("sor", F.round(S.strand_odds_ratio(*[F.col(c) for c in ("ref_fw", "ref_rv", "alt_fw", "alt_rv")]), 6))


@query(
    "fisher_strand",
    f"""WITH {_TABLE}, n AS (SELECT k, CASE WHEN a + b + c + d > 400 THEN (a + b + c + d) / 200.0 ELSE 1.0 END AS f, * EXCLUDE (k) FROM t),
    s AS (SELECT k, CAST(floor(a / f) AS INT) AS a, CAST(floor(b / f) AS INT) AS b, CAST(floor(c / f) AS INT) AS c, CAST(floor(d / f) AS INT) AS d FROM n),
    m AS (SELECT k, a, a + b AS m, c + d AS n, a + c AS kk, greatest(0, a + c - (c + d)) AS lo, least(a + c, a + b) AS hi FROM s),
    x AS (SELECT k, a, lo, hi, m, n, kk, unnest(generate_series(lo, hi)) AS x FROM m),
    l AS (SELECT k, a, x, lo, hi, lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n + 1) - lgamma(kk - x + 1) - lgamma(n - kk + x + 1)
       - (lgamma(m + n + 1) - lgamma(kk + 1) - lgamma(m + n - kk + 1)) AS lp FROM x),
    o AS (SELECT k, lp * (1 - 1e-7) AS thr FROM l WHERE x = a),
    p AS (SELECT l.k, max(lo) AS lo, max(hi) AS hi, least(1.0, coalesce(sum(exp(lp)) FILTER (lp <= thr), 1.0)) AS p FROM l JOIN o ON l.k = o.k GROUP BY l.k)
    SELECT k, round(greatest(0.0, -10 * log10(CASE WHEN lo >= hi THEN 1.0 ELSE p END)), 5) + 0.0 AS fs FROM p""",
)
def _(spark, sf):
    t = _table(spark, sf, 2)
    fs = S.fisher_strand(*[F.col(c) for c in ("ref_fw", "ref_rv", "alt_fw", "alt_rv")])
    return t.select("k", (F.round(fs, 5) + 0.0).alias("fs"))


@query(
    "excess_het",
    """WITH g AS (SELECT l_partkey AS pk, count(*) FILTER (l_returnflag = 'A') AS ref, count(*) FILTER (l_returnflag = 'N') AS het, count(*) FILTER (l_returnflag = 'R') AS hom FROM lineitem GROUP BY 1),
    n AS (SELECT pk, het, least(ref, hom) AS r, greatest(ref, hom) AS c, 2 * least(ref, hom) + het AS rare, ref + het + hom AS n FROM g),
    x AS (SELECT pk, het, rare, n, unnest(generate_series(rare % 2, rare, 2)) AS h FROM n),
    l AS (SELECT pk, het, h, h * ln(2) - lgamma((rare - h) / 2 + 1) - lgamma(h + 1) - lgamma(n - h - (rare - h) / 2 + 1) AS lp FROM x),
    e AS (SELECT pk, het, h, exp(lp - max(lp) OVER (PARTITION BY pk)) AS w FROM l)
    SELECT pk, round(greatest(0.0, -10 * log10(sum(w) FILTER (h >= het) / sum(w))), 5) + 0.0 AS excess_het FROM e GROUP BY pk""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("pk")).agg(
        *[F.count(F.when(F.col("l_returnflag") == f, 1)).alias(n) for f, n in (("A", "ref"), ("N", "het"), ("R", "hom"))]
    )
    return g.select("pk", (F.round(S.excess_het(F.col("ref"), F.col("het"), F.col("hom")), 5) + 0.0).alias("excess_het"))


_RANKS = """r AS (SELECT {k} AS k, {v} AS v, l_returnflag = 'R' AS alt FROM lineitem),
  w AS (SELECT k, v, alt, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY k, v) AS c, count(*) OVER (PARTITION BY k) AS n FROM r),
  s AS (SELECT k, count(*) FILTER (alt) AS n1, count(*) FILTER (NOT alt) AS n2, sum(rk) FILTER (alt) AS r1, sum(CASE WHEN c <> n THEN CAST(c AS DOUBLE) * c - 1 ELSE 0 END) AS ties FROM w GROUP BY k)"""


@query(
    "rank_sum_large",
    f"""WITH {_RANKS.format(k='l_suppkey', v='l_extendedprice')} SELECT k, n1, n2,
      round((r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0 + CASE WHEN ties = 0 THEN 0 ELSE 0.5 END)
        / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z FROM s""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k")
    return S.rank_sum(li, ["k"], "l_extendedprice", F.col("l_returnflag") == "R").withColumn("z", F.round("z", 6))


@query(
    "rank_sum_small",
    f"""WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_quantity AS v, l_returnflag = 'R' AS alt FROM lineitem), {rank_tests('o', 'k')}
    SELECT k, n1, n2, round(z, 3) + 0.0 AS z FROM rz""",
)
def _(spark, sf):
    """Every order is a site with a handful of values on each side: the exact permutation branch."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return S.rank_sum(li, ["k"], "l_quantity", F.col("l_returnflag") == "R").withColumn("z", F.round("z", 3) + 0.0)


@query("rms_quality", f"WITH {READS} SELECT k, round(sqrt(avg(mapq * mapq) FILTER (mapq <> 255)), 6) AS rms_mq FROM reads GROUP BY k")
def _(spark, sf):
    return S.rms_quality(reads(spark, sf), ["k"]).withColumn("rms_mq", F.round("rms_mq", 6))


@query(
    "quality_report",
    f"""WITH {READS}, q AS (SELECT unnest(string_split(qual, '')) AS c FROM reads), v AS (SELECT ascii(c) - 33 AS q FROM q)
    SELECT (SELECT count(*) FROM reads) AS n_seqs, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM reads) AS total_bases, (SELECT round(avg(length(seq)), 6) FROM reads) AS mean_length,
      (SELECT min(length(seq)) FROM reads) AS min_length, (SELECT max(length(seq)) FROM reads) AS max_length, round(avg(q), 6) AS mean_q, min(q) AS min_q, max(q) AS max_q, quantile_cont(q, 0.5) AS median_q FROM v""",
)
def _(spark, sf):
    r = S.quality_report(reads(spark, sf))
    return r.withColumn("mean_q", F.round("mean_q", 6)).withColumn("mean_length", F.round("mean_length", 6))


@query(
    "quality_histogram",
    f"""WITH {READS}, q AS (SELECT unnest(string_split(qual, '')) AS c FROM reads)
    SELECT ascii(c) - 33 AS q, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM q GROUP BY c""",
)
def _(spark, sf):
    return S.quality_histogram(reads(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "base_histogram",
    """WITH c AS (SELECT translate(text, 'acgt', 'ACGT') AS t FROM documents), n AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base, unnest([
      length(t) - length(replace(t, 'A', '')), length(t) - length(replace(t, 'C', '')), length(t) - length(replace(t, 'G', '')), length(t) - length(replace(t, 'T', ''))]) AS n FROM c)
    SELECT base, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1 UNION ALL SELECT 'N', (SELECT CAST(sum(length(t)) AS BIGINT) FROM c) - (SELECT CAST(sum(n) AS BIGINT) FROM n)""",
)
def _(spark, sf):
    return S.base_histogram(table(spark, sf, "documents"), "text")


@query(
    "base_histogram_intervals",
    f"""WITH {SHIPMENTS}, d AS (SELECT DISTINCT k, unnest(generate_series("start", "end")) - 9000 AS p FROM shipments),
    b AS (SELECT {sql_ref_base('k', 'p')} AS base FROM d) SELECT base, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'N', 0""",
)
def _(spark, sf):
    from strandline.operators.pileup import bases_in_intervals

    s = shipments(spark, sf).select("k", (F.col("start") - 9000).alias("start"), (F.col("end") - 9000).alias("end"))
    return S.base_histogram(bases_in_intervals(s, reference_chunks(spark, sf), ["k"], 256), "bases")


@query(
    "composition",
    """SELECT doc_id, length(t) - length(replace(t, 'A', '')) AS n_a, length(t) - length(replace(t, 'C', '')) AS n_c, length(t) - length(replace(t, 'G', '')) AS n_g, length(t) - length(replace(t, 'T', '')) AS n_t,
      length(regexp_replace(t, '[ACGT]', '', 'g')) AS n_n, round(length(regexp_replace(t, '[^GC]', '', 'g')) / length(t), 6) AS gc, len(regexp_extract_all(t, 'THE')) AS pattern
    FROM (SELECT doc_id, translate(text, 'acgthe', 'ACGTHE') AS t FROM documents)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    c = S.composition("text")
    return d.select(
        "doc_id", *[v.alias(n) if n != "gc" else F.round(v, 6).alias(n) for n, v in c.items()],
        F.regexp_count(F.col("text"), F.lit("[tT][hH][eE]")).cast("long").alias("pattern"),
    )


@query("evidence_count", f"""WITH {READS} SELECT k, count(DISTINCT qname) AS evidence FROM reads WHERE mapq >= 20 OR flag & 8 <> 0 GROUP BY k""")
def _(spark, sf):
    r = reads(spark, sf).select("k", F.col("qname").alias("read_id"), "mapq", "flag")
    return S.evidence_count(r.where("mapq >= 20"), r.where("flag & 8 <> 0"), ["k"])


@query(
    "site_ratios",
    """WITH g AS (SELECT l_partkey AS pk, sum(l_quantity) AS depth, sum(l_tax) AS q, count(*) FILTER (l_returnflag = 'N') AS het, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT pk, round(q * 1000 / nullif(depth, 0), 6) AS qd, CASE WHEN n >= 30 THEN round(1 - het / n, 6) END AS inbreeding FROM g""",
)
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pk")).agg(
        F.sum("l_quantity").alias("depth"), F.sum("l_tax").alias("q"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("het"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        "pk", F.round(S.qual_by_depth(F.col("q") * 1000, F.col("depth")), 6).alias("qd"),
        F.round(S.inbreeding(F.col("het"), F.col("n"), 30), 6).alias("inbreeding"),
    )
