"""Composed jobs over the derived reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import READS, reads, reference_chunks
from checks.pileups import OBS
from checks.registry import query
from strandline.functions.cigar import reference_span
from strandline.operators import signal as G
from strandline.plans import pipelines as P

KERNEL = G.gaussian_kernel(10, 4.0)


def _inputs(spark, sf):
    r = reads(spark, sf).withColumn("contig", F.col("k"))
    ref = reference_chunks(spark, sf).withColumnRenamed("k", "contig")
    spans = r.groupBy("contig").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return r, ref, spans


_PRIOR = ", ".join(f"(lgamma(3) - lgamma({n} + 1) - lgamma({2 - n} + 1) + lgamma({n} + 0.01) + lgamma({2 - n} + 10.0)) / ln(10)" for n in range(3))
_SMOOTHED = f"""{OBS}, t AS (SELECT k, pos, is_alt, CASE WHEN is_deletion THEN 30 ELSE q END AS q, is_next_to_clip, hq FROM alt),
  u AS (SELECT *, q >= 10 AS used, CASE WHEN q <= 0 THEN '-inf'::DOUBLE ELSE log10(1 - pow(10, -q / 10.0)) END AS a, -q / 10.0 - log10(3) AS b FROM t),
  v AS (SELECT *, CASE WHEN is_alt THEN b ELSE a END AS rr, CASE WHEN is_alt THEN a ELSE b END AS aa FROM u),
  h AS (SELECT *, greatest(rr, aa) + CASE WHEN abs(rr - aa) < 8 THEN log10(1 + pow(10, -(floor(abs(rr - aa) * 10000.0 + 0.5) / 10000.0))) ELSE 0 END AS hh FROM v),
  g AS (SELECT k, pos, coalesce(sum(rr) FILTER (used), 0) AS g0, coalesce(sum(hh) FILTER (used), 0) - count(*) FILTER (used) * log10(2) AS g1, coalesce(sum(aa) FILTER (used), 0) AS g2,
    avg(hq) FILTER (used AND is_alt AND is_next_to_clip) AS clip FROM h GROUP BY k, pos),
  l AS (SELECT k, pos, clip, list_transform([g0, g1, g2], lambda x: floor(-10 * (x - greatest(g0, g1, g2)) + 0.5) / -10.0) AS gl FROM g),
  o AS (SELECT *, list_transform([1, 2, 3], lambda i: gl[i] + [{_PRIOR}][i]) AS po FROM l),
  pb AS (SELECT k, pos, CASE WHEN clip > 6 THEN floor(clip) END AS clip, CASE WHEN gl[1] >= list_max(gl) OR po[1] >= list_max(po) THEN 0.0
    ELSE 1 - pow(10, po[1] - list_max(po)) / list_sum(list_transform(po, lambda x: pow(10, x - list_max(po)))) END AS prob FROM o),
  sp AS (SELECT k, unnest(generate_series(min(pos), max(pos))) AS pos FROM reads GROUP BY k),
  m AS (SELECT sp.k, sp.pos, coalesce(prob, 0) * CASE WHEN clip IS NULL THEN 1 ELSE sp.pos + least(clip, 60) - greatest(1, sp.pos - least(clip, 60)) + 1 END AS m FROM sp LEFT JOIN pb USING (k, pos)),
  ma AS MATERIALIZED (SELECT * FROM m),
  kn AS (SELECT t - 11 AS d, {KERNEL!r}[t] AS tap FROM range(1, 22) r(t))"""


@query("smoothed_activity", f"""WITH {_SMOOTHED} SELECT contig, pos, round(smoothed, 6) AS smoothed
  FROM (SELECT k AS contig, pos - d AS pos, sum(m * tap) AS smoothed FROM ma, kn GROUP BY ALL) x SEMI JOIN sp ON sp.k = x.contig AND sp.pos = x.pos""")
def _(spark, sf):
    r, ref, spans = _inputs(spark, sf)
    s = P.smoothed_activity(r, ref, spans, chunk_size=256, kernel=KERNEL)
    return s.select("contig", "pos", F.round("smoothed", 6).alias("smoothed"))


@query("active_regions")
def _(spark, sf):
    r, ref, spans = _inputs(spark, sf)
    s = P.smoothed_activity(r, ref, spans, chunk_size=256, kernel=KERNEL)
    return P.active_regions(s, threshold=0.3, min_size=10, max_size=60, pad=10).drop("region_id")


@query(
    "confidence_blocks",
    f"""WITH RECURSIVE {OBS}, t AS (SELECT k, pos, is_deletion OR base <> ref_base AS is_alt, base <> ref_base OR before_deletion OR before_insertion AS st, CASE WHEN is_deletion THEN 30 ELSE q END AS q, is_deletion FROM obs),
    u AS (SELECT *, is_deletion OR q >= 10 AS used, CASE WHEN q <= 0 THEN '-inf'::DOUBLE ELSE log10(1 - pow(10, -q / 10.0)) END AS a, -q / 10.0 - log10(3) AS b FROM t),
    v AS (SELECT *, CASE WHEN is_alt THEN b ELSE a END AS rr, CASE WHEN is_alt THEN a ELSE b END AS aa FROM u),
    h AS (SELECT *, greatest(rr, aa) + CASE WHEN abs(rr - aa) < 8 THEN log10(1 + pow(10, -(floor(abs(rr - aa) * 10000.0 + 0.5) / 10000.0))) ELSE 0 END AS hh FROM v),
    g AS (SELECT k, pos, count(*) AS dp, coalesce(sum(rr) FILTER (used), 0) AS g0, coalesce(sum(hh) FILTER (used), 0) - count(*) FILTER (used) * log10(2) AS g1, coalesce(sum(aa) FILTER (used), 0) AS g2,
      count(*) FILTER (st AND NOT is_deletion) AS n_st, coalesce(sum(CASE WHEN st THEN b ELSE a END) FILTER (used AND NOT is_deletion), 0) AS s0, coalesce(sum(hh) FILTER (used AND NOT is_deletion), 0) - count(*) FILTER (used AND NOT is_deletion) * log10(2) AS s1,
      coalesce(sum(CASE WHEN st THEN a ELSE b END) FILTER (used AND NOT is_deletion), 0) AS s2 FROM h GROUP BY ALL),
    pl AS MATERIALIZED (SELECT k, pos, n_st, list_transform([s0, s1, s2], lambda x: floor(-10 * (x - greatest(s0, s1, s2)) + 0.5)) AS pl FROM g),
    em AS (SELECT DISTINCT pl, list_transform(pl, lambda x: x / -10.0) AS gl, log10(0.5) AS f0, log10(0.5) AS f1, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0 AS it, false AS done FROM pl WHERE pl[1] > 0
      UNION ALL
      SELECT pl, gl, log10((10 + n0) / (10.01 + n0 + n1)), log10((0.01 + n1) / (10.01 + n0 + n1)), n0, n1, it + 1, greatest(abs(n0 - c0), abs(n1 - c1)) <= 0.1 OR it + 1 > 100 FROM (
        SELECT *, (2 * w[1] + w[2]) / list_sum(w) AS n0, (w[2] + 2 * w[3]) / list_sum(w) AS n1 FROM (
          SELECT *, [pow(10, gl[1] + 2 * f0), 2 * pow(10, gl[2] + f0 + f1), pow(10, gl[3] + 2 * f1)] AS w FROM em WHERE NOT done))),
    em1 AS (SELECT pl, [pow(10, gl[1] + 2 * f0), 2 * pow(10, gl[2] + f0 + f1), pow(10, gl[3] + 2 * f1)] AS w FROM em WHERE done),
    vr AS (SELECT k, pos FROM pl JOIN em1 USING (pl) WHERE (pl[2] = 0 OR n_st >= 2) AND -10 * log10(w[1] / list_sum(w)) >= 10),
    c AS (SELECT k, pos, dp, CAST(least(99, greatest(0, floor(-10 * (list_sort([g0, least(g1, g0), least(g2, g0)], 'DESC')[2] - list_sort([g0, least(g1, g0), least(g2, g0)], 'DESC')[1]) + 0.5))) AS BIGINT) AS gq FROM g),
    sp AS (SELECT k, unnest(generate_series(min(pos), max(pos))) AS pos FROM reads GROUP BY k),
    f AS (SELECT sp.k, sp.pos, coalesce(gq, 0) AS gq, coalesce(dp, 0) AS dp, CASE WHEN coalesce(gq, 0) < 20 THEN 20 WHEN gq < 60 THEN 60 WHEN gq < 99 THEN 99 ELSE 100 END AS hi FROM sp LEFT JOIN c USING (k, pos) ANTI JOIN vr USING (k, pos)),
    l AS (SELECT *, CASE WHEN lag(hi) OVER w = hi AND lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS hd FROM f WINDOW w AS (PARTITION BY k ORDER BY pos)),
    i AS (SELECT *, sum(hd) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM l)
    SELECT k AS contig, min(pos) AS "start", max(pos) AS "end", max(hi) AS band_upper, min(gq) AS min_gq, min(dp) AS min_dp, max(dp) AS max_dp FROM i GROUP BY k, isl""",
)
def _(spark, sf):
    r, ref, spans = _inputs(spark, sf)
    return P.confidence_blocks(r, ref, spans, chunk_size=256, bands=[20, 60, 99])


@query(
    "reads_by_region",
    f"""WITH {READS}, s AS (SELECT k, pos AS a, pos + CASE shape WHEN 0 THEN n WHEN 1 THEN n - 2 WHEN 2 THEN n + 2 ELSE n - 1 END - 1 AS b FROM reads),
    sp AS (SELECT k, min(pos) AS lo, max(pos) AS hi FROM reads GROUP BY k), t AS (SELECT k, hi, unnest(generate_series(lo, hi, 100)) AS lo FROM sp)
    SELECT t.k AS contig, t.lo - 10 AS padded_start, count(*) AS n FROM t JOIN s ON s.k = t.k AND s.a <= least(t.lo + 99, t.hi) + 10 AND s.b >= t.lo - 10 GROUP BY ALL""",
)
def _(spark, sf):
    """Reads per active region over whole contigs; the regions come from fixed tiles of each supplier."""
    r, _, spans = _inputs(spark, sf)
    r = r.select("contig", "qname", F.col("pos").alias("start"), (F.col("pos") + reference_span("cigar") - 1).alias("end"))
    from strandline.operators.intervals import tile

    t = tile(spans, 100).select(
        "contig", F.xxhash64("contig", "tile_start").alias("region_id"), (F.col("tile_start") - 10).alias("padded_start"), (F.col("tile_end") + 10).alias("padded_end")
    )
    return P.assign_reads(r, t).groupBy("contig", "padded_start").agg(F.count(F.lit(1)).alias("n"))
