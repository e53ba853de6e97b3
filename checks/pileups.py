"""Reads opened along their alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import READS, _REF, reads, reference_chunks, sql_ref_base
from checks.filters import _sql_rules
from checks.ranks import rank_tests
from checks.registry import query
from strandline.operators import annotate as A
from strandline.operators import filters as X
from strandline.operators import likelihood as L
from strandline.operators import pileup as P

# One row per covered reference position; `i` is the query offset, `j` the reference offset.
OBS = f"""{READS}, pos0 AS (SELECT ok, ln, k, pos AS p0, n, half, shape, seq, qual, flag, mapq, qname, sample,
      unnest(range(0, CASE shape WHEN 1 THEN n - 2 WHEN 2 THEN n + 2 WHEN 3 THEN n - 1 ELSE n END)) AS j FROM reads),
  pos1 AS (SELECT *, CASE WHEN shape = 2 AND j >= half AND j < half + 2 THEN NULL WHEN shape = 1 THEN j + 2 WHEN shape = 2 AND j >= half + 2 THEN j - 2
      WHEN shape = 3 AND j >= half THEN j + 1 ELSE j END AS i FROM pos0),
  obs AS (SELECT k, p0 + j AS pos, ok, ln, qname, flag, mapq, sample, i IS NULL AS is_deletion, CASE WHEN i IS NULL THEN '-' ELSE substr(seq, i + 1, 1) END AS base,
      CASE WHEN i IS NOT NULL THEN ascii(substr(qual, i + 1, 1)) - 33 END AS q, i AS read_offset, n AS read_length, {sql_ref_base('k', '(p0 + j)')} AS ref_base,
      shape = 2 AND j = half - 1 AS before_deletion, shape = 2 AND j = half + 2 AS after_deletion, shape = 3 AND j = half - 1 AS before_insertion,
      shape = 3 AND j = half AS after_insertion, shape = 1 AND j = 0 AS is_next_to_clip,
      CASE WHEN shape = 1 THEN length(regexp_replace(substr(qual, 1, 2), '[!-=]', '', 'g')) ELSE 0 END AS hq FROM pos1),
  alt AS (SELECT *, is_deletion OR base <> ref_base OR before_deletion OR after_deletion OR before_insertion OR after_insertion OR is_next_to_clip AS is_alt FROM obs)"""


SITE = ["k", "chunk", "pos"]  # a position, with the chunk by which its observations lie together


def observations(spark, sf, realigned=False, lone=False):
    r = reads(spark, sf).withColumn("contig", F.col("k"))
    ref = reference_chunks(spark, sf).withColumnRenamed("k", "contig")
    keep = ["ok", "ln", "qname", "flag", "mapq", "sample"]
    if lone:
        r, keep = P.mark_lone(r, name="ok"), [*keep, "lone"]
    return P.pileup(r, ref, chunk_size=256, keep=keep, realigned=realigned).withColumnRenamed("contig", "k")


_FLAGS = ["is_deletion", "before_deletion", "after_deletion", "before_insertion", "after_insertion", "is_next_to_clip", "is_alt"]


@query(
    "pileup",
    f"WITH {OBS} SELECT k, pos, sample, count(*) AS depth, count(*) FILTER (base = ref_base) AS n_ref, CAST(sum(coalesce(q, 0)) AS BIGINT) AS sum_q, max(hq) AS max_hq, "
    + ", ".join(f"count(*) FILTER ({f}) AS n_{f}" for f in _FLAGS) + " FROM alt GROUP BY ALL",
)
def _(spark, sf):
    o = observations(spark, sf)
    return o.groupBy(*SITE, "sample").agg(
        F.count(F.lit(1)).alias("depth"), F.count(F.when(F.col("base") == F.col("ref_base"), 1)).alias("n_ref"),
        F.sum(F.coalesce(F.col("qual"), F.lit(0))).alias("sum_q"), F.max("hq_clip_bases").cast("long").alias("max_hq"),
        *[F.count(F.when(F.col(f), 1)).alias(f"n_{f}") for f in _FLAGS],
    ).drop("chunk")


@query("reference_bases", f"WITH {OBS} SELECT k, pos, ref_base FROM obs GROUP BY ALL")
def _(spark, sf):
    return observations(spark, sf).select(*SITE, "ref_base").distinct().drop("chunk")


@query("one_per_name", f"WITH {OBS} SELECT k, pos, ok, base, q FROM obs QUALIFY row_number() OVER (PARTITION BY k, pos, ok ORDER BY ln, base DESC, q) = 1")
def _(spark, sf):
    # Line items of one order share its name; the generated tables repeat (order, line) pairs, so ties
    # are broken by the observation itself.
    o = observations(spark, sf, lone=True).select(*SITE, "ok", "ln", "base", F.col("qual").alias("q"), "lone")
    o = o.withColumn("rev", -F.ascii("base")).withColumn("qq", F.coalesce("q", F.lit(-1)))
    return P.one_per_name(o, SITE, ["ln", "rev", "qq"], "ok", "lone").select("k", "pos", "ok", "base", "q")


@query(
    "mate_overlap_cleanup",
    f"""WITH {OBS}, w AS (SELECT *, count(*) OVER p AS c, min(base) OVER p = max(base) OVER p AS agree, bool_or(is_deletion) OVER p AS dele FROM obs WINDOW p AS (PARTITION BY k, pos, ok))
    SELECT k, pos, CAST(sum(CASE WHEN c = 2 AND NOT dele AND agree THEN least(q, 20) WHEN c = 2 AND NOT dele THEN 0 ELSE q END) AS BIGINT) AS q FROM w GROUP BY ALL""",
)
def _(spark, sf):
    o = observations(spark, sf, lone=True).select(*SITE, "ok", "base", "is_deletion", "qual", "lone")
    return P.clean_mate_overlap(o, SITE, name="ok", lone="lone").groupBy(*SITE).agg(F.sum("qual").alias("q")).drop("chunk")


@query(
    "indel_depth",
    f"""WITH {READS}, ev AS (SELECT k, pos + half - 1 AS anchor, 'D' AS op, 2 AS len, '' AS ins FROM reads WHERE shape = 2
        UNION ALL SELECT k, pos + half - 1, 'I', 1, substr(seq, half + 1, 1) FROM reads WHERE shape = 3),
    al AS (SELECT k, anchor, op, len, ins, count(*) AS alt_depth FROM ev GROUP BY ALL),
    m AS (SELECT k, pos AS s, pos + CASE WHEN shape = 1 THEN n - 2 WHEN shape IN (2, 3) THEN half ELSE n END - 1 AS e FROM reads
        UNION ALL SELECT k, CASE WHEN shape = 2 THEN pos + half + 2 ELSE pos + half END, pos + CASE WHEN shape = 2 THEN n + 2 ELSE n - 1 END - 1 FROM reads WHERE shape IN (2, 3)),
    o AS (SELECT a.k, anchor, count(*) AS c FROM (SELECT DISTINCT k, anchor FROM al) a JOIN m ON a.k = m.k AND anchor BETWEEN s AND e GROUP BY ALL)
    SELECT al.k, al.anchor, op, len, ins, alt_depth, c - alt_depth AS ref_depth FROM al JOIN o ON o.k = al.k AND o.anchor = al.anchor""",
)
def _(spark, sf):
    r = reads(spark, sf)
    return P.indel_depth(r, P.alignment_events(r, "k"), "k")


@query(
    "pileup_extra_events",
    f"""WITH {OBS}, s AS (SELECT k, pos, base AS alt, count(*) AS n FROM obs WHERE NOT is_deletion AND base <> ref_base GROUP BY ALL),
    kn AS (SELECT DISTINCT k, pos, base AS alt FROM obs WHERE sample = 's0' AND NOT is_deletion)
    SELECT * FROM s ANTI JOIN kn USING (k, pos, alt) WHERE n >= 2""",
)
def _(spark, sf):
    o = observations(spark, sf)
    known = o.where("sample = 's0' and not is_deletion").select(*SITE, F.col("base").alias("alt"))
    return P.pileup_alleles(o, SITE, known, 2).drop("chunk")


@query(
    "variation_positions",
    f"""WITH {OBS} SELECT k, pos FROM obs WHERE NOT is_deletion AND base <> ref_base UNION SELECT k, pos + half - 1 FROM reads WHERE shape IN (2, 3)""",
)
def _(spark, sf):
    return P.variation_positions(observations(spark, sf), P.alignment_events(reads(spark, sf), "k"), "k")


@query("vote_correction")
def _(spark, sf):
    o = observations(spark, sf).withColumn("read_id", F.concat_ws(":", "qname", "k"))
    return P.correct_by_vote(o, SITE)


@query(
    "confidence_loci_from_reads",
    f"""WITH {OBS}, t AS (SELECT k, pos, sample, is_alt, CASE WHEN is_deletion THEN 30 ELSE q END AS q, is_deletion FROM alt),
    u AS (SELECT *, is_deletion OR q >= 10 AS used, CASE WHEN q <= 0 THEN '-inf'::DOUBLE ELSE log10(1 - pow(10, -q / 10.0)) END AS a, -q / 10.0 - log10(3) AS b FROM t),
    v AS (SELECT *, CASE WHEN is_alt THEN b ELSE a END AS rr, CASE WHEN is_alt THEN a ELSE b END AS aa FROM u),
    h AS (SELECT *, greatest(rr, aa) + CASE WHEN abs(rr - aa) < 8 THEN log10(1 + pow(10, -(floor(abs(rr - aa) * 10000.0 + 0.5) / 10000.0))) ELSE 0 END AS hh FROM v),
    g AS (SELECT k, pos, sample, count(*) AS dp, coalesce(sum(rr) FILTER (used), 0) AS g0, coalesce(sum(hh) FILTER (used), 0) - count(*) FILTER (used) * log10(2) AS g1, coalesce(sum(aa) FILTER (used), 0) AS g2 FROM h GROUP BY ALL),
    c AS (SELECT *, list_sort([g0, least(g1, g0), least(g2, g0)], 'DESC') AS s FROM g)
    SELECT k, pos, sample, dp, CAST(least(99, greatest(0, floor(round(-10 * (s[2] - s[1]), 7) + 0.5))) AS BIGINT) AS gq FROM c""",
)
def _(spark, sf):
    return L.confidence_loci(observations(spark, sf), [*SITE, "sample"]).drop("chunk")


# --- annotations of sites ---

SITES = f"""{OBS}, ob AS MATERIALIZED (SELECT k, pos, sample, is_deletion OR base <> ref_base AS alt, flag & 16 <> 0 AS rev, is_deletion AS gap, q, mapq,
    CASE WHEN NOT is_deletion THEN least(read_offset, read_length - 1 - read_offset) END AS place FROM obs)"""


def _kind_tests(kinds: dict[str, str], source: str) -> str:
    """The test of each kind of value, under the name of its kind."""
    each = " UNION ALL ".join(f"SELECT k, pos, '{name}' AS kind, CAST({v} AS DOUBLE) AS v, alt FROM {source}" for name, v in kinds.items())
    return f"kv AS ({each}), {rank_tests('kv', 'k, pos, kind')}"


@query(
    "rank_sum_inputs",
    f"""WITH RECURSIVE {SITES}, {_kind_tests({'b': 'q', 'm': 'mapq', 'p': 'place', 's': '(q + 1) / 100.0'}, 'ob')}
    SELECT k, pos, round(max(z) FILTER (kind = 'b'), 3) + 0.0 AS base_q, round(max(z) FILTER (kind = 'm'), 3) + 0.0 AS mapq, round(max(z) FILTER (kind = 'p'), 3) + 0.0 AS place,
      round(max(z) FILTER (kind = 's'), 3) + 0.0 AS share FROM rz GROUP BY k, pos""",
)
def _(spark, sf):
    """The three rank sums of every covered position, and one of values between 0 and 1."""
    o = observations(spark, sf, realigned=True)
    z = A.rank_sums(o, SITE, F.col("is_alt"), A.read_values() | {"share": (F.col("qual") + 1) / 100.0})
    named = {"base_q_rank_sum": "base_q", "mq_rank_sum": "mapq", "read_pos_rank_sum": "place", "share": "share"}
    return z.select("k", "pos", *[(F.round(c, 3) + 0.0).alias(n) for c, n in named.items()])


_ANNOTATED = f"""{SITES}, st AS MATERIALIZED (SELECT k, pos FROM ob GROUP BY k, pos HAVING count(*) FILTER (alt) >= 3), so AS MATERIALIZED (SELECT ob.* FROM ob JOIN st USING (k, pos)),
  u AS (SELECT *, gap OR q >= 10 AS used, CASE WHEN NOT gap AND q <= 0 THEN '-inf'::DOUBLE ELSE log10(1 - pow(10, -(CASE WHEN gap THEN 30 ELSE q END) / 10.0)) END AS a,
    -(CASE WHEN gap THEN 30 ELSE q END) / 10.0 - log10(3) AS b FROM so),
  v AS (SELECT *, CASE WHEN alt THEN b ELSE a END AS rr, CASE WHEN alt THEN a ELSE b END AS aa FROM u),
  h AS (SELECT *, greatest(rr, aa) + CASE WHEN abs(rr - aa) < 8 THEN log10(1 + pow(10, -(floor(abs(rr - aa) * 10000.0 + 0.5) / 10000.0))) ELSE 0 END AS hh FROM v),
  gs AS (SELECT k, pos, sample, count(*) FILTER (NOT alt) AS ad0, count(*) FILTER (alt) AS ad1, coalesce(sum(rr) FILTER (used), 0) AS g0,
    coalesce(sum(hh) FILTER (used), 0) - count(*) FILTER (used) * log10(2) AS g1, coalesce(sum(aa) FILTER (used), 0) AS g2 FROM h GROUP BY ALL),
  pl AS (SELECT *, list_transform([g0, g1, g2], lambda x: floor(-10 * (x - greatest(g0, g1, g2)) + 0.5)) AS pl FROM gs),
  ca AS (SELECT *, list_position(pl, list_min(pl)) - 1 AS gt FROM pl),
  su AS (SELECT k, pos, count(*) FILTER (gt = 0) AS rr, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 2) AS hom, CAST(sum(gt) AS BIGINT) AS ac, 2 * count(*) AS an,
    CAST(sum(ad0 + ad1) AS BIGINT) AS dp, CAST(sum(CASE WHEN gt > 0 THEN ad0 + ad1 ELSE 0 END) AS BIGINT) AS carried, list(list_transform(pl, lambda x: x / -10.0)) AS gl FROM ca GROUP BY k, pos),
  em AS (SELECT k, pos, gl, log10(0.5) AS f0, log10(0.5) AS f1, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0 AS it, false AS done FROM su
    UNION ALL
    SELECT k, pos, gl, log10((10 + n0) / (10.01 + n0 + n1)), log10((0.01 + n1) / (10.01 + n0 + n1)), n0, n1, it + 1, greatest(abs(n0 - c0), abs(n1 - c1)) <= 0.1 OR it + 1 > 100 FROM (
      SELECT *, list_sum(list_transform(w, lambda v: (2 * v[1] + v[2]) / (v[1] + v[2] + v[3]))) AS n0, list_sum(list_transform(w, lambda v: (v[2] + 2 * v[3]) / (v[1] + v[2] + v[3]))) AS n1 FROM (
        SELECT *, list_transform(gl, lambda x: [pow(10, x[1] + 2 * f0), 2 * pow(10, x[2] + f0 + f1), pow(10, x[3] + 2 * f1)]) AS w FROM em WHERE NOT done))),
  ef AS (SELECT k, pos, c1, list_transform(gl, lambda x: [pow(10, x[1] + 2 * f0), 2 * pow(10, x[2] + f0 + f1), pow(10, x[3] + 2 * f1)]) AS w FROM em WHERE done),
  eq AS (SELECT k, pos, CAST(floor(c1 + 0.5) AS BIGINT) AS mleac, greatest(0, -10 * list_sum(list_transform(w, lambda v: log10(v[1] / (v[1] + v[2] + v[3]))))) AS qual FROM ef),
  eh AS (SELECT k, pos, het, 2 * least(rr, hom) + het AS rare, rr + het + hom AS n FROM su),
  ex AS (SELECT k, pos, het, rare, n, unnest(generate_series(rare % 2, rare, 2)) AS h FROM eh),
  el AS (SELECT k, pos, het, h, h * ln(2) - lgamma((rare - h) / 2 + 1) - lgamma(h + 1) - lgamma(n - h - (rare - h) / 2 + 1) AS lp FROM ex),
  ew AS (SELECT k, pos, het, h, exp(lp - max(lp) OVER (PARTITION BY k, pos)) AS w FROM el),
  eo AS (SELECT k, pos, greatest(0.0, -10 * log10(sum(w) FILTER (h >= het) / sum(w))) AS excess_het FROM ew GROUP BY k, pos),
  tb AS (SELECT k, pos, count(*) FILTER (NOT alt AND NOT rev) AS a, count(*) FILTER (NOT alt AND rev) AS b, count(*) FILTER (alt AND NOT rev) AS c, count(*) FILTER (alt AND rev) AS d,
    sqrt(avg(mapq * mapq) FILTER (mapq <> 255)) AS mq FROM so GROUP BY k, pos),
  sr AS (SELECT k, pos, mq, ln(((a + 1.0) / (b + 1)) * ((d + 1.0) / (c + 1)) + ((b + 1.0) / (a + 1)) * ((c + 1.0) / (d + 1))) + ln(least(a + 1.0, b + 1) / greatest(a + 1, b + 1))
    - ln(least(c + 1.0, d + 1) / greatest(c + 1, d + 1)) AS sor FROM tb),
  fm AS (SELECT k, pos, a, a + b AS m, c + d AS n, a + c AS kk, greatest(0, a - d) AS lo, least(a + c, a + b) AS hi FROM tb),
  fx AS (SELECT *, unnest(generate_series(lo, hi)) AS x FROM fm),
  fl AS (SELECT *, lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n + 1) - lgamma(kk - x + 1) - lgamma(n - kk + x + 1) - (lgamma(m + n + 1) - lgamma(kk + 1) - lgamma(m + n - kk + 1)) AS lp FROM fx),
  fo AS (SELECT k, pos, lp * (1 - 1e-7) AS thr FROM fl WHERE x = a),
  fs AS (SELECT k, pos, greatest(0.0, -10 * log10(CASE WHEN max(lo) >= max(hi) THEN 1.0 ELSE least(1.0, coalesce(sum(exp(lp)) FILTER (lp <= thr), 1.0)) END)) AS fs FROM fl JOIN fo USING (k, pos) GROUP BY k, pos),
  {_kind_tests({'b': 'q', 'm': 'mapq', 'p': 'place'}, 'so')},
  rk AS (SELECT k, pos, max(z) FILTER (kind = 'b') AS bq, max(z) FILTER (kind = 'm') AS mqr, max(z) FILTER (kind = 'p') AS rp FROM rz GROUP BY k, pos),
  an AS (SELECT k, pos, qual, ac, ac / an AS af, an, dp, excess_het, fs, sor, mleac, least(1.0, mleac / an) AS mleaf, mq, qual / nullif(carried, 0) AS qd, bq, mqr, rp,
    CASE WHEN an >= 6 THEN 1.0 - het / (an / 2) END AS inbreeding FROM su JOIN eq USING (k, pos) JOIN eo USING (k, pos) JOIN sr USING (k, pos) JOIN fs USING (k, pos) LEFT JOIN rk USING (k, pos))"""


@query(
    "annotate_sites",
    f"""WITH RECURSIVE {_ANNOTATED}
    SELECT k, pos, round(qual, 4) + 0.0 AS qual, ac, round(af, 6) AS af, an, dp, round(excess_het, 4) + 0.0 AS excess_het, round(fs, 4) + 0.0 AS fs, round(sor, 5) + 0.0 AS sor, mleac, round(mleaf, 6) AS mleaf,
      round(mq, 5) AS mq, round(qd, 4) + 0.0 AS qd, round(bq, 3) + 0.0 AS base_q_rank_sum, round(mqr, 3) + 0.0 AS mq_rank_sum, round(rp, 3) + 0.0 AS read_pos_rank_sum, round(inbreeding, 6) AS inbreeding FROM an""",
)
def _(spark, sf):
    """Every site with three alternative observations or more, its line numbers as samples."""
    a = A.annotate_sites(observations(spark, sf, realigned=True), SITE, F.expr("flag & 16 <> 0"), min_alt=3, min_samples=3).drop("chunk")
    places = {"qual": 4, "af": 6, "excess_het": 4, "fs": 4, "sor": 5, "mleaf": 6, "mq": 5, "qd": 4, "base_q_rank_sum": 3, "mq_rank_sum": 3, "read_pos_rank_sum": 3, "inbreeding": 6}
    return a.select(*[(F.round(c, places[c]) + 0.0).alias(c) if c in places else F.col(c) for c in a.columns])


@query(
    "annotated_filters",
    f"""WITH RECURSIVE {_ANNOTATED}, nm AS (SELECT k, pos, qd AS QD, qual AS QUAL, sor AS SOR, fs AS FS, mq AS MQ, mqr AS MQRankSum, rp AS ReadPosRankSum FROM an)
    SELECT k, pos, {_sql_rules(X.SNP_RULES)} AS filters FROM nm""",
)
def _(spark, sf):
    """The filter presets fed from reads: annotations of the same sites under the rules for single bases."""
    a = A.annotate_sites(observations(spark, sf, realigned=True), SITE, F.expr("flag & 16 <> 0"), min_alt=3, min_samples=3)
    return X.hard_filter(A.as_rule_names(a), X.SNP_RULES).select("k", "pos", F.array_join("filters", ";").alias("filters"))
