"""Genotype arrays, cohort merge and joint genotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import day, ref_index, sql_day, sql_ref_base
from checks.registry import query, table
from strandline.functions import genotype as G
from strandline.operators import em as E
from strandline.plans import cohort as Co
from strandline.plans import combine as C


# --- arrays from line item columns: alleles A, C, T, <NON_REF> ---

def _arrays(spark, sf):
    li = table(spark, sf, "lineitem")
    q, d, ln = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_linenumber")
    pl = F.array(q, d, q + d, q * 2, d * 3, q % 7, ln * 5, q + ln, d + ln * 2, q * 3)
    return li.select(
        F.col("l_orderkey").alias("ok"), ln.cast("long").alias("ln"), q.cast("long").alias("q"), d.cast("long").alias("d"), pl.alias("pl"),
        F.array(q, d, ln, q % 5).alias("ad"), F.array(*[F.lit(x) for x in ("A", "C", "T", G.NON_REF)]).alias("alleles"),
    )


_ARR = """ar AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
  a AS (SELECT *, [q, d, q + d, q * 2, d * 3, q % 7, ln * 5, q + ln, d + ln * 2, q * 3] AS pl, [q, d, ln, q % 5] AS ad, ['A', 'C', 'T', '<NON_REF>'] AS alleles FROM ar)"""


def _txt(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("gq_from_pl", f"WITH {_ARR}, s AS (SELECT *, list_sort(pl) AS s FROM a) SELECT ok, ln, q, d, least(99, s[2] - s[1]) AS gq FROM s")
def _(spark, sf):
    return _arrays(spark, sf).select("ok", "ln", "q", "d", G.gq_from_pl(F.col("pl")).cast("long").alias("gq"))


_IJ = "[0,0,1,0,1,2,0,1,2,3]", "[0,1,1,2,2,2,3,3,3,3]"


@query("gt_from_pl", f"WITH {_ARR} SELECT ok, ln, q, d, {_IJ[0]}[list_position(pl, list_min(pl))] || '/' || {_IJ[1]}[list_position(pl, list_min(pl))] AS gt FROM a")
def _(spark, sf):
    g = G.gt_from_pl(F.col("pl"), F.lit(4))
    return _arrays(spark, sf).select("ok", "ln", "q", "d", F.concat_ws("/", g[0].cast("string"), g[1].cast("string")).alias("gt"))


@query(
    "pl_from_gl",
    """WITH g AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, [-l_quantity / 10, -l_discount * 30, -l_tax * 40] AS gl FROM lineitem),
    p AS (SELECT ok, ln, list_transform(gl, lambda x: greatest(0, CAST(round(round(-10 * (x - list_max(gl)), 9)) AS BIGINT))) AS p FROM g)
    SELECT ok, ln, array_to_string(list_transform(p, lambda x: x - list_min(p)), ',') AS pl FROM p""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    gl = F.array(-F.col("l_quantity") / 10, -F.col("l_discount") * 30, -F.col("l_tax") * 40)
    # Both sides round away float noise first, so that exact halves agree.
    gl = F.transform(gl, lambda x: F.round(x, 9))
    return li.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), _txt(G.pl_from_gl(gl)).alias("pl"))


@query(
    "remap_pl_ad",
    f"""WITH {_ARR}, m AS (SELECT *, [0, 2, 3, 3] AS m FROM a),
    r AS (SELECT *, flatten(list_transform(range(0, 4), lambda j: list_transform(range(0, j + 1), lambda i:
       pl[greatest(m[i + 1], m[j + 1]) * (greatest(m[i + 1], m[j + 1]) + 1) // 2 + least(m[i + 1], m[j + 1]) + 1]))) AS p FROM m)
    SELECT ok, ln, q, d, array_to_string(p, ',') AS pl, array_to_string(list_transform(m, lambda x: coalesce(ad[x + 1], 0)), ',') AS ad FROM r""",
)
def _(spark, sf):
    m = G.index_map(F.col("alleles"), F.array(*[F.lit(x) for x in ("A", "T", "G", G.NON_REF)]))
    a = _arrays(spark, sf).withColumn("m", m)
    return a.select("ok", "ln", "q", "d", _txt(G.remap_pl(F.col("pl"), F.col("m"))).alias("pl"), _txt(G.remap_ad(F.col("ad"), F.col("m"))).alias("ad"))


@query(
    "drop_symbolic_allele",
    f"""WITH {_ARR}, n AS (SELECT *, [least(pl[1], pl[7], pl[10]), least(pl[2], pl[8]), least(pl[3], pl[8]), least(pl[4], pl[9]), pl[5], least(pl[6], pl[9])] AS p FROM a)
    SELECT ok, ln, q, d, array_to_string(list_transform(p, lambda x: x - list_min(p)), ',') AS pl, array_to_string([ad[1], ad[2], ad[3]], ',') AS ad FROM n""",
)
def _(spark, sf):
    a = _arrays(spark, sf)
    return a.select(
        "ok", "ln", "q", "d", _txt(G.drop_symbolic_pl(F.col("pl"), F.col("alleles"))).alias("pl"),
        _txt(G.drop_symbolic_ad(F.col("ad"), F.col("alleles"))).alias("ad"),
    )


@query(
    "subset_alleles",
    f"""WITH {_ARR}, g AS (SELECT *, {_IJ[0]}[list_position(pl, list_min(pl))] AS gi, {_IJ[1]}[list_position(pl, list_min(pl))] AS gj FROM a),
    k AS (SELECT *, list_filter([0, 1, 2, 3], lambda x: x = 0 OR x = gi OR x = gj) AS k FROM g),
    p AS (SELECT *, flatten(list_transform(range(0, len(k)), lambda j: list_transform(range(0, j + 1), lambda i: pl[k[j + 1] * (k[j + 1] + 1) // 2 + k[i + 1] + 1]))) AS p FROM k)
    SELECT ok, ln, q, d, array_to_string(list_transform(k, lambda x: alleles[x + 1]), ',') AS alleles, array_to_string(list_transform(p, lambda x: x - list_min(p)), ',') AS pl,
      array_to_string(list_transform(k, lambda x: ad[x + 1]), ',') AS ad, (list_position(k, gi) - 1) || ',' || (list_position(k, gj) - 1) AS gt FROM p""",
)
def _(spark, sf):
    a = _arrays(spark, sf).withColumn("gt", G.gt_from_pl(F.col("pl"), F.lit(4)))
    s = a.withColumn("s", G.subset_alleles(F.col("pl"), F.col("ad"), F.col("gt"), F.col("alleles")))
    return s.select("ok", "ln", "q", "d", F.array_join("s.alleles", ",").alias("alleles"), *[_txt(F.col(f"s.{c}")).alias(c) for c in ("pl", "ad", "gt")])


@query(
    "phasing_fields",
    """WITH c AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_linenumber % 3 - 1 AS a, l_orderkey % 2 AS b, l_returnflag <> 'N' AS en, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS ps FROM lineitem),
    p AS (SELECT *, en AND ps IS NOT NULL AND a <> b AND a >= 0 AS ph, CASE WHEN a < 0 THEN '.' ELSE CAST(a AS VARCHAR) END AS ta, CAST(b AS VARCHAR) AS tb FROM c)
    SELECT ok, ln, ta || (CASE WHEN ph THEN '|' ELSE '/' END) || tb AS gt, CASE WHEN ph THEN ps || '_' || a || '_' || b END AS pid, ph AS phased FROM p""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    gt = F.array((F.col("l_linenumber") % 3 - 1).cast("int"), (F.col("l_orderkey") % 2).cast("int"))
    f = G.phasing_fields(gt, F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "F", F.col("l_partkey")))
    x = li.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), f.alias("f"))
    return x.select("ok", "ln", "f.gt", "f.pid", "f.phased")


@query(
    "trim_alleles",
    """WITH v AS (SELECT p_partkey AS pk, p_name AS ref, p_name || substr(p_name, length(p_name) - 1) AS alt FROM part)
    SELECT pk, length(ref) AS pos, substr(ref, length(ref)) AS ref, substr(alt, length(ref)) AS alt FROM v""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("ref"), F.concat("p_name", F.right("p_name", F.lit(2))).alias("alt"))
    t = G.trim_alleles(F.lit(1).cast("long"), F.col("ref"), F.col("alt"))
    return p.select("pk", t.alias("t")).select("pk", "t.pos", "t.ref", "t.alt")


@query(
    "merge_multiallelic",
    """WITH e AS (SELECT DISTINCT p_type AS site, p_brand AS ref, p_brand || p_name AS alt FROM part),
    s AS (SELECT site, arg_max(ref, (length(ref), ref)) AS ref FROM e GROUP BY 1),
    r AS (SELECT e.site, s.ref, CASE WHEN length(s.ref) > length(e.ref) THEN alt || right(s.ref, length(s.ref) - length(e.ref)) ELSE alt END AS a, min((e.ref, alt)) AS o FROM e JOIN s ON e.site = s.site GROUP BY ALL)
    SELECT site, any_value(ref) AS ref, count(*) AS n_alts, md5(string_agg(a, ',' ORDER BY o)) AS alts FROM r GROUP BY site""",
)
def _(spark, sf):
    from strandline.operators.events import merge_multiallelic

    e = table(spark, sf, "part").select(F.col("p_type").alias("site"), F.col("p_brand").alias("ref"), F.concat("p_brand", "p_name").alias("alt")).distinct()
    m = merge_multiallelic(e, ["site"], order=["ref", "alt"])
    return m.select("site", "ref", F.size("alts").cast("long").alias("n_alts"), F.md5(F.array_join("alts", ",")).alias("alts"))


# --- cohort tables: one row per (supplier, line number as sample, start) ---

def gvcf(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("long").alias("input_ord"), (day("l_shipdate") - 9000).alias("start")).agg(
        F.min("l_orderkey").alias("ok"), F.max("l_quantity").cast("long").alias("n"), F.max(F.round(F.col("l_discount") * 100)).cast("long").alias("d")
    )
    alt = F.col("ok") % 4 == 0
    kind = F.floor(F.col("ok") / 4) % 3
    rl = F.when(alt & (kind == 1), 3).otherwise(1)

    def base(p, shift=0):
        return F.substring(F.lit("ACGT"), ((ref_index(F.col("k"), p) + shift) % 4 + 1).cast("int"), F.lit(1))

    s = F.col("start")
    ref = F.when(rl == 3, F.concat(base(s), base(s + 1), base(s + 2))).otherwise(base(s))
    a = F.when(kind == 0, base(s, 1)).when(kind == 1, base(s)).otherwise(F.concat(base(s), F.lit("GA")))
    n, d = F.col("n"), F.col("d")
    i = lambda *xs: F.array(*[x.cast("int") for x in xs])
    return g.select(
        "k", F.concat(F.lit("s"), F.col("input_ord").cast("string")).alias("sample"), "input_ord", "start",
        F.when(alt, s + rl - 1).otherwise(s + n - 1).alias("end"), ref.alias("ref"),
        F.when(alt, F.array(a, F.lit(G.NON_REF))).otherwise(F.array(F.lit(G.NON_REF))).alias("alts"),
        F.when(alt, i(n * 6, F.lit(0), n * 2, n * 6 + 5, n + 40, n * 9)).otherwise(i(F.lit(0), d * 3, d * 30)).alias("pl"),
        F.when(alt, i(d, n, F.lit(0))).otherwise(i(d, F.lit(0))).alias("ad"),
        (F.when(alt, n * 2).otherwise(d * 3)).cast("int").alias("gq"), (n % 5).cast("int").alias("dp"),
    )


_B = lambda p, s=0: f"substr('ACGT', CAST(((k * 31 + ({p}) * 17 + (({p}) * ({p})) % 13) % 4 + {s}) % 4 + 1 AS BIGINT), 1)"
GVCF = f"""g0 AS (SELECT l_suppkey AS k, CAST(l_linenumber AS BIGINT) AS ord, {sql_day('l_shipdate')} - 9000 AS s, min(l_orderkey) AS ok, CAST(max(l_quantity) AS BIGINT) AS n, CAST(max(round(l_discount * 100)) AS BIGINT) AS d FROM lineitem GROUP BY 1, 2, 3),
  g1 AS (SELECT *, ok % 4 = 0 AS alt, (ok // 4) % 3 AS kind FROM g0),
  gv AS (SELECT k, ord, s, CASE WHEN NOT alt THEN s + n - 1 WHEN kind = 1 THEN s + 2 ELSE s END AS e, CASE WHEN alt AND kind = 1 THEN {_B('s')} || {_B('s + 1')} || {_B('s + 2')} ELSE {_B('s')} END AS ref,
    CASE WHEN alt THEN [CASE kind WHEN 0 THEN {_B('s', 1)} WHEN 1 THEN {_B('s')} ELSE {_B('s')} || 'GA' END, '<NON_REF>'] ELSE ['<NON_REF>'] END AS alts,
    CASE WHEN alt THEN [n * 6, 0, n * 2, n * 6 + 5, n + 40, n * 9] ELSE [0, d * 3, d * 30] END AS pl, CASE WHEN alt THEN [d, n, 0] ELSE [d, 0] END AS ad,
    CASE WHEN alt THEN n * 2 ELSE d * 3 END AS gq, n % 5 AS dp FROM g1),
  bp0 AS (SELECT k, s AS p FROM gv UNION SELECT k, e + 1 FROM gv UNION SELECT k, unnest(range(s + 1, e + 1)) FROM gv WHERE len(alts) > 1),
  bp AS (SELECT k, p, lead(p) OVER (PARTITION BY k ORDER BY p) - 1 AS pe FROM bp0),
  cov AS (SELECT gv.*, p, pe, s <> p AS sp FROM bp JOIN gv ON bp.k = gv.k AND p BETWEEN s AND e WHERE pe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gv.k, p, ord ORDER BY s) = 1)"""
_COMBINE = f"""{GVCF}, rf AS (SELECT k, p, coalesce(arg_max(ref, length(ref)) FILTER (NOT sp), left(arg_min(ref, ord), 1)) AS rf FROM cov GROUP BY k, p),
  mp AS (SELECT cov.*, rf, list_transform(alts, lambda a: CASE WHEN a = '<NON_REF>' THEN a WHEN sp THEN CASE WHEN length(a) < length(ref) THEN '*' ELSE '.' END WHEN length(rf) > length(ref) THEN a || right(rf, length(rf) - length(ref)) ELSE a END) AS m FROM cov JOIN rf USING (k, p)),
  al AS (SELECT k, p, a, min(-ord) AS o FROM (SELECT k, p, ord, rf, unnest(m) AS a FROM mp) WHERE a NOT IN ('<NON_REF>', '*', '.') AND a <> rf GROUP BY k, p, a),
  ll AS (SELECT k, p, list(a ORDER BY o) AS l FROM al GROUP BY k, p),
  sd AS (SELECT k, p, bool_or(list_contains(m, '*') OR (sp AND len(alts) > 1)) AS sd FROM mp GROUP BY k, p),
  tg AS (SELECT sd.k, sd.p, list_concat(list_concat(coalesce(l, []), CASE WHEN sd THEN ['*'] ELSE [] END), ['<NON_REF>']) AS ta FROM sd LEFT JOIN ll USING (k, p)),
  im AS (SELECT mp.*, ta, list_concat([0], list_transform(ta, lambda t: coalesce(nullif(list_position(m, t), 0), len(m)))) AS x FROM mp JOIN tg USING (k, p)),
  ca AS (SELECT k, p, pe, rf, ta, ord, gq, dp, list_transform(x, lambda v: coalesce(ad[v + 1], 0)) AS ad, flatten(list_transform(range(0, len(x)), lambda j: list_transform(range(0, j + 1), lambda i:
     pl[greatest(x[i + 1], x[j + 1]) * (greatest(x[i + 1], x[j + 1]) + 1) // 2 + least(x[i + 1], x[j + 1]) + 1]))) AS pl FROM im),
  st AS (SELECT k, p AS "start", pe AS "end", any_value(rf) AS ref, array_to_string(any_value(ta), ',') AS alts,
     string_agg('s' || ord || ':' || gq || ':' || dp || ':' || array_to_string(ad, ',') || ':' || array_to_string(pl, ','), ' ' ORDER BY ord) AS calls FROM ca GROUP BY k, p, pe)"""


def _flat(df):
    c = F.transform(
        "calls",
        lambda x: F.concat_ws(":", x["sample"], x["gq"].cast("string"), x["dp"].cast("string"), _txt(x["ad"]), _txt(x["pl"])),
    )
    return df.select("k", "start", "end", "ref", F.array_join("alts", ",").alias("alts"), F.array_join(c, " ").alias("calls"))


@query("combine_segments", f'WITH {_COMBINE} SELECT k, "start", "end", ref, alts, calls FROM st')
def _(spark, sf):
    return _flat(C.combine(gvcf(spark, sf), ["k"], coalesce=False))


@query(
    "combine_blocks",
    f"""WITH {_COMBINE}, fl AS (SELECT *, CASE WHEN alts = '<NON_REF>' AND lag(alts) OVER w = alts AND lag(ref) OVER w = ref AND lag(calls) OVER w = calls AND lag("end") OVER w + 1 = "start" THEN 0 ELSE 1 END AS h FROM st WINDOW w AS (PARTITION BY k ORDER BY "start")),
    ii AS (SELECT *, sum(h) OVER (PARTITION BY k ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS i FROM fl)
    SELECT k, min("start") AS "start", max("end") AS "end", any_value(ref) AS ref, any_value(alts) AS alts, any_value(calls) AS calls FROM ii GROUP BY k, i""",
)
def _(spark, sf):
    return _flat(C.combine(gvcf(spark, sf), ["k"]))


@query("breakpoints", f'WITH {GVCF} SELECT k, p AS pos, pe AS seg_end FROM bp WHERE pe IS NOT NULL')
def _(spark, sf):
    return C.breakpoints(gvcf(spark, sf), ["k"])


_PAIRS = [(i, j) for j in range(9) for i in range(j + 1)]
_PI, _PJ = str([i for i, _ in _PAIRS]), str([j for _, j in _PAIRS])
_GT = f"list_transform(gls, lambda g: list_transform(range(1, len(g) + 1), lambda p: pow(10, g[p] + la[{_PI}[p] + 1] + la[{_PJ}[p] + 1] + CASE WHEN {_PI}[p] = {_PJ}[p] THEN 0 ELSE log10(2) END)))"
_JOINT = f"""{_COMBINE},
  vc AS (SELECT *, len(ta) AS m, list_concat([rf], list_slice(ta, 1, len(ta) - 1)) AS al FROM ca WHERE len(ta) > 1),
  dp0 AS (SELECT k, p, ord, m, al, dp, ad[1:m] AS ad, flatten(list_transform(range(0, m), lambda j: list_transform(range(0, j + 1), lambda i: least(pl[j * (j + 1) // 2 + i + 1],
      CASE WHEN i = j OR i = 0 THEN pl[m * (m + 1) // 2 + j + 1] END, CASE WHEN j = 0 THEN pl[m * (m + 1) // 2 + m + 1] END)))) AS pl FROM vc),
  dc AS MATERIALIZED (SELECT * REPLACE (list_transform(pl, lambda x: x - list_min(pl)) AS pl) FROM dp0),
  gg AS (SELECT k, p, any_value(m) AS n, any_value(al) AS al, list(list_transform(pl, lambda x: x / -10.0)) AS gls FROM dc GROUP BY k, p),
  pr AS (SELECT *, list_transform(range(1, n + 1), lambda a: CASE WHEN a = 1 THEN 10.0 WHEN length(al[a]) = length(al[1]) THEN 0.01 ELSE 0.00125 END) AS prior FROM gg),
  em AS (SELECT k, p, n, gls, prior, list_transform(prior, lambda x: -log10(n)) AS la, list_transform(prior, lambda x: 0.0::DOUBLE) AS c, 0 AS it, false AS done FROM pr
    UNION ALL
    SELECT k, p, n, gls, prior, CASE WHEN n = 2 OR NOT rest THEN list_transform(range(1, n + 1), lambda a: log10((prior[a] + new[a]) / (list_sum(prior) + list_sum(new)))) ELSE la END, new, it + 1, rest FROM (
      SELECT *, list_max(list_transform(range(1, n + 1), lambda a: abs(new[a] - c[a]))) <= 0.1 OR it + 1 > 100 AS rest FROM (
        SELECT *, list_transform(range(0, n), lambda a: list_sum(list_transform(w, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda p: x[p] * (CAST({_PI}[p] = a AS INT) + CAST({_PJ}[p] = a AS INT)))) / list_sum(x)))) AS new FROM (
          SELECT *, {_GT} AS w FROM em WHERE NOT done)))),
  fin AS (SELECT *, {_GT} AS w FROM em WHERE done),
  es AS MATERIALIZED (SELECT k, p, n, c, list_transform(c, lambda x: greatest(x / list_sum(c), 1e-300)) AS af, greatest(0, -10 * list_sum(list_transform(w, lambda x: log10(x[1] / list_sum(x))))) AS qual FROM fin),
  cs AS (SELECT dc.*, qual, c, list_transform(range(1, len(pl) + 1), lambda x: pl[x] / -10.0 + log10(af[{_PI}[x] + 1]) + log10(af[{_PJ}[x] + 1]) + CASE WHEN {_PI}[x] = {_PJ}[x] THEN 0 ELSE log10(2) END) AS sc
    FROM dc JOIN es ON dc.k = es.k AND dc.p = es.p WHERE qual >= 30),
  cg AS (SELECT *, {_PI}[len(sc) - list_position(list_reverse(sc), list_max(sc)) + 1] AS g0, {_PJ}[len(sc) - list_position(list_reverse(sc), list_max(sc)) + 1] AS g1, list_sort(pl) AS sp FROM cs),
  sj AS (SELECT k, p, any_value(al) AS al, any_value(qual) AS qual, any_value(c) AS c, 2 * count(*) AS an, count(*) AS ns, CAST(sum(dp) AS BIGINT) AS dp, list(g0) AS l0, list(g1) AS l1,
    sum(CASE WHEN g1 > 0 THEN list_sum(ad) ELSE 0 END) AS carried, string_agg('s' || ord || ':' || g0 || ',' || g1 || ':' || least(99, sp[2] - sp[1]), ' ' ORDER BY ord) AS calls FROM cg GROUP BY k, p)"""


@query(
    "joint_genotype",
    f"""WITH RECURSIVE {_JOINT} SELECT k, p AS "start", al[1] AS ref, array_to_string(list_slice(al, 2, len(al)), ',') AS alts, round(qual, 4) AS qual,
      array_to_string(list_transform(range(1, len(al)), lambda a: len(list_filter(l0, lambda x: x = a)) + len(list_filter(l1, lambda x: x = a))), ',') AS ac, an, ns, dp,
      round(qual / nullif(carried, 0), 5) AS qd, array_to_string(list_transform(range(2, len(al) + 1), lambda a: CAST(floor(c[a] + 0.5) AS BIGINT)), ',') AS mleac, calls FROM sj""",
)
def _(spark, sf):
    """Merge and joint genotypes in long form; the calls are gathered for the comparison only."""
    _, calls = Co.merge(gvcf(spark, sf), ["k"], variants_only=True)
    sites, called = Co.genotype(calls, ["k"])
    j = Co.wide(sites, called, ["k"])
    return j.select(
        "k", "start", "ref", F.array_join("alts", ",").alias("alts"), F.round("qual", 4).alias("qual"), _txt(F.col("ac")).alias("ac"), "an", "ns", "dp",
        F.round("qd", 5).alias("qd"), _txt(F.col("mleac")).alias("mleac"),
        F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["sample"], _txt(c["gt"]), c["gq"].cast("string"))), " ").alias("calls"),
    )


@query("merge_long", f"""WITH {_COMBINE} SELECT ca.k, p AS "start", pe AS "end", rf AS ref, array_to_string(ta, ',') AS alts, 's' || ord AS sample, gq, dp, array_to_string(ad, ',') AS ad, array_to_string(pl, ',') AS pl,
    dp * 2 AS least_depth FROM ca""")
def _(spark, sf):
    """The merged cohort as calls, with a column that the merge does not know."""
    blocks = gvcf(spark, sf).withColumn("least_depth", F.col("dp") * 2)
    _, calls = Co.merge(blocks, ["k"])
    ref, alts = F.col("alleles")[0], F.array_join(F.slice("alleles", F.lit(2), F.size("alleles") - 1), ",")
    return calls.select("k", "start", "end", ref.alias("ref"), alts.alias("alts"), "sample", "gq", "dp", _txt(F.col("ad")).alias("ad"), _txt(F.col("pl")).alias("pl"), "least_depth")


@query(
    "joint_compatibility",
    f"""WITH {GVCF}, c AS (SELECT k, ord, s, e, max(e) OVER (PARTITION BY k, ord ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM gv)
    SELECT k, ord AS input_ord, s AS "start", e AS "end", 'overlaps an earlier row' AS reason FROM c WHERE r >= s""",
)
def _(spark, sf):
    g = gvcf(spark, sf).select("k", "input_ord", "start", "end")
    return C.joint_compatibility(g, ["k", "input_ord"])


def _pls(spark, sf):
    li = table(spark, sf, "lineitem")
    q, d = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    pl = F.when(F.col("l_returnflag") == "R", F.array(q, F.lit(0), d)).otherwise(F.array(F.lit(0), d, q + d))
    return li.select(F.col("l_partkey").alias("pk"), F.lit(2).alias("n_alleles"), pl.alias("pl"))


_EM = """pl AS (SELECT l_partkey AS pk, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, l_returnflag = 'R' AS r FROM lineitem),
  g AS (SELECT pk, list(CASE WHEN r THEN [-q / 10.0, 0.0, -d / 10.0] ELSE [0.0, -d / 10.0, -(q + d) / 10.0] END) AS gl FROM pl GROUP BY pk),
  em AS (SELECT pk, gl, log10(0.5) AS f0, log10(0.5) AS f1, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0 AS it, false AS done FROM g
    UNION ALL
    SELECT pk, gl, log10((10 + n0) / (10.01 + n0 + n1)), log10((0.01 + n1) / (10.01 + n0 + n1)), n0, n1, it + 1, greatest(abs(n0 - c0), abs(n1 - c1)) <= 0.1 OR it + 1 > 100 FROM (
      SELECT *, list_sum(list_transform(w, lambda v: (2 * v[1] + v[2]) / (v[1] + v[2] + v[3]))) AS n0, list_sum(list_transform(w, lambda v: (v[2] + 2 * v[3]) / (v[1] + v[2] + v[3]))) AS n1 FROM (
        SELECT *, list_transform(gl, lambda x: [pow(10, x[1] + 2 * f0), 2 * pow(10, x[2] + f0 + f1), pow(10, x[3] + 2 * f1)]) AS w FROM em WHERE NOT done))),
  fin AS (SELECT *, list_transform(gl, lambda x: [pow(10, x[1] + 2 * f0), 2 * pow(10, x[2] + f0 + f1), pow(10, x[3] + 2 * f1)]) AS w FROM em WHERE done),
  res AS (SELECT pk, c1 / (c0 + c1) AS af, it AS rounds, greatest(0, -10 * list_sum(list_transform(w, lambda v: log10(v[1] / (v[1] + v[2] + v[3]))))) AS qual, c1 FROM fin)"""


@query("joint_af_em", f"WITH RECURSIVE {_EM} SELECT pk, round(af, 6) AS af, rounds, round(qual, 5) + 0.0 AS qual FROM res")
def _(spark, sf):
    e = E.af_em(_pls(spark, sf), ["pk"])
    return e.select("pk", F.round(F.col("af")[1], 6).alias("af"), "rounds", (F.round("qual", 5) + 0.0).alias("qual"))


@query("joint_af_em_distributed", f"WITH RECURSIVE {_EM} SELECT pk, round(af, 6) AS af, CAST(floor(c1 + 0.5) AS BIGINT) AS alt_count, rounds, round(qual, 5) + 0.0 AS qual FROM res")
def _(spark, sf):
    e = E.af_em_distributed(_pls(spark, sf), ["pk"])
    return e.select("pk", F.round(F.col("af")[1], 6).alias("af"), F.col("counts")[1].cast("long").alias("alt_count"), "rounds", (F.round("qual", 5) + 0.0).alias("qual"))


def _many_alleles(spark, sf):
    """Parts as sites of two to four alleles, their line items as samples; alternatives of one base and of two."""
    a = _arrays(spark, sf).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_partkey").alias("pk")).distinct(), ["ok", "ln"])
    n = (2 + F.col("pk") % 3).cast("int")
    alleles = F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda i: F.when(i == 1, F.lit("A")).when((F.col("pk") + i) % 2 == 0, F.lit("C")).otherwise(F.lit("CT")))
    return a.select("pk", n.alias("n_alleles"), F.slice("pl", F.lit(1), (n * (n + 1) / 2).cast("int")).alias("pl"), alleles.alias("alleles"))


def _em_many(other: str) -> str:
    """Estimation for any number of alleles; ``other`` is the pseudocount of alternative a of a site."""
    i, j = _IJ
    post = f"list_transform(gls, lambda g: list_transform(range(1, len(g) + 1), lambda p: pow(10, g[p] + la[{i}[p] + 1] + la[{j}[p] + 1] + CASE WHEN {i}[p] = {j}[p] THEN 0 ELSE log10(2) END)))"
    return f"""{_ARR}, ids AS (SELECT DISTINCT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk FROM lineitem),
  v AS (SELECT pk, 2 + pk % 3 AS n, list_transform(pl[1:((2 + pk % 3) * (3 + pk % 3)) // 2], lambda x: x / -10.0) AS gl FROM a JOIN ids USING (ok, ln)),
  g AS (SELECT pk, n, list(gl) AS gls, list_transform(range(1, n + 1), lambda a: CASE WHEN a = 1 THEN 10.0 ELSE {other} END) AS prior FROM v GROUP BY pk, n),
  em AS (SELECT pk, n, gls, prior, list_transform(prior, lambda x: -log10(n)) AS la, list_transform(prior, lambda x: 0.0::DOUBLE) AS c, 0 AS it, false AS done FROM g
    UNION ALL
    SELECT pk, n, gls, prior, CASE WHEN n = 2 OR NOT rest THEN list_transform(range(1, n + 1), lambda a: log10((prior[a] + new[a]) / (list_sum(prior) + list_sum(new)))) ELSE la END, new, it + 1, rest FROM (
      SELECT *, list_max(list_transform(range(1, n + 1), lambda a: abs(new[a] - c[a]))) <= 0.1 OR it + 1 > 100 AS rest FROM (
        SELECT *, list_transform(range(0, n), lambda a: list_sum(list_transform(w, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda p: x[p] * (CAST({i}[p] = a AS INT) + CAST({j}[p] = a AS INT)))) / list_sum(x)))) AS new FROM (
          SELECT *, {post} AS w FROM em WHERE NOT done)))),
  fin AS (SELECT *, {post} AS w FROM em WHERE done),
  res AS (SELECT pk, n, list_transform(c, lambda x: x / list_sum(c)) AS af, it AS rounds, greatest(0, -10 * list_sum(list_transform(w, lambda x: log10(x[1] / list_sum(x))))) AS qual FROM fin)"""


def _estimate(e):
    share = [F.round(F.get("af", F.lit(a)), 6).alias(f"af{a}") for a in range(4)]
    return e.select("pk", F.col("n_alleles").cast("long").alias("n"), *share, "rounds", (F.round("qual", 5) + 0.0).alias("qual"))


_ESTIMATE = "SELECT pk, n, round(af[1], 6) AS af0, round(af[2], 6) AS af1, round(af[3], 6) AS af2, round(af[4], 6) AS af3, rounds, round(qual, 5) + 0.0 AS qual FROM res"


@query("af_em_multi", f"WITH RECURSIVE {_em_many('0.01')} {_ESTIMATE}")
def _(spark, sf):
    """Sites of mixed allele counts, each estimated in its row."""
    return _estimate(E.af_em(_many_alleles(spark, sf), ["pk"]))


@query("af_em_indel", f"WITH RECURSIVE {_em_many('CASE WHEN (pk + a) % 2 = 0 THEN 0.01 ELSE 0.00125 END')} {_ESTIMATE}")
def _(spark, sf):
    """The same sites by rounds over all vectors, with the prior of indels where an alternative has two bases."""
    return _estimate(E.af_em_distributed(_many_alleles(spark, sf), ["pk"], prior=E.site_prior(F.col("alleles"))))


@query("single_sample_none", f"""WITH RECURSIVE {_ARR}, v AS (SELECT DISTINCT list_transform(pl, lambda x: x / -10.0) AS gl, pl FROM a), pr AS (SELECT [10.0, 0.01, 0.01, 0.00125] AS prior),
  em AS (SELECT pl, [gl] AS gls, prior, list_transform(prior, lambda x: log10(0.25)) AS la, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS c, 0 AS it, false AS done FROM v, pr
    UNION ALL
    SELECT pl, gls, prior, list_transform(range(1, 5), lambda a: log10((prior[a] + new[a]) / (list_sum(prior) + list_sum(new)))), new, it + 1,
      list_max(list_transform(range(1, 5), lambda a: abs(new[a] - c[a]))) <= 0.1 OR it + 1 > 100 FROM (
      SELECT *, list_transform(range(0, 4), lambda a: list_sum(list_transform(w, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda p: x[p] * (CAST({_PI}[p] = a AS INT) + CAST({_PJ}[p] = a AS INT)))) / list_sum(x)))) AS new FROM (
        SELECT *, {_GT} AS w FROM em WHERE NOT done))),
  fin AS (SELECT pl, least(0, log10((w[1][1] + w[1][4] + w[1][6]) / list_sum(w[1]))) AS none FROM (SELECT *, {_GT} AS w FROM em WHERE done))
  SELECT ok, ln, round(none, 6) + 0.0 AS log10_none FROM a JOIN fin ON a.pl = fin.pl""")
def _(spark, sf):
    """P(no variant) of one sample over a reference, a SNP, a spanning deletion and a symbol, per line item. Equal
    likelihoods are computed once."""
    a = _arrays(spark, sf)
    alleles = F.array(*[F.lit(x) for x in ("A", "C", "*", G.NON_REF)])
    each = a.select("pl").distinct().select("pl", E.single_sample_log10_none(F.col("pl"), alleles).alias("v"))
    return a.join(each, "pl").select("ok", "ln", (F.round("v", 6) + 0.0).alias("log10_none"))
