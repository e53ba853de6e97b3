"""k-mers, candidates, scores, callset comparison and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import READS, SHIPMENTS, reads, reference_chunks, shipments, sql_day, sql_ref_base
from checks.registry import query, spread, table
from strandline.functions import strings as T
from strandline.operators import compare as V
from strandline.operators import kmers as K
from strandline.operators import paths as Pa
from strandline.operators import pruning as Pr
from strandline.operators import reference as R
from strandline.operators import sampling as Sa
from strandline.operators import scoring as S

# --- documents as sequences: letters onto bases by a fixed table, anything else is N ---

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26]


def dna(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    s = F.regexp_replace(F.translate(F.col("text"), _LETTERS, _BASES), "[^ACGT]", "N")
    return d.select("doc_id", "lang", s.alias("seq"))


DNA = f"dna AS (SELECT doc_id, lang, regexp_replace(translate(text, '{_LETTERS}', '{_BASES}'), '[^ACGT]', 'N', 'g') AS seq FROM documents)"
_KM = "km AS (SELECT lang, doc_id, substr(seq, i, {k}) AS kmer FROM (SELECT lang, doc_id, seq, unnest(generate_series(1, length(seq) - {k} + 1)) AS i FROM dna WHERE length(seq) >= {k}))"
_KC = _KM + ", kc AS (SELECT lang, kmer, count(*) AS n FROM km GROUP BY ALL)"


@query("kmer_counts", f"WITH {DNA}, {_KC.format(k=11)} SELECT n, count(*) AS kmers FROM kc GROUP BY n")
def _(spark, sf):
    return K.kmer_counts(dna(spark, sf), ["lang"], "seq", 11).groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


@query("solid_kmers", f"WITH {DNA}, {_KC.format(k=11)} SELECT lang, kmer, n FROM kc WHERE n >= 20")
def _(spark, sf):
    return K.solid(K.kmer_counts(dna(spark, sf), ["lang"], "seq", 11))


@query("repeated_kmers", f"WITH {DNA}, {_KM.format(k=25)} SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, kmer FROM km GROUP BY ALL HAVING count(*) > 1) GROUP BY 1")
def _(spark, sf):
    return K.repeated_kmers(dna(spark, sf), ["doc_id"], "seq", 25).groupBy("doc_id").agg(F.count(F.lit(1)).alias("repeated"))


def _three(name: str, source: str) -> str:
    """K-mers of 25 by their three pieces, one of which two k-mers with at most two differences share."""
    return f"{name} AS (SELECT lang, kmer, n, i, substr(kmer, 1 + 8 * CAST(i AS INT), CASE WHEN i = 2 THEN 9 ELSE 8 END) AS piece FROM {source}, range(3) t(i))"


@query("nearest_solid", f"""WITH {DNA}, {_KC.format(k=25)}, {_three('r', '(SELECT * FROM kc WHERE n < 20)')}, {_three('g', '(SELECT * FROM kc WHERE n >= 20)')},
  j AS (SELECT DISTINCT r.lang, r.kmer, g.kmer AS solid, g.n FROM r JOIN g ON r.lang = g.lang AND r.i = g.i AND r.piece = g.piece WHERE hamming(r.kmer, g.kmer) BETWEEN 1 AND 2)
  SELECT lang, kmer, arg_min(solid, (-n, solid)) AS solid, max(n) AS solid_n FROM j GROUP BY lang, kmer""")
def _(spark, sf):
    c = K.kmer_counts(dna(spark, sf), ["lang"], "seq", 25)
    return K.nearest_solid(c, ["lang"], 25)


_EDGES = f"""{READS},
  rr AS (SELECT k, unnest(string_split_regex(m, ' +')) AS r FROM (SELECT k, string_agg(CASE WHEN ascii(substr(qual, i, 1)) - 33 >= 10 THEN substr(seq, i, 1) ELSE ' ' END, '' ORDER BY i) AS m FROM (SELECT k, rid, seq, qual, unnest(range(1, n + 1)) AS i FROM (SELECT *, row_number() OVER () AS rid FROM reads)) GROUP BY k, rid)),
  w AS (SELECT k, substr(r, i, 6) AS w FROM (SELECT k, r, unnest(generate_series(1, length(r) - 5)) AS i FROM rr WHERE length(r) >= 6))"""


@query("kmer_edges", f"WITH {_EDGES} SELECT k, left(w, 5) AS src, right(w, 5) AS dst, count(*) AS support FROM w GROUP BY ALL")
def _(spark, sf):
    r = reads(spark, sf).select("k", K.usable_runs(F.col("seq"), F.col("qual")).alias("runs"))
    return K.kmer_edges(r, ["k"], "runs", 5)


def _graph(spark, sf):
    """The reads of every supplier as one k-mer graph each."""
    r = reads(spark, sf).select("k", K.usable_runs(F.col("seq"), F.col("qual")).alias("runs"))
    return K.kmer_edges(r, ["k"], "runs", 5)


_WHOLE = READS.replace("{", "{{").replace("}", "}}") + ", w AS (SELECT k, substr(seq, i, {n}) AS w FROM (SELECT k, seq, unnest(generate_series(1, n - {n} + 1)) AS i FROM reads WHERE n >= {n}))"


def _chains_sql(k: int, masked: bool = True, least: int = 1) -> str:
    """Edges of the k-mer graphs with the chain they lie on; cycles that nothing enters or leaves have their least edge."""
    return f"""{_EDGES if masked else _WHOLE.format(n=k + 1)},
  e AS MATERIALIZED (SELECT k, left(w, {k}) AS src, right(w, {k}) AS dst, count(*) AS support FROM w GROUP BY ALL HAVING count(*) >= {least}),
  ou AS (SELECT k, src AS node, count(*) AS o, sum(support) AS s FROM e GROUP BY ALL), i_ AS (SELECT k, dst AS node, count(*) AS i, sum(support) AS s FROM e GROUP BY ALL),
  th AS MATERIALIZED (SELECT ou.k, ou.node FROM ou JOIN i_ ON ou.k = i_.k AND ou.node = i_.node WHERE o = 1 AND i = 1),
  ch AS (SELECT e.*, src || '>' || dst AS chain, 1 AS no FROM e ANTI JOIN th ON e.k = th.k AND e.src = th.node
    UNION ALL SELECT e.k, e.src, e.dst, e.support, chain, no + 1 FROM ch JOIN th ON ch.k = th.k AND ch.dst = th.node JOIN e ON e.k = ch.k AND e.src = ch.dst),
  lo AS (SELECT e.* FROM e ANTI JOIN ch ON e.k = ch.k AND e.src = ch.src AND e.dst = ch.dst),
  cy AS (SELECT k, src, dst, support, src AS a, dst AS at FROM lo UNION SELECT cy.k, cy.src, cy.dst, cy.support, cy.a, lo.dst FROM cy JOIN lo ON cy.k = lo.k AND cy.at = lo.src),
  cc AS (SELECT cy.k, cy.src, cy.dst, cy.support, min(lo.src || '>' || lo.dst) AS chain FROM cy JOIN lo ON lo.k = cy.k AND lo.src = cy.at GROUP BY ALL),
  al AS MATERIALIZED (SELECT k, src, dst, support, chain, no FROM ch UNION ALL SELECT k, src, dst, support, chain, 1 FROM cc)"""


@query("low_weight_prune", f"WITH RECURSIVE {_chains_sql(5)} SELECT k, src, dst, support FROM al QUALIFY max(support) OVER (PARTITION BY k, chain) >= 2")
def _(spark, sf):
    return K.low_weight_prune(_graph(spark, sf), ["k"])


def _llr(others: str, own: str, q: str) -> str:
    """The odds of an end; harmonic numbers stand for the digamma function."""
    e = f"pow(10, -{q} / 10.0)"
    tilt = f"exp(list_sum(list_transform(range(0, CAST({others} AS BIGINT) + 1), lambda x: CASE WHEN x = 0 THEN 0.0 ELSE 1.0 / x END)) - list_sum(list_transform(range(0, CAST({own} AS BIGINT) + 1), lambda x: CASE WHEN x = 0 THEN 0.0 ELSE 1.0 / x END)))"
    z = f"((1 - {e}) / (1 - {e} + {e} * {tilt}))"
    spread = f"CASE WHEN {z} <= 0 OR {z} >= 1 THEN 0 ELSE -{z} * ln({z}) - (1 - {z}) * ln(1 - {z}) END"
    n = f"({others} + {own})"
    return f"({z} * (ln(1 - {e}) - ln({e})) + {spread} - ln({n} + 1.0) - (lgamma({n} + 1) - lgamma({own} + 1) - lgamma({others} + 1)))"


def _good_sql(name: str, rate: str) -> str:
    """Chains to keep at a rate of each region: ``name`` (k, chain)."""
    return f"""{name}_q AS (SELECT k, least(254, greatest(0, round(-10 * log10(greatest(rate, 1e-300))))) AS q FROM ({rate})),
  {name}_t AS MATERIALIZED (SELECT tb.*, CASE WHEN source THEN 0 WHEN q = 0 THEN -99 ELSE {_llr('(lt - head)', 'head', 'q')} END AS l, CASE WHEN sink THEN 0 WHEN q = 0 THEN -99 ELSE {_llr('(rt - tail)', 'tail', 'q')} END AS r FROM tb JOIN {name}_q USING (k)),
  {name}_w AS MATERIALIZED (SELECT k, fi AS v, chain, fi, la FROM {name}_t WHERE l >= -20 UNION ALL SELECT k, la, chain, fi, la FROM {name}_t WHERE r >= -20),
  {name}_h AS (SELECT k, arg_max((chain, fi, la), (top, n, fi, chain)) AS h FROM {name}_t GROUP BY k),
  {name}_s AS (SELECT k, v FROM (SELECT k, unnest([fi, la]) AS v FROM {name}_t WHERE l >= 0 AND r >= 0) GROUP BY k, v HAVING count(*) > 2),
  {name}_r AS (SELECT k, unnest([h[2], h[3]]) AS v FROM {name}_h UNION SELECT k, v FROM {name}_s UNION
    SELECT x.k, unnest([x.fi, x.la]) FROM {name}_r r JOIN {name}_w x ON r.k = x.k AND r.v = x.v),
  {name} AS MATERIALIZED (SELECT DISTINCT x.k, chain FROM {name}_w x JOIN {name}_r r ON r.k = x.k AND r.v = x.v UNION SELECT k, h[1] FROM {name}_h)"""


_ADAPTIVE = f"""{_chains_sql(11, False, 2)},
  tb AS MATERIALIZED (SELECT c.*, lt, rt, i1.node IS NULL AS source, o2.node IS NULL AS sink FROM (
      SELECT k, chain, split_part(chain, '>', 1) AS fi, max(support) FILTER (src || '>' || dst = chain) AS head, max(support) AS top, count(*) AS n, sum(support) AS mass,
        max((dst, support)) FILTER (mid IS NULL OR dst = split_part(chain, '>', 1)) AS tl, tl[1] AS la, tl[2] AS tail
      FROM (SELECT al.*, th.node AS mid FROM al LEFT JOIN th ON al.k = th.k AND al.dst = th.node) GROUP BY k, chain) c
    JOIN (SELECT k, node, s AS lt FROM ou) o1 ON o1.k = c.k AND o1.node = fi LEFT JOIN i_ i1 ON i1.k = c.k AND i1.node = fi
    JOIN (SELECT k, node, s AS rt FROM i_) i2 ON i2.k = c.k AND i2.node = la LEFT JOIN ou o2 ON o2.k = c.k AND o2.node = la),
  {_good_sql('g1', 'SELECT DISTINCT k, 0.001 AS rate FROM tb')},
  rt AS (SELECT tb.k, coalesce(sum(mass) FILTER (g1.chain IS NULL), 0) / sum(mass) AS rate FROM tb LEFT JOIN g1 ON tb.k = g1.k AND tb.chain = g1.chain GROUP BY tb.k),
  {_good_sql('g2', 'SELECT k, rate FROM rt')}"""


@query("adaptive_prune", f"WITH RECURSIVE {_ADAPTIVE} SELECT k, src, dst, support FROM al SEMI JOIN g2 ON al.k = g2.k AND al.chain = g2.chain")
def _(spark, sf):
    """The reads of every supplier as a graph of 11-mers, without the chains that are likely errors. Every 23rd base
    is one: windows seen once are left out before, and the bounds are wider than the defaults."""
    r = reads(spark, sf).select("k", F.array("seq").alias("runs"))
    return Pr.adaptive_prune(K.kmer_edges(r, ["k"], "runs", 11).where("support >= 2"), ["k"], log_odds=-20.0, seed_log_odds=0.0)


_STEPS = """n AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_suppkey % 20 AS k, l_linenumber || chr(97 + CAST(l_partkey % 3 AS INT)) AS node FROM lineitem),
  e AS (SELECT a.k, a.node AS src, b.node AS dst, count(*) AS support FROM n a JOIN n b ON a.ok = b.ok AND b.ln = a.ln + 1 GROUP BY ALL),
  c AS (SELECT k, src, dst, log10(support / sum(support) OVER (PARTITION BY k, src)) AS c FROM e),
  p AS (SELECT DISTINCT k, '1a' AS node, '1a' AS path, 0.0::DOUBLE AS score FROM e UNION ALL SELECT p.k, dst, path || right(dst, 1), score + c FROM p JOIN c ON p.k = c.k AND p.node = src)"""


@query("k_best_paths", f"""WITH RECURSIVE {_STEPS} SELECT k, path, round(score, 6) AS score, row_number() OVER (PARTITION BY k ORDER BY round(score, 10) DESC, path) AS rank
  FROM p WHERE node = '7b' QUALIFY rank <= 8""")
def _(spark, sf):
    """The steps from line to line of all orders as a graph for each of twenty groups of suppliers."""
    n = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), (F.col("l_suppkey") % 20).alias("k"),
        F.concat(F.col("l_linenumber").cast("string"), F.char(F.lit(97) + F.col("l_partkey") % 3)).alias("node"),
    )
    b = n.select("ok", (F.col("ln") - 1).alias("ln"), F.col("node").alias("dst"))
    e = n.join(b, ["ok", "ln"]).groupBy("k", F.col("node").alias("src"), "dst").agg(F.count(F.lit(1)).alias("support"))
    ends = e.select("k", F.lit("1a").alias("source"), F.lit("7b").alias("sink")).distinct()
    p = Pa.k_best_paths(e, ends, ["k"], k=8)
    return p.select("k", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("homopolymer_run", f"WITH {DNA} SELECT doc_id, list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+|N+'), lambda x: length(x))) AS longest FROM dna")
def _(spark, sf):
    return dna(spark, sf).select("doc_id", K.longest_homopolymer(F.col("seq")).cast("long").alias("longest"))


@query("repeat_quality_cap", "SELECT p_partkey AS pk, CAST(greatest(10, floor(41 - exp(p_size / (3 * pi())) + 0.5)) AS BIGINT) AS cap FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("pk"), K.repeat_quality_cap(F.col("p_size")).cast("long").alias("cap"))


# --- scores: each read against its chunk's reference and a variant of it ---

def _scores(spark, sf):
    r = reads(spark, sf).select(
        "k", F.floor((F.col("pos") - 1) / 256).alias("chunk"), F.concat_ws(":", "ok", "ln", "pos", "k", "cigar").alias("read_id"), "seq",
        F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33).alias("quals"), "mapq",
    )
    r = r.withColumn("quals", S.cap_qualities(F.col("quals"), F.col("mapq")))
    c = reference_chunks(spark, sf)
    flip = F.concat(F.left("bases", F.lit(100)), F.translate(F.substring("bases", 101, 1), "ACGT", "CGTA"), F.substr("bases", F.lit(102)))
    cand = c.select("k", "chunk", F.posexplode(F.array("bases", flip)).alias("cand_id", "bases"))
    return S.score_pairs(r, cand, ["k", "chunk"], salts=4)


@query("pair_scores")
def _(spark, sf):
    return S.sum_scores(_scores(spark, sf), ["k", "chunk"]).withColumn("total", F.round("total", 4))


# A cheap score over the same tables, so that the aggregations have an exact SQL twin.
def _cheap(spark, sf):
    r = reads(spark, sf)
    s = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda a: -((F.col("ok") * (a + 3) + F.col("ln") * 7) % 50) / 10.0)
    return r.select(F.col("k").alias("region"), F.concat_ws(":", "ok", "ln", "pos", "cigar", "flag", "rnext").alias("read_id"), F.posexplode(s).alias("cand_id", "score"))


_CHEAP = f"""{READS}, sc AS (SELECT k AS region, ok || ':' || ln || ':' || pos || ':' || cigar || ':' || flag || ':' || rnext AS read_id, a AS cand_id, -((ok * (a + 3) + ln * 7) % 50) / 10.0 AS score FROM reads, (VALUES (0), (1), (2)) AS t(a))"""


@query("sum_candidate_scores", f"WITH {_CHEAP}, t AS (SELECT region, cand_id, sum(score) AS total FROM sc GROUP BY ALL) SELECT region, arg_max(cand_id, (round(total, 6), cand_id)) AS best, round(max(total), 6) AS total FROM t GROUP BY region")
def _(spark, sf):
    t = S.sum_scores(_cheap(spark, sf), ["region"]).withColumn("total", F.round("total", 6))
    return S.best_candidate(t, ["region"]).withColumnRenamed("cand_id", "best").join(t.groupBy("region").agg(F.max("total").alias("total")), "region").withColumn("best", F.col("best").cast("long"))


_DISTINCT = "ds AS (SELECT region, read_id, cand_id, max(score) AS score FROM sc GROUP BY ALL)"


@query("informative_depth", f"""WITH {_CHEAP}, {_DISTINCT}, r AS (SELECT *, row_number() OVER (PARTITION BY region, read_id ORDER BY score DESC, cand_id) AS rn FROM ds),
  b AS (SELECT region, read_id, max(cand_id) FILTER (rn = 1) AS allele, max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2) AS lead FROM r GROUP BY ALL)
  SELECT region, allele, count(*) AS depth FROM b WHERE lead > 0.2000001 GROUP BY ALL""")
def _(spark, sf):
    mapping = spark.range(3).select(F.col("id").cast("int").alias("cand_id"), F.col("id").cast("long").alias("allele"))
    a = _cheap(spark, sf)
    m = a.select("region").distinct().crossJoin(F.broadcast(mapping))  # three rows per region
    alleles = S.marginalise(a, m, ["region"])
    return S.informative_depth(alleles, ["region"], threshold=0.2000001)


def _pair(a, b):
    return (f"round(sum(greatest({a}, {b}) + CASE WHEN abs({a} - {b}) < 8 THEN log10(1 + pow(10, -floor(abs({a} - {b}) * 10000.0 + 0.5) / 10000.0)) ELSE 0 END"
            " + log10(0.5)), 5)")


@query("genotype_likelihoods", f"""WITH {_CHEAP}, {_DISTINCT}, p AS (SELECT region, read_id, max(score) FILTER (cand_id = 0) AS a, max(score) FILTER (cand_id = 1) AS b,
    max(score) FILTER (cand_id = 2) AS c FROM ds GROUP BY ALL)
  SELECT region, round(sum(a), 5) AS g0, {_pair('a', 'b')} AS g1, round(sum(b), 5) AS g2, {_pair('a', 'c')} AS g3, {_pair('b', 'c')} AS g4, round(sum(c), 5) AS g5 FROM p GROUP BY region""")
def _(spark, sf):
    g = S.genotype_likelihoods(_cheap(spark, sf).withColumnRenamed("cand_id", "allele"), ["region"], 3)
    return g.select("region", *[F.round(F.col("gl")[i], 5).alias(f"g{i}") for i in range(6)])


# --- callsets: labels as truth, a length rule as calls ---

def _callset(spark, sf, shift):
    """Line items as a callset: the position is the day, alleles come from part and supplier."""
    s = shipments(spark, sf)
    gt = F.when((F.col("ok") + shift) % 5 == 0, "1|1").otherwise("0/1")
    return s.where((F.col("ok") + F.col("ln") + shift) % 7 != 0).select(
        F.concat(F.when(F.col("ok") % 2 == 0, "chr").otherwise(""), F.col("k").cast("string")).alias("contig"), F.col("start").alias("pos"),
        F.lower("flag").alias("ref"), F.when(F.col("ln") == 3, "c,*,g").when(F.col("ln") == 4, ".").otherwise("g").alias("alt"), gt.alias("gt"),
        F.create_map(F.lit("DP"), (F.col("qual") + (F.col("ok") % (3 + shift))).cast("string"), F.lit("GQ"), F.col("ln").cast("string")).alias("fields"),
        "ok", "ln", "end", "strand", "qual",
    )


_ORD = ["ok", "ln", "end", "strand", "qual", "contig"]


def _callset_sql(name, shift):
    return f"""{name}0 AS (SELECT CAST(k AS VARCHAR) AS contig, "start" AS pos, flag AS ref, unnest(string_split(CASE WHEN ln = 3 THEN 'C,*,G' ELSE 'G' END, ',')) AS alt,
      CASE WHEN (ok + {shift}) % 5 = 0 THEN '1/1' ELSE '0/1' END AS gt, qual + (ok % {3 + shift}) AS dp, ln AS gq,
      (ok, ln, "end", strand, qual, CASE WHEN ok % 2 = 0 THEN 'chr' ELSE '' END || k) AS o FROM shipments WHERE (ok + ln + {shift}) % 7 <> 0 AND ln <> 4),
    {name} AS (SELECT contig, pos, ref, alt, arg_max((gt, dp, gq), o) AS v FROM {name}0 WHERE alt <> '*' GROUP BY ALL)"""


@query(
    "callset_compare",
    f"""WITH {SHIPMENTS}, {_callset_sql('x', 0)}, {_callset_sql('y', 1)}, j AS (SELECT x.v AS a, y.v AS b FROM x FULL JOIN y ON x.contig = y.contig AND x.pos = y.pos AND x.ref = y.ref AND x.alt = y.alt)
    SELECT count(a) AS a_sites, count(b) AS b_sites, count(*) FILTER (a[1] = b[1] AND abs(a[2] - b[2]) <= 1 AND a[3] = b[3]) AS identical, count(*) FILTER (a[1] <> b[1]) AS genotype_differs,
      count(*) FILTER (a[1] = b[1] AND NOT (abs(a[2] - b[2]) <= 1 AND a[3] = b[3])) AS fields_differ, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM j""",
)
def _(spark, sf):
    a, b = (V.normalize_callset(_callset(spark, sf, i), _ORD) for i in (0, 1))
    return V.compare_callsets(a, b, tol=1)


def _truth(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    l = table(spark, sf, "labels")
    j = d.join(l, "doc_id")
    calls = j.where("n_chars > 1000").select("doc_id", "lang")
    truth = j.where("quality = 1").select("doc_id", "lang")
    return calls, truth, j.where("toxic = 0").select("doc_id", "lang")


_PR = """j AS (SELECT d.doc_id, lang, n_chars > 1000 AS c, quality = 1 AS t, toxic = 0 AS u FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _pr_sql(c):
    return f"""SELECT lang, count(*) FILTER ({c} AND t) AS tp, count(*) FILTER ({c} AND NOT t) AS fp, count(*) FILTER (NOT {c} AND t) AS fn FROM j WHERE {c} OR t GROUP BY lang"""


@query("precision_recall", f"""WITH {_PR}, g AS ({_pr_sql('c')}) SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
   round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""")
def _(spark, sf):
    calls, truth, _u = _truth(spark, sf)
    p = V.precision_recall(calls, truth, ["doc_id"], ["lang"])
    return p.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("f1_delta_gate", f"""WITH {_PR}, a AS ({_pr_sql('c')}), b AS ({_pr_sql('u')}), d AS (SELECT coalesce(a.lang, b.lang) AS lang,
   coalesce(2 * b.tp / (2 * b.tp + b.fp + b.fn), 0) - coalesce(2 * a.tp / (2 * a.tp + a.fp + a.fn), 0) AS delta FROM a FULL JOIN b ON a.lang = b.lang)
   SELECT lang, round(delta, 6) AS delta, abs(delta) <= 0.1 AS passes FROM d""")
def _(spark, sf):
    calls, truth, other = _truth(spark, sf)
    a, b = (V.precision_recall(c, truth, ["doc_id"], ["lang"]) for c in (calls, other))
    return V.f1_delta_gate(a, b, ["lang"], 0.1).withColumn("delta", F.round("delta", 6))


@query("strict_diff", """WITH a AS (SELECT l_returnflag || l_linenumber AS value, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag || l_linenumber AS value, count(*) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
   SELECT CASE WHEN coalesce(n, 0) > coalesce(m, 0) THEN 'a' ELSE 'b' END AS side, coalesce(a.value, b.value) AS value, abs(coalesce(n, 0) - coalesce(m, 0)) AS n FROM a FULL JOIN b ON a.value = b.value WHERE coalesce(n, 0) <> coalesce(m, 0)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus", F.concat("l_returnflag", "l_linenumber").alias("value"))
    return V.strict_diff(li.where("l_linestatus = 'F'").select("value"), li.where("l_linestatus = 'O'").select("value"))


@query("dedupe_first_wins", f"""WITH {SHIPMENTS} SELECT k, "start", flag, ok, ln FROM shipments QUALIFY row_number() OVER (PARTITION BY k, "start", flag ORDER BY ok, ln, "end", strand, qual) = 1""")
def _(spark, sf):
    s = shipments(spark, sf)
    return V.first_wins(s, ["k", "start", "flag"], ["ok", "ln", "end", "strand", "qual"]).select("k", "start", "flag", "ok", "ln")


# --- scalars ---

@query("rev_comp", f"WITH {DNA} SELECT doc_id, md5(translate(reverse(seq), 'ACGTacgt', 'TGCAtgca')) AS rc FROM dna")
def _(spark, sf):
    return dna(spark, sf).select("doc_id", F.md5(T.reverse_complement("seq")).alias("rc"))


@query("quality_trim", f"""WITH {READS}, f AS (SELECT *, regexp_extract(qual, '^[!-=]*') AS h, regexp_extract(qual, '[!-=]*$') AS t FROM reads)
   SELECT k, count(*) AS n, CAST(sum(CASE WHEN length(h) = length(qual) THEN length(qual) ELSE length(qual) - length(h) - length(t) END) AS BIGINT) AS kept FROM f GROUP BY k""")
def _(spark, sf):
    t = reads(spark, sf).select("k", T.quality_trim("seq", "qual", 29).alias("t"))
    return t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t.seq")).cast("long").alias("kept"))


@query("hamming_distance", "SELECT p_partkey AS pk, CASE WHEN length(p_name) = length(p_brand || 'x') THEN hamming(p_name, p_brand || 'x') END AS distance FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("pk"), T.hamming(F.col("p_name"), F.concat("p_brand", F.lit("x"))).cast("long").alias("distance"))


# --- windows of the reference, indels at their leftmost place, ranked alleles ---

_SPAN = "pos - 150 AS a, pos + n * CASE WHEN ln = 7 THEN 20 ELSE 1 END AS z"
_LAST = f"(SELECT (CAST(floor((max({sql_day('l_shipdate')} + CAST(l_quantity AS BIGINT)) - 9000 + 64) / 256) AS BIGINT) + 1) * 256 FROM lineitem)"


@query("reference_windows", f"""WITH {READS}, s AS (SELECT DISTINCT k, {_SPAN} FROM reads), c AS (SELECT k, a, z, greatest(a, 1) AS s, least(z, {_LAST}) AS e FROM s)
  SELECT k, a, z, s AS "start", e AS "end", md5(string_agg(b, '' ORDER BY p)) AS bases FROM (SELECT k, a, z, s, e, p, {sql_ref_base('k', 'p')} AS b FROM (SELECT *, unnest(generate_series(s, e)) AS p FROM c)) GROUP BY ALL""")
def _(spark, sf):
    """Reads with 150 bases before them, some of them with long ones after; clamped at the contig's start."""
    s = reads(spark, sf).select("k", (F.col("pos") - 150).alias("start"), (F.col("pos") + F.length("seq") * F.when(F.col("ln") == 7, 20).otherwise(1)).alias("end")).distinct()
    s = s.withColumn("a", F.col("start")).withColumn("z", F.col("end"))
    w = R.reference_windows(s, reference_chunks(spark, sf), ["k"], chunk_size=256, reach=256)
    return w.select("k", "a", "z", "start", "end", F.md5("bases").alias("bases"))


@query("ranked_alleles", """WITH s AS (SELECT l_suppkey AS k, l_linenumber AS allele, round(l_discount * l_quantity, 6) AS score FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY k, allele ORDER BY score DESC) AS n FROM s),
  b AS (SELECT k, allele, max(score) FILTER (n = 1) AS best, max(score) FILTER (n = 2) AS second FROM r GROUP BY k, allele)
  SELECT k, CAST(allele AS BIGINT) AS allele, best, second, row_number() OVER (PARTITION BY k ORDER BY allele = 3 DESC, best DESC, second DESC NULLS LAST, allele) AS rank FROM b QUALIFY rank <= 4""")
def _(spark, sf):
    """Line numbers as alleles of a supplier, the third as the reference; ten genotypes allow four alleles."""
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("long").alias("allele"), F.round(F.col("l_discount") * F.col("l_quantity"), 6).alias("score"))
    r = Sa.ranked_alleles(s, ["k"], is_reference=F.col("allele") == 3, max_genotypes=10)
    return r.withColumn("rank", F.col("rank").cast("long"))
