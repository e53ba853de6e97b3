"""Soft-filter rules, read filters with reasons, caps and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import READS, SHIPMENTS, reads, shipments
from checks.registry import query, table
from strandline.operators import filters as X
from strandline.operators import sampling as S


def _sites(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").cast("long").alias("ln"),
        F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("QUAL"),
        F.when(F.col("l_linenumber") != 3, F.round(F.col("l_discount") * 100)).alias("QD"),
        (F.col("l_extendedprice") / 1000).alias("FS"),
        F.round(F.col("l_tax") * 100).alias("SOR"),
        (F.col("l_quantity") + 20).alias("MQ"),
        (F.col("l_linenumber") * -4.0).alias("MQRankSum"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * -3.5).alias("ReadPosRankSum"),
        (F.col("l_linestatus") == "F").alias("is_snp"),
    )


_SITES = """sites AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, nullif(l_quantity, 7) AS "QUAL",
  CASE WHEN l_linenumber <> 3 THEN round(l_discount * 100) END AS "QD", l_extendedprice / 1000 AS "FS", round(l_tax * 100) AS "SOR",
  l_quantity + 20 AS "MQ", l_linenumber * -4.0 AS "MQRankSum",
  CASE WHEN l_returnflag <> 'N' THEN l_linenumber * -3.5 END AS "ReadPosRankSum", l_linestatus = 'F' AS is_snp FROM lineitem)"""


def _sql_rules(rules):
    cases = []
    for e, n in rules:
        name, op, num = e.split()
        col = 'coalesce("QUAL", -10)' if name == "QUAL" else f'"{name}"'
        if op in ("==", "="):
            cond = f"abs({col} - {num}) < 1e-12"
        elif op == "!=":
            cond = f"abs({col} - {num}) >= 1e-12"
        else:
            cond = f"{col} {op} {num}"
        cases.append(f"CASE WHEN {cond} THEN '{n}' END")
    return f"coalesce(nullif(concat_ws(';', {', '.join(cases)}), ''), 'PASS')"


_RULES = [("QD < 2.0", "lowqd"), ("QUAL <= 10", "lowqual"), ("SOR >= 7", "sor"), ("MQ == 40", "mq40"), ("FS != 5.5", "fs"), ("FS > 70", "fs70")]


@query("hard_filter_rules", f"WITH {_SITES} SELECT ok, ln, {_sql_rules(_RULES)} AS filters FROM sites")
def _(spark, sf):
    return X.hard_filter(_sites(spark, sf), _RULES).select("ok", "ln", F.array_join("filters", ";").alias("filters"))


_PRESET = f"CASE WHEN is_snp THEN {_sql_rules(X.SNP_RULES)} ELSE {_sql_rules(X.INDEL_RULES)} END"


@query("hard_filter_preset", f"WITH {_SITES} SELECT filters, count(*) AS n FROM (SELECT {_PRESET} AS filters FROM sites) GROUP BY 1")
def _(spark, sf):
    f = X.hard_filter_by_class(_sites(spark, sf), F.col("is_snp"))
    return f.groupBy(F.array_join("filters", ";").alias("filters")).agg(F.count(F.lit(1)).alias("n"))


_OPS = {"q": "MIS=X", "r": "MDN=X"}
_LEN = lambda ops: f"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{ops}]', 1), lambda x: CAST(x AS BIGINT))), 0)"
_FAIL = f"""CASE WHEN mapq < 20 THEN 'mapq_below_min' WHEN mapq = 255 THEN 'mapq_unavailable' WHEN flag & 4 <> 0 THEN 'unmapped'
  WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 512 <> 0 THEN 'vendor_fail'
  WHEN {_LEN('MDN=XP')} <= 0 THEN 'no_reference_bases'
  WHEN regexp_matches(cigar, '[ID][0-9]+[ID]') OR regexp_matches(cigar, '^([0-9]+[SH])*[0-9]+D') OR regexp_matches(cigar, '[0-9]+D([0-9]+[SH])*$') THEN 'bad_cigar'
  WHEN rg IS NULL OR length(seq) = 0 OR length(seq) <> length(qual) OR cigar LIKE '%N%' OR pos < 1 OR {_LEN('MIS=X')} <> length(seq) THEN 'not_well_formed' END"""


@query("filter_fail_reason", f"WITH {READS}, f AS (SELECT coalesce({_FAIL}, 'pass') AS reason FROM reads) SELECT reason, count(*) AS count FROM f GROUP BY 1")
def _(spark, sf):
    return X.filter_report(X.filter_reads_standard(reads(spark, sf), 20, report="reason"), "reason")


_WF = f"rg IS NOT NULL AND length(seq) > 0 AND length(seq) = length(qual) AND NOT cigar LIKE '%N%' AND (flag & 4 <> 0 OR (pos >= 1 AND {_LEN('MDN=X')} >= 1 AND {_LEN('MIS=X')} = length(seq)))"


@query("filter_reads_minimal", f"WITH {READS} SELECT ok, ln FROM reads WHERE {_WF} AND mapq <> 255 AND mapq >= 20 AND flag & {4 + 256 + 1024 + 2048} = 0")
def _(spark, sf):
    return X.filter_reads_minimal(reads(spark, sf)).select("ok", "ln")


@query("filter_reads_export", f"WITH {READS} SELECT ok, ln FROM reads WHERE {_WF} AND mapq >= 20 AND flag & {4 + 256 + 1024 + 2048} = 0")
def _(spark, sf):
    return X.filter_reads_export(reads(spark, sf)).select("ok", "ln")


@query(
    "filter_reads_chain",
    f"""WITH {READS} SELECT ok, ln FROM reads WHERE flag & {4 + 256 + 1024} = 0 AND mapq >= 20
      AND length(seq) - {_LEN('S')} >= 10 AND (flag & 1 = 0 OR flag & 8 <> 0 OR flag & 4 <> 0 OR rnext = '=' OR rnext = contig)""",
)
def _(spark, sf):
    r = X.filter_flags(reads(spark, sf), 0, drop_supplementary=False)
    return X.mate_on_same_contig(X.min_unclipped_length(X.assembly_mapq(r))).select("ok", "ln")


@query("flag_columns", f"WITH {READS} SELECT " + ", ".join(f"count(*) FILTER (flag & {b} <> 0) AS is_{n}" for n, b in X.FLAGS.items()) + " FROM reads")
def _(spark, sf):
    f = X.flag_columns(reads(spark, sf))
    return f.agg(*[F.count(F.when(F.col(f"is_{n}"), 1)).alias(f"is_{n}") for n in X.FLAGS])


@query(
    "validate_reads",
    f"""WITH {READS}, rgs AS (SELECT DISTINCT 'g' || (l_linenumber % 5) AS rg FROM lineitem) SELECT reason, count(*) AS n FROM (
      SELECT 'cigar length differs from sequence length' AS reason FROM reads WHERE flag & 4 = 0 AND {_LEN('MIS=X')} <> length(seq)
      UNION ALL SELECT 'mapped read without a position' FROM reads WHERE flag & 4 = 0 AND pos < 1
      UNION ALL SELECT 'read group missing from header' FROM reads WHERE rg IS NOT NULL AND rg NOT IN (SELECT rg FROM rgs)) GROUP BY 1""",
)
def _(spark, sf):
    r = reads(spark, sf)
    rgs = table(spark, sf, "lineitem").select(F.concat(F.lit("g"), (F.col("l_linenumber") % 5).cast("string")).alias("rg")).distinct()
    return X.validate_reads(r, rgs).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("mask_ambiguous", "SELECT doc_id, md5(translate(text, 'RYMKWSBDHVrymkwsbdhvn', 'NNNNNNNNNNNNNNNNNNNNN')) AS masked FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.mask_ambiguous("text")).alias("masked"))


@query(
    "remap_mapq",
    """SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, CAST(CASE WHEN xq <= 30 THEN xq WHEN xq <= 60 THEN round(30 + (xq - 30) / 30.0 * 10)
      WHEN xq <= 100 THEN round(40 + (xq - 60) / 40.0 * 5) WHEN xq <= 200 THEN round(45 + (xq - 100) / 100.0 * 5) ELSE 50 END AS BIGINT) AS mapq
    FROM (SELECT *, CAST(l_quantity * 6 AS BIGINT) AS xq FROM lineitem)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    xq = (F.col("l_quantity") * 6).cast("int")
    return li.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"),
        X.remap_mapq(xq, F.lit(0)).cast("long").alias("mapq"),
    )


@query("dedupe_reads", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_shipdate, l_linenumber FROM lineitem)")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    r = li.select(F.col("l_orderkey").alias("qname"), F.col("l_shipdate").alias("pos"), F.col("l_linenumber").alias("flag"))
    return X.dedupe_reads(r.unionAll(r)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "variant_type",
    """WITH v AS (SELECT p_partkey AS pk, p_brand AS ref, [p_type, p_name] AS alts FROM part)
    SELECT type, count(*) AS n FROM (SELECT CASE WHEN length(ref) = 1 AND length(alts[1]) = 1 AND length(alts[2]) = 1 THEN 'SNP'
      WHEN length(alts[1]) > length(ref) OR length(alts[2]) > length(ref) THEN 'insertion'
      WHEN length(alts[1]) < length(ref) OR length(alts[2]) < length(ref) THEN 'deletion' ELSE 'complex' END AS type FROM v) GROUP BY 1""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("ref"), F.array("p_type", "p_name").alias("alts"))
    return p.groupBy(X.variant_type().alias("type")).agg(F.count(F.lit(1)).alias("n"))


# --- sampling ---

@query(
    "cap_per_start",
    f"""WITH {SHIPMENTS} SELECT k, "start", ok, ln FROM shipments
      QUALIFY row_number() OVER (PARTITION BY k, "start" ORDER BY ok, ln, "end", flag, strand, qual) <= 1""",
)
def _(spark, sf):
    s = shipments(spark, sf)
    order = [F.col(c) for c in ("ok", "ln", "end", "flag", "strand", "qual")]
    return S.cap_per_start(s, ["k"], "start", 1, order_by=order).select("k", "start", "ok", "ln")


@query("top_k_alleles", """SELECT l_partkey AS pk, l_suppkey AS allele, n, rank FROM (SELECT l_partkey, l_suppkey, count(*) AS n,
   row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3""")
def _(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("allele")).agg(F.count(F.lit(1)).alias("n"))
    return S.top_k(c, ["pk"], [F.col("n").desc(), F.col("allele")], 3, rank="rank").withColumn("rank", F.col("rank").cast("long"))


@query(
    "systematic_sample",
    """WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS total FROM events)
    SELECT event_id FROM t WHERE i % greatest(1, total // 1000) = 0 AND i // greatest(1, total // 1000) < 1000""",
)
def _(spark, sf):
    return S.systematic_sample(table(spark, sf, "events").select("event_id"), "event_id", 1000)


@query(
    "allele_biased_counts",
    """WITH n AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
        count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    rm AS (SELECT *, CAST(floor((a + n + r) * 0.1) AS BIGINT) AS x, CAST(floor((a + n + r) * 0.1) AS BIGINT) // 2 AS h FROM n),
    opt AS (SELECT k, unnest([0, 1, 2, 3, 4, 5, 6]) AS o, unnest([
       [a, n, r], [greatest(a - x, 0), n, r], [greatest(a - h, 0), greatest(n - h, 0), r], [greatest(a - h, 0), n, greatest(r - h, 0)],
       [a, greatest(n - x, 0), r], [a, greatest(n - h, 0), greatest(r - h, 0)], [a, n, greatest(r - x, 0)]]) AS v FROM rm),
    sc AS (SELECT k, o, v, least(list_sort(v)[3] - list_sort(v)[2] + list_sort(v)[1], list_sort(v)[2] + list_sort(v)[1]) AS s FROM opt),
    best AS (SELECT k, v FROM sc QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, o) = 1)
    SELECT k, unnest(['A', 'N', 'R']) AS flag, unnest(v) AS kept FROM best""",
)
def _(spark, sf):
    s = shipments(spark, sf)
    kept = S.allele_biased_cap(s, ["k"], "flag", 0.1, ["ok", "ln", "start", "end", "qual"])
    return kept.groupBy("k", "flag").agg(F.count(F.lit(1)).alias("kept"))


@query("genotype_count", "SELECT p_partkey AS pk, CAST((p_size + 1) * p_size / 2 AS BIGINT) AS diploid, CAST(p_size * (p_size + 1) * (p_size + 2) / 6 AS BIGINT) AS triploid FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size").cast("long")
    return p.select(F.col("p_partkey").alias("pk"), S.genotype_count(n, 2).alias("diploid"), S.genotype_count(n, 3).alias("triploid"))
