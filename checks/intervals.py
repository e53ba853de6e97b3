"""Interval algebra and range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bases import (
    CUSTOMER_SHIPMENTS, ORDER_WINDOWS, SHIPMENTS, customer_shipments, day, merged_sql, order_windows,
    shipments, sql_day,
)
from checks.registry import query, table
from strandline.operators import intervals as I
from strandline.operators import joins as J

K = ["k", "flag"]


@query("merge_intervals", f"WITH {SHIPMENTS}, {merged_sql('shipments', 'k, flag', 'm')} SELECT * FROM m")
def _(spark, sf):
    return I.merge_intervals(shipments(spark, sf).select(*K, "start", "end"), K)


def _sides(spark, sf):
    s = shipments(spark, sf)
    a = s.where("strand = 'F'").select("k", "start", "end")
    b = s.where("strand = 'O'").select("k", "start", "end")
    return a, b


_SIDES = (
    SHIPMENTS
    + """, a AS (SELECT k, "start", "end" FROM shipments WHERE strand = 'F'),
  b AS (SELECT k, "start", "end" FROM shipments WHERE strand = 'O'),
  da AS (SELECT DISTINCT k, unnest(generate_series("start", "end")) AS d FROM a),
  db AS (SELECT DISTINCT k, unnest(generate_series("start", "end")) AS d FROM b)"""
)
_DAYS_TO_SPANS = """ SELECT k, min(d) AS "start", max(d) AS "end" FROM
  (SELECT k, d, d - row_number() OVER (PARTITION BY k ORDER BY d) AS g FROM x) GROUP BY k, g"""


@query(
    "subtract_intervals",
    f"WITH {_SIDES}, x AS (SELECT * FROM da EXCEPT SELECT * FROM db)" + _DAYS_TO_SPANS,
)
def _(spark, sf):
    return I.subtract_intervals(*_sides(spark, sf), ["k"])


@query(
    "intersect_intervals",
    f"WITH {_SIDES}, x AS (SELECT * FROM da INTERSECT SELECT * FROM db)" + _DAYS_TO_SPANS,
)
def _(spark, sf):
    return I.intersect_intervals(*_sides(spark, sf), ["k"])


_CONTIGS = f"""contigs AS (SELECT l_suppkey AS k, max({sql_day('l_shipdate')}) AS length FROM lineitem GROUP BY 1)"""


def _contigs(spark, sf):
    """Suppliers as contigs, as long as their last shipping day."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.max(day("l_shipdate")).alias("length"))


@query(
    "pad_merge_shards",
    f"""WITH {SHIPMENTS}, {_CONTIGS}, clipped AS (SELECT k, "start", least("end", length) AS "end"
      FROM shipments JOIN contigs USING (k)),
    {merged_sql('clipped', 'k', 'u')},
    p AS (SELECT k, greatest(1, "start" - 10) AS "start", least(length, "end" + 10) AS "end" FROM u JOIN contigs USING (k)),
    {merged_sql('p', 'k', 'pm')}
    SELECT k, "start", "end", 'user' AS kind FROM u UNION ALL SELECT k, "start", "end", 'padded' FROM pm""",
)
def _(spark, sf):
    c = _contigs(spark, sf)
    s = shipments(spark, sf).join(c, "k")
    s = s.select("k", "start", F.least("end", "length").alias("end"))
    return I.make_shards(s, c, "k", pad=10)


@query(
    "tile_counts",
    f"""WITH {SHIPMENTS}, {merged_sql('shipments', 'k', 'm')},
    t AS (SELECT k, unnest(generate_series("start", "end", 100)) AS tile_start, "end" FROM m),
    tt AS (SELECT k, tile_start, least(tile_start + 99, "end") AS tile_end FROM t)
    SELECT tt.k, tile_start, tile_end, count(s.k) AS n_reads FROM tt
      LEFT JOIN shipments s ON s.k = tt.k AND s."start" <= tile_end AND tile_start <= s."end"
    GROUP BY ALL""",
)
def _(spark, sf):
    s = shipments(spark, sf).select("k", "start", "end")
    t = I.tile(I.merge_intervals(s, ["k"]), 100).select("k", "tile_start", "tile_end")
    return J.overlap_count(t, s, ["k"], ("tile_start", "tile_end"), out="n_reads")


_PAIR = f"WITH {CUSTOMER_SHIPMENTS}, {ORDER_WINDOWS}"
_ON = """ON cs.c = ow.c AND cs."start" <= ow."end" AND ow."start" <= cs."end" """


@query(
    "overlap_join_pairs",
    _PAIR + f"""SELECT cs.c, ok, ln, feature, greatest(cs."start", ow."start") AS "start",
       least(cs."end", ow."end") AS "end" FROM cs JOIN ow {_ON}""",
)
def _(spark, sf):
    a = customer_shipments(spark, sf).withColumnsRenamed({"start": "a_start", "end": "a_end"})
    b = order_windows(spark, sf).withColumnsRenamed({"start": "b_start", "end": "b_end"})
    return J.overlap_join(a, b, ["c"]).select(
        "c", "ok", "ln", "feature", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end")
    )


@query("overlap_join_counts", _PAIR + f"SELECT cs.c, count(*) AS n FROM cs JOIN ow {_ON} GROUP BY cs.c")
def _(spark, sf):
    n = J.overlap_count(customer_shipments(spark, sf), order_windows(spark, sf), ["c"], out="n")
    return n.where("n > 0").groupBy("c").agg(F.sum("n").alias("n"))


@query(
    "count_reads_in_region",
    f"""WITH {SHIPMENTS}, r AS (SELECT DISTINCT k, "start" - 5 AS "start", "start" + 5 AS "end" FROM shipments WHERE flag = 'N')
    SELECT r.k, r."start", r."end", count(s.k) AS n_reads FROM r LEFT JOIN shipments s
      ON s.k = r.k AND s."start" <= r."end" AND r."start" <= s."end" GROUP BY ALL""",
)
def _(spark, sf):
    s = shipments(spark, sf)
    r = s.where("flag = 'N'").select("k", (F.col("start") - 5).alias("start"), (F.col("start") + 5).alias("end")).distinct()
    return J.overlap_count(r, s.select("k", "start", "end"), ["k"], out="n_reads")


@query(
    "list_reads_in_region",
    f"""WITH {SHIPMENTS}, {_CONTIGS}, r AS (SELECT k, length - 20 AS lo, length AS hi FROM contigs)
    SELECT r.k, ok, ln FROM r JOIN shipments s ON s.k = r.k AND s."start" <= hi AND lo <= s."end" """,
)
def _(spark, sf):
    r = _contigs(spark, sf).select("k", (F.col("length") - 20).alias("lo"), F.col("length").alias("hi"))
    s = shipments(spark, sf).select("k", "ok", "ln", "start", "end")
    return J.overlap_join(r, s, ["k"], ("lo", "hi"), ("start", "end")).select("k", "ok", "ln")


@query(
    "overlap_semi",
    _PAIR + """SELECT c, ok, ln FROM cs WHERE EXISTS (SELECT 1 FROM ow WHERE cs.c = ow.c AND ow.feature <> -1
      AND cs."start" <= ow."end" AND ow."start" <= cs."end")""",
)
def _(spark, sf):
    return J.overlap_semi(customer_shipments(spark, sf), order_windows(spark, sf), ["c"]).select("c", "ok", "ln")


@query(
    "overlap_anti",
    _PAIR + """SELECT c, ok, ln FROM cs WHERE NOT EXISTS (SELECT 1 FROM ow WHERE cs.c = ow.c
      AND cs."start" <= ow."end" AND ow."start" <= cs."end")""",
)
def _(spark, sf):
    return J.overlap_anti(customer_shipments(spark, sf), order_windows(spark, sf), ["c"]).select("c", "ok", "ln")


@query(
    "position_in_intervals",
    f"""WITH {SHIPMENTS}, p AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_suppkey AS k,
       {sql_day('l_shipdate')} AS pos FROM lineitem)
    SELECT p.ok, p.ln, EXISTS (SELECT 1 FROM shipments s WHERE s.k = p.k AND s.flag = 'A' AND s.strand = 'F'
      AND pos BETWEEN s."start" AND s."end") AS inside FROM p""",
)
def _(spark, sf):
    s = shipments(spark, sf)
    p = s.select("ok", "ln", "k", F.col("start").alias("pos"))
    spans = s.where("flag = 'A' and strand = 'F'").select("k", "start", "end")
    return I.position_flags(p, spans, ["k"]).select("ok", "ln", "inside")


@query(
    "covering_first_per_sample",
    f"""WITH {SHIPMENTS}, b AS (SELECT k, flag AS sample, "start", "end", ok * 8 + ln AS input_ord FROM shipments),
    p AS (SELECT DISTINCT k, "start" AS pos FROM b)
    SELECT p.k, pos, sample, input_ord, b."start", b."end" FROM p JOIN b ON p.k = b.k AND pos BETWEEN b."start" AND b."end"
    QUALIFY row_number() OVER (PARTITION BY p.k, pos, sample ORDER BY input_ord, b."start") = 1""",
)
def _(spark, sf):
    b = shipments(spark, sf).select(
        "k", F.col("flag").alias("sample"), "start", "end", (F.col("ok") * 8 + F.col("ln")).alias("input_ord")
    )
    p = b.select("k", F.col("start").alias("pos")).distinct()
    return J.covering_rows(p, b, ["k"])


@query(
    "parse_intervals",
    f"""WITH {SHIPMENTS} SELECT 'S' || k AS contig, "start", "end", flag = 'R' AS exclude, CAST(NULL AS VARCHAR) AS error FROM shipments""",
)
def _(spark, sf):
    s = shipments(spark, sf)
    text = s.groupBy("ok").agg(
        F.array_join(
            F.collect_list(
                F.concat(
                    F.when(F.col("flag") == "R", "^").otherwise(""), F.lit("S"), F.col("k").cast("string"),
                    F.lit(":"), F.format_number("start", 0), F.lit("-"), F.col("end").cast("string"),
                )
            ),
            ";",
        ).alias("text")
    )
    return I.parse_intervals(text)


@query(
    "validate_intervals",
    f"""WITH {SHIPMENTS}, {_CONTIGS} SELECT k, "start", "end", 'end past contig' AS reason
      FROM shipments JOIN contigs USING (k) WHERE "end" > length""",
)
def _(spark, sf):
    s = shipments(spark, sf).select(F.col("k").cast("string").alias("k"), "start", "end")
    c = _contigs(spark, sf).withColumn("k", F.col("k").cast("string"))
    return I.validate_intervals(s, c, "k").withColumn("k", F.col("k").cast("long"))


@query(
    "dictionary_diff",
    f"""WITH {_CONTIGS}, f AS (SELECT l_suppkey AS k, max({sql_day('l_shipdate')}) AS length FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT CAST(coalesce(f.k, contigs.k) AS VARCHAR) AS k, f.length AS file_length, contigs.length AS dict_length,
      CASE WHEN contigs.length IS NULL THEN 'not in dictionary' WHEN f.length IS NULL THEN 'not in file' ELSE 'length differs' END AS reason
    FROM f FULL JOIN contigs ON f.k = contigs.k WHERE f.length IS DISTINCT FROM contigs.length""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    f = li.groupBy(F.col("l_suppkey").cast("string").alias("k")).agg(F.max(day("l_shipdate")).alias("length"))
    return I.dictionary_diff(f, _contigs(spark, sf).withColumn("k", F.col("k").cast("string")), "k")


@query(
    "mate_pairs",
    f"""WITH {SHIPMENTS}, x AS (SELECT ok, ln, "start", row_number() OVER w AS rn, lead(ln) OVER w AS mate_ln,
       lead("start") OVER w AS mate_start FROM shipments WINDOW w AS (PARTITION BY ok ORDER BY "start", ln, k, "end", flag, strand, qual))
    SELECT ok, ln, "start", mate_ln, mate_start FROM x WHERE rn % 2 = 1 AND mate_ln IS NOT NULL""",
)
def _(spark, sf):
    s = shipments(spark, sf)
    p = J.mate_pairs(s, ["ok"], ["start", "ln", "k", "end", "flag", "strand", "qual"], payload=["ln", "start"])
    return p.select(
        "ok", F.col("left.ln").alias("ln"), F.col("left.start").alias("start"),
        F.col("right.ln").alias("mate_ln"), F.col("right.start").alias("mate_start"),
    )


@query(
    "read_group_sample",
    """SELECT o_orderpriority AS sample, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, sf):
    rg = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rg"), F.col("o_orderpriority").alias("sample"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rg"))
    return J.strict_dimension_join(li, rg, "rg", "sample").groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query(
    "force_active",
    f"""WITH {SHIPMENTS}, f AS (SELECT k, "start" AS fs, "end" AS fe FROM shipments WHERE flag = 'R' AND strand = 'O'),
    p AS (SELECT k, "start" AS pos, max(qual) / 10.0 AS prob FROM shipments GROUP BY ALL)
    SELECT p.k, pos, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.k = p.k AND pos BETWEEN fs AND fe) THEN 1.0 ELSE round(prob, 6) END AS prob FROM p""",
)
def _(spark, sf):
    from strandline.operators.signal import force_active

    s = shipments(spark, sf)
    feats = s.where("flag = 'R' and strand = 'O'").select("k", "start", "end")
    p = s.groupBy("k", F.col("start").alias("pos")).agg((F.max("qual") / 10.0).alias("prob"))
    return force_active(p, ["k"], feats).select("k", "pos", F.round("prob", 6).alias("prob"))
