"""How the driver's tables stand in for intervals, features, reads, signals and sequences.

Each mapping exists twice: a DataFrame builder and the DuckDB text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import spread, table


def day(col: str):
    return F.unix_date(F.to_date(F.col(col))).cast("long")


def sql_day(col: str) -> str:
    return f"CAST(date_diff('day', DATE '1970-01-01', CAST({col} AS DATE)) AS BIGINT)"


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as intervals: supplier and return flag are the key, one day per unit of quantity."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("k"),
        F.col("l_returnflag").alias("flag"),
        day("l_shipdate").alias("start"),
        (day("l_shipdate") + F.col("l_quantity").cast("long") - 1).alias("end"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").cast("long").alias("ln"),
        F.col("l_linestatus").alias("strand"),
        F.round(F.col("l_discount") * 100).cast("long").alias("qual"),
    )


SHIPMENTS = f"""shipments AS (
  SELECT l_suppkey AS k, l_returnflag AS flag, {sql_day('l_shipdate')} AS "start",
         {sql_day('l_shipdate')} + CAST(l_quantity AS BIGINT) - 1 AS "end", l_orderkey AS ok,
         CAST(l_linenumber AS BIGINT) AS ln, l_linestatus AS strand,
         CAST(round(l_discount * 100) AS BIGINT) AS qual
  FROM lineitem)"""


def customer_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """The same intervals keyed by the customer of their order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("c"))
    return shipments(spark, sf).join(o, "ok").select("c", "ok", "ln", "start", "end")


def order_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as 30-day features of their customer."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("c"),
        F.col("o_orderkey").alias("feature"),
        day("o_orderdate").alias("start"),
        (day("o_orderdate") + 29).alias("end"),
    )


CUSTOMER_SHIPMENTS = (
    SHIPMENTS
    + """, cs AS (SELECT o_custkey AS c, ok, ln, "start", "end" FROM shipments JOIN orders ON ok = o_orderkey)"""
)
ORDER_WINDOWS = f"""ow AS (SELECT o_custkey AS c, o_orderkey AS feature, {sql_day('o_orderdate')} AS "start",
  {sql_day('o_orderdate')} + 29 AS "end" FROM orders)"""


def merged_sql(src: str, keys: str, name: str) -> str:
    """Gaps and islands over closed intervals, abutting ones merged."""
    return f"""{name}_r AS (SELECT {keys}, "start", "end", max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
      {name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_r),
      {name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM {name}_i GROUP BY {keys}, isl)"""


# --- reads --------------------------------------------------------------------------------------
# A line item is a read on its supplier's contig. Reference and read bases come from integer
# arithmetic on (supplier, position), so both engines derive the same sequence; an operation per line
# number gives clips, deletions and insertions, and a sparse rule flips bases.

BASE_DAY = 9000
QUAL_TEXT = "!+5:?DII"


def ref_index(k, p):
    return (k * 31 + p * 17 + (p * p) % 13) % 4


_REF = "(({k}) * 31 + ({p}) * 17 + (({p}) * ({p})) % 13) % 4"


# Bases and qualities repeat along a contig, so a read is cut out of constant texts instead of being put
# together letter by letter: the reference every 52 positions, flips every 23 indices, both every 1,196.

PERIOD, FLIPS = 52, 23
CUT = 1024  # letters that a repeated text can give without being repeated in the row


def _cut(text, size: int, at, n):
    """``n`` letters of the endless repetition of a text of ``size`` letters from the 0-based place ``at``; ``text`` holds
    it as often as ``CUT`` letters from any place need."""
    n = n.cast("int")
    return F.substring(F.when(n <= CUT, text).otherwise(F.repeat(text, (F.floor(n / size) + 2).cast("int"))), (at + 1).cast("int"), n)


def _by_contig(k, text, size: int):
    """The text of the letters ``text(x)`` raised by what the contig adds to its bases, modulo 4."""
    full = ["".join("ACGT"[(text(x) + add) % 4] for x in range(size)) * (CUT // size + 2) for add in range(4)]
    add = F.pmod(k * 31, F.lit(4))
    return F.when(add == 0, full[0]).when(add == 1, full[1]).when(add == 2, full[2]).when(add == 3, full[3])


def reference_piece(k, p, n):
    """``n`` bases of the reference of contig ``k`` from position ``p``."""
    return _cut(_by_contig(k, lambda x: ref_index(0, x), PERIOD), PERIOD, F.pmod(p, F.lit(PERIOD)), n)


def flipped_piece(k, p, turn, n):
    """As ``reference_piece``, a base one letter on where ``turn`` plus the index is divisible by 23.

    The place in the common period has the remainder of the position by 52 and that of the turn by 23."""
    size = PERIOD * FLIPS
    at = F.pmod(F.pmod(p, F.lit(PERIOD)) * 989 + F.pmod(turn, F.lit(FLIPS)) * 208, F.lit(size))
    return _cut(_by_contig(k, lambda x: ref_index(0, x % PERIOD) + (x % FLIPS == 0), size), size, at, n)


def reads(spark: SparkSession, sf: str) -> DataFrame:
    li = spread(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_linestatus", "l_returnflag", "l_discount"
    ))
    n = F.col("l_quantity").cast("long")
    ln = F.col("l_linenumber").cast("long")
    shape = F.when(n < 10, 0).otherwise(ln % 4)
    half = F.floor(n / 2)
    base = li.select(
        F.col("l_orderkey").alias("ok"), ln.alias("ln"), F.col("l_suppkey").alias("k"),
        (day("l_shipdate") - BASE_DAY).alias("pos"), n.alias("n"), half.alias("half"), shape.alias("shape"),
        F.col("l_linestatus").alias("strand"), F.col("l_returnflag").alias("rf"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
    )
    def run(x):
        return x.cast("string")

    cigar = (
        F.when(F.col("shape") == 0, F.concat(run(F.col("n")), F.lit("M")))
        .when(F.col("shape") == 1, F.concat(F.lit("2S"), run(F.col("n") - 2), F.lit("M")))
        .when(F.col("shape") == 2, F.concat(run(F.col("half")), F.lit("M2D"), run(F.col("n") - F.col("half")), F.lit("M")))
        .otherwise(F.concat(run(F.col("half")), F.lit("M1I"), run(F.col("n") - F.col("half") - 1), F.lit("M")))
    )

    k, pos, n, half, turn = F.col("k"), F.col("pos"), F.col("n"), F.col("half"), 14 * (F.col("ok") * 7 + F.col("ln") * 3)
    first = F.when(F.col("shape") == 2, half).when(F.col("shape") == 3, half + 1).otherwise(n)
    seq = F.concat(
        flipped_piece(k, F.when(F.col("shape") == 1, pos - 2).otherwise(pos), turn, first),
        flipped_piece(k, F.when(F.col("shape") == 2, pos + half + 2).otherwise(pos + half), turn + first, n - first),
    )
    cycle = "".join(QUAL_TEXT[i * 3 % 8] for i in range(8))
    qual = _cut(F.lit(cycle * (CUT // 8 + 2)), 8, F.pmod((F.col("ok") + F.col("disc")) * 3, F.lit(8)), n)
    flag = (
        F.lit(1) + F.when(F.col("strand") == "F", 16).otherwise(0) + F.when(F.col("ok") % 17 == 0, 1024).otherwise(0)
        + F.when((F.col("ln") == 7) & (F.col("ok") % 2 == 0), 256).otherwise(0) + F.when(F.col("ok") % 41 == 0, 512).otherwise(0)
        + F.when((F.col("ln") == 6) & (F.col("ok") % 3 == 0), 2048).otherwise(0) + F.when(F.col("ok") % 29 == 0, 4).otherwise(0)
        + F.when(F.col("disc") == 5, 8).otherwise(0)
    )
    return base.select(
        "ok", "ln", "k", F.col("k").cast("string").alias("contig"), "pos",
        F.concat_ws(":", F.col("ok").cast("string"), F.col("ln").cast("string")).alias("qname"),
        flag.cast("int").alias("flag"),
        F.when(F.col("ok") % 19 == 0, 255).otherwise(F.col("ok") % 60 + 5).cast("int").alias("mapq"),
        cigar.alias("cigar"), seq.alias("seq"), qual.alias("qual"),
        F.when(F.col("ok") % 31 == 0, F.lit(None)).when(F.col("ok") % 37 == 0, F.lit("g9")).otherwise(F.concat(F.lit("g"), (F.col("ln") % 5).cast("string"))).alias("rg"),
        F.when(F.col("rf") == "N", F.lit("=")).when(F.col("rf") == "A", F.col("k").cast("string")).otherwise(F.lit("other")).alias("rnext"),
        F.concat(F.lit("s"), (F.col("ln") % 3).cast("string")).alias("sample"),
        F.create_map(F.lit("PG"), F.lit("p1")).alias("tags"),
    )


_FLIP = "CASE WHEN (ok * 7 + ln * 3 + i * 5) % 23 = 0 THEN 1 ELSE 0 END"
_OFF = "CASE WHEN shape = 1 THEN i - 2 WHEN shape = 2 AND i >= half THEN i + 2 WHEN shape = 3 AND i > half THEN i - 1 ELSE i END"
READS = f"""rd0 AS (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_suppkey AS k, {sql_day('l_shipdate')} - {BASE_DAY} AS pos,
    CAST(l_quantity AS BIGINT) AS n, CAST(l_quantity AS BIGINT) // 2 AS half, CASE WHEN l_quantity < 10 THEN 0 ELSE l_linenumber % 4 END AS shape,
    l_linestatus AS strand, l_returnflag AS rf, CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem),
  reads AS (SELECT ok, ln, k, CAST(k AS VARCHAR) AS contig, pos, ok || ':' || ln AS qname,
    CAST(1 + (CASE WHEN strand = 'F' THEN 16 ELSE 0 END) + (CASE WHEN ok % 17 = 0 THEN 1024 ELSE 0 END) + (CASE WHEN ln = 7 AND ok % 2 = 0 THEN 256 ELSE 0 END)
      + (CASE WHEN ok % 41 = 0 THEN 512 ELSE 0 END) + (CASE WHEN ln = 6 AND ok % 3 = 0 THEN 2048 ELSE 0 END) + (CASE WHEN ok % 29 = 0 THEN 4 ELSE 0 END)
      + (CASE WHEN disc = 5 THEN 8 ELSE 0 END) AS BIGINT) AS flag,
    CASE WHEN ok % 19 = 0 THEN 255 ELSE ok % 60 + 5 END AS mapq, n, half, shape,
    CASE shape WHEN 0 THEN n || 'M' WHEN 1 THEN '2S' || (n - 2) || 'M' WHEN 2 THEN half || 'M2D' || (n - half) || 'M' ELSE half || 'M1I' || (n - half - 1) || 'M' END AS cigar,
    array_to_string(list_transform(range(0, n), lambda i: substr('ACGT', CAST((({_REF.format(k='k', p=f'pos + ({_OFF})')}) + ({_FLIP})) % 4 + 1 AS BIGINT), 1)), '') AS seq,
    array_to_string(list_transform(range(0, n), lambda i: substr('{QUAL_TEXT}', CAST((ok + i * 3 + disc) % 8 + 1 AS BIGINT), 1)), '') AS qual,
    CASE WHEN ok % 31 = 0 THEN NULL WHEN ok % 37 = 0 THEN 'g9' ELSE 'g' || (ln % 5) END AS rg,
    CASE rf WHEN 'N' THEN '=' WHEN 'A' THEN CAST(k AS VARCHAR) ELSE 'other' END AS rnext, 's' || (ln % 3) AS sample FROM rd0)"""


def reference_chunks(spark: SparkSession, sf: str, chunk: int = 256) -> DataFrame:
    """The reference the reads were drawn from: one row per supplier and chunk, up to the last position of a read."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    reach = F.max(day("l_shipdate") + F.col("l_quantity").cast("long")) - BASE_DAY + 64
    last = table(spark, sf, "lineitem").agg(F.greatest(reach, F.lit(1).cast("long")).alias("last"))
    c = s.crossJoin(F.broadcast(last))  # one row
    c = c.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / chunk))))
    bases = reference_piece(F.col("k"), F.col("chunk") * chunk + 1, F.lit(chunk))
    return c.select("k", "chunk", bases.alias("bases"))


def sql_ref_base(k: str, p: str) -> str:
    return f"substr('ACGT', CAST({_REF.format(k=k, p=p)} + 1 AS BIGINT), 1)"
