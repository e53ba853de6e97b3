"""Reads and references of the registered queries: cut out of repeated texts, equal to the rule letter by letter."""

from pyspark.sql import functions as F

from checks import bases


def _reference(k, p):
    return "ACGT"[bases.ref_index(k, p) % 4]


def test_reads_follow_the_rule_letter_by_letter(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for r in bases.reads(spark, sf_dir).join(
        li.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), (F.round(F.col("l_discount") * 100)).cast("long").alias("d")).distinct(),
        ["ok", "ln"],
    ).where("ok % 7 = 0").collect():
        n, half = len(r.seq), len(r.seq) // 2
        shape = 0 if n < 10 else r.ln % 4
        want = ""
        for i in range(n):
            off = i - 2 if shape == 1 else i + 2 if shape == 2 and i >= half else i - 1 if shape == 3 and i > half else i
            want += "ACGT"[(bases.ref_index(r.k, r.pos + off) % 4 + ((r.ok * 7 + r.ln * 3 + i * 5) % 23 == 0)) % 4]
        assert r.seq == want
        assert len(r.qual) == n and r.qual in {"".join(bases.QUAL_TEXT[(r.ok + i * 3 + d) % 8] for i in range(n)) for d in range(11)}


def test_pieces_longer_than_the_repeated_text(spark):
    row = spark.range(1).select(F.lit(3).alias("k"), F.lit(77).alias("p"), F.lit(5).alias("t"), F.lit(3000).alias("n"))
    got = row.select(
        bases.reference_piece(F.col("k"), F.col("p"), F.col("n")).alias("r"), bases.flipped_piece(F.col("k"), F.col("p"), F.col("t"), F.col("n")).alias("f")
    ).first()
    assert got.r == "".join(_reference(3, 77 + i) for i in range(3000))
    assert got.f == "".join("ACGT"[(bases.ref_index(3, 77 + i) + ((5 + i) % 23 == 0)) % 4] for i in range(3000))


def test_no_letter_of_a_read_is_made_by_itself(spark, sf_dir):
    """F27 F33 F39 F43: a filter's every mention of seq made all letters again by interpreted functions."""
    for df in (bases.reads(spark, sf_dir), bases.reference_chunks(spark, sf_dir)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "transform" not in plan
