"""What has to hold for large tables: which rows move, and that results stay those of the plain forms."""

import re

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from strandline.operators import pileup as P
from strandline.operators.joins import attach_reference_base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    reads = spark.createDataFrame(
        [("r1", 1, 3, "4M", "ACGT"), ("r1", 1, 5, "2S3M", "GGACG"), ("r2", 1, 6, "2M3D2M", "ACGT"), ("r3", 1, 8, "2M2I6M", "ACGTACGTAC"), ("r4", 2, 1, "*", "A")],
        "qname string, contig long, pos long, cigar string, seq string",
    ).select("*", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), F.lit(0).alias("flag"), F.lit(9).alias("mapq"), F.lit("s").alias("sample"))
    chunks = spark.createDataFrame([(1, 0, "ACGT"), (1, 1, "TGCA"), (1, 2, "AACC")], "contig long, chunk long, bases string")
    return reads, chunks


def test_reference_meets_reads_before_they_open(spark, small):
    """Reads over several chunks and past the last one, against a join of each observation."""
    reads, chunks = small
    got = P.pileup(reads, chunks, chunk_size=4)
    want = attach_reference_base(P.explode_alignment(reads), chunks, ["contig"], chunk_size=4)
    assert got.where(F.col("chunk") != F.floor((F.col("pos") - 1) / 4)).count() == 0
    rows = sorted(map(tuple, got.select(want.columns).collect()), key=repr)
    assert len(rows) == 22 and any(r[-1] is None for r in rows)
    assert rows == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("name", ["pileup", "reference_bases", "confidence_loci_from_reads"])
def test_observations_do_not_move(spark, sf_dir, name):
    """No exchange stands above the step that opens reads into positions."""
    text = plan(QUERIES[name](spark, sf_dir)).split("== Initial Plan ==")[0]
    opened = text.index("Generate explode(sequence(")
    assert not re.search(r"\bExchange\b", text[:opened])


def test_lone_names_pass(spark, small):
    reads, chunks = small
    marked = P.mark_lone(reads)
    assert {r.qname: r.lone for r in marked.collect()} == {"r1": False, "r2": True, "r3": True, "r4": True}
    obs = P.pileup(marked, chunks, chunk_size=4, keep=("qname", "lone")).select("contig", "pos", "qname", "base", "is_deletion", "qual", "lone")
    key = ["contig", "pos"]
    for with_lone, without in (
        (P.one_per_name(obs, key, ["base"], lone="lone"), P.one_per_name(obs, key, ["base"])),
        (P.clean_mate_overlap(obs, key, lone="lone"), P.clean_mate_overlap(obs, key)),
    ):
        a, b = (sorted(map(tuple, x.select(obs.columns).collect()), key=repr) for x in (with_lone, without))
        assert a == b


def test_long_active_runs_stay_whole_in_islands(spark, tmp_path):
    """Events in every hour, more than two each: one active run far longer than a region, as the SQL has it."""
    from checks import ORACLES
    from checks.run import compare

    hours = spark.range(700).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "id")
    events = hours.select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    status, n, *_, note = compare(spark, con, "segment_islands", QUERIES["segment_islands"], ORACLES["segment_islands"], str(tmp_path))
    assert (status, n) == ("ok", 1), note


def test_repeated_kmers_in_their_row(spark, monkeypatch):
    """Single rows, keys of several rows, long, short and null sequences against grouping of all windows."""
    from strandline.operators import kmers as K

    rows = [(1, "ACGT" * 90 + "TTT"), (2, "ACGTACG"), (2, "ACGTA"), (3, "AC"), (4, None), (5, "A" * 400), (6, "AACCGGTT"), (None, "GTGTGT"), (7, "ACG" * 200)]
    df = spark.createDataFrame(rows, "d long, seq string")
    monkeypatch.setattr(K, "WHOLE", 500)
    got = K.repeated_kmers(df, ["d"], "seq", 4)
    want = K.kmer_counts(df, ["d"], "seq", 4).where("n > 1")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # Only the rest is grouped: windows of single rows stand above no exchange but that of the texts.
    branch = plan(got).split("== Initial Plan ==")[0].split("Union")[1]
    own = branch[: branch.index("HashAggregate")]
    assert own.count("Exchange ") == 1
