import pytest

from pyspark.sql import functions as F

from strandline.operators import intervals as I
from strandline.plans import combine as C
from strandline.sources import text as S


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">chr1 first one\nACGT\nACGTN\n>chr2\nTTTT\n")
    rows = {r.name: r for r in S.read_fasta(spark, p).collect()}
    assert rows["chr1"].seq == "ACGTACGTN" and rows["chr1"].description == "first one" and rows["chr1"].length == 9
    assert rows["chr2"].seq == "TTTT" and rows["chr2"].description is None
    chunks = S.reference_chunks(S.read_fasta(spark, p), 4).orderBy("contig", "chunk").collect()
    assert [(c.contig, c.chunk, c.chunk_start, c.bases) for c in chunks] == [
        ("chr1", 0, 1, "ACGT"), ("chr1", 1, 5, "ACGT"), ("chr1", 2, 9, "N"), ("chr2", 0, 1, "TTTT"),
    ]
    out = str(tmp_path / "out")
    S.write_text(S.fasta_lines(S.read_fasta(spark, p).orderBy("name"), 4).coalesce(1), out)
    assert sorted(r.seq for r in S.read_fasta(spark, out).collect()) == ["ACGTACGTN", "TTTT"]


def test_fastq_with_awkward_quality(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@r1 lane one\nACGT\n+\nIIII\n@r2\nGGTT\n+\n@III\n@r3 x\nA\n+\n!\n")
    rows = {r.name: r for r in S.read_fastq(spark, p).collect()}
    assert set(rows) == {"r1", "r2", "r3"}
    assert rows["r1"].description == "lane one" and rows["r1"].qual == "IIII"
    assert rows["r2"].qual == "@III" and rows["r2"].seq == "GGTT"
    assert rows["r3"].qual == "!"
    out = str(tmp_path / "out")
    S.write_text(S.fastq_lines(S.read_fastq(spark, p)).coalesce(1), out)
    assert {r.name: r.qual for r in S.read_fastq(spark, out).collect()} == {"r1": "IIII", "r2": "@III", "r3": "!"}


SAM = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:100\n@RG\tID:rg1\tSM:s1\tLB:l1\tPL:p\n@CO\tfree text\nr1\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tRG:Z:rg1\tXQ:i:40\n"


def test_sam(spark, tmp_path):
    header, reads = S.read_sam(spark, put(tmp_path, "a.sam", SAM))
    assert [tuple(r) for r in S.sam_contigs(header).collect()] == [("chr1", 100)]
    assert [tuple(r) for r in S.read_groups(header).collect()] == [("rg1", "s1", "l1", "p")]
    r = reads.collect()[0]
    assert (r.qname, r.pos, r.mapq, r.rg, r.tags["XQ"]) == ("r1", 5, 60, "rg1", "40")
    assert S.canonical_header(header).count() == 3
    assert S.sam_lines(reads).collect()[0].value.startswith("r1\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\t")
    with pytest.raises(Exception, match="too few columns"):
        S.read_sam(spark, put(tmp_path, "b.sam", "r1\t0\tchr1\n"))[1].collect()


VCF = (
    "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{s}\n"
    "chr1\t10\t.\tA\t<NON_REF>\t.\t.\tEND=20\tGT:GQ:DP:MIN_DP:PL\t0/0:{g}:30:28:0,{g},{h}\n"
)


def test_vcf_and_cohort(spark, tmp_path):
    a = put(tmp_path, "a.vcf", VCF.format(s="S1", g=90, h=900))
    b = put(tmp_path, "b.vcf", VCF.format(s="S2", g=60, h=600))
    blocks = S.read_cohort(spark, [a, b])
    rows = C.combine(blocks).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.contig, r.start, r.end, r.ref, r.alts) == ("chr1", 10, 20, "A", ["<NON_REF>"])
    assert [(c.sample, c.pl) for c in r.calls] == [("S1", [0, 90, 900]), ("S2", [0, 60, 600])]
    with pytest.raises(ValueError):
        S.read_cohort(spark, [])
    _, v = S.read_vcf(spark, put(tmp_path, "c.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\tx\t.\tA\tC\t1\tPASS\tDB;AF=0.5\nchr1\t7\trs\tA\tC,G\t12.5\tPASS\tDB;AF=0.5,0.1;DP=3\n"))
    got = {x.ref + str(x.pos): x for x in v.collect()}
    assert got["ANone"].error == "position is not a number"
    ok = got["A7"]
    assert ok.alts == ["C", "G"] and ok.info == {"DB": [], "AF": ["0.5", "0.1"], "DP": ["3"]} and ok.qual == 12.5
    line = S.vcf_lines(v.where("pos = 7")).collect()[0].value
    assert line == "chr1\t7\trs\tA\tC,G\t12.5\tPASS\tDB;AF=0.5,0.1;DP=3"
    types = spark.createDataFrame([("0.5",), ("3,4",), ("abc",), (None,)], "v string").select(S.info_type(F.col("v")).alias("t"))
    assert [r.t for r in types.collect()] == ["Float", "Integer", "String", "Flag"]


def test_vcf_sink_refuses_binary_and_sorts(spark, tmp_path):
    rows = spark.createDataFrame([("b", 5), ("a", 9), ("a", 2)], "contig string, pos long").select(
        "contig", "pos", F.lit(".").alias("id"), F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts"), F.lit(1.5).alias("qual"),
        F.array(F.lit("PASS")).alias("filters"), F.create_map(F.lit("DP"), F.array(F.lit("3"))).alias("info"), F.lit("GT").alias("format"),
        F.array(F.create_map(F.lit("GT"), F.lit("0/1"))).alias("samples"),
    )
    contigs = spark.createDataFrame([("b", 0), ("a", 1)], "contig string, ord int")
    with pytest.raises(ValueError):
        S.write_vcf(rows, contigs, str(tmp_path / "x.vcf.gz"), [])
    assert not (tmp_path / "x.vcf.gz").exists()
    out = str(tmp_path / "x.vcf")
    S.write_vcf(rows, contigs, out, ["##fileformat=VCFv4.2"], partitions=1)
    lines = [r.value for r in spark.read.text(out + "/rows").collect()]
    assert [x.split("\t")[:2] for x in lines] == [["b", "5"], ["a", "2"], ["a", "9"]]
    assert lines[0].endswith("\tGT\t0/1")


def test_working_form_and_span_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", i) for i in range(1, 50)] + [("b", 7)], "contig string, pos long")
    S.write_working(df, str(tmp_path / "w"))
    spans = spark.createDataFrame([("a", 5, 6), ("a", 40, 41)], "contig string, start long, end long")
    got = S.span_scan(S.read_working(spark, str(tmp_path / "w")), spans)
    assert sorted(r.pos for r in got.collect()) == [5, 6, 40, 41]
    ordered = S.coordinate_order(df.where("pos < 3 or contig = 'b'"), spark.createDataFrame([("b", 0), ("a", 1)], "contig string, ord int"))
    assert [(r.contig, r.pos) for r in ordered.collect()] == [("b", 7), ("a", 1), ("a", 2)]


def test_interval_text(spark, tmp_path):
    contigs = spark.createDataFrame([("chr1", 100), ("chr2", 50)], "contig string, length long")
    t = spark.createDataFrame([("chr1:1-1,0;chr2",), ("^chr2:10-20",)], "text string")
    got = sorted(tuple(r) for r in I.include_exclude(I.parse_intervals(t), contigs).collect())
    assert got == [("chr1", 1, 10), ("chr2", 1, 9), ("chr2", 21, 50)]
    with pytest.raises(Exception, match="inclusion"):
        I.include_exclude(I.parse_intervals(spark.createDataFrame([("^chr1",)], "text string")), contigs).collect()
    with pytest.raises(Exception, match="unknown contig"):
        I.include_exclude(I.parse_intervals(spark.createDataFrame([("zz:1-2",)], "text string")), contigs).collect()
    sq, iv = S.read_interval_list(spark, put(tmp_path, "i.list", "@SQ\tSN:chr1\tLN:100\n# note\nchr1\t5\t9\t+\tx\n^chr1:7-7\n"))
    assert [tuple(r) for r in sq.collect()] == [("chr1", 100)]
    assert sorted((r.start, r.end, r.exclude) for r in iv.collect()) == [(5, 9, False), (7, 7, True)]


def test_fastq_in_many_splits(spark, tmp_path):
    quals = ["@@@I", "@III", "+@@I", "IIII"]
    text = "".join(f"@r{i} d\nACGT\n+\n{quals[i % 4]}\n" for i in range(1500))
    p = put(tmp_path, "many.fq", text)
    key, opened = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old, old_open = spark.conf.get(key), spark.conf.get(opened)
    try:
        for size in ("1024", "5003", "4100", "128m"):
            spark.conf.set(key, size)
            spark.conf.set(opened, "0")
            rows = {r.name: r.qual for r in S.read_fastq(spark, p).collect()}
            assert rows == {f"r{i}": quals[i % 4] for i in range(1500)}
    finally:
        spark.conf.set(key, old)
        spark.conf.set(opened, old_open)
    with pytest.raises(Exception):
        S.read_fastq(spark, put(tmp_path, "bad.fq", "@a\nACGT\n+\nIII\n")).collect()


def test_cohort_of_equal_names(spark, tmp_path):
    paths = []
    for i, folder in enumerate(["s1", "s 2", "s%3"]):
        (tmp_path / folder).mkdir()
        paths.append(put(tmp_path / folder, "out.g.vcf", VCF.format(s=f"S{i}", g=90, h=900)))
    got = S.read_cohort(spark, paths).select("sample", "input_ord").collect()
    assert sorted(map(tuple, got)) == [("S0", 0), ("S1", 1), ("S2", 2)]
    with pytest.raises(ValueError):
        S.read_cohort(spark, [paths[0], paths[0]])


def test_tags_keep_their_types(spark, tmp_path):
    line = "r1\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tXQ:i:40\tXF:f:0.5\tRG:Z:g"
    _, reads = S.read_sam(spark, put(tmp_path, "t.sam", line + "\n"))
    assert S.sam_lines(reads).collect()[0].value == line


def test_chunks_of_a_contig(spark):
    fasta = spark.createDataFrame([("c", "ACGTACGTAC")], "name string, seq string")
    got = [tuple(r) for r in S.reference_chunks(fasta, 4).orderBy("chunk").collect()]
    assert got == [("c", 0, 1, "ACGT"), ("c", 1, 5, "ACGT"), ("c", 2, 9, "AC")]
