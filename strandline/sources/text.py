"""Sequence and variant text formats as DataFrames, read with Spark's own splittable text scan."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINARY_SUFFIXES = (".gz", ".bgz", ".bcf", ".bam", ".cram")


def _records(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(path if isinstance(path, str) else list(path))


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``name, description, seq, length``. A record is what lies between two ``>`` at line starts."""
    r = _records(spark, path, "\n>").where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    head = lines[0]
    seq = F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    desc = F.trim(F.substr(head, F.length(name) + 1))
    return r.select(name.alias("name"), F.nullif(desc, F.lit("")).alias("description"), seq.alias("seq"), F.length(seq).alias("length"))


def reference_chunks(fasta: DataFrame, chunk: int = 65536, key: str = "contig") -> DataFrame:
    """Sequences as fixed chunks: the working form for joins by position."""
    # One pass over the text; a substring for each chunk would walk from the start every time.
    cut = F.regexp_extract_all("seq", F.lit(f".{{1,{chunk}}}"), F.lit(0))
    rows = fasta.where(F.length("seq") > 0).select(F.col("name").alias(key), F.posexplode(cut).alias("chunk", "bases"))
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), (F.col("chunk").cast("long") * chunk + 1).alias("chunk_start"), "bases")


def contigs_of(fasta: DataFrame) -> DataFrame:
    return fasta.select(F.col("name").alias("contig"), F.col("length").cast("long").alias("length"))


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their file and number in it (from 0), however the files are split: each split counts its lines, and
    the counts of the splits before it, one row a split, are carried in."""
    t = _records(spark, path, "\n").select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
    )
    splits = t.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = splits.select("file", "split", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("carry"))
    return t.join(carry, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("carry")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``name, description, seq, qual`` from records of four lines. Lines are told by their number in the file, never
    by what they begin with, so a quality may begin with ``@`` or ``+``. A broken record stops the query."""
    lines = numbered_lines(spark, path)
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    rec = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(
        part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual")
    )
    rec = rec.where(F.length(F.concat_ws("", "head", "seq", "plus", "qual")) > 0)
    sound = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    wrong = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.left("head", F.lit(60)))).cast("boolean")
    rec = rec.where(F.coalesce(sound, F.lit(False)) | wrong)
    head = F.substr("head", F.lit(2))
    name = F.substring_index(head, " ", 1)
    desc = F.nullif(F.trim(F.substr(head, F.length(name) + 1)), F.lit(""))
    return rec.select(name.alias("name"), desc.alias("description"), "seq", "qual")


def read_sam(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(header rows, reads). Header rows: ``tag, fields`` map; reads: 11 columns, tags map, rg, cigar text."""
    t = _records(spark, path, "\n").select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.length("value") > 0)
    head = t.where(F.col("value").startswith("@")).withColumn("f", F.split("value", "\t"))
    kv = F.filter(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: x.contains(":"))
    header = head.select(
        F.substr(F.col("f")[0], F.lit(2)).alias("tag"),
        F.map_from_entries(F.transform(kv, lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.substr(x, F.lit(4)).alias("v")))).alias("fields"),
    )
    r = t.where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t"))
    short = F.size("f") < 11
    r = r.where(~short | F.raise_error(F.concat(F.lit("alignment row with too few columns: "), F.left("value", F.lit(60)))).cast("boolean"))
    f = F.col("f")
    tags = F.filter(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    tag_map = F.map_from_entries(F.transform(tags, lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.substr(x, F.lit(6)).alias("v"))))
    reads = r.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), F.nullif(f[2], F.lit("*")).alias("contig"), f[3].cast("long").alias("pos"),
        f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[6].alias("rnext"), f[7].cast("long").alias("pnext"), f[8].cast("long").alias("tlen"),
        F.when(f[9] == "*", "").otherwise(f[9]).alias("seq"), F.when(f[10] == "*", "").otherwise(f[10]).alias("qual"), tag_map.alias("tags"),
        F.map_from_entries(F.transform(tags, lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.substring(x, 4, 1).alias("v")))).alias("tag_types"),
    )
    return header, reads.withColumn("rg", F.try_element_at("tags", F.lit("RG")))


def sam_contigs(header: DataFrame) -> DataFrame:
    return header.where("tag = 'SQ'").select(F.col("fields")["SN"].alias("contig"), F.col("fields")["LN"].cast("long").alias("length"))


def read_groups(header: DataFrame) -> DataFrame:
    g = lambda k: F.try_element_at("fields", F.lit(k))
    return header.where("tag = 'RG'").select(g("ID").alias("rg"), g("SM").alias("sample"), g("LB").alias("library"), g("PL").alias("platform"))


def canonical_header(header: DataFrame) -> DataFrame:
    """HD, SQ and RG rows in a fixed order, for comparison."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "\t")
    return header.where(F.col("tag").isin("HD", "SQ", "RG")).select("tag", text.alias("text")).orderBy("tag", "text")


def info_type(value: Column) -> Column:
    """Type of an INFO value by its text: Flag (absent), Float with a dot, Integer, else String."""
    return (
        F.when(value.isNull(), "Flag").when(value == ".", "Empty").when(value.contains(".") & value.rlike(r"^[-+0-9.,eE]+$"), "Float")
        .when(value.rlike(r"^[-0-9,]+$"), "Integer").otherwise("String")
    )


def read_vcf(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(header lines with file, rows). INFO becomes a map of arrays, a bare key an empty array; sample columns
    become an array of FORMAT maps in column order. Rows that cannot be parsed carry ``error``."""
    t = _records(spark, path, "\n").select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file")).where(F.length("value") > 0)
    header = t.where(F.col("value").startswith("#"))
    r = t.where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    f = F.col("f")

    def at(i: int) -> Column:
        return F.try_element_at(f, F.lit(i + 1))

    items = F.filter(F.split(F.coalesce(at(7), F.lit("")), ";"), lambda x: (x != "") & (x != "."))
    info = F.map_from_entries(
        F.transform(
            items,
            lambda x: F.struct(
                F.substring_index(x, "=", 1).alias("k"),
                F.when(x.contains("="), F.split(F.regexp_replace(x, "^[^=]*=", ""), ",")).otherwise(
                    F.array().cast("array<string>")
                ).alias("v"),
            ),
        )
    )
    keys = F.split(F.coalesce(at(8), F.lit("")), ":")
    cols = F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0)))
    samples = F.transform(
        cols,
        lambda s: F.map_from_entries(
            F.zip_with(keys, F.split(s, ":"), lambda k, v: F.struct(k.alias("k"), F.coalesce(v, F.lit(".")).alias("v")))
        ),
    )
    error = F.when(F.size(f) < 8, "too few columns").when(at(1).try_cast("long").isNull(), "position is not a number")
    rows = r.select(
        "file", at(0).alias("contig"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"),
        F.when(at(4).isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(at(4), ",")).alias("alts"),
        at(5).try_cast("double").alias("qual"),
        F.when(at(6).isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(at(6), ";")).alias("filters"),
        info.alias("info"), at(8).alias("format"), samples.alias("samples"), error.alias("error"),
    )
    return header, rows


def checked(rows: DataFrame) -> DataFrame:
    """Rows without an error; the first broken one stops the query."""
    return rows.where(F.col("error").isNull() | F.raise_error(F.col("error")).cast("boolean")).drop("error")


def _uri_of(path: str) -> str:
    """A path as scans report it: absolute, its special characters escaped, without the local scheme."""
    local = re.sub("^file:/+", "/", path)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", local):
        return local
    return quote(os.path.abspath(local), safe="/:@!$&'()*+,;=~-._")


def read_cohort(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per-sample block tables in one scan: blocks for ``plans.combine``. The sample is the first one of each
    file's header; the order of ``paths`` gives ``input_ord``. Header rows are one per file."""
    if not paths:
        raise ValueError("no inputs")
    header, rows = read_vcf(spark, list(paths))
    names = header.where(F.col("value").startswith("#CHROM")).select("file", F.split("value", "\t").alias("h")).select(
        "file", F.try_element_at("h", F.lit(10)).alias("sample")
    )
    order = spark.createDataFrame([(i, _uri_of(p)) for i, p in enumerate(paths)], "input_ord long, uri string")
    if order.select("uri").distinct().count() < len(paths):
        raise ValueError("an input is named twice")
    names = names.withColumn("uri", F.regexp_replace("file", "^file:/+", "/")).join(order, "uri", "full")
    lost = F.concat(F.lit("no header or no input for "), F.coalesce("uri", F.lit("?")))
    names = names.where((F.col("file").isNotNull() & F.col("input_ord").isNotNull()) | F.raise_error(lost).cast("boolean"))
    ints = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("int"))
    s = F.col("samples")[0]
    num = lambda k: F.try_element_at(s, F.lit(k)).try_cast("int")
    arr = lambda k: F.when(F.try_element_at(s, F.lit(k)) != ".", ints(F.try_element_at(s, F.lit(k))))
    end = F.coalesce(F.try_element_at(F.try_element_at("info", F.lit("END")), F.lit(1)).try_cast("long"), F.col("pos") + F.length("ref") - 1)
    x = checked(rows).join(names, "file")
    bad = F.col("sample").isNull()
    x = x.where(~bad | F.raise_error(F.concat(F.lit("no sample in "), F.col("file"))).cast("boolean"))
    return x.select(
        "contig", "sample", "input_ord", F.col("pos").alias("start"), end.alias("end"), "ref", "alts",
        arr("PL").alias("pl"), arr("AD").alias("ad"), num("GQ").alias("gq"), num("DP").alias("dp"),
    )


def read_interval_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contigs from ``@SQ`` lines, parsed intervals). Rows are tab separated or region text; ``^`` excludes."""
    from strandline.operators.intervals import parse_intervals

    t = _records(spark, path, "\n").select(F.trim("value").alias("value")).where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    sq = t.where(F.col("value").startswith("@SQ")).select(
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("length")
    )
    rows = t.where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t"))
    text = F.when(F.size("f") >= 3, F.concat(F.col("f")[0], F.lit(":"), F.col("f")[1], F.lit("-"), F.col("f")[2])).otherwise(F.col("value"))
    return sq, parse_intervals(rows.select(text.alias("text")))


def span_scan(df: DataFrame, spans: DataFrame, contig: str = "contig", start: str = "pos", end: str | None = None) -> DataFrame:
    """Rows of a position-sorted table that overlap the spans. The bounds of the spans, one row per contig,
    join first, so dynamic pruning and row-group statistics can act before the exact test."""
    from strandline.operators.joins import overlap_semi

    hull = spans.groupBy(contig).agg(F.min("start").alias("__lo"), F.max("end").alias("__hi"))
    e = end or start
    near = df.join(hull, contig).where((F.col(start) <= F.col("__hi")) & (F.col(e) >= F.col("__lo"))).drop("__lo", "__hi")
    if end is None:
        return overlap_semi(near.withColumn("__e", F.col(start)), spans, [contig], (start, "__e")).drop("__e")
    return overlap_semi(near, spans, [contig], (start, end))


def refuse_binary(path: str) -> None:
    """Plain text only; called before a sink touches its path."""
    if path.lower().endswith(BINARY_SUFFIXES):
        raise ValueError(f"compressed or binary output is not supported: {path}")


def vcf_lines(rows: DataFrame) -> DataFrame:
    """Rows (contig, pos, id, ref, alts, qual, filters, info map, format, samples) as VCF text lines."""
    dot = lambda c: F.when(c.isNull() | (c == ""), F.lit(".")).otherwise(c)
    info = F.array_join(
        F.transform(F.map_entries("info"), lambda e: F.when(F.size(e["value"]) == 0, e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";"
    )
    keys = F.split("format", ":")
    smp = F.transform("samples", lambda s: F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(s, k), F.lit("."))), ":"))
    base = F.concat_ws(
        "\t", "contig", F.col("pos").cast("string"), dot(F.col("id")), "ref", dot(F.array_join("alts", ",")),
        dot(F.col("qual").cast("string")), dot(F.array_join("filters", ";")), dot(info),
    )
    tail = F.when(F.size("samples") > 0, F.concat(F.lit("\t"), F.col("format"), F.lit("\t"), F.array_join(smp, "\t"))).otherwise(F.lit(""))
    return rows.select("contig", "pos", F.concat(base, tail).alias("value"))


def write_vcf(rows: DataFrame, contigs: DataFrame, path: str, header: Sequence[str], partitions: int | None = None) -> None:
    """Part files in contig, position order: range partitions sorted inside. The header is the folder's first file."""
    refuse_binary(path)
    spark = rows.sparkSession
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    x = vcf_lines(rows).join(contigs.select("contig", "ord"), "contig")
    by = [F.col("ord"), F.col("pos")]
    x = x.repartitionByRange(partitions, *by) if partitions else x.repartitionByRange(*by)
    x.sortWithinPartitions("ord", "pos").select("value").write.mode("overwrite").text(f"{path}/rows")


def sam_lines(reads: DataFrame) -> DataFrame:
    """Reads as SAM lines; tags keep the types of ``tag_types``, text without."""
    kind = lambda k: F.coalesce(F.try_element_at("tag_types", k), F.lit("Z")) if "tag_types" in reads.columns else F.lit("Z")
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), kind(e["key"]), F.lit(":"), e["value"]))
    star = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit("*")).otherwise(F.col(c))
    base = F.concat_ws(
        "\t", "qname", *[F.col(c).cast("string") for c in ("flag",)], star("contig"), *[F.col(c).cast("string") for c in ("pos", "mapq")], star("cigar"), star("rnext"),
        F.coalesce(F.col("pnext"), F.lit(0)).cast("string"), F.coalesce(F.col("tlen"), F.lit(0)).cast("string"), star("seq"), star("qual"),
    )
    return reads.select(F.concat_ws("\t", base, F.array_join(tags, "\t")).alias("value")).select(F.regexp_replace("value", "\t$", "").alias("value"))


def fastq_lines(seqs: DataFrame) -> DataFrame:
    head = F.concat(F.lit("@"), F.concat_ws(" ", "name", "description"))
    return seqs.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))


def fasta_lines(seqs: DataFrame, width: int = 60) -> DataFrame:
    n = F.greatest(F.length("seq"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(width)), lambda i: F.substring(F.col("seq"), i + 1, F.lit(width)))
    return seqs.select(F.concat_ws("\n", F.concat(F.lit(">"), F.concat_ws(" ", "name", "description")), F.array_join(cut, "\n")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    refuse_binary(path)
    lines.select("value").write.mode("overwrite").text(path)


def write_working(df: DataFrame, path: str, contig: str = "contig", pos: str = "pos") -> None:
    """Columnar working form: folders per contig, sorted by position so row-group statistics prune."""
    df.repartitionByRange(F.col(contig), F.col(pos)).sortWithinPartitions(contig, pos).write.mode("overwrite").partitionBy(contig).parquet(path)


def read_working(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def coordinate_order(df: DataFrame, contigs: DataFrame, contig: str = "contig", pos: str = "pos", ties: Sequence[str] = ()) -> DataFrame:
    """Global order by contig ordinal, position and ties: a range partitioned sort."""
    return df.join(contigs.select(F.col("contig").alias(contig), "ord"), contig).orderBy("ord", pos, *ties)
