"""Quality rules: counts of each text, and frequencies of lines across the documents of a host.

One Python pass over whole texts gives the counts of a document and the hashes of its normalised lines (lower case,
single spaces). Per host and line, distinct documents are counted; documents of the same text are one, so copies of a
document do not make its lines common. A line above the host's limit is removed, and a document that loses more than
the allowed share of its words, or keeps fewer than the least number, is rejected. Limits are shares of the host's
documents, so they mean the same at every size.

Counting combines on the map side before each exchange. The lines above a limit are written as a table before they are
joined, so a line with a great share of all rows can be split at run time. Only hashes are shuffled.

Nulls: a null text has no words and fails; a null host is a host of its own; a null id is kept. Rows that repeat all of
id, host and text are kept, each with the same result. Texts of any length are whole in one row. An empty table gives
an empty result. Other columns are ignored (:func:`screen`) or kept (:func:`clean`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
REPEAT_PERCENT = 20
LINE_SHARE = 0.01  # a line above this share of a host's distinct documents is removed
LINE_FLOOR = 20  # but never one of so few documents
REMOVED_SHARE = 0.5  # a document that loses more of its words is rejected

COUNTS = pa.schema([
    ("doc_id", pa.int64()), ("host", pa.string()), ("key", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()),
    ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))),
])


def hashed(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - (1 << 63)


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, the first included. Exact: windows are
    numbered by doubling, two equal numbers meaning equal words."""
    n = len(words)
    if n <= width or len(set(words)) == n:
        return 0
    number: dict[bytes, int] = {}
    one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    now, size = one, 1
    while size < width:
        step = min(size, width - size)
        added = one if step == 1 else now
        now = np.unique(now[:-step] * n + added[size : size + len(now) - step], return_inverse=True)[1]
        size += step
        if int(now.max()) == len(now) - 1:
            return 0
    common_windows = np.flatnonzero(np.bincount(now)[now] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, common_windows, 1)
    np.add.at(edges, common_windows + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def describe(text: str) -> tuple[int, int, int, int, int, list[dict]]:
    words = common.words_only(text)
    seen, lines, repeated = set(), [], 0
    for line in text.split("\n"):
        n = len(common.words_only(line))
        if n:
            repeated += line in seen
            seen.add(line)
            lines.append({"line": hashed(normalised(line)), "words": n})
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeated, repeated_words(words), lines,
    )


def count_texts(df: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """Counts and line hashes of every row, stored. ``key`` stands for id, host and text together."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches, "text", 4_000_000):
            found = [describe(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "host", "key", "text_key")]
            columns += [pa.array([f[i] for f in found], COUNTS.field(4 + i).type) for i in range(6)]
            yield pa.record_batch(columns, schema=COUNTS)

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), row_key(id_col, host_col, text_col).alias("key"),
        F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"),
    )
    schema = "doc_id long, host string, key long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: long>>"
    return common.stored(rows.mapInArrow(read, schema), "text-counts")


def row_key(id_col: str, host_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit("|"), F.col(host_col), F.lit("|"), F.col(text_col))


def common_lines(counts: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR) -> DataFrame:
    """Hosts and lines that more distinct documents of the host hold than its limit."""
    limits = counts.groupBy("host").agg(F.count_distinct("text_key").alias("docs"))
    limits = limits.select("host", F.greatest(F.lit(float(floor)), F.col("docs") * share).alias("limit"))
    each = counts.select("host", "text_key", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    held = each.groupBy("host", "line").agg(F.count_distinct("text_key").alias("docs")).where(F.col("docs") > floor)
    joined = held.join(limits.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where("docs > limit")
    return common.stored(joined.select("host", "line", "docs"), "common-lines")


def removed_words(counts: DataFrame, lines: DataFrame) -> DataFrame:
    """Per row key: words of the lines above the limit, and those lines."""
    each = counts.select("key", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("l"))
    found = each.select("key", "host", "no_host", "l.line", "l.words").join(
        lines.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line"), ["host", "no_host", "line"]
    )
    return found.groupBy("key").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone"))


def screen(df: DataFrame, id_col: str, host_col: str, text_col: str, removed_share: float = REMOVED_SHARE) -> DataFrame:
    """One row a document: counts, words removed with common lines, both verdicts."""
    counts = count_texts(df, id_col, host_col, text_col)
    once = counts.dropDuplicates(["key"])
    removed = removed_words(once, common_lines(counts))
    out = counts.drop("lines").join(removed, "key", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("removed") > removed_share * F.col("n_words")) | (F.col("n_words") - F.col("removed") < LEAST_WORDS)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def clean(df: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """The rows that are kept, all columns, their texts without the lines above the limit. Texts that lose no line
    stay as they are."""
    verdicts = screen(df, id_col, host_col, text_col).dropDuplicates(["key"]).where("kept").select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))

    columns_kept = df.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches, text_col, 4_000_000):
            at, gone = batch.schema.get_field_index(text_col), batch.column(batch.schema.get_field_index("__gone")).to_pylist()
            texts = [
                t if not g else "\n".join(x for x in t.split("\n") if not x.split() or hashed(normalised(x)) not in set(g))
                for t, g in zip(batch.column(at).to_pylist(), gone, strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, names=batch.schema.names).select(columns_kept)

    rows = df.withColumn("__key", row_key(id_col, host_col, text_col)).join(verdicts, "__key").drop("__key")
    return rows.mapInArrow(read, df.schema)
