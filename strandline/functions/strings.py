"""Sequence text as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: str | Column) -> Column:
    """Case kept; letters other than A, C, G, T stay."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing places; null for texts of different length."""
    d = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x
    )
    return F.when(F.length(a) == F.length(b), d)


def is_dna(seq: str | Column) -> Column:
    return _c(seq).rlike("^[ACGTNacgtn]*$")


def subsequence(seq: str | Column, start: Column, end: Column) -> Column:
    """Closed 1-based cut."""
    return F.substring(_c(seq), start, end - start + 1)


def pattern_count(seq: str | Column, pattern: str) -> Column:
    """Occurrences, overlapping ones included."""
    return F.regexp_count(_c(seq), F.lit(f"(?={pattern})"))


def quality_trim(seq: str | Column, qual: str | Column, min_qual: int, offset: int = 33) -> Column:
    """From the first to the last base of at least ``min_qual``; everything when there is none."""
    s, q = _c(seq), _c(qual)
    low = f"[{chr(offset)}-{chr(offset + min_qual - 1)}]".replace("[[", r"[\[").replace("]]", r"\]]").replace(r"\-", r"\\-")
    head = F.length(F.regexp_extract(q, f"^{low}*", 0))
    tail = F.length(F.regexp_extract(q, f"{low}*$", 0))
    n = F.length(q)
    none = head == n
    start = F.when(none, F.lit(1)).otherwise(head + 1)
    size = F.when(none, n).otherwise(n - head - tail)
    return F.struct(F.substring(s, start, size).alias("seq"), F.substring(q, start, size).alias("qual"))


def trim_ends(seq: str | Column, head: int, tail: int) -> Column:
    s = _c(seq)
    return F.substring(s, F.lit(head + 1), F.greatest(F.lit(0), F.length(s) - head - tail))


def mean_quality(qual: str | Column, offset: int = 33) -> Column:
    q = _c(qual)
    total = F.aggregate(F.split(q, ""), F.lit(0), lambda a, c: a + F.ascii(c) - offset)
    return F.when(F.length(q) > 0, total / F.length(q))


def valid_record(seq: str | Column, qual: str | Column) -> Column:
    """Equal lengths, bases A, C, G, T, N of either case, quality characters 33 to 126."""
    s, q = _c(seq), _c(qual)
    return (F.length(s) == F.length(q)) & is_dna(s) & q.rlike("^[!-~]*$")


def filter_bases(seq: str | Column, qual: str | Column, min_qual: int, offset: int = 33) -> Column:
    """(base, quality) pairs of at least ``min_qual``."""
    pairs = F.zip_with(
        F.split(_c(seq), ""), F.split(_c(qual), ""), lambda b, c: F.struct(b.alias("base"), (F.ascii(c) - offset).alias("qual"))
    )
    return F.filter(pairs, lambda p: p["qual"] >= min_qual)
