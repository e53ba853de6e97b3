"""CIGAR text as columns: runs, lengths and clips, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_OPS = "MIS=X"
REFERENCE_OPS = "MDN=X"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def runs(cigar: str | Column) -> Column:
    """``10M2D`` to ``[{len 10, op M}, {len 2, op D}]``; ``*`` gives an empty array."""
    parts = F.regexp_extract_all(_col(cigar), F.lit(r"[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(
        parts,
        lambda t: F.struct(
            F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len"),
            F.right(t, F.lit(1)).alias("op"),
        ),
    )


def to_text(run_array: str | Column) -> Column:
    return F.array_join(F.transform(_col(run_array), lambda r: F.concat(r["len"].cast("string"), r["op"])), "")


def op_bases(cigar: str | Column, ops: str) -> Column:
    """Total length of the runs whose op is one of ``ops``."""
    pattern = r"([0-9]+)[" + ops.replace("=", r"\=") + "]"
    nums = F.regexp_extract_all(_col(cigar), F.lit(pattern), F.lit(1))
    return F.aggregate(nums, F.lit(0), lambda acc, x: acc + x.cast("int"))


def query_length(cigar: str | Column) -> Column:
    return op_bases(cigar, QUERY_OPS)


def reference_span(cigar: str | Column) -> Column:
    return op_bases(cigar, REFERENCE_OPS)


def reference_span_padded(cigar: str | Column) -> Column:
    """Reference span as the "consumes reference" filter counts it: padding included."""
    return op_bases(cigar, REFERENCE_OPS + "P")


def leading_soft_clip(cigar: str | Column) -> Column:
    n = F.regexp_extract(_col(cigar), r"^(?:[0-9]+H)?([0-9]+)S", 1)
    return F.when(n == "", F.lit(0)).otherwise(n.cast("int"))


def trailing_soft_clip(cigar: str | Column) -> Column:
    n = F.regexp_extract(_col(cigar), r"[MIDN=XP]([0-9]+)S(?:[0-9]+H)?$", 1)
    return F.when(n == "", F.lit(0)).otherwise(n.cast("int"))
