"""Secret scans with SQL functions alone: patterns, and windows of high entropy.

Patterns come first: assignments to secret-like names, access keys and long hexadecimal runs. The method then takes every
maximal run of a character class as a candidate and slides a window over it. A window's Shannon entropy follows from the
counts of its characters, which a fold keeps in a string (one place a character) and changes by the one that enters
and the one that leaves; the sum of c log2 c is kept in whole millionths of a bit, so it never drifts. A candidate with
windows at or above the class's threshold gives the stretch from the first such window to the last. Candidates
that the allow-list matches, and stretches inside a span found before, are left out. Spans of patterns always stay.

A class's threshold is the 1 % quantile of the entropy of a window of characters drawn uniformly from the smallest alphabet that
the class is there for (62, 32, 32 and 16 symbols), so that a random token is found whatever its alphabet. Ordinary
words are kept out by the allow-list alone: a token whose letters happen to look like words (one case throughout and no
digit) is left out with them.

Narrow: no shuffle; cheap tests keep the folds to texts that hold a candidate. Nulls: a null text is empty. Repeated rows
each have their result; texts of any length are whole; an empty table gives an empty result; columns are carried along
by :func:`redact` and added names begin with two underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of 20 characters or more; a run is taken from its first AKIA on
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy64", "entropy16", "entropy36", "entropy32")
WINDOW = 20
# Per class: characters, and the least entropy of a window in bits.
CLASSES = {
    "entropy64": ("A-Za-z0-9+/_=-", 3.64), "entropy16": ("0-9a-fA-F", 2.9), "entropy36": ("a-z0-9", 3.34), "entropy32": ("A-Z0-9", 3.34),
}
# In words joined by signs, as of paths and names, no digit stands before a letter, numbers after letters are short, and
# letters change case as in CamelCase. One lookahead, since repeated groups would use the stack by the length of the text.
WORDS = r"^(?!.*(?:[0-9][A-Za-z]|[A-Za-z][0-9]{5}|[A-Za-z]{16}[0-9]|[A-Z][a-z][A-Z]|[a-z][A-Z]{5}))"
# Candidates that are no secrets: words, digits alone, one character throughout, alphabets, identifiers of the UUID form,
# examples of documentation.
ALLOWED = (
    WORDS, r"^[0-9]+$", r"^(.)\1*$", r"(?i)abcdefghijklmnop|0123456789abcdef",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"(?i)example|placeholder|changeme",
)
MICRO = 1_000_000
NOTHING = "cast(array() as array<struct<start: int, no: int, end: int, hit: string>>)"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def matches(text: Column, pattern: str, no: int, possible: Column) -> Column:
    """Leftmost non-overlapping matches with their places in code points: the lengths of the pieces between matches and
    of the matches add up."""

    def placed(found: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(found["pieces"], i))
            end = start + F.length(F.get(found["hits"], i))
            span = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.get(found["hits"], i).alias("hit"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.expr(NOTHING).alias("out"))
        each = F.when(F.size(found["hits"]) > 0, F.sequence(F.lit(0), F.size(found["hits"]) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(each, start, step, lambda s: s["out"])

    pieces = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(possible, bound(pieces, placed)).otherwise(F.expr(NOTHING))


def windows(candidate: Column, least: float) -> Column:
    """(first, last): where the first window of enough entropy begins and the last one ends; nulls without one."""
    weight = F.array(*[F.lit(round(MICRO * c * math.log2(c)) if c else 0) for c in range(WINDOW + 2)])
    enough = round(MICRO * WINDOW * (math.log2(WINDOW) - least))  # the most that the sum of c log2 c may be

    def changed(state: Column, code: Column, by: int) -> Column:
        def apply(now: Column) -> Column:
            total = state["total"] + F.get(weight, now + by) - F.get(weight, now)
            return F.struct(F.overlay(state["counts"], F.char(now + by + 32), code, F.lit(1)).alias("counts"), total.alias("total"))

        return bound(F.ascii(F.substring(state["counts"], code, F.lit(1))) - 32, apply)

    def step(letters: Column):
        def slide(state: Column, i: Column) -> Column:
            left = F.when(i >= WINDOW, changed(state, F.ascii(F.get(letters, i - WINDOW)), -1)).otherwise(
                F.struct(state["counts"].alias("counts"), state["total"].alias("total"))
            )
            return bound(left, lambda gone: bound(changed(gone, F.ascii(F.get(letters, i)), 1), lambda now: F.struct(
                now["counts"].alias("counts"), now["total"].alias("total"),
                F.when(state["first"] >= 0, state["first"]).when((i >= WINDOW - 1) & (now["total"] <= enough), i - WINDOW + 1).otherwise(-1).alias("first"),
                F.when((i >= WINDOW - 1) & (now["total"] <= enough), i + 1).otherwise(state["last"]).alias("last"),
            )))

        return slide

    start = F.struct(F.lit(" " * 128).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return bound(F.split(candidate, ""), lambda letters: F.aggregate(
        F.sequence(F.lit(0), F.length(candidate) - 1), start, step(letters), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
    ))


def entropy_spans(text: Column, no: int, letters: str, least: float) -> Column:
    pattern = f"[{letters}]{{{WINDOW},}}"
    candidates = matches(text, pattern, no, text.rlike(f"[{letters}]{{{WINDOW}}}"))
    candidates = F.filter(candidates, lambda c: ~c["hit"].rlike("|".join(f"(?:{a})" for a in ALLOWED)))
    placed = F.transform(candidates, lambda c: bound(windows(c["hit"], least), lambda w: F.struct(
        (c["start"] + w["first"]).alias("start"), c["no"].alias("no"), (c["start"] + w["last"]).alias("end"),
        F.substring(c["hit"], w["first"] + 1, w["last"] - w["first"]).alias("hit"), (w["first"] >= 0).alias("any"),
    )))
    return F.transform(F.filter(placed, lambda c: c["any"]), lambda c: F.struct(
        c["start"].alias("start"), c["no"].alias("no"), c["end"].alias("end"), c["hit"].alias("hit")
    ))


def outside(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])))


def added(spans: Column, names: list[str], held: Column) -> Column:
    """Spans of the classes in their order, without those inside a pattern's span or one of a class before. Each class's
    result is bound: named columns would be put in again wherever they are read."""
    if not names:
        return held
    fresh = outside(outside(spans[names[0]], spans["base"]), held)
    return bound(F.concat(held, fresh), lambda now: added(spans, names[1:], now))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined with commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["no"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def scan(df: DataFrame, text_col: str) -> DataFrame:
    """All columns, with ``__base`` (spans of patterns), ``__added`` (of entropy): arrays of start, no of the kind, end
    and hit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.filter(matches(text, ASSIGN, 0, named), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    access = matches(text, ACCESS, 1, text.contains("AKIA"))
    hexes = matches(text, HEX, 2, text.rlike("[0-9a-f]{24}"))
    rows = df.withColumn("__base", F.concat(assign, access, hexes))
    found = F.struct(F.col("__base").alias("base"), *[entropy_spans(text, KINDS.index(k), *c).alias(k) for k, c in CLASSES.items()])
    return rows.withColumn("__added", bound(found, lambda spans: added(spans, list(CLASSES), F.expr(NOTHING))))


def redact(df: DataFrame, text_col: str, mark: str = "[SECRET]") -> DataFrame:
    """The same columns, each stretch that spans cover replaced by ``mark``; overlapping spans are one stretch."""
    rows = scan(df, text_col).withColumn("__all", F.array_sort(F.concat("__base", "__added")))
    text = F.col(text_col)

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate("__all", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size("__all") > 0, folded).otherwise(text)).select(df.columns)
