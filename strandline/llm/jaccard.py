"""Jaccard join of documents over word shingles by chosen paths.

Rows of equal shingle sets are one representative from the start (a grouped minimum), so copies never meet. Each
representative has a sketch: the least hash of its set in each of 128 parts of the hash range. In each run, a node of the
path tree chooses some coordinates of the sketch by its own hash, and every set goes to one child for each chosen
coordinate, named by its value there: the sampled shared tokens of the chosen-path method. A node with few sets is
compared by brute force; a node with many is split again, unless most of it stays together. A pair is compared in the
first small root node that it shares, and elsewhere only if it shares none. Two sets of similarity J that share a node share a chosen child
with chance 1 - (1 - J)^b, so a run finds a pair of the threshold with a known chance, and runs are repeated until
the target recall. A node that splits do not make small (many near copies) is compared block by block.

Brute force compares sketches and sizes; the margin is five standard deviations. Pairs that pass are verified on their
whole shingle sets, in cells that hold a bounded number of sets; each pair is verified once. Links join into groups by
the least id, iterated over tables of links between representatives.

What is shuffled: one narrow row a representative and chosen node, a byte a coordinate of sets in nodes of two or more, and the
texts of representatives with a candidate. Nothing is collected to the driver but one count a round.

Words are runs of other characters than white space, in lower case. A text of fewer words than a shingle has one shingle,
all its words. Texts without a word, and null texts, are a group each of their own (no links). Null ids and repeated
rows are kept; a row that repeats id and text is in the same group. An empty table gives an empty result. Other columns
are carried along by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

SHINGLE = 5
THRESHOLD = 0.8
PARTS = 128
BRANCHES = 4  # coordinates that a node chooses
RECALL = 1 - 1e-7  # of a pair at the threshold
BUCKET = 512  # sets that a node may hold for brute force
BLOCK = 1024  # sets of one block of a node that splitting does not make small
DEPTH = 3  # splits; nodes that are larger still are compared in blocks
MARGIN = 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / PARTS)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    hashes = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(words))):
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each part of the range, as 32 bits; an empty part takes the next one's with its distance."""
    part = (hashes >> np.uint64(57)).astype(np.int64)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    filled, values = part[at], (hashes[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    nearest = np.searchsorted(filled, np.arange(PARTS)) % len(filled)
    distance = (filled[nearest] - np.arange(PARTS)) % PARTS
    return values[nearest] ^ (distance.astype(np.uint32) * np.uint32(0x85EBCA6B))


def sets_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One stored row a row: doc_id, key of the text, key of the shingle set, its size and sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.string()), ("size", pa.int64()), ("sketch", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches, "text", 4_000_000):
            keys, sizes, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text or "")
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return common.stored(rows.mapInArrow(read, "doc_id long, text_key long, set_key string, size long, sketch binary"), "sets")


def representatives(sets: DataFrame) -> DataFrame:
    """One stored row a distinct set: rep (a number from its key), the least id and text key, count, size, sketch."""
    reps = sets.where("size > 0").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch")
    )
    return common.stored(reps.select(F.xxhash64("set_key").alias("rep"), "set_key", "first.doc_id", "first.text_key", "copies", "size", "sketch"), "representatives")


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is missed with a chance below 1 - recall."""
    found = 1.0
    for _ in range(DEPTH):
        found = 1 - (1 - threshold * found) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def chosen(seed: int) -> list[int]:
    """The coordinates that the root of a run chooses."""
    return [int(i) for i in np.random.default_rng(seed).permutation(PARTS)[:BRANCHES]]


def value_at(i: Column | int) -> Column:
    return F.substring(F.col("sketch"), (F.lit(i) if isinstance(i, int) else i) * 4 + 1, F.lit(4))


def root_nodes(reps: DataFrame, runs: int) -> DataFrame:
    """Rows (node, slot, rep): each set's child of the root in every run. Slots number the roots' chosen coordinates."""
    slots = [i for run in range(runs) for i in chosen(run)]
    nodes = F.array(*[F.struct(F.lit(n).alias("slot"), F.xxhash64(F.lit(n), value_at(i)).alias("node")) for n, i in enumerate(slots)])
    return reps.select("rep", F.explode(nodes).alias("x")).select("x.node", "x.slot", "rep", F.lit(None).cast("long").alias("above"))


def children(rows: DataFrame) -> DataFrame:
    """Rows (node, rep) sent to the chosen children of large nodes, with the number of sets in the node."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda b: F.pmod(F.xxhash64(F.col("node"), b), F.lit(PARTS)).cast("int"))
    child = F.transform(F.array_distinct(picks), lambda i: F.xxhash64(F.col("node"), i, value_at(i)))
    return rows.select(F.explode(child).alias("node"), F.lit(-1).alias("slot"), "rep", F.col("count").alias("above"))


def buckets(reps: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """Small nodes (node, slot, rep, size, marks, roots), and those that splits do not make small: a child with more than
    half of a large node's sets holds sets that are alike, and what is large after the last split.

    ``marks`` has a byte of each coordinate, enough for the estimate. ``roots`` has the set's node in each slot where that
    node is small, else 0: two sets that share one are compared there, and nowhere else again.
    """
    n_slots = runs * BRANCHES
    now, small, dense, shared = root_nodes(reps, runs), [], [], None
    for depth in range(1, DEPTH + 1):
        narrow = common.stored(now, "nodes")
        counts = common.stored(narrow.groupBy("node").agg(F.count("*").alias("count"), F.max("above").alias("above")).where("count > 1"), "node-counts")
        placed = common.stored(narrow.drop("above").join(counts, "node"), "placed-nodes")
        large = F.col("count") > BUCKET
        if depth == 1:
            here = [F.coalesce(F.max(F.when(F.col("slot") == n, F.col("node"))), F.lit(0)) for n in range(n_slots)]
            roots = placed.where(~large).groupBy("rep").agg(F.array(*here).alias("roots"))
            held = placed.select("rep").distinct().join(reps.select("rep", "size", marks_of(F.col("sketch")).alias("marks")), "rep").join(roots, "rep", "left")
            shared = common.stored(held, "compared-sets")
        alike = F.coalesce(F.col("count") * 2 > F.col("above"), F.lit(False)) | F.lit(depth == DEPTH)
        small.append(placed.where(~large).select("node", "slot", "rep"))
        dense.append(placed.where(large & alike).select("node", "rep"))
        rest = placed.where(large & ~alike)
        if rest.isEmpty():
            break
        now = children(rest.select("node", "rep", "count").join(reps.select("rep", "sketch"), "rep"))
    return reduce(DataFrame.unionByName, small).join(shared, "rep"), reduce(DataFrame.unionByName, dense).join(shared, "rep")


def marks_of(sketch: Column) -> Column:
    """The last byte of each coordinate."""
    return F.unhex(F.regexp_replace(F.hex(sketch), "(..)......", "$1"))


class Compared:
    """Sets of one cell as arrays."""

    def __init__(self, table: pa.Table):
        self.reps, self.sizes = table.column("rep").to_numpy(), table.column("size").to_numpy()
        self.marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, PARTS)
        roots = [r or [] for r in table.column("roots").to_pylist()]
        self.roots = np.zeros((len(roots), max(map(len, roots), default=0)), np.int64)
        for i, r in enumerate(roots):
            self.roots[i, : len(r)] = r

    def links(self, one: np.ndarray, two: np.ndarray, slot: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of the two lists that may reach the threshold and share no small root before the slot (with
        slot -1: none at all)."""
        first, second = np.nonzero(likely(self.marks[one], self.marks[two], self.sizes[one], self.sizes[two], threshold))
        x, y = one[first], two[second]
        before = slice(None) if slot < 0 else slice(0, slot)
        met = ((self.roots[x, before] == self.roots[y, before]) & (self.roots[x, before] != 0)).any(axis=1)
        return x[~met], y[~met]

    def table(self, x: np.ndarray, y: np.ndarray, cell: int) -> pa.Table:
        a, b = np.minimum(self.reps[x], self.reps[y]), np.maximum(self.reps[x], self.reps[y])
        return pa.table({"a": a, "b": b, "cell": np.full(len(a), cell, np.int64)}, schema=PAIRS)


def likely(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two matrices of marks may reach the threshold."""
    agree = np.zeros((len(a), len(b)), np.float32)
    for i in range(len(a)):
        agree[i] = (a[i] == b).mean(axis=1)
    low, high = np.minimum.outer(sizes_a, sizes_b), np.maximum.outer(sizes_a, sizes_b)
    # A small set fills few parts, and its estimate has the wider spread of so many draws.
    spread = np.maximum(MARGIN, 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(1, np.minimum(high, PARTS))))
    return (agree >= threshold - spread) & (low >= threshold * high - 1e-9)


def compare_small(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    held, every = Compared(table), np.arange(table.num_rows)
    x, y = held.links(every, every, table.column("slot")[0].as_py(), threshold)
    return held.table(x[x < y], y[x < y], key[0].as_py())


def compare_blocks(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """One pair of blocks of a large node: rows of the one against rows of the other, or one block with itself."""
    held, side = Compared(table), table.column("side").to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    x, y = held.links(one, two if len(two) else one, -1, threshold)
    keep = slice(None) if len(two) else x < y
    return held.table(x[keep], y[keep], key[0].as_py())


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])


def block_cells(large: DataFrame) -> DataFrame:
    """Rows of large nodes dealt to blocks of bounded size, each block sent to the cells it shares with others."""
    counts = common.stored(large.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "block-counts")
    rows = common.stored(large, "large-nodes").join(counts, "node").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.xxhash64("node", low, high).alias("cell"), F.when(F.col("block") == low, 0).otherwise(1).alias("side"), "rep", "size", "marks", "roots")


def candidates(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Stored pairs of representatives that may reach the threshold, each with one cell for its verification."""
    small, large = buckets(reps, runs_for(recall, threshold))
    schema = "a long, b long, cell long"
    pairs = small.groupBy("node").applyInArrow(lambda k, t: compare_small(k, t, threshold), schema)
    if not large.isEmpty():
        cells = block_cells(large)
        pairs = pairs.unionByName(cells.groupBy("cell").applyInArrow(lambda k, t: compare_blocks(k, t, threshold), schema))
    return common.stored(pairs.groupBy("a", "b").agg(F.min("cell").alias("cell")), "candidate-pairs")


def verified(df: DataFrame, id_col: str, text_col: str, reps: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Stored links: pairs whose whole shingle sets have a Jaccard similarity of at least the threshold."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = common.stored(reps.join(ends, "rep").select("rep", "doc_id", "text_key"), "candidate-sets")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = rows.join(wanted.withColumnRenamed("doc_id", "d"), F.col("d").eqNullSafe(F.col("doc_id")) & (wanted["text_key"] == rows["text_key"]))
    texts = common.stored(texts.select("rep", "text").dropDuplicates(["rep"]), "candidate-texts")
    members = pairs.select("cell", F.explode(F.array("a", "b")).alias("rep")).distinct()
    in_cells = members.join(texts, "rep").select("cell", "rep", "text", F.lit(None).cast("long").alias("other"))
    asked = pairs.select("cell", F.col("a").alias("rep"), F.lit(None).cast("string").alias("text"), F.col("b").alias("other"))

    def check(key: tuple, table: pa.Table) -> pa.Table:
        held, ask = {}, []
        for rep, text, other in zip(*(table.column(c).to_pylist() for c in ("rep", "text", "other")), strict=True):
            if other is None:
                held[rep] = shingles(text)
            else:
                ask.append((rep, other))
        out = []
        for a, b in ask:
            both = len(np.intersect1d(held[a], held[b], assume_unique=True))
            if both >= threshold * (len(held[a]) + len(held[b]) - both) - 1e-12:
                out.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return common.stored(in_cells.unionByName(asked).groupBy("cell").applyInArrow(check, "a long, b long"), "links")


def groups(links: DataFrame) -> DataFrame:
    """Connected groups of links (a, b): node and the least node of its group. Every node takes the least label around
    it, then the label of its label, until nothing changes; a table is written each round."""
    both = common.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links-both-ways")
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nearer = common.stored(nearer, "nearer-labels")
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = nearer.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        labels = common.stored(after, "labels")
        if labels.where("old <> label").isEmpty():
            return labels.select("node", "label")


def join(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a row: doc_id, text_key, set_id (equal shingle sets), class_id (least id of its linked group), class_size, n_links (other
    rows linked with it, copies included)."""
    sets = sets_of(df, id_col, text_col)
    reps = representatives(sets)
    links = verified(df, id_col, text_col, reps, candidates(reps, threshold, recall), threshold)
    label = groups(links)
    copies = reps.select("rep", "copies")
    linked = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = linked.join(copies, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("copies").alias("others"))
    of_rep = (
        reps.select("rep", "set_key", "doc_id", "copies").join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    of_rep = common.stored(of_rep, "labelled-sets")
    of_class = of_rep.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = common.stored(of_rep.join(of_class, "label").select(
        "set_key", F.col("doc_id").alias("set_id"), "class_id", "class_size", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    ), "classes")
    out = sets.select("doc_id", "text_key", "set_key").join(known, "set_key", "left")
    return out.select(
        "doc_id", "text_key", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of one row of each group: that of the least id, and of rows that share id and text one. Rows without
    a word stay."""
    found = join(df, id_col, text_col, threshold)
    kept = found.where((F.col("class_id") == F.col("doc_id")) | F.col("class_id").isNull())
    kept = common.stored(kept.select(F.xxhash64("doc_id", "text_key").alias("__key")).distinct(), "kept-rows")
    rows = df.withColumn("__key", F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    return rows.join(kept, "__key").dropDuplicates(["__key"]).select(df.columns)
