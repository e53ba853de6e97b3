"""Hard negatives by exact inner products of packed integers.

Kronecker packing: the components of several candidates are made non-negative by a bias and laid into separated fields
of one wide integer, one such integer for each dimension. One product with an anchor's biased component then serves all
of its candidates, the sum over dimensions leaves each field a whole inner product, and taking off the biases' share
gives exact scores. A field is as wide as the largest sum it can hold. Where two fields or more fit the 53 bits that a
double holds exactly, the wide integers are doubles and all anchors are multiplied at once; components too large for
that go to integers of any width with ``FIELDS`` fields each. Both give the same scores.

Anchors are a stated set of query rows, scored against all rows in blocks. Rows are sorted by length, label and id and
written as packed blocks to the shared folder. A task holds a group of anchors of one length and reads the blocks one
after the other, so memory is bounded by two blocks and nothing that grows with the product of anchors and rows is
moved or kept: a task returns at most k rows an anchor. Once there are ``SPREAD`` groups or more for each core, a group
reads all blocks; below that the files are split into stripes and the stripes' results are merged, which keeps the rows
to merge below a constant for each core.

Positives come first: an anchor's k best other rows of its label, from blocks whose range of labels holds it. Then, for
each anchor and positive, the best rows of other labels whose score lies in the band. Ties go to the smaller id.

Rows with a null id, a null label or a vector that is null, empty, or holds a null, non-finite or too large component
(2^52 after scaling) take no part. Vectors meet those of their own length only. A row with an anchor's id is the
anchor's own; rows that repeat an id are kept, and each row of an anchor's id is an anchor. An anchor without positives
gives no row, a positive whose band is empty none either. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.vectors import floored, keys_of, matrices, narrow

BLOCK = 2048  # rows of a packed block
GROUP = 1024  # anchors that a task holds
FILE = 32  # blocks of a file
SPREAD = 3  # groups and stripes for each core
FIELDS = 64  # fields of an integer of any width
LONG = 2**62
ROWS = "n_dims int, first long, last long, ids binary, labels binary, width int, x binary"
NO = np.iinfo(np.int64)


class Packed:
    """Candidates' vectors in wide integers, made for anchors of a given range."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        self.rows, self.dims = candidates.shape
        self.low, self.anchor_low = int(candidates.min()), int(anchors.min())
        largest = self.dims * (int(candidates.max()) - self.low) * (int(anchors.max()) - self.anchor_low)
        self.bits = max(1, largest.bit_length())
        self.exact = 2 * self.bits <= 53
        self.fields = 53 // self.bits if self.exact else FIELDS
        words = -(-self.rows // self.fields)
        padded = np.zeros((words * self.fields, self.dims), np.int64)
        padded[: self.rows] = candidates - self.low
        # Field f of a word is row f * words + the word's number.
        laid = padded.reshape(self.fields, words, self.dims)
        kind = np.int64 if self.exact else object
        wide = np.zeros((words, self.dims), kind)
        for f in range(self.fields):
            wide = wide + (laid[f].astype(kind) << (self.bits * f))
        self.wide = wide.astype(np.float64).T if self.exact else wide.T
        sums = candidates.astype(kind).sum(axis=1)
        self.share = self.anchor_low * sums - self.dims * self.anchor_low * self.low

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of each anchor with each candidate, as 64-bit integers; an error beyond these."""
        kind = np.float64 if self.exact else object
        product = (anchors - self.anchor_low).astype(kind) @ self.wide
        if self.exact:
            product = product.astype(np.int64)
        mask = (1 << self.bits) - 1
        fields = np.concatenate([(product >> (self.bits * f)) & mask for f in range(self.fields)], axis=1)[:, : self.rows]
        whole = anchors.astype(np.int64 if self.exact else object).sum(axis=1)
        found = fields + self.low * whole[:, None] + self.share[None, :]
        if not self.exact and max(abs(int(found.max())), abs(int(found.min()))) >= LONG:
            raise OverflowError("an inner product does not fit 64 bits; use a smaller scale")
        return found.astype(np.int64)


def packed_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (n_dims, first and last label, ids, labels, x), at most ``size`` vectors of one length each. A vector's row
    keeps its place, so an anchor is known by its block and number."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in floored(batch.column(2), batch.column(3)[0].as_py() if batch.num_rows else 1):
                took = pa.array(at)
                yield pa.record_batch([batch.column(0).take(took), batch.column(1).take(took), pa.array(np.full(len(at), x.shape[1], np.int32)), keys_of(x)],
                                      names=["id", "label", "n_dims", "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches come in order; the part of a block that is not full waits for the next batch.
        waiting: pa.Table | None = None

        def write(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            (at, x), = matrices(t.column("key").combine_chunks())
            x = narrow(x)
            labels = t.column("label").to_numpy()[at]
            return pa.RecordBatch.from_pydict({
                "n_dims": pa.array([x.shape[1]], pa.int32()), "first": pa.array([labels.min()]), "last": pa.array([labels.max()]),
                "ids": [t.column("id").to_numpy()[at].tobytes()], "labels": [labels.tobytes()], "width": pa.array([x.dtype.itemsize], pa.int32()), "x": [x.tobytes()],
            })

        for batch in batches:
            t = pa.Table.from_batches([batch])
            waiting = t if waiting is None else pa.concat_tables([waiting, t])
            while waiting.num_rows:
                dims = waiting.column("n_dims").to_numpy()
                change = np.flatnonzero(dims != dims[0])
                end = min(size, int(change[0]) if len(change) else len(dims))
                if end < size and not len(change):
                    break
                yield write(waiting.slice(0, end))
                waiting = waiting.slice(end)
        if waiting is not None and waiting.num_rows:
            yield write(waiting)

    each = rows.mapInArrow(vectors, "id long, label long, n_dims int, key binary")
    order = ["n_dims", "label", "id", "key"]
    return each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, ROWS)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, matrix of a block."""
    x = np.frombuffer(row["x"], f"<i{row['width']}").reshape(-1, row["n_dims"]).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), x


def blocks_of(files: list[str], n_dims: int, first: int | None = None, last: int | None = None) -> Iterator[tuple]:
    """Opened blocks of files in the shared folder, one at a time: of a length, and of labels between two where given."""
    field = pyarrow.dataset.field
    for uri in files:
        with common.input_file(uri) as source:
            file = pq.ParquetFile(source)
            for batch in file.iter_batches(batch_size=1, columns=["n_dims", "first", "last", "ids", "labels", "width", "x"]):
                for row in batch.to_pylist():
                    if row["n_dims"] == n_dims and (first is None or row["last"] >= first and row["first"] <= last):
                        yield opened(row)


def first_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each slot's k best by score, ties by the smaller id; in order of slot and rank."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(s)]])))
    return order[rank < k]


class Best:
    """The k best so far of every slot, and the score below which a slot takes no more."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.slot = self.score = self.ids = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        kept = first_of(slot, score, ids, self.k)
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]
        full = np.bincount(self.slot, minlength=len(self.floors)) == self.k
        ends = np.searchsorted(self.slot, np.arange(len(self.floors)), side="right") - 1
        self.floors[full] = np.maximum(self.floors[full], self.score[ends[full]])


def shares(df: DataFrame, uris: list[str]) -> DataFrame:
    """Rows of anchors' groups once for each stripe of files; a stripe is all files once groups alone fill the cores."""
    groups = max(1, df.count())
    wanted = SPREAD * df.sparkSession.sparkContext.defaultParallelism
    stripes = min(len(uris), max(1, -(-wanted // groups)))
    cells = df.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(max(1, stripes) - 1))))
    return cells.repartition(groups * max(1, stripes), "no", "stripe"), max(1, stripes)


def mine(
    df: DataFrame, id_col: str, vector_col: str, label: Column, asks: Column, scale: int = 256, positives: int = 5, negatives: int = 3,
    band: tuple[int, int, int] = (50, 95, 100),
) -> DataFrame:
    """For each row where ``asks`` holds and each of its positives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. ``band`` (least, most, whole): whole * negative_score lies from least to most times
    the positive's score."""
    least, most, whole = band
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), F.lit(scale).alias("scale"), asks.alias("asks"))
    rows = rows.where("id is not null and label is not null and v is not null")
    folder = common.shared_folder(df.sparkSession, "blocks")
    packed_blocks(rows.drop("asks"), BLOCK).write.option("maxRecordsPerFile", FILE).parquet(folder)
    uris = sorted(df.sparkSession.read.schema(ROWS).parquet(folder).inputFiles())
    anchors = packed_blocks(rows.where("asks").drop("asks"), GROUP).withColumn("no", F.monotonically_increasing_id())
    anchors = common.stored(anchors, "anchors")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x = opened(row)
                best = Best(np.full(len(ids), NO.min), positives)
                for c_ids, c_labels, c in blocks_of(uris[row["stripe"] :: n_stripes], row["n_dims"], row["first"], row["last"]):
                    score = Packed(c, x).scores(x)
                    hit = (score >= best.floors[:, None]) & (labels[:, None] == c_labels[None, :]) & (ids[:, None] != c_ids[None, :])
                    a, j = np.nonzero(hit)
                    best.add(a, score[a, j], c_ids[j])
                yield pa.RecordBatch.from_pydict({
                    "no": pa.array(np.full(len(best.slot), row["no"])), "place": pa.array(best.slot), "positive_id": pa.array(best.ids), "positive_score": pa.array(best.score),
                })

    cells, n_stripes = shares(anchors, uris)
    found = cells.mapInArrow(near, "no long, place long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("no", "place").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("order", rank).where(F.col("order") <= positives)
    # A group of anchors holds at most GROUP times ``positives`` of them.
    told = found.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "order", "positive_id", "positive_score"))).alias("positives"))
    asked = common.stored(anchors.join(told, "no"), "positives")

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x = opened(row)
                place, chosen, p = (np.array([r[c] for r in row["positives"]], np.int64) for c in ("place", "positive_id", "positive_score"))
                # whole * s between least * p and most * p, in whole numbers.
                low, high = -(-least * p // whole), most * p // whole
                best = Best(low, negatives)
                anchor_high, anchor_low = np.full(len(ids), NO.min), np.full(len(ids), NO.max)
                np.maximum.at(anchor_high, place, high)
                slots = [np.flatnonzero(place == a) for a in range(len(ids))]
                for c_ids, c_labels, c in blocks_of(uris[row["stripe"] :: n_cells], row["n_dims"]):
                    if (labels == c_labels[0]).all() and (c_labels == c_labels[0]).all():
                        continue
                    score = Packed(c, x).scores(x)
                    anchor_low[:] = NO.max
                    np.minimum.at(anchor_low, place, best.floors)
                    hit = (score >= anchor_low[:, None]) & (score <= anchor_high[:, None]) & (labels[:, None] != c_labels[None, :])
                    a, j = np.nonzero(hit)
                    if not len(a):
                        continue
                    s, found_ids = score[a, j], c_ids[j]
                    # Each hit meets the positives of its anchor.
                    n = np.array([len(t) for t in slots], np.int64)[a]
                    slot = np.concatenate([slots[i] for i in a]) if n.sum() else np.zeros(0, np.int64)
                    s, found_ids = np.repeat(s, n), np.repeat(found_ids, n)
                    fits = (s >= best.floors[slot]) & (s <= high[slot])
                    best.add(slot[fits], s[fits], found_ids[fits])
                yield pa.RecordBatch.from_pydict({
                    "no": pa.array(np.full(len(best.slot), row["no"])), "slot": pa.array(best.slot), "anchor_id": pa.array(ids[place[best.slot]]),
                    "positive_id": pa.array(chosen[best.slot]), "positive_score": pa.array(p[best.slot]), "negative_id": pa.array(best.ids), "negative_score": pa.array(best.score),
                })

    cells, n_cells = shares(asked, uris)
    negative = cells.mapInArrow(hard, "no long, slot long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("no", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return negative.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
