"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at content-selected places: the minimisers of word 8-grams in windows chosen so that every passage of
the least length holds one, at the same word in every document that has the passage. Suffixes whose 8-gram only one
document holds are left out by a grouped minimum and maximum. The others carry their words to the right and to the left as
hashes, are sorted over the whole cluster by their words to the right, and neighbours of different documents are compared:
the common words to the right and then to the left. Where both together reach the least length, the stretch is marked
in both documents. Neighbours are enough where an 8-gram has two suffixes. Where it has more, the partner with the
longest stretch may stand further off, so every window of the least length whose minimiser such an 8-gram is goes by its
hash (64 bits) instead: the least and the greatest document of a hash, combined on the map side, tell whether two hold it.
Each shared window has its minimiser in both documents, so all are found, in groups of any size. Pairs are never listed.

Rows at the edges of sorted partitions are compared in a second, small job over a few rows a partition.

Words are runs of other characters than space and the control characters 9 to 13. Texts of fewer words than the least length,
and null texts, have no passages. Rows that repeat id and text are one document; a null id is kept. A passage that one
document alone holds twice is none. Texts are whole, of any length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common

LEAST = 50
GRAM = 8
BLOCK = 4_000_000


def word_hashes(text: str) -> np.ndarray:
    words = common.words_only(text)
    known: dict[bytes, int] = {}
    return np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)


def gram_hashes(words: np.ndarray, width: int = GRAM) -> np.ndarray:
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def least_places(grams: np.ndarray, window: int) -> np.ndarray:
    """The place of the least gram of every window, the first of equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    out = []
    for at in range(0, len(grams) - window + 1, 1 << 16):  # bounds the memory of a long text
        view = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + window - 1], window)
        out.append(view.argmin(axis=1) + np.arange(len(view)) + at)
    return np.concatenate(out)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    return np.unique(least_places(grams, window))


def window_hashes(grams: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the windows of ``least`` words from ``starts`` on, of the grams that cover them."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in [*range(0, least - GRAM, GRAM), least - GRAM]:
            out = (out ^ grams[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def documents_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.lit("|"), F.col(text_col)).alias("doc"),
        F.col(text_col).alias("text"),
    )


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """Rows (doc, key, pos): the kept suffixes of every document."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches, "text", BLOCK):
            doc, key, pos = [], [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(text or "")
                if len(words) >= least:
                    grams = gram_hashes(words)
                    at = minimisers(grams, least - GRAM + 1)
                    doc.append(np.full(len(at), number, np.int64))
                    key.append(grams[at].view(np.int64))
                    pos.append(at.astype(np.int32))
            if doc:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (doc, key, pos)], schema=schema)

    return docs.select("doc", "text").mapInArrow(read, "doc long, key long, pos int")


def shared_places(found: DataFrame) -> DataFrame:
    """Per document: the places of suffixes whose gram another document holds too; apart, those of more than two suffixes."""
    keys = found.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
    keys = keys.where("least <> most").select("key", (F.col("n") > 2).alias("crowded"))
    shared = found.join(common.stored(keys, "shared-grams"), "key")
    places = [F.collect_set(F.when(c, F.col("pos"))).alias(name) for c, name in ((~F.col("crowded"), "places"), (F.col("crowded"), "crowded"))]
    return common.stored(shared.groupBy("doc").agg(*places), "shared-places")


def contexts(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """A row for each suffix shared by two: its key, its words to the right and to the left as hashes, and how many there
    are. A row for each document with suffixes that more share: hashes and starts of the windows around them."""
    right, left = least, least - GRAM
    schema = pa.schema([
        ("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc", pa.int64()), ("pos", pa.int32()), ("n_words", pa.int32()), ("doc_id", pa.int64()),
        ("windows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches, "text", BLOCK):
            out = {name: [] for name in schema.names}
            for doc, doc_id, text, at, crowded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, at = word_hashes(text), np.sort(np.array(at, np.int64))
                n = len(words)
                if crowded:
                    grams = gram_hashes(words)
                    starts = np.flatnonzero(np.isin(least_places(grams, least - GRAM + 1), np.array(crowded, np.int64)))
                    row = {"doc": doc, "doc_id": doc_id, "windows": window_hashes(grams, starts, least).view(np.int64), "starts": starts.astype(np.int32)}
                    for name in schema.names:
                        out[name].append(row.get(name))
                if not len(at):
                    continue
                short = np.concatenate([np.zeros(left, np.uint64), words, np.zeros(right, np.uint64)]).astype(np.uint32).byteswap()
                key = gram_hashes(words)[at].view(np.int64)
                after = short[(at + left)[:, None] + np.arange(GRAM, right)]
                before = short[(at + left)[:, None] - np.arange(1, left + 1)]
                out["key"] += key.tolist()
                out["right"] += [row.tobytes() for row in after]
                out["left"] += [row.tobytes() for row in before]
                out["pos"] += at.tolist()
                for name, value in (("doc", doc), ("n_words", n), ("doc_id", doc_id)):
                    out[name] += [value] * len(at)
                for name in ("windows", "starts"):
                    out[name] += [None] * len(at)
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    rows = docs.join(places, "doc").select("doc", "doc_id", "text", "places", "crowded")
    return rows.mapInArrow(read, "key long, right binary, left binary, doc long, pos int, n_words int, doc_id long, windows array<long>, starts array<int>")


def shared_windows(found: DataFrame, least: int) -> DataFrame:
    """Marks (doc, doc_id, start, end) of the windows that two documents hold."""
    each = found.where("windows is not null").select("doc", "doc_id", F.explode(F.arrays_zip("windows", "starts")).alias("w"))
    each = each.select(F.col("w.windows").alias("window"), "doc", "doc_id", F.col("w.starts").cast("long").alias("start"))
    twice = each.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most").select("window")
    return each.join(common.stored(twice, "shared-windows"), "window").select("doc", "doc_id", "start", (F.col("start") + least).alias("end"))


class Suffixes:
    """Sorted suffixes as arrays."""

    def __init__(self, table: pa.Table, least: int):
        self.least, n = least, table.num_rows
        self.doc, self.pos, self.n_words, self.key = (table.column(c).to_numpy() for c in ("doc", "pos", "n_words", "key"))
        self.ids = table.column("doc_id").to_pylist()
        self.right = np.frombuffer(b"".join(table.column("right").to_pylist()), np.uint32).reshape(n, least - GRAM)
        self.left = np.frombuffer(b"".join(table.column("left").to_pylist()), np.uint32).reshape(n, least - GRAM)

    def common_words(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words to the left of two suffixes and from their start to the right, within their documents."""
        def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            differ = x != y
            return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])

        to_right = np.minimum(run(self.right[a], self.right[b]), np.minimum(self.n_words[a] - self.pos[a], self.n_words[b] - self.pos[b]) - GRAM)
        to_left = np.minimum(run(self.left[a], self.left[b]), np.minimum(self.pos[a], self.pos[b]))
        same = self.key[a] == self.key[b]
        return np.where(same, to_left, 0), np.where(same, to_right + GRAM, 0)

    def marks(self, a: np.ndarray, b: np.ndarray) -> dict[str, list]:
        """Stretches of both documents of each compared pair that reach the least length."""
        left, right = self.common_words(a, b)
        long = np.flatnonzero(left + right >= self.least)
        at = np.concatenate([a[long], b[long]])
        left, right = np.tile(left[long], 2), np.tile(right[long], 2)
        return {
            "doc": self.doc[at], "doc_id": pa.array([self.ids[i] for i in at], pa.int64()),
            "start": (self.pos[at] - left).astype(np.int64), "end": (self.pos[at] + right).astype(np.int64),
        }

    def next_of_other(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place, and the next one that holds another document; and likewise backwards, the two lists joined."""
        n = len(self.doc)
        change = np.flatnonzero(self.doc[1:] != self.doc[:-1]) + 1 if n else np.zeros(0, np.int64)
        after = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
        before = np.concatenate([[-1], change - 1])[np.searchsorted(change, np.arange(n), side="right")]
        place = np.arange(n)
        a = np.concatenate([place[after < n], before[before >= 0]])
        b = np.concatenate([after[after < n], place[before >= 0]])
        pairs = np.unique(a * max(n, 1) + b)
        return pairs // max(n, 1), pairs % max(n, 1)


MARKS = "doc long, doc_id long, start long, end long, part long, edge binary"
MARK_SCHEMA = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("part", pa.int64()), ("edge", pa.binary())])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def compare_sorted(rows: DataFrame, least: int) -> DataFrame:
    """Marks of neighbours, and one row a partition with its outermost suffixes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, now]) if held is not None else now
            found = Suffixes(table, least)
            yield marked(found.marks(*found.next_of_other()))
            first = outermost(table, found.doc, True) if first is None or first.num_rows < 2 else first
            held = outermost(table, found.doc, False)
        if held is not None:
            edge = packed(pa.concat_tables([first, held]))
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "edge": edge}], schema=MARK_SCHEMA)

    return rows.mapInArrow(read, MARKS)


def marked(found: dict) -> pa.RecordBatch:
    n = len(found["start"])
    return pa.record_batch(
        [pa.array(found["doc"], pa.int64()), found["doc_id"], pa.array(found["start"], pa.int64()), pa.array(found["end"], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
        schema=MARK_SCHEMA,
    )


def outermost(table: pa.Table, doc: np.ndarray, first: bool) -> pa.Table:
    """The first (last) row, and the first (last) one of another document than that, in their order."""
    other = np.flatnonzero(doc != doc[0 if first else -1])
    places = [0, *other[:1]] if first else [*other[-1:], len(doc) - 1]
    return table.take(pa.array(places, pa.int64()))


def compare_edges(edges: DataFrame, least: int) -> DataFrame:
    """Marks of neighbours that two partitions hold: a few rows of each partition."""
    numbered = edges.select("part", "edge", F.lead("part").over(Window.orderBy("part")).alias("next"))
    pairs = numbered.alias("x").join(edges.alias("y"), F.col("x.next") == F.col("y.part")).select(F.col("x.edge").alias("one"), F.col("y.edge").alias("two"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in ((r["one"], r["two"]) for b in batches for r in b.to_pylist()):
            table = pa.concat_tables([pa.ipc.open_stream(one).read_all(), pa.ipc.open_stream(two).read_all()])
            found = Suffixes(table, least)
            a, b = np.triu_indices(table.num_rows, 1)
            differ = found.doc[a] != found.doc[b]
            yield marked(found.marks(a[differ], b[differ]))

    return pairs.mapInArrow(read, MARKS)


def find(df: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """One row for each document that shares a passage: doc_id, spans (array of start and end in words, end exclusive,
    merged), n_words (of the spans)."""
    docs = documents_of(df, id_col, text_col)
    places = shared_places(common.stored(suffixes(docs, least), "suffixes"))
    found = common.stored(contexts(docs, places, least), "contexts")
    rows = found.where("windows is null").drop("windows", "starts")
    rows = rows.repartitionByRange("key", "right", "left", "doc", "pos").sortWithinPartitions("key", "right", "left", "doc", "pos")
    marks = common.stored(compare_sorted(rows, least), "marks")
    marks = marks.where("edge is null").unionByName(compare_edges(marks.where("edge is not null").select("part", "edge"), least))
    marks = marks.select("doc", "doc_id", "start", "end").unionByName(shared_windows(found, least))
    return merged(marks)


def merged(marks: DataFrame) -> DataFrame:
    """One row a document: its marks joined where they meet. Sorted rows in one pass; a task holds one document's spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_words", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, now_id, spans = None, None, []
        for batch in batches:
            out = []
            for doc, doc_id, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans and doc == now:
                    if start > spans[-1]["end"]:
                        spans.append({"start": start, "end": end})
                    elif end > spans[-1]["end"]:
                        spans[-1]["end"] = end
                    continue
                if spans:
                    out.append(row_of(now_id, spans))
                now, now_id, spans = doc, doc_id, [{"start": start, "end": end}]
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if spans:
            yield pa.RecordBatch.from_pylist([row_of(now_id, spans)], schema=schema)

    rows = marks.repartition("doc").sortWithinPartitions("doc", "start")
    return rows.mapInArrow(read, "doc_id long, spans array<struct<start: long, end: long>>, n_words long")


def row_of(doc_id: int | None, spans: list[dict]) -> dict:
    return {"doc_id": doc_id, "spans": spans, "n_words": sum(s["end"] - s["start"] for s in spans)}
