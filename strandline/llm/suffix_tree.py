"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of one to ``DEPTH`` words; the root is the distribution of single words. A context's
distribution is its counts smoothed by the distribution of the next shorter context that is kept,

    P(x | s) = (c(s x) + B * d(s) * P(x | shorter)) / (c(s) + B * d(s)),    B = BACK, d(s) the distinct words after s,

so it sums to one whenever the root does, and contexts with many different words after them lean on shorter ones. The
root adds 0.1 to each count and to one unknown word. A context is a
candidate from ``LEAST`` occurrences on and is kept by a divergence test: the log10 likelihood that its distribution gains
over its suffix's on the context's own occurrences, each left out of the counts that predict it, is at least ``GAIN``.
That estimates c(s) times the divergence without the bias of counts that predict themselves. A word is scored in the
longest kept suffix of the words before it in its document.

Documents become blocks of word codes in the shared folder, once. Counts of whole texts need no row for each word:
a block sends its distinct words, and then its distinct n-grams by length, as packed sorted 64-bit hashes to buckets,
a bucket adds what all blocks sent and answers every block in the order it asked: the sum, a small number by which the
bucket knows the n-gram from then on where it is frequent enough to be a context, and whether the block owns it, which of
all blocks that hold an n-gram one does. What is summed for a context (its distinct next words, its gain) comes from the
owners of its n-grams and goes to its bucket under that number. Buckets follow the hash of the n-gram, of which a block
sends one entry however often it occurs, so no word or context is a hot key. Their number grows
with the words of the input, and so do the tables of counts. Words are compared as bytes; n-grams by hash, of which two
meet with a chance of about n^2 / 2^65. A length's n-grams are counted only behind contexts of ``LEAST`` occurrences, which
the counts of the length before tell; nothing else limits them. Answers are written by input split, so a task reads one
small folder, and a lost executor costs its tasks only.

A null text is empty: one end alone. Rows with null or repeated ids are scored each; the caller's condition says which
rows are learned from, and null means not. Very long texts are one block each. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

BLOCK_BYTES = 10 << 20  # text of a block; a longer document is a block by itself
WORDS = 1 << 19  # words of all blocks to a bucket
GRAMS = 1 << 21  # n-grams of all blocks to a bucket
DEPTH = 3  # words of a context
LEAST = 8  # occurrences of a context
BACK = 1.0  # weight of the shorter context's distribution for each distinct word after the context
GAIN = 1.0  # log10 likelihood that a kept context gains
ROOT = 0.1  # added to each count of the root
BLOCKS = "part int, block long, learns binary, lengths binary, codes binary, words binary, n_tokens long, n_words long, n_learned long"
ASKED = "bucket int, part int, block long, keys binary, n long, values binary"
ANSWERS = "part int, block long, bucket int, totals binary, owned binary, numbers binary, known long"
LEVEL = 1 << 24  # buckets of one length of context, at most
FINE = 4096.0  # gains are summed in whole numbers of this part of a unit, so that their sum has no order


def packed(x: np.ndarray) -> bytes:
    """An array of numbers, compressed byte by byte position: small or sorted numbers shrink to little."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, kind: type = np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first words and of their last."""
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) + (after ^ (before >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and which of them stands at each place. Only distinct keys are sorted."""
    number, distinct = pd.factorize(keys)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], rank[number]


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash, in its order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def to_blocks(df: DataFrame, id_col: str, text_col: str, learns: Column) -> DataFrame:
    """Documents as blocks of codes: lengths in words with the end, codes into the block's own sorted words. The end is
    the empty word."""
    docs = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns")
    )
    kind = docs.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for group in gathered(batches):
            learned = group.column("learns").to_numpy(zero_copy_only=False)
            pieces = pc.ascii_split_whitespace(pc.ascii_lower(group.column("text").combine_chunks().cast(pa.large_string())))
            sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
            flat = pieces.flatten()
            full = pc.greater(pc.binary_length(flat), 0)
            lengths = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes)) + 1
            coded = flat.filter(full).dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(1, len(order) + 1)
            codes = np.zeros(int(lengths.sum()), np.int64)
            words = np.ones(len(codes), bool)
            words[np.cumsum(lengths) - 1] = False
            codes[words] = place[coded.indices.to_numpy()]
            listed = [b"", *coded.dictionary.take(pa.array(order)).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([(part << 24) + number]),
                "ids": pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), group.column("id").combine_chunks()),
                "learns": [packed(learned.astype(np.int64))], "lengths": [packed(lengths)], "codes": [packed(codes.astype(np.int32))],
                "words": [zlib.compress(b"\n".join(listed), 1)], "n_tokens": pa.array([len(codes)]), "n_words": pa.array([len(listed)]),
                "n_learned": pa.array([int(lengths[learned].sum())]),
            })
            number += 1

    folder = common.shared_folder(df.sparkSession, "word-blocks")
    made = docs.mapInArrow(blocks, f"part int, block long, ids array<{kind}>, {BLOCKS.split(', ', 2)[2]}")
    made.write.option("maxRecordsPerFile", 1).parquet(folder)
    return df.sparkSession.read.schema(made.schema).parquet(folder)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole documents of about ``BLOCK_BYTES`` of text, over the borders of batches."""
    waiting, size = [], 0
    for batch in common.batches_of(batches, "text", BLOCK_BYTES):
        more = batch.column(1).nbytes
        if waiting and size + more > BLOCK_BYTES:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, size = [], 0
        waiting.append(batch)
        size += more
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


@dataclass
class Model:
    """What tasks need besides the tables: scalars and the folders of answers so far."""

    depth: int
    least: int
    back: float
    gain: float
    word_buckets: int
    gram_buckets: int
    learned: int = 0
    distinct: int = 0
    words: str = ""
    grams: tuple[str, ...] = ()
    spreads: str = ""
    kept: str = ""


def rows_of(folder: str, part: int, block: int) -> list[dict]:
    """What the buckets answered a block, by bucket."""
    system, path = fs.FileSystem.from_uri(f"{folder}/part={part}")
    found = []
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                t = pq.ParquetFile(source).read(columns=["block", "bucket", "totals", "owned", "numbers"])
            found += t.filter(pc.equal(t.column("block"), block)).to_pylist()
    return sorted(found, key=lambda r: r["bucket"])


@dataclass
class Answer:
    """For what a block asked, in its order: sums, whether it owns each, and each one's bucket and number there (the
    number is -1 for those too rare to be a context)."""

    totals: np.ndarray
    owned: np.ndarray
    bucket: np.ndarray
    number: np.ndarray


def answer_of(folder: str, part: int, block: int, least: int) -> Answer:
    parts = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row in rows_of(folder, part, block):
        totals = unpacked(row["totals"])
        number = np.full(len(totals), -1)
        number[totals >= least] = np.cumsum(unpacked(row["numbers"]))
        owned = np.unpackbits(np.frombuffer(zlib.decompress(row["owned"]), np.uint8), count=len(totals)).astype(bool)
        parts.append((totals, owned, np.full(len(totals), row["bucket"]), number))
    return Answer(*[np.concatenate(x) for x in zip(*parts)])


class Block:
    """The words of a block and what is known of their counts."""

    def __init__(self, row: dict, model: Model):
        self.model, self.part, self.block = model, row["part"], row["block"]
        self.words = zlib.decompress(row["words"]).split(b"\n")
        self.codes, self.lengths = unpacked(row["codes"], np.int32), unpacked(row["lengths"])
        self.ids = row.get("ids")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.place = (np.arange(len(self.codes)) - np.repeat(self.starts, self.lengths)).astype(np.int32)
        self.learns = np.repeat(unpacked(row["learns"]) > 0, self.lengths)
        self.hashes = hashed(self.words)
        # Of the n-grams that end at each place: hash, which of the block's distinct ones, and how often it is learned.
        self.length, self.grams, self.which = 1, self.hashes[self.codes], self.codes
        self.counts: np.ndarray | None = None
        self.answer: Answer | None = None

    def asked_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Order in which words are asked for, and the bucket of each."""
        bucket = bucket_of(self.hashes, self.model.word_buckets)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def know_words(self) -> np.ndarray:
        """Counts of the block's words among all that is learned."""
        asked = answer_of(self.model.words, self.part, self.block, self.model.least)
        back = np.empty(len(self.words), np.int64)
        back[self.asked_words()[0]] = np.arange(len(self.words))
        self.answer = Answer(asked.totals[back], asked.owned[back], asked.bucket[back], asked.number[back])
        self.counts = self.answer.totals[self.codes]
        return self.counts

    def level(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next length: places of its n-grams, occurrences of their contexts, which contexts these are; its distinct
        n-grams in order, and which of them stands at each place."""
        at = np.flatnonzero((self.place[1:] >= self.length) & (self.counts[:-1] >= self.model.least)) + 1
        contexts, seen = self.which[at - 1], self.counts[at - 1]
        keys = joined(self.grams[at - 1], self.hashes[self.codes[at]])
        distinct, number = ranked(keys)
        self.length += 1
        self.grams = np.zeros(len(self.codes), np.uint64)
        self.grams[at] = keys
        self.which = np.zeros(len(self.codes), np.int32)
        self.which[at] = number
        return at, seen, contexts, distinct, number

    def know_level(self) -> Level:
        """The next length with the answers for it."""
        context = self.answer
        at, seen, contexts, distinct, number = self.level()
        self.answer = answer_of(self.model.grams[self.length - 2], self.part, self.block, self.model.least)
        self.counts = np.zeros(len(self.codes), np.int64)
        self.counts[at] = self.answer.totals[number] if len(at) else 0
        return Level(self.length - 1, at, seen, contexts, self.counts[at], number, len(distinct), context, self.answer.owned)

    def root(self) -> np.ndarray:
        return (self.know_words() + ROOT) / (self.model.learned + ROOT * (self.model.distinct + 1))

    def contexts_of(self) -> Iterator[Level]:
        for _ in range(self.model.depth):
            yield self.know_level()


@dataclass
class Level:
    """One length of contexts in a block: places of their next words, the contexts' occurrences, which contexts these are
    (of ``asked``) and the n-grams' occurrences; which distinct n-gram stands at each place, and which are owned."""

    length: int
    at: np.ndarray
    seen: np.ndarray
    contexts: np.ndarray
    found: np.ndarray
    number: np.ndarray
    distinct: int
    asked: Answer
    owned: np.ndarray

    def once(self) -> np.ndarray:
        """A place in ``at`` for each n-gram that the block owns."""
        first = np.zeros(self.distinct, np.int64)
        first[self.number] = np.arange(len(self.at))
        return first[self.owned]

    def frequent(self) -> np.ndarray:
        """The asked n-grams that are contexts, by bucket and number there: the order of messages about them."""
        known = np.flatnonzero(self.asked.number >= 0)
        return known[np.lexsort((self.asked.number[known], self.asked.bucket[known]))]

    def spread_out(self, folder: str, block: Block) -> np.ndarray:
        """What the buckets of contexts answered, for each place."""
        values = np.zeros(len(self.asked.totals), np.int64)
        answers = [unpacked(r["totals"]) for r in rows_of(folder, block.part, block.block) if r["bucket"] // LEVEL == self.length]
        if answers:
            values[self.frequent()] = np.concatenate(answers)
        return values[self.contexts]


def ask(block: Block, keys: Callable[[int, int], bytes], buckets: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Rows of what a block sends: keys and values of each bucket. ``keys`` packs those between two places."""
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(buckets) else np.zeros(1, np.int64)
    spans = list(zip(edges[:-1], edges[1:]))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([int(buckets[a]) for a, _ in spans], pa.int32()), "part": pa.array([block.part] * len(spans), pa.int32()),
        "block": pa.array([block.block] * len(spans), pa.int64()), "keys": pa.array([keys(a, b) for a, b in spans], pa.binary()),
        "n": pa.array([int(b - a) for a, b in spans], pa.int64()), "values": pa.array([packed(values[a:b]) for a, b in spans], pa.binary()),
    })


def steps_of(keys: np.ndarray) -> Callable[[int, int], bytes]:
    return lambda a, b: packed(np.diff(keys[a:b], prepend=np.uint64(0)))


def send_words(block: Block) -> Iterator[pa.RecordBatch]:
    order, buckets = block.asked_words()
    local = np.bincount(block.codes[block.learns], minlength=len(block.words))[order]
    yield ask(block, lambda a, b: zlib.compress(b"\n".join(block.words[i] for i in order[a:b]), 1), buckets, local)


def send_grams(block: Block) -> Iterator[pa.RecordBatch]:
    block.know_words()
    for _ in block.model.grams:
        block.know_level()
    at, _, _, distinct, number = block.level()
    local = np.bincount(number[block.learns[at]], minlength=len(distinct)).astype(np.int64)
    yield ask(block, steps_of(distinct), bucket_of(distinct, block.model.gram_buckets), local)


def send_contexts(block: Block, level: Level, values: np.ndarray) -> pa.RecordBatch:
    """``values`` for each asked n-gram, sent for those that are contexts."""
    known = level.frequent()
    buckets = level.length * LEVEL + level.asked.bucket[known]
    return ask(block, steps_of(level.asked.number[known].astype(np.uint64)), buckets, values[known])


def send_spreads(block: Block) -> Iterator[pa.RecordBatch]:
    """How many different words follow a context, counted by the owners of its n-grams."""
    block.know_words()
    for level in block.contexts_of():
        yield send_contexts(block, level, np.bincount(level.contexts[level.once()], minlength=len(level.asked.totals)))


def send_gains(block: Block) -> Iterator[pa.RecordBatch]:
    """What a context gains over its suffix, every occurrence left out of the counts that predict it, summed by the
    owners of its n-grams: all occurrences of one have the same."""
    p, back = block.root(), block.model.back
    for level in block.contexts_of():
        spreads = level.spread_out(block.model.spreads, block)
        q, weight = p[level.at], back * spreads
        own = level.once()
        own = own[level.seen[own] > 1]
        found, seen = level.found[own], level.seen[own]
        # An n-gram that occurs once takes its word with it.
        less = back * (spreads[own] - (found == 1))
        gains = found * (np.log10((found - 1 + less * q[own]) / (seen - 1 + less)) - np.log10(q[own]))
        total = np.zeros(len(level.asked.totals), np.int64)
        np.add.at(total, level.contexts[own], np.rint(gains * FINE).astype(np.int64))
        p[level.at] = (level.found + weight * q) / (level.seen + weight)
        yield send_contexts(block, level, total)


def score_block(block: Block) -> Iterator[pa.RecordBatch]:
    p, back = block.root(), block.model.back
    base = np.log10(p)
    known = block.counts > 0
    state = np.zeros(len(p), np.int64)
    for level in block.contexts_of():
        here = level.spread_out(block.model.kept, block) >= block.model.gain * FINE
        on = level.at[here]
        weight = back * level.spread_out(block.model.spreads, block)[here]
        p[on] = (level.found[here] + weight * p[on]) / (level.seen[here] + weight)
        state[on] = level.length
    add = lambda x: np.add.reduceat(x, block.starts)
    yield pa.RecordBatch.from_pydict({
        "id": block.ids, "n_tokens": block.lengths, "n_known": add(known.astype(np.int64)), "base_score": add(base), "score": add(np.log10(p)),
        "n_in_context": add((state > 0).astype(np.int64)),
    })


def each_block(blocks: DataFrame, model: Model, make: Callable[[Block], Iterator[pa.RecordBatch]], schema: str, ids: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names) if c != "ids"}
                if ids:
                    row["ids"] = batch.column(batch.schema.get_field_index("ids"))[i].values
                yield from make(Block(row, model))

    return (blocks if ids else blocks.drop("ids")).mapInArrow(run, schema)


def answered(asked: DataFrame, least: int, text: bool = False) -> str:
    """Buckets add up what blocks sent for equal keys and answer each block in its order. The folder of the answers, by
    input split."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        # Blocks in order: the first that holds a key owns it.
        table = table.take(pc.sort_indices(table.column("block")))
        raw = table.column("keys").to_pylist()
        if text:
            words = pa.array([w for r in raw for w in zlib.decompress(r).split(b"\n")], pa.large_binary()).dictionary_encode()
            place = np.empty(len(words.dictionary), np.int64)
            place[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
            number = place[words.indices.to_numpy()]
        else:
            _, number = ranked(np.concatenate([np.cumsum(unpacked(r, np.uint64), dtype=np.uint64) for r in raw]))
        values = np.concatenate([unpacked(v) for v in table.column("values").to_pylist()])
        totals = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        np.add.at(totals, number, values)
        held = np.flatnonzero(values > 0)
        owner = np.zeros(len(values), bool)
        first = np.full(len(totals), len(values))
        np.minimum.at(first, number[held], held)
        owner[first[first < len(values)]] = True
        # Keys in order have ascending numbers, and so do the keys of each block.
        frequent = np.cumsum(totals >= least) - 1
        cuts = np.cumsum(table.column("n").to_numpy())[:-1]
        parts = list(zip(np.split(number, cuts), np.split(owner, cuts)))
        known = int((totals > 0).sum())
        return pa.table({
            "part": table.column("part"), "block": table.column("block"), "bucket": table.column("bucket"),
            "totals": pa.array([packed(totals[n]) for n, _ in parts], pa.binary()),
            "owned": pa.array([zlib.compress(np.packbits(o).tobytes(), 1) for _, o in parts], pa.binary()),
            "numbers": pa.array([packed(np.diff(frequent[n[totals[n] >= least]], prepend=0)) for n, _ in parts], pa.binary()),
            "known": pa.array([known] + [0] * (table.num_rows - 1), pa.int64()),
        })

    folder = common.shared_folder(asked.sparkSession, "answers")
    asked.groupBy("bucket").applyInArrow(add, ANSWERS).repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def score(
    df: DataFrame, id_col: str, text_col: str, learns: Column, depth: int = DEPTH, least: int = LEAST, back: float = BACK, gain: float = GAIN
) -> DataFrame:
    """For each row: id, n_tokens (words and the end), n_known, base_score and score (log10 probabilities under the
    root and under the tree), n_in_context (tokens scored in another state than the root), train_tokens."""
    spark = df.sparkSession
    blocks = to_blocks(df, id_col, text_col, learns)
    sizes = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"), F.sum("n_learned").alias("learned")).first()
    tokens, words, learned = sizes["tokens"] or 0, sizes["words"] or 0, sizes["learned"] or 0
    model = Model(depth, max(1, least), back, gain, max(1, -(-words // WORDS)), max(1, -(-tokens // GRAMS)), learned)
    model.words = answered(each_block(blocks, model, send_words, ASKED), model.least, text=True)
    answers = spark.read.schema(ANSWERS).parquet(model.words)
    model.distinct = answers.agg(F.sum("known").alias("v")).first()["v"] or 0
    for _ in range(depth):
        model.grams += (answered(each_block(blocks, model, send_grams, ASKED), model.least),)
    model.spreads = answered(each_block(blocks, model, send_spreads, ASKED), model.least)
    model.kept = answered(each_block(blocks, model, send_gains, ASKED), model.least)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, base_score double, score double, n_in_context long"
    return each_block(blocks, model, score_block, schema, ids=True).withColumn("train_tokens", F.lit(learned).cast("long"))
