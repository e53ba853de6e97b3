"""Byte-level BPE by ranks: native folds over the distinct words of a table, decoding by joining binary pieces.

Plan of :func:`encode`: a Python step cuts whole texts into the matches of the split pattern, writes the places of each block
of documents to a file of the shared folder and passes on the distinct words that are no token as a whole. These meet by
word; Spark's higher-order functions fold the ranked merges over the bytes of each distinct word of the table once, with
the ranks as a literal. The symbols go back to the blocks, where a second Python step deals them to the documents.
What is shuffled: a narrow row a block and word, once by word and once by block. Texts and places do not move.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common

BLOCK_CHARS = 32_000_000  # text that one block of documents holds before it is passed on; results do not depend on it
LONG_WORD = 192  # bytes; longer words are merged with a heap, since the fold's cost is quadratic in the word
BUCKETS = 32_768  # entries of the literal rank table, a power of two
EDGE = "\ufffe"  # stands before and after a word, and is no token
NONE = "\uffff"  # stands between entries, and for two neighbours that make no token: above all symbols


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def symbol(rank: int) -> str:
    """A token as one character: ranks stay below the surrogates, so a word is a string of its tokens."""
    return chr(rank + 1)


def symbols(word: bytes, single: list[str]) -> str:
    """The bytes of a word, each as the symbol of its own token."""
    return "".join([single[b] for b in word])


def rank_table(ranks: dict[bytes, int]) -> Column:
    """Which two neighbouring tokens make which token, as a constant: an array of short strings addressed by the CRC
    of the two symbols, each entry NONE, the two symbols and the one they make. Symbols compare as their ranks do.
    Few objects, since every task reads the constant anew."""
    if len(ranks) >= 0xD7FF:
        raise ValueError("a vocabulary of more than 55,000 tokens does not fit one character a token")
    table = [NONE] * BUCKETS
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pair = symbol(left) + symbol(right)
                table[zlib.crc32(pair.encode()) % BUCKETS] += pair + symbol(rank) + NONE
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), T.ArrayType(T.StringType()))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas are interpreted without common subexpressions."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_merges(table: Column, word: Column) -> Column:
    """One word of symbols with its ranked merges done: at each step of the fold the two neighbours of lowest rank,
    leftmost first, become one symbol, until no two neighbours have a rank. What each two neighbours make is carried
    along, and a step looks up the two pairs that are new. An edge on both sides gives every symbol two neighbours."""

    def merged_symbol(pair: Column) -> Column:
        """The symbol that two make, else NONE: what follows the pair in its bucket, else the bucket's own beginning."""
        entries = F.get(table, F.crc32(pair.cast("binary")).bitwiseAND(BUCKETS - 1).cast("int"))
        return F.substring(F.call_function("substring_index", entries, F.concat(F.lit(NONE), pair), F.lit(-1)), 1, 1)

    def step(now: Column, low: Column) -> Column:
        def merged(at: Column) -> Column:
            around = F.concat(F.substring(now["w"], at - 1, F.lit(1)), low, F.substring(now["w"], at + 2, F.lit(1)))
            new = F.array(merged_symbol(F.substring(around, 1, 2)), merged_symbol(F.substring(around, 2, 2)))
            return F.struct(
                F.overlay(now["w"], low, at, F.lit(2)).alias("w"),
                F.concat(F.slice(now["m"], F.lit(1), at - 2), new, F.slice(now["m"], at + 2, F.length(now["w"]))).alias("m"),
                F.lit(True).alias("go"),
            )

        return F.when(low < NONE, bound(F.array_position(now["m"], low).cast("int"), merged)).otherwise(
            F.struct(now["w"].alias("w"), now["m"].alias("m"), F.lit(False).alias("go"))
        )

    edged = F.concat(F.lit(EDGE), word, F.lit(EDGE))
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: merged_symbol(F.substring(edged, i, F.lit(2))))
    start = F.struct(edged.alias("w"), pairs.alias("m"), (F.length(word) > 1).alias("go"))
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))

    def one(now: Column, _: Column) -> Column:
        return F.when(now["go"], bound(F.array_min(now["m"]), lambda low: step(now, low))).otherwise(now)

    return F.aggregate(steps, start, one, lambda done: F.substring(done["w"], F.lit(2), F.length(done["w"]) - 2))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in n log n: a heap of pairs by rank and place over a chain of pieces."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        push(i)
    gone = bytearray(n)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if gone[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Vocabulary:
    """What a Python worker keeps of a rank file."""

    held: dict[str, Vocabulary] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.single = [symbol(self.ranks[bytes([b])]) for b in range(256)]
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]

    def done(self, word: str) -> str | None:
        """The symbols of a word that needs no fold: one if it is a token as a whole, those of the heap if it is long."""
        data = word.encode("utf-8", "surrogatepass")
        if (rank := self.ranks.get(data)) is not None:
            return symbol(rank)
        return "".join(map(symbol, merge_long(data, self.ranks))) if len(data) > LONG_WORD else None


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The binary pieces of the ids, one after the other."""
    return b"".join(map(vocabulary.tokens.__getitem__, ids.tolist()))


def digests(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[str, str]:
    """SHA-256 of the ids in decimal, joined by commas, and of the bytes that they decode to."""
    text = ",".join(map(vocabulary.decimals.__getitem__, ids.tolist()))
    return hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decode(ids, vocabulary)).hexdigest()


WORDS = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("word", pa.string())])


def write_block(folder: str, doc_ids: list, places: list[np.ndarray], words: list[str | None]) -> int:
    """One file of the shared folder, under a number that is returned: documents, the places of their matches in the list
    of words, and the symbols of the words where they are known."""
    number = uuid.uuid4().int >> 65
    block = pa.record_batch({
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "sizes": pa.array([[len(p) for p in places]], pa.list_(pa.int64())),
        "places": pa.array([np.concatenate(places).tobytes()], pa.large_binary()), "words": pa.array([words], pa.list_(pa.string())),
    })
    system, path = common.open_folder(folder)
    temporary = common.attempt_name(f"{path}/{number}.arrow")
    with system.open_output_stream(temporary) as out, pa.ipc.new_file(out, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        file.write(block)
    common.finish(system, temporary, f"{path}/{number}.arrow")
    return number


def encode(df: DataFrame, id_col: str, text_col: str, rank_file: str, pattern: str, digest: bool = False) -> DataFrame:
    """One row a row: doc_id, n_tokens, and either ``ids`` (16-bit little-endian) or the two digests.

    Nulls: a null text is empty and has no tokens; a null id is kept. Rows that repeat an id each have theirs. Texts are
    whole, of any length; words longer than LONG_WORD bytes are merged with a heap and do not go to the fold. An empty
    table gives an empty result; other columns are ignored.
    """
    folder = common.shared_folder(df.sparkSession, "token-blocks")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = Vocabulary.of(rank_file), regex.compile(pattern)
        known: dict[str, int] = {}
        doc_ids, places, chars = [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            """The words to fold, and an empty one by which a block without any comes back."""
            done = [vocabulary.done(w) for w in known]
            at = [-1] + [i for i, d in enumerate(done) if d is None]
            words = [""] + [symbols(w.encode("utf-8", "surrogatepass"), vocabulary.single) for w, d in zip(known, done, strict=True) if d is None]
            number = write_block(folder, doc_ids, places, done)
            for i in range(0, len(at), 50_000):
                n = len(at[i : i + 50_000])
                yield pa.record_batch([pa.array([number] * n, pa.int64()), pa.array(at[i : i + n], pa.int32()), pa.array(words[i : i + n])], schema=WORDS)

        for batch in common.batches_of(batches, "text", 4_000_000):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split.findall(text or "")
                for word in set(found).difference(known):
                    known[word] = len(known)
                doc_ids.append(doc_id)
                places.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield from block()
                    known, doc_ids, places, chars = {}, [], [], 0
        if doc_ids:
            yield from block()

    def deal(key: tuple, found: pa.Table) -> pa.Table:
        vocabulary = Vocabulary.of(rank_file)
        with pa.ipc.open_file(common.input_file(f"{folder}/{key[0].as_py()}.arrow")) as file:
            doc_ids, sizes, places, words = (c[0] for c in file.get_batch(0).columns)
        words = words.as_py()
        for at, word in zip(found.column("at").to_pylist(), found.column("word").to_pylist(), strict=True):
            if at >= 0:
                words[at] = word
        sizes_of = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16) - np.uint16(1)
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes_of)])), pa.array(flat))
        places = np.frombuffer(places.as_buffer(), np.int32)
        ids = pc.take(table, pa.array(places)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes_of[places])])
        edges = ends[np.concatenate([[0], np.cumsum(np.array(sizes.as_py(), np.int64))])]
        parts = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns = [doc_ids.values, pa.array(np.diff(edges))]
        if digest:
            both = [digests(p, vocabulary) for p in parts]
            columns += [pa.array([x for x, _ in both], pa.string()), pa.array([y for _, y in both], pa.string())]
        else:
            columns.append(pa.array([p.astype("<u2").tobytes() for p in parts], pa.binary()))
        return pa.table(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids"]
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = common.stored(rows.mapInArrow(number, "block long, at int, word string"), "block-words")
    # As many tasks as read the texts: the words are few bytes and much work.
    tasks = max(1, rows.rdd.getNumPartitions())
    each = words.repartition(tasks, "word").groupBy("word").agg(F.collect_list(F.struct("block", "at")).alias("uses"))
    merged = each.select("uses", bound(rank_table(read_ranks(rank_file)), lambda table: fold_merges(table, F.col("word"))).alias("word"))
    back = merged.select("word", F.explode("uses").alias("use")).select("use.block", "use.at", "word")
    return back.repartition(4 * tasks, "block").groupBy("block").applyInArrow(deal, out)
