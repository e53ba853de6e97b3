"""Token ids as Arrow stream files of fixed-size lists.

A file is a run of record batches of one schema: ``ids`` (fixed_size_list of unsigned integers) and ``mask``
(fixed_size_list of bool, false only on the padding of a file's last sequence). All batches but the last have the same
number of rows, so sequence i of a mapped file is a view at a place that follows from i: nothing is copied or decoded.
Beside each file lies the index of its documents: id and number of tokens, in the order of the file.

Rows are dealt by ranges of the id and sorted in each range, so the files in their order hold the documents in
ascending id. Each task writes its own file under a temporary name and renames it; a task that runs twice writes the
same bytes. What reaches the driver is nothing; the manifest has one row a file.

Nulls: a null text is empty and yields the end id alone; rows without an id come first. Repeated rows and equal ids are
kept, each with its own tokens. An empty table gives no files. Other columns of the table are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common

BATCH_TOKENS = 1 << 19  # tokens of one record batch
CACHED_WORDS = 400_000  # words whose ids a Python worker keeps; beyond that, those that came again

MANIFEST = "file_no long, path string, index_path string, n_docs long, n_tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def letters_alone(word: str) -> bool:
    return word.isalpha() and unicodedata.is_normalized("NFC", word) and word.lower().isalpha()


class WordEncoder:
    """Ids of texts by the tokenizers library, one call for each distinct word of the worker.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words (runs without
    ASCII white space) one after the other. Words of ASCII are lowered first, as the tokenizer does itself, and a
    closing full stop or comma after a letter, which is a token boundary, is encoded on its own. The tokenizer's special
    strings are its ids wherever they stand in a text, exactly as written: they are cut out as words of their own first.
    """

    held: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        return cls.held.setdefault(path, cls(path)) if path not in cls.held else cls.held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closes[number] = token.endswith("</w>")
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.offsets = [np.zeros(1, np.int64)]
        self.ids: list[np.ndarray] = []
        self.total = 0
        self.table: pa.LargeListArray | None = None
        self.again: set[bytes] = set()

    def shrink(self) -> None:
        """Make room: the words that came again since they were learnt stay, half a cache of them at most."""
        words = list(self.again)[-CACHED_WORDS // 2 :]
        kept = pc.take(self.table, pa.array([self.number[w] for w in words], pa.int64()))
        self.number = {w: i for i, w in enumerate(words)}
        self.offsets, self.ids = [kept.offsets.to_numpy().astype(np.int64)], [kept.values.to_numpy()]
        self.total, self.table, self.again = len(self.ids[0]), kept, set()

    def learn(self, words: list[bytes]) -> None:
        tails = {b".": [], b",": []}
        stems, parts = {}, []
        for word in words:
            low = word.lower() if word.isascii() else word
            if b"|" in low and low != word and any(t.encode() in low for t in self.special):
                low = word  # a special string only once lowered is ordinary text
            tail = low[-1:] if low[-1:] in tails and low[-2:-1].isalpha() and low.isascii() else b""
            stem = low[: len(low) - len(tail)]
            parts.append((stems.setdefault(stem, len(stems)), tail))
        found = self.library([k.decode("utf-8", "surrogatepass") for k in chain(tails, stems)])
        tails = dict(zip(tails, found, strict=False))
        lists = [found[2 + stem] + tails[tail] if tail else found[2 + stem] for stem, tail in parts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids.append(np.fromiter(chain.from_iterable(lists), self.dtype, int(sizes.sum())))
        self.offsets.append(self.total + np.cumsum(sizes))
        self.total += int(sizes.sum())
        for word in words:
            self.number[word] = len(self.number)
        self.offsets, self.ids = [np.concatenate(self.offsets)], [np.concatenate(self.ids)]
        self.table = pa.LargeListArray.from_arrays(pa.array(self.offsets[0]), pa.array(self.ids[0]))

    def library(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words of letters alone are one pre-token each, whose last token is marked as such; they are
        encoded by the sentence and cut at the marks. If the marks do not count up, or for other words, one by one."""
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha() or letters_alone(w)]
        held = [words[i] for i in plain]
        sentences = [" ".join(held[at : at + 64]) for at in range(0, len(held), 64)]
        ids = list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(sentences, add_special_tokens=False)))
        ends = (np.flatnonzero(self.closes[np.array(ids, np.int64)]) + 1).tolist()
        out: list[list[int] | None] = [None] * len(words)
        if len(ends) == len(plain):
            for i, start, end in zip(plain, [0, *ends], ends, strict=False):
                out[i] = ids[start:end]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has. Arrow splits the texts and numbers their words, so Python sees
        each distinct word of the texts once."""
        for token in self.special:
            if pc.any(pc.match_substring(texts, token)).as_py():
                texts = pc.replace_substring(texts, token, f" {token} ")
        split = pc.ascii_split_whitespace(texts)
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        pieces = split.flatten()
        full = pc.greater(pc.binary_length(pieces), 0)
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        coded = pieces.filter(full).cast(pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > CACHED_WORDS:
            self.shrink()
        number = self.number
        known = [number.get(w) for w in words]
        new = [w for w, n in zip(words, known, strict=True) if n is None]
        self.again.update(w for w, n in zip(words, known, strict=True) if n is not None)
        if new:
            self.learn(new)
            known = [number[w] for w in words]
        if not words:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        places = np.array(known, np.int64)[coded.indices.to_numpy()]
        ids = pc.take(self.table, pa.array(places)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(self.offsets[0])[places])])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[edges])


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with ``end_id`` after each document."""
    return np.insert(ids, np.cumsum(sizes), end_id).astype(ids.dtype, copy=False)


class SequenceWriter:
    """Cuts a stream of ids into sequences of one length and writes them as equal record batches."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.rows, self.dtype = length, max(1, BATCH_TOKENS // length), dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def batch(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.length
        mask = np.concatenate([np.ones(len(ids), bool), np.zeros(pad, bool)])
        ids = np.concatenate([ids, np.zeros(pad, ids.dtype)])
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids, pa.from_numpy_dtype(self.dtype)), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ], schema=self.schema))

    def write(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= (size := self.rows * self.length):
            ids = np.concatenate(self.waiting)
            whole = len(ids) // size * size
            for at in range(0, whole, size):
                self.batch(ids[at : at + size])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self.batch(np.concatenate(self.waiting))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file, as views of the mapped bytes."""

    def __init__(self, source: pa.NativeFile | str):
        self.source = common.input_file(source) if isinstance(source, str) else source
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches[-1:]) + self.rows * max(0, len(self.batches) - 1)

    def values(self, batch: int, column: str) -> pa.Array:
        return self.batches[batch].column(column).flatten()

    def sequence(self, i: int) -> np.ndarray:
        batch, row = divmod(i, self.rows)
        return self.values(batch, "ids")[row * self.length : (row + 1) * self.length].to_numpy()

    def mask(self, i: int) -> pa.Array:
        batch, row = divmod(i, self.rows)
        return self.values(batch, "mask")[row * self.length : (row + 1) * self.length]

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` to before ``end`` of the file's stream; a view if they lie in one batch."""
        size = self.rows * self.length
        if start >= end:
            return np.zeros(0, np.uint32)
        parts = [
            self.values(b, "ids").to_numpy()[max(start - b * size, 0) : end - b * size]
            for b in range(start // size, (end - 1) // size + 1)
        ]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_files(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Write the tokens of all rows; the manifest (one row a file, in the order of the ids) comes back."""
    folder = common.shared_folder(df.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        system, base = common.open_folder(folder)
        path, index = f"{base}/{number:06d}.arrows", f"{base}/{number:06d}.index"
        draft, index_draft = common.attempt_name(path), common.attempt_name(index)
        docs = tokens = 0
        with system.open_output_stream(draft) as sink, system.open_output_stream(index_draft) as beside:
            out, lines = SequenceWriter(sink, length, encoder.dtype), pa.ipc.new_stream(beside, INDEX)
            for batch in common.batches_of(batches, "text", 4_000_000):
                ids, sizes = encoder.encode(batch.column(1))
                out.write(with_ends(ids, sizes, end_id))
                lines.write_batch(pa.record_batch([batch.column(0), pa.array(sizes + 1)], schema=INDEX))
                docs, tokens = docs + batch.num_rows, tokens + len(ids) + batch.num_rows
            out.close()
            lines.close()
        if docs:
            common.finish(system, draft, path)
            common.finish(system, index_draft, index)
            row = [number, f"{folder}/{number:06d}.arrows", f"{folder}/{number:06d}.index", docs, tokens]
            yield pa.RecordBatch.from_pylist([dict(zip(("file_no", "path", "index_path", "n_docs", "n_tokens"), row, strict=True))])
        else:
            system.delete_file(draft)
            system.delete_file(index_draft)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return common.stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document read back from the files: doc_id, start (tokens of all documents before it), n_tokens and the
    CRC-32 of its ids as little-endian 32-bit integers."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            tokens, at, start = SequenceFile(row["path"]), 0, row["start"]
            for docs in pa.ipc.open_stream(common.input_file(row["index_path"])):
                sizes, crcs = docs.column("n_tokens").to_pylist(), []
                for size in sizes:
                    crcs.append(zlib.crc32(tokens.span(at, at + size).astype("<u4")))
                    at += size
                starts = start + np.cumsum([0, *sizes])
                start = int(starts[-1])
                yield pa.record_batch(
                    [docs.column("doc_id"), pa.array(starts[:-1]), docs.column("n_tokens"), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return common.dealt(files, "file_no").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
