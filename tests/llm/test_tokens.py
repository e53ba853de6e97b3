import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe, token_files

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)  # the library's defaults


@pytest.fixture(scope="module")
def manifest(docs):
    return token_files.write_files(docs, "doc_id", "text", WORDS, end_id=2, length=64)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_files_hold_all_ids_in_order(manifest, rows, tokenizer):
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in by_id(rows)]
    want = sorted((-1 if i is None else i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for i, t, *_ in rows
                  for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]


def test_special_strings_and_white_space(tokenizer):
    texts = [
        "a <|endoftext|> b", "word<|endoftext|>word.<|startoftext|>", "<|ENDOFTEXT|> <|EndOfText|>.", "<|endoftext|><|endoftext|>", "<|endof text|>", "\x1c\x85\u2028 a\u00a0b",
        "", " \t\n", "A,B. C., d.e, Ünï. <|endoftext", "Don't WE'LL 3rd x2,", "e\u0301 \u0301e I\u0307",
    ]
    ids, sizes = token_files.WordEncoder(WORDS).encode(pa.array(texts))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_random_access_is_a_view(manifest):
    for row in manifest.collect():
        held = token_files.SequenceFile(row.path)
        assert len(held) == -(-row.n_tokens // 64)
        first = held.sequence(0)
        assert len(first) == 64 and not first.flags.owndata
        stream = np.concatenate([held.sequence(i) for i in range(len(held))])
        masks = np.concatenate([held.mask(i).to_numpy(zero_copy_only=False) for i in range(len(held))])
        assert masks.sum() == row.n_tokens and masks[: row.n_tokens].all()
        assert (held.span(3, row.n_tokens) == stream[3 : row.n_tokens]).all()


def test_many_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_TOKENS", 40)
    with open(tmp_path / "f", "wb") as sink:
        out = token_files.SequenceWriter(sink, 8, np.uint16)
        for at in range(0, 333, 11):
            out.write(np.arange(at, min(at + 11, 333)).astype(np.uint16))
        out.close()
    held = token_files.SequenceFile(f"file://{tmp_path}/f")
    assert len(held) == 42 and held.span(0, 333).tolist() == list(range(333)) and held.span(37, 45).tolist() == list(range(37, 45))


def test_cache_of_words_does_not_change_ids(rows, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 50)
    encoder = token_files.WordEncoder(WORDS)
    odd = ["ÀÉÎ İstanbul ΣΑΣ ẞtraße", "it's they'll x's 'sa", "a.b, c., d.,. 12.5, éa.", "<|endoftext|>.", "ﬁne 漢字かな१२ a b\x1cc"]
    for part in (odd, [t or "" for _, t, *_ in rows[:20]], odd, [t or "" for _, t, *_ in rows]):
        ids, sizes = encoder.encode(part)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_no_rows(none):
    assert token_files.read_documents(token_files.write_files(none, "doc_id", "text", WORDS, 2)).collect() == []
    assert bpe.encode(none, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_as_the_library(docs, rows):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()
    vocabulary = bpe.Vocabulary.of(RANKS)
    ids = [np.frombuffer(r.ids, "<u2") for r in got]
    want = sorted((-1 if i is None else i, library.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, x.tolist()) for r, x in zip(got, ids, strict=True)) == want
    assert all(r.n_tokens == len(x) for r, x in zip(got, ids, strict=True))
    assert sorted(bpe.decode(x, vocabulary).decode() for x in ids) == sorted(t or "" for _, t, *_ in rows)


def test_blocks_do_not_matter(docs, monkeypatch):
    def run():
        return sorted(map(tuple, bpe.encode(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN, digest=True).collect()), key=str)

    whole = run()
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    monkeypatch.setattr(bpe, "LONG_WORD", 6)
    assert run() == whole


@pytest.mark.parametrize("word", ["a" * 1000, "thethe" * 99, "ñandú漢字" * 40, "0123456789" * 30])
def test_long_words(word):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert bpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)
