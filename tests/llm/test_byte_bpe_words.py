"""Words of the byte BPE are folded once a table, and come back to every block that has them."""

import numpy as np
import public_tokenizers

from strandline.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_words_meet_before_they_are_folded(spark):
    texts = ["zyxwvqzyx  qqqzzx", None, "", "the", "zyxwvqzyx the", "qqqzzx " + "q" * 400, "￾￿ 中\U0001f600x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(5)
    found = bpe.encode(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    assert "hashpartitioning(word" in found._jdf.queryExecution().executedPlan().toString()
    ranks, split, want = bpe.read_ranks(RANKS), bpe.regex.compile(public_tokenizers.PATTERN), []
    for i, t in enumerate(texts * 3):
        words = [w.encode() for w in split.findall(t or "")]
        want.append((i, [x for w in words for x in ([ranks[w]] if w in ranks else bpe.merge_long(w, ranks))]))
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in found.collect()) == want
