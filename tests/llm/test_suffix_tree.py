"""Scores of the suffix tree against a direct reckoning over dictionaries, and on held-out texts."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import suffix_tree
from strandline.llm.queries import QUERIES

END = "\n"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [END]


def reckoned(rows, depth, least, back, gain):
    """(n_tokens, n_known, base, score) of each row of (text, learns)."""
    words = [tokens(t) for t, _ in rows]
    learned = [w for w, (_, yes) in zip(words, rows) if yes]
    one = collections.Counter(x for w in learned for x in w)
    total, distinct = sum(one.values()), len(one)
    after = collections.defaultdict(collections.Counter)
    for w in learned:
        for p in range(1, len(w)):
            for k in range(1, min(depth, p) + 1):
                after[tuple(w[p - k : p])][w[p]] += 1

    def root(x):
        return (one[x] + 0.1) / (total + 0.1 * (distinct + 1))

    def mixed(x, context, kept=None):
        p = root(x)
        for k in range(1, len(context) + 1):
            s = context[-k:]
            n = sum(after[s].values()) if s in after else 0
            if n >= least and (kept is None or s in kept):
                b = back * len(after[s])
                p = (after[s][x] + b * p) / (n + b)
        return p

    kept = set()
    for s, found in after.items():
        n = sum(found.values())
        if n >= max(2, least):
            won = 0.0
            for x, c in found.items():
                q, b = mixed(x, s[1:]), back * (len(found) - (c == 1))
                won += c * (math.log10((c - 1 + b * q) / (n - 1 + b)) - math.log10(q))
            if won >= gain:
                kept.add(s)
    out = []
    for w in words:
        score = sum(math.log10(mixed(x, tuple(w[max(0, p - depth) : p]), kept)) for p, x in enumerate(w))
        out.append((len(w), sum(one[x] > 0 for x in w), sum(math.log10(root(x)) for x in w), score))
    return out, kept, total


@pytest.mark.parametrize("depth, least", [(3, 3), (2, 1)])
def test_scores_equal_direct_reckoning(spark, docs, rows, monkeypatch, depth, least):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_tree, "WORDS", 300)
    monkeypatch.setattr(suffix_tree, "GRAMS", 2000)
    df = docs.select("*", F.lit(1).alias("id"), F.lit("x").alias("words"), F.lit(2).alias("part"))
    learns = F.col("doc_id") % 4 != 0
    got = suffix_tree.score(df, "doc_id", "text", learns, depth=depth, least=least, gain=0.5).collect()
    want, kept, total = reckoned([(r[1], r[0] is not None and r[0] % 4 != 0) for r in rows], depth, least, 1.0, 0.5)
    assert kept and {r["train_tokens"] for r in got} == {total}
    line = lambda i, n, k, b, s: (str(i), n, k, round(b, 5), round(s, 5))
    assert sorted(line(r["id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got) == sorted(
        line(r[0], *w) for r, w in zip(rows, want, strict=True)
    )
    assert sum(r["n_in_context"] for r in got) > 0


def test_known_and_unseen_words_after_a_kept_context(spark):
    words = "abcde"
    rows = [(0, "a b a b a c a b d e a b " * 9, True)] + [(1 + i, f"a {x}", False) for i, x in enumerate([*words, "unseen", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, learns boolean")
    got = {r["id"]: r for r in suffix_tree.score(df, "doc_id", "text", F.col("learns"), depth=1).collect()}
    want, kept, _ = reckoned([(t, y) for _, t, y in rows], 1, suffix_tree.LEAST, suffix_tree.BACK, suffix_tree.GAIN)
    assert ("a",) in kept
    assert all(abs(got[i]["score"] - want[i][3]) < 1e-9 for i in got)


def test_nothing_to_learn_and_nothing_at_all(spark, none):
    assert suffix_tree.score(none, "doc_id", "text", F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, None), (2, "A b")], "doc_id long, text string")
    got = {r["id"]: r for r in suffix_tree.score(df, "doc_id", "text", F.lit(None).cast("boolean")).collect()}
    assert (got[1]["n_tokens"], got[2]["n_tokens"], got[2]["n_known"], got[2]["train_tokens"], got[2]["score"]) == (1, 3, 0, 0, 0.0)


def test_held_out_texts_gain_from_contexts(spark, sf_dir):
    got = QUERIES["op12_lm_scores"](spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sums = {r["held_out"]: r for r in got.groupBy("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).collect()}
    assert sums[True]["s"] > sums[True]["b"] and sums[False]["n"] == got.first()["train_tokens"]
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {r["doc_id"] for r in got.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0}
