import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import archives, jaccard, mixing, repeats, topk


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """Brute force: links of each row and the least id of its group; rows by place."""
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(rows[i][0], min((x for x in groups[find(i)] if x is not None), default=None), len(groups[find(i)]), links[i]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=str)


def test_jaccard_as_brute_force(docs, rows, none):
    got = [(r.doc_id, r.class_id, r.class_size, r.n_links) for r in jaccard.join(docs, "doc_id", "text").collect()]
    assert order(got) == order(classes([(i, t) for i, t, *_ in rows]))
    assert jaccard.join(none, "doc_id", "text").collect() == [] and jaccard.keep_one(none, "doc_id", "text").collect() == []


def test_large_groups_are_split_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, "a hot line that all of them share " + " ".join(f"u{i}v{j}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.class_size, r.n_links) for r in jaccard.join(df, "doc_id", "text").collect()]
    assert order(got) == order(classes(rows))


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert set(got.values()) == {1}
    found = classes([(i, t) for i, t, *_ in rows])
    want = {(i, t) for (i, t, *_), (_, c, _, _) in zip(rows, found, strict=True) if c == i or c is None}
    assert set(got) == want


def test_chances():
    assert jaccard.runs_for(1 - 1e-7, 0.8) == 3 and jaccard.runs_for(0.5, 0.8) == 1


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_repeats_as_brute_force(docs, rows, none, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    texts = {(i, t) for i, t, *_ in rows}
    holders = defaultdict(set)
    words = {k: repeats.common.words_only(k[1] or "") for k in texts}
    for k, w in words.items():
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(k)
    want = []
    for k, w in words.items():
        spans = []
        for i in range(len(w) - 49):
            if len(holders[tuple(w[i : i + 50])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        if spans:
            want.append((k[0], tuple(map(tuple, spans)), sum(b - a for a, b in spans)))
    got = [(r.doc_id, tuple(map(tuple, r.spans)), r.n_words) for r in repeats.find(docs, "doc_id", "text").collect()]
    assert order(got) == order(want) and len(want) > 10
    assert repeats.find(none, "doc_id", "text").collect() == []


def test_repeats_in_large_groups_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(f"e{rng.randrange(10**9)}" if rng.random() < 0.05 else w for w in base)) for i in range(400)]
    texts = dict(rows)
    holders = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    want = {}
    for i, t in texts.items():
        w = t.split()
        marked = {k + j for k in range(len(w) - 49) if len(holders[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        if marked:
            want[i] = marked
    got = {r.doc_id: {j for a, b in r.spans for j in range(a, b)} for r in repeats.find(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == want and len(want) > 200


def test_topk_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "SHARD", 2)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, -0.25, 0.0, 1.0, 0.125]) for i in range(150)]  # one vector many times
    rows += [(600, None), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (602, [float("nan")] * 6), (603, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (604, []), (None, [1.0] * 6)]
    rows += [(700 + 10 * i, [float(i), 1.0]) for i in range(3)] + [(5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    sound = {}
    for i, v in df.select("vec_id", "embedding").collect():
        if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v):
            sound.setdefault(i, []).append([int((256 * x) // 1) for x in v])
    want = []
    for q, vs in sound.items():
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vs[0], c, strict=True)), i) for i, cs in sound.items() for c in cs if i != q and len(c) == len(vs[0]))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    got = [tuple(r) for r in topk.search(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("rate", [0.3, 2.0, 31.0, 100.0])
def test_poisson_counts(spark, rate):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("xx").alias("text"))
    counts = Counter(r.doc_id for r in mixing.mix(df, "doc_id", "source", "text", {"a": 1.0}, other=0.0, size=rate).collect())
    values = [counts[i] for i in range(n)]
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values) / n
    assert abs(mean - rate) < 5 * (rate / n) ** 0.5 and abs(spread / rate - 1) < 0.2


def test_mix_bears_anything(docs, none, rows):
    weights = {None: 0.2, "s1": 0.3, "absent": 0.1, "s2": 0.0}
    mixed = mixing.mix(docs, "doc_id", "source", "text", weights, other=0.4, size=3.0)
    assert set(docs.columns) <= set(mixed.columns)
    first = order(map(tuple, mixed.select("doc_id", "text", "__copy").collect()))
    assert first == order(map(tuple, mixing.mix(docs.repartition(7), "doc_id", "source", "text", weights, other=0.4, size=3.0).select("doc_id", "text", "__copy").collect()))
    assert not {r.source for r in mixed.select("source").collect()} & {"s2"}
    assert len(set(first)) + first.count(first[0]) - 1 <= len(first)  # rows that repeat draw the same copies
    assert mixing.mix(none, "doc_id", "source", "text", weights, other=0.4).collect() == []


def test_archives_round_trip(spark, none):
    long, small = "p" * 150 + "é", "tiny"
    pages = [(3, "http://a/ b\n", long), (1, None, long), (2, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (1, "u", long), (8, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(4)
    arc = archives.write_arc(df, "page_id", "url", "html")
    assert {r.file_no % 2 for r in arc.collect()} == {0, 1}  # both versions
    got = archives.read_back(archives.convert(arc)).collect()
    assert len(got) == len(pages) and len({r.record_id for r in got}) == len(pages)
    import hashlib

    for r in got:
        payloads = [(h or "").encode() for i, _, h in pages if i == r.page_id]
        assert any((r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest()) for p in payloads)
        assert r.warc_date == "2024-01-01T00:00:00Z"
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds[1, "response", None] == 1 and kinds[1, "revisit", 1] == 1 and kinds[3, "revisit", 1] == 1 and kinds[None, "revisit", 1] == 1
    assert kinds[2, "response", None] == kinds[4, "response", None] == kinds[5, "response", None] == kinds[6, "response", None] == 1
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.read_back(archives.convert(archives.write_arc(nothing, "page_id", "url", "html"))).collect() == []


def test_bad_archives_are_refused():
    import io

    whole = archives.arc_opening("a", "1") + archives.arc_record("1", "a", 0, "http://x", b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert [r.block[-4:] for r in archives.read_arc(io.BytesIO(whole))] == [b"body"]
    for bad in (whole[:-9], whole[5:], whole.replace(b"URL IP", b"URI IP")):
        with pytest.raises(ValueError):
            list(archives.read_arc(io.BytesIO(bad)))
