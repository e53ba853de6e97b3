"""Hard negatives and whitening against brute force, with nulls, ties, repeats, ragged and very large vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import negatives, vectors, whitening
from strandline.llm.queries import QUERIES


def whole(v, scale):
    return None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(scale * x)) for x in v]


def mined(rows, asks, scale=256, k=5, m=3):
    sound = [(i, lab, whole(v, scale)) for i, lab, v in rows if i is not None and lab is not None and whole(v, scale) is not None]
    out = []
    for a, lab, v in [r for r in sound if asks(r[0])]:
        scored = [(sum(p * q for p, q in zip(v, w)), i, other) for i, other, w in sound if i != a and len(w) == len(v)]
        best = sorted([(-s, i) for s, i, other in scored if other == lab])[:k]
        for s, i in best:
            fit = sorted([(-t, j) for t, j, other in scored if other != lab and 50 * -s <= 100 * t <= 95 * -s])[:m]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, id string, v int, asks int, no int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def answers(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("scale", [256, 2**18])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "FILE", 1)
    rnd = random.Random(3)
    base = [rnd.gauss(0, 0.3) for _ in range(8)]
    rows = []
    for i in range(240):
        v = [round(b + rnd.gauss(0, 0.25), 1) for b in base]  # coarse, so that scores tie
        rows.append((i, 0 if i % 3 else rnd.randrange(6), v))
    rows[5] = (5, None, rows[5][2])
    rows[6] = (6, 1, None)
    rows[10] = (10, 1, rows[10][2][:7] + [None])
    rows[11] = (11, 1, rows[11][2][:7] + [float("nan")])
    rows[12] = (12, 1, rows[12][2][:7] + [float("inf")])
    rows[13] = (13, 1, [])
    rows[14] = (None, 1, rows[14][2])
    rows += [(1000 + i, i % 2, [1.0, 0.5]) for i in range(7)] + [(-20, 0, rows[0][2]), (7, 0, rows[7][2])]
    asks = lambda i: i % 10 == 0
    found = negatives.mine(table_of(spark, rows).repartition(5), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0, scale=scale)
    want = mined(rows, asks, scale)
    assert len(want) > 50 and answers(found) == want


def test_hard_negatives_of_nothing(spark):
    empty = negatives.mine(table_of(spark, []), "vec_id", "embedding", F.col("label"), F.lit(True))
    assert empty.count() == 0
    alone = negatives.mine(table_of(spark, [(0, 1, [1.0]), (1, 2, [1.0])]), "vec_id", "embedding", F.col("label"), F.lit(True))
    assert alone.count() == 0


@pytest.mark.parametrize("largest", [3, 200, 2**20, 2**28])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(1)
    c, a = rng.integers(-largest, largest, (37, 19)), rng.integers(-largest, largest // 2 + 1, (5, 19))
    packed = negatives.Packed(c, a)
    assert packed.exact == (largest < 2**20) and packed.fields >= 2
    assert (packed.scores(a) == a @ c.T).all()
    with pytest.raises(OverflowError):
        negatives.Packed(np.full((2, 4), 2**40), np.full((1, 4), 2**40)).scores(np.full((1, 4), 2**40))


def test_keys_tell_vectors_apart():
    x = np.array([[1, 2], [1, 2], [1, 300], [-129, 2], [2**40, 1], [0, 0]])
    keys = vectors.keys_of(x)
    assert len(set(keys.to_pylist())) == 5
    back = np.zeros_like(x)
    for rows, m in vectors.matrices(keys):
        back[rows] = m
    assert (back == x).all()


def whitened(rows, weights="one", scale=64):
    sound = [(i, np.array(whole(v, scale), object) + 1_000_000) for i, _, v in rows if whole(v, scale) is not None]
    x = [tuple(v) for _, v in sound]
    fit = sorted(set(x)) if weights == "one" else x
    n, s = len(fit), np.array(fit, object).sum(axis=0)
    f = np.array([[float(e) for e in (n * np.array(v, object) - s)] for v in fit]) / n
    cov = f.T @ f / n
    e, u = np.linalg.eigh(cov)
    out = {}
    for i, v in sound:
        d = n * v - s
        out.setdefault(i, []).append((n, int((d * d).sum()), np.abs((d / n).astype(float) @ u[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)))))
    return out, e[::-1] / np.trace(cov)


@pytest.mark.parametrize("weights", ["one", "count"])
@pytest.mark.parametrize("scale", [64, 2**40])
def test_whitening_equals_brute_force(spark, monkeypatch, weights, scale):
    monkeypatch.setattr(whitening, "BATCH", 16)
    monkeypatch.setattr(whitening, "HOT", 8)
    rng = np.random.default_rng(5)
    rows = [(i, 0, [float(x) for x in rng.normal(0, [0.1, 0.5, 1, 2, 3]) + [5, 0, 0, -3, 0]]) for i in range(150)]
    rows += [(i, 0, rows[3][2]) for i in range(200, 280)] + [(None, 1, rows[4][2]), (7, 1, rows[8][2])]
    rows += [(300, 0, None), (301, 0, []), (302, 0, [None, 1.0, 1.0, 1.0, 1.0]), (303, 0, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    got = whitening.whiten(table_of(spark, rows).repartition(4), "vec_id", "embedding", scale=scale, weights=weights, components=3).collect()
    want, explained = whitened(rows, weights, scale)
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, v in want.items() for _ in v)
    for r in got:
        assert r["identity_error"] < 1e-9 and np.allclose(r["explained"], explained[:3], rtol=1e-9)
        assert any(r["n"] == n and int(r["deviation"]) == d and np.allclose(np.abs(r["whitened"]), w[:3], atol=1e-8) for n, d, w in want[r["id"]])


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(table_of(spark, []), "vec_id", "embedding").count() == 0
    same = whitening.whiten(table_of(spark, [(i, 0, [1.0, 2.0]) for i in range(3)]), "vec_id", "embedding").collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in same] == [(1, 0, [])] * 3
    # Each length of vector is a fit of its own; a constant dimension gives no component.
    rows = [(i, 0, [float(i), 1.0]) for i in range(4)] + [(i, 0, [float(i % 3), float(i), float(i * i)]) for i in range(10, 20)]
    got = {r["id"]: r for r in whitening.whiten(table_of(spark, rows), "vec_id", "embedding").collect()}
    assert {len(got[i]["whitened"]) for i in range(4)} == {1} and {len(got[i]["whitened"]) for i in range(10, 20)} == {3}
    assert got[0]["n"] == 4 and got[10]["n"] == 10


def test_queries_run_on_whole_tables(spark, sf_dir):
    found = QUERIES["op13_whitening"](spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.groupBy("vec_id").count().where("count <> 16").count() == 0
    assert QUERIES["op11_hard_negatives"](spark, sf_dir).count() > 0
