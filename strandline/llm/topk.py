"""Exact top-k search by inner product over a pivot-distance index.

One more coordinate gives every candidate the same norm, so the highest inner product with a query is the least distance
from it. The index keys each vector by its nearest pivot and its distance from that pivot, sorts by both over the whole
cluster, and cuts the order into annuli of a bounded number of vectors. A query's distance from a pivot and an
annulus's inner and outer radius bound the distance of all its vectors (triangle inequality). A task holds one shard of
annuli and one group of queries: it expands the annuli by their bounds and stops a query where the bound falls below
its k-th score so far, which begins at the k-th score over the pivots. Scores are integers and are compared exactly;
bounds carry a margin for rounding.

The pivots are a sample of bounded size, a documented parameter; every vector is indexed. Queries and candidates meet
in blocks of bounded size, and each task returns k rows a query. Many equal vectors fill annuli of their own and
are spread like any others, since the order's last key is the id.

Rows without an id, and vectors that are null, empty, or hold a null or a non-finite component take no part. Queries
meet candidates of their own length. A row with a query's id is the query's own. Ties go to the smaller id; rows that
repeat an id are kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common

PIVOTS = 64  # vectors sampled by the hash of their id
ANNULUS = 512  # vectors of one annulus at most
SHARD = 8  # annuli that a task holds
GROUP = 1024  # queries that a task holds
SLACK = 1e-9  # relative, for distances in doubles


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def matrix(lists: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    values = pa.chunked_array([lists]) if isinstance(lists, pa.Array) else lists
    return values.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where these are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def index(vectors: DataFrame, pivots: dict[int, np.ndarray], top: dict[int, int]) -> DataFrame:
    """Stored annuli: rows (annulus, n_dims, pivot, inner, outer, ids, values) of a table of id and integer vector.
    ``top`` is the largest squared norm of each length of vector."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1)])
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x, p = matrix(rows.column(1), rows.num_rows), pivots[int(size)]
                rest = np.sqrt(np.maximum(0.0, top[int(size)] - (x.astype(float) ** 2).sum(axis=1)))
                rest_p = np.sqrt(np.maximum(0.0, top[int(size)] - (p.astype(float) ** 2).sum(axis=1)))
                # All augmented norms are top, so the squared distance is 2 * (top - product).
                d = np.sqrt(np.maximum(0.0, 2.0 * (top[int(size)] - products(x, p) - np.outer(rest, rest_p))))
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(np.full(len(x), size, np.int64)), pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))],
                    names=["id", "v", "n_dims", "pivot", "distance"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1):
                for at in range(0, len(part), ANNULUS):
                    rows = batch.slice(int(part[at]), len(part[at : at + ANNULUS]))
                    d = rows.column(4).to_numpy()
                    yield pa.RecordBatch.from_pylist([{
                        "annulus": int(rows.column(0)[0].as_py()), "n_dims": int(key[part[at]][0]), "pivot": int(key[part[at]][1]), "inner": float(d.min()),
                        "outer": float(d.max()), "ids": rows.column(0).to_numpy().tobytes(), "values": matrix(rows.column(1), rows.num_rows).tobytes(),
                    }])

    keyed = vectors.select("id", "v").mapInArrow(near, "id long, v array<long>, n_dims long, pivot long, distance double")
    order = ["n_dims", "pivot", "distance", "id"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.stored(ordered.mapInArrow(cut, "annulus long, n_dims long, pivot long, inner double, outer double, ids binary, values binary"), "annuli")


def search(df: DataFrame, id_col: str, vector_col: str, asks: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For each row where ``asks`` holds, its k best of all other rows: query_id, rank, vec_id, score."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), asks.alias("asks"))
    rows = common.stored(rows.where("id is not null and v is not null"), "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    # A row for each length of vector, then the sample: both bounded by parameters of the data model and the index.
    tops = {r["n"]: r["top"] for r in rows.groupBy(F.size("v").alias("n")).agg(F.max(norm).alias("top")).collect()}
    pivots, pivot_ids = {}, {}
    for n in tops:
        sample = rows.where(F.size("v") == n).orderBy(F.xxhash64("id"), "id").select("id", "v").limit(PIVOTS).collect()
        pivots[n] = np.array([r["v"] for r in sample], np.int64)
        pivot_ids[n] = np.array([r["id"] for r in sample], np.int64)
    annuli = index(rows, pivots, tops)
    n_shards = max(1, -(-annuli.count() // SHARD))
    shards = annuli.select(F.pmod(F.xxhash64("annulus"), F.lit(n_shards)).cast("int").alias("shard"), "*")
    queries = rows.where("asks").select("id", "v")
    n_groups = max(1, -(-queries.count() // GROUP))
    left = shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def expand(annuli: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        sizes = np.array([len(v) for v in asked.column("v")], np.int64)
        for n in np.unique(sizes):
            rows = asked.take(pa.array(np.flatnonzero(sizes == n)))
            held = annuli.filter(pa.compute.equal(annuli.column("n_dims"), int(n)))
            if held.num_rows:
                out.append(best_of(held, rows.column("id").to_numpy(), matrix(rows.column("v"), rows.num_rows), pivots[int(n)], pivot_ids[int(n)], tops[int(n)], k))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(expand, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def best_of(annuli: pa.Table, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, pivot_ids: np.ndarray, top: int, k: int) -> pa.Table:
    """The k best of one shard for each query, or fewer where no more can be among its k best of all."""
    seed = products(q, pivots)
    squares = (q.astype(float) ** 2).sum(axis=1)
    # The added coordinate of a query is 0, so the augmented product with a pivot is the plain one.
    to_pivot = np.sqrt(np.maximum(0.0, squares[:, None] + top - 2.0 * seed))
    known = np.where(pivot_ids[None, :] == ids[:, None], np.iinfo(np.int64).min, seed)
    least = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(ids), np.iinfo(np.int64).min)
    inner, outer, near = (annuli.column(c).to_numpy() for c in ("inner", "outer", "pivot"))
    gap = np.maximum(0.0, np.maximum(inner[None, :] - to_pivot[:, near], to_pivot[:, near] - outer[None, :]))
    gap = np.maximum(0.0, gap - SLACK * (to_pivot[:, near] + outer[None, :] + 1.0))
    bound = (squares[:, None] + top - gap**2) / 2.0
    bound += SLACK * (np.abs(bound) + 1.0)
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
    for a in np.argsort(-bound.max(axis=0), kind="stable"):
        live = np.flatnonzero(bound[:, a] >= least)
        if not len(live):
            if bound[:, a].max() < least.min():
                break
            continue
        vec = np.frombuffer(annuli.column("ids")[int(a)].as_py(), np.int64)
        values = np.frombuffer(annuli.column("values")[int(a)].as_py(), np.int64).reshape(len(vec), -1)
        scores = products(q[live], values)
        for row, score in zip(live, scores, strict=True):
            hit = np.flatnonzero((score >= least[row]) & (vec != ids[row]))
            if len(hit):
                s, v = np.concatenate([kept[row][0], score[hit]]), np.concatenate([kept[row][1], vec[hit]])
                first = np.lexsort((v, -s))[:k]
                kept[row] = (s[first], v[first])
                if len(first) == k:
                    least[row] = max(least[row], s[first[-1]])
    sizes = [len(s) for s, _ in kept]
    return pa.table({
        "query_id": np.repeat(ids, sizes), "vec_id": np.concatenate([v for _, v in kept]), "score": np.concatenate([s for s, _ in kept]),
    }, schema=FOUND)
