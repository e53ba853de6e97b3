"""Whitening of vectors by a covariance in which each distinct vector is met once, with its multiplicity as a weight.

Rows become integer vectors and then a binary key, so that equal vectors group without arithmetic. The list of distinct
vectors carries its counts; the fit weighs each by its count or by one. Sums, covariance and the check of the result are
partial matrices a batch (weighted, centred, then multiplied), added entry by entry with a map-side combine. Each
distinct vector is projected once and joined back to its rows by key.

Vectors of each length are fitted apart: sums, covariances and components of all lengths are rows of one table, keyed by
the length, and are decomposed one length a group (a matrix of the vectors' length, a bound of the data model). Batches
of distinct vectors meet their model by a join on length and a small number that deals one length over many tasks.

A key that holds more than 1/``HOT`` of all rows would be one task's work when rows are joined back. There are fewer than
``HOT`` such keys at any size, so these are broadcast with their results; all other rows are joined by key.

Rows whose vector is null, empty, or holds a null, non-finite or too large component (2^52 after scaling) are dropped.
Null and repeated ids are kept like any other. Components whose eigenvalue is at most 1e-12 of the trace have no
direction to speak of and are left out: one distinct vector alone, and constant dimensions, give none. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.vectors import floored, keys_of, matrices

HOT = 1024  # keys with more than 1/HOT of all rows are fewer than HOT
DEALS = 64  # tasks that one length of vector may be dealt over when it meets its model
BATCH = 2048  # distinct vectors to a batch


def keyed(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, key of the integer vector: rows that take part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in floored(batch.column(1), scale):
                yield pa.record_batch([batch.column(0).take(pa.array(at)), keys_of(x)], names=["id", "key"])

    ids = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(rows, f"id {kind}, key binary")


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def batched(distinct: DataFrame) -> DataFrame:
    """Rows (n_dims, deal, keys, counts): distinct vectors of one length, at most ``BATCH`` of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at, x in matrices(batch.column(0)):
                for start in range(0, len(at), BATCH):
                    part = pa.array(at[start : start + BATCH])
                    yield pa.RecordBatch.from_pydict({
                        "n_dims": pa.array([x.shape[1]], pa.int32()), "deal": pa.array([number % DEALS], pa.int32()),
                        "keys": one_list(batch.column(0).take(part)), "counts": one_list(batch.column(1).take(part)),
                    })
                    number += 1

    return distinct.select("key", "n").mapInArrow(rows, "n_dims int, deal int, keys array<binary>, counts array<long>")


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S for each entry, exactly: in longs where these hold it, else in whole numbers of any size."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(abs(s) for s in sums)
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0**62:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def fit_weights(counts: np.ndarray, weights: str) -> np.ndarray:
    return counts if weights == "count" else np.ones_like(counts)


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.Array, np.ndarray, np.ndarray]]:
    """The row's other columns, its keys, its vectors and its counts."""
    for i in range(batch.num_rows):
        row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names) if c not in ("keys", "counts")}
        keys = batch.column(batch.schema.get_field_index("keys"))[i].values
        counts = batch.column(batch.schema.get_field_index("counts"))[i].values.to_numpy()
        (at, x), = matrices(keys)
        yield row, keys.take(pa.array(at)), x, counts[at]


def sums_of(blocks: DataFrame, weights: str) -> DataFrame:
    """A row for each length: the fit's weight ``n`` and the sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, x, counts in parts_of(batch):
                w = fit_weights(counts, weights)
                total = (x.astype(object) * w.astype(object)[:, None]).sum(axis=0) if np.abs(x).max() * float(w.sum()) >= 2**62 else (x * w[:, None]).sum(axis=0)
                yield pa.record_batch([
                    pa.array([row["n_dims"]] * len(total), pa.int32()), pa.array(np.arange(len(total)), pa.int32()),
                    pa.array([int(w.sum())] * len(total), pa.int64()), pa.array([int(t) for t in total], pa.decimal128(38, 0)),
                ], names=["n_dims", "dim", "n", "s"])

    each = blocks.mapInArrow(partial, "n_dims int, dim int, n long, s decimal(38,0)")
    each = each.groupBy("n_dims", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    # A group has as many rows as the vector has dimensions.
    return each.groupBy("n_dims").agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda d: d["s"].cast("string")).alias("sums")
    )


def meet(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """Batches joined to the row of their length; the models are copied to every deal, so no length is one task's."""
    copies = models.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return blocks.join(copies, ["n_dims", "deal"])


def gram(met: DataFrame, weights: str, project) -> DataFrame:
    """A row for each length and line of the matrix: sum over the fit of w * y_i * y_j for y = ``project(row, x)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, x, counts in parts_of(batch):
                y = project(row, x)
                if y.shape[1]:
                    g = (y * fit_weights(counts, weights)[:, None]).T @ y
                    i, j = np.triu_indices(len(g))
                    yield pa.record_batch([pa.array(np.full(len(i), row["n_dims"], np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])],
                                          names=["n_dims", "i", "j", "g"])

    each = met.mapInArrow(partial, "n_dims int, i int, j int, g double")
    return each.groupBy("n_dims", "i", "j").agg(F.sum("g").alias("g"))


def centred(row: dict, x: np.ndarray) -> np.ndarray:
    """x - S/n from the exact whole numbers n * x - S, so that nothing is lost to a large mean."""
    return (scaled_deviation(x, row["n"], [int(s) for s in row["sums"]]) / row["n"]).astype(np.float64)


def projected(row: dict, x: np.ndarray) -> np.ndarray:
    """Centred vectors on the model's components, each over the root of its eigenvalue."""
    u = np.array(row["components"], np.float64).reshape(-1, x.shape[1])
    return centred(row, x) @ u.T / np.sqrt(np.array(row["eigenvalues"]))


def decomposed(grams: DataFrame, sums: DataFrame, components: int) -> DataFrame:
    """A row for each length: n, sums, components (one after the other), eigenvalues, trace."""

    def eigen(key: tuple, table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        v = np.zeros((d, d))
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        v[i, j] = v[j, i] = table.column("g").to_numpy() / table.column("n")[0].as_py()
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")[:components]
        order = order[e[order] > 1e-12 * np.trace(v)]
        return pa.table({
            "n_dims": pa.array([d], pa.int32()), "components": one_list(pa.array(u[:, order].T.ravel())), "eigenvalues": one_list(pa.array(e[order])),
            "trace": pa.array([float(np.trace(v))]),
        })

    each = grams.join(sums.select("n_dims", "n"), "n_dims").groupBy("n_dims").applyInArrow(
        eigen, "n_dims int, components array<double>, eigenvalues array<double>, trace double"
    )
    return each.join(sums, "n_dims")


def identity_error(blocks: DataFrame, models: DataFrame, weights: str) -> DataFrame:
    """One row: the largest absolute entry of the whitened vectors' covariance minus the identity. The mean is taken
    off before multiplying, though it is zero but for rounding."""

    def line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, x, counts in parts_of(batch):
                w = projected(row, x)
                total = (w * fit_weights(counts, weights)[:, None]).sum(axis=0) / row["n"]
                yield pa.record_batch([pa.array(np.full(w.shape[1], row["n_dims"], np.int32)), pa.array(np.arange(w.shape[1], dtype=np.int32)), pa.array(total)], names=["n_dims", "i", "m"])

    met = meet(blocks, models)
    means = met.mapInArrow(line, "n_dims int, i int, m double").groupBy("n_dims", "i").agg(F.sum("m").alias("m"))
    means = means.groupBy("n_dims").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("means"))
    centre = meet(blocks, models.join(means, "n_dims"))
    grams = gram(centre, weights, lambda row, x: projected(row, x) - np.array(row["means"]))
    grams = grams.join(models.select("n_dims", "n"), "n_dims")
    return grams.agg(F.max(F.abs(F.col("g") / F.col("n") - (F.col("i") == F.col("j")).cast("double"))).alias("identity_error"))


def whiten(df: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000, weights: str = "one", components: int = 16) -> DataFrame:
    """For each row that takes part: id, n, deviation (decimal(38,0); null where it has more digits), whitened and
    explained (arrays by component), identity_error. Entries are floor(``scale`` * c) + ``shift``; ``weights`` is "one"
    or "count". The shift moves every entry alike: it cancels in each result and is not added."""
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    rows = common.stored(keyed(df, id_col, vector_col, scale), "vector-keys")
    distinct = common.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    blocks = common.stored(batched(distinct), "vector-batches")
    sums = sums_of(blocks, weights)
    sums = common.stored(sums, "vector-sums")
    models = common.stored(decomposed(gram(meet(blocks, sums), weights, centred), sums, components), "vector-models")
    error = common.stored(identity_error(blocks, models, weights), "identity-error")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, keys, x, _ in parts_of(batch):
                d = squares(scaled_deviation(x, row["n"], [int(s) for s in row["sums"]]))
                w = projected(row, x)
                share = [e / row["trace"] for e in row["eigenvalues"]]
                yield pa.record_batch([
                    keys, pa.array([row["n"]] * len(keys), pa.int64()), pa.array([v if v < 10**38 else None for v in d], pa.decimal128(38, 0)),
                    pa.array(list(w), pa.list_(pa.float64())), pa.array([share] * len(keys), pa.list_(pa.float64())),
                ], names=["key", "n", "deviation", "whitened", "explained"])

    done = meet(blocks, models).mapInArrow(project, "key binary, n long, deviation decimal(38,0), whitened array<double>, explained array<double>")
    done = common.stored(done, "whitened")
    whole = distinct.agg(F.sum("n").alias("whole"))
    hot = distinct.join(whole, F.col("n") * HOT > F.col("whole")).select("key")
    # Fewer than HOT keys, by the condition above.
    held = F.broadcast(done.join(F.broadcast(hot), "key"))
    rest = rows.join(F.broadcast(hot), "key", "left_anti").join(done.join(F.broadcast(hot), "key", "left_anti"), "key")
    found = rows.join(held, "key").unionByName(rest)
    # One row; a left join keeps the rows' columns where there is none.
    return found.crossJoin(F.broadcast(error)).select("id", "n", "deviation", "whitened", "explained", "identity_error")
