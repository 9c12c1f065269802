"""Fitting the factorization machine on every row of a training set: sums over the cells of a grid.

The model, its loss, first coefficients and steps are those of Spark's ``FMClassifier`` (log loss, AdamW over all rows).
That class keeps a sparse vector a row and walks it by factor; here the hashed vector of a user and of an item are taken once
a cell, and a row is two places and a label: its score is the user's part, the item's part and the product of their sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .grid import Arrays, Grid

#: The relative change of the coefficients that ends the steps, as in Spark.
TOLERANCE = 1e-6


def hashed_entries(vectors: DataFrame, most: int) -> DataFrame:
    """(id, idx array<int>, val array<double>) of sparse ``features`` of at most ``most`` entries, filled up with zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("features")
            lists = [vector.field(name) for name in ("indices", "values")]
            size = np.diff(lists[0].offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            out = []
            for column, kind in zip(lists, (np.int32, float)):
                filled = np.zeros((len(size), most), kind)
                filled[row, place] = column.flatten().to_numpy(zero_copy_only=False)
                out.append(pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * most, filled.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out], ["id", "idx", "val"])

    return vectors.select("id", "features").mapInArrow(run, "id long, idx array<int>, val array<double>")


def gradient(cell: Arrays, users: Arrays, items: Arrays, weights: np.ndarray, buckets: int, factors: int) -> np.ndarray:
    """(number of rows, the gradient of their summed loss by factors, linear coefficients and intercept) of one cell."""
    n = len(cell["u"])
    if not n:
        return np.zeros(1 + len(weights))
    v = weights[:buckets * factors].reshape(buckets, factors)
    linear, intercept = weights[buckets * factors:-1], weights[-1]
    u, i, n_users, n_items = cell["u"], cell["i"], len(users["id"]), len(items["id"])

    def parts(side: Arrays) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector: the sums of its factors, and its score by itself."""
        total, alone = np.zeros((factors, len(side["id"]))), np.zeros(len(side["id"]))
        for idx, x in zip(side["idx"].T, side["val"].T):
            total += (v[idx] * x[:, None]).T
            alone += linear[idx] * x - 0.5 * (v[idx] ** 2).sum(1) * x * x
        return total, alone + 0.5 * (total ** 2).sum(0)

    (of_user, user_score), (of_item, item_score) = parts(users), parts(items)
    raw = user_score[u] + item_score[i] + intercept
    for a, b in zip(of_user, of_item):
        raw += a[u] * b[i]
    # entries of a user and an item in one bucket are one feature, which does not meet itself
    shared = []
    for s in range(users["idx"].shape[1]):
        own, own_x = users["idx"][:, s], users["val"][:, s]
        for t in range(items["idx"].shape[1]):
            hit = np.flatnonzero(own[u] == items["idx"][:, t][i])
            x = own_x[u[hit]] * items["val"][i[hit], t]
            shared.append((hit[x != 0], own[u[hit[x != 0]]], x[x != 0]))
    for hit, bucket, x in shared:
        raw[hit] -= x * (v[bucket] ** 2).sum(1)
    with np.errstate(over="ignore"):
        off = 1 / (1 + np.exp(-raw)) - cell["label"]

    out_v, out_linear = np.zeros((factors, buckets)), np.zeros(buckets)

    def spread(side: Arrays, alone: np.ndarray, total: np.ndarray, by_total: np.ndarray) -> None:
        """The gradient by a vector's own score and by its sums, brought to its buckets."""
        for idx, x in zip(side["idx"].T, side["val"].T):
            out_linear[:] += np.bincount(idx, alone * x, buckets)
            for f in range(factors):
                out_v[f] += np.bincount(idx, x * (by_total[f] + alone * (total[f] - v[idx, f] * x)), buckets)

    by_user, by_item = np.empty((factors, n_users)), np.empty((factors, n_items))
    for f in range(factors):
        by_user[f] = np.bincount(u, off * of_item[f][i], n_users)
        by_item[f] = np.bincount(i, off * of_user[f][u], n_items)
    spread(users, np.bincount(u, off, n_users), of_user, by_user)
    spread(items, np.bincount(i, off, n_items), of_item, by_item)
    for hit, bucket, x in shared:
        for f in range(factors):
            out_v[f] -= np.bincount(bucket, 2 * off[hit] * x * v[bucket, f], buckets)
    return np.concatenate([[n], out_v.T.ravel(), out_linear, [off.sum()]])


def fit(grid: Grid, first: np.ndarray, buckets: int, factors: int, max_iter: int,
        update: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """The coefficients after at most ``max_iter`` steps: ``update`` makes the next ones of (these, the mean gradient, step)."""
    weights = first
    for turn in range(1, max_iter + 1):
        found = grid.map(lambda cell, users, items: gradient(cell, users, items, weights, buckets, factors)).treeReduce(np.add)
        if not found[0]:
            raise ValueError("there is no row to fit")
        before, weights = weights, update(weights, found[1:] / found[0], turn)
        if np.linalg.norm(weights - before) < TOLERANCE * max(np.linalg.norm(weights), 1.0):
            break
    return weights
