"""What the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Neither null nor empty nor zero, every component finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, rows: int, *by: str) -> np.ndarray:
    """At most `rows` of the vectors, those with the smallest hashes of their values and of `by`, as a matrix of doubles."""
    return matrix([r["embedding"] for r in smallest(vectors.select("embedding", F.xxhash64("embedding", *by).alias("h")), rows)])


def smallest(hashed: DataFrame, rows: int) -> list:
    """At most `rows` of the rows, those with the smallest hashes `h`: of all rows, only half as many more are collected."""
    place = F.col("h").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    share = 1.5 * rows / max(1, hashed.count())
    return sorted((hashed.where(place <= share) if share < 1 else hashed).collect(), key=lambda r: (r["h"] & (1 << 62) - 1, r["h"]))[:rows]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to between 1/2 and 1: exact, and squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def matrix(rows: list, width: int | None = None) -> np.ndarray:
    """Rows as doubles; a shorter row counts as if it ended in zeros."""
    width = width or max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means of the rows of x from distinct rows; fewer centres where there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def batches_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; one reshape where all rows have the full width."""
    if len(column) and not column.null_count:
        flat = column.flatten()
        if len(flat) == len(column) * width and (np.diff(column.offsets.to_numpy()) == width).all():
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return matrix(column.to_pylist(), width)


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, is it new, rows): runs of equal values in the first `keys` columns of sorted batches."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(values[a].tolist())
            yield key, key != last, b.slice(a, z - a)
            last = key
