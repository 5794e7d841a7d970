"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

The index is fitted on a bounded sample (SAMPLE rows): coarse centroids, and for each slice of the residual a codebook.
There are half as many lists as the root of the number of rows, between LISTS; a query visits VISITED of them. All vectors
are scaled by one power of two and each query by another, which changes no order and keeps estimates finite.
Every row is indexed: it goes to its nearest centroid's list with the codes of its residual. A query visits the lists
whose centroids have the largest inner products with it; in a list the candidates are ranked by asymmetric distance
tables (exact query, quantised row); the best EXACT, and all whose estimate plus ERRORS standard errors of quantisation
reaches the k-th of those, are ranked again exactly on the original vectors in double precision, and each list gives its
k best. Lists of more than BLOCK rows are cut into chunks, each searched alike, so a hot list meets
no single task; a query's final ranking merges at most k rows of each list and chunk that it visited.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or as
candidates; shorter vectors count as if they ended in zeros; ties go to the smaller id; rows with one id are one vector
each, and no row with the query's id is its neighbour; rows with a null id take no part; where there are fewer
candidates than k all that the visited lists hold are given; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import batches_of, by_key, centres, nearest, sample, scaled, usable

#: The fewest and the most lists, and the share of them that a query visits.
LISTS, VISITED = (128, 2048), 0.7
#: Slices of a residual, codes of a slice, rows of a chunk, rows ranked exactly, rows of the sample.
SLICES, CODES, BLOCK, EXACT, SAMPLE = 16, 256, 8192, 128, 16384
#: An estimate may be off by so many standard errors before a row is not ranked exactly.
ERRORS = 2.0


class Index:
    """Coarse centroids and codebooks, fitted on a sample."""

    def __init__(self, x: np.ndarray, lists: int, slices: int = SLICES, codes: int = CODES):
        self.width = x.shape[1]
        self.coarse = centres(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        edges = np.linspace(0, self.width, min(slices, self.width) + 1).astype(int)
        self.slices = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.books = [centres(rest[:, a:b], codes, rounds=6) for a, b in self.slices]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, standard error of an inner product with a unit vector) of each row."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.slices, self.books)], axis=1)
        for i, ((a, b), book) in enumerate(zip(self.slices, self.books)):
            rest[:, a:b] -= book[codes[:, i]]
        return own, codes.astype(np.uint8), np.linalg.norm(rest, axis=1) / self.width**0.5

    def visits(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")[:, :probes]

    def estimates(self, q: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows): inner products with the quantised rows of one list, from a table for each slice."""
        out = np.repeat((q @ self.coarse[own])[:, None], len(codes), axis=1)
        for i, ((a, b), book) in enumerate(zip(self.slices, self.books)):
            out += (q[:, a:b] @ book.T)[:, codes[:, i]]
        return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, lists: int | None = None, probes: int | None = None, exact: int = EXACT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of `vectors` (vec_id, embedding) with is_query."""
    fit = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    largest = F.array_max(F.transform("embedding", F.abs))
    width, rows_in, most = fit.agg(F.max(F.size("embedding")), F.count("*"), F.max(largest)).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not width:
        return vectors.sparkSession.createDataFrame([], empty)
    lists = lists or min(max(round(rows_in**0.5 / 2), LISTS[0]), LISTS[1])
    probes = probes or math.ceil(lists * VISITED)
    down = -int(np.frexp(most)[1])
    picked = sample(fit, SAMPLE, "vec_id")
    index = Index(np.ldexp(np.pad(picked, ((0, 0), (0, width - picked.shape[1]))), down), lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = batches_of(b.column(1), width)
                own, codes, off = index.encode(np.ldexp(x, down))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(off)], ["list", "id", "codes", "vector", "off"])

    indexed = staged(fit.mapInArrow(place, "list long, id long, codes binary, vector binary, off double"), "inverted-file")
    sizes = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    chunks = np.ones(len(index.coarse), np.int64)
    for own, n in sizes.items():
        chunks[own] = -(-n // BLOCK)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = batches_of(b.column(1), width)
                to = index.visits(scaled(x), probes)
                rows = [(c, n, 1, i, r.tobytes()) for i, r, ls in zip(b.column(0).to_pylist(), x, to.tolist()) for c in ls for n in range(chunks[c])]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]), pa.nulls(len(rows), pa.binary()), pa.array([r[4] for r in rows], pa.binary()), pa.nulls(len(rows), pa.float64())], ["list", "chunk", "side", "id", "codes", "vector", "off"])

    schema = "list long, chunk long, side long, id long, codes binary, vector binary, off double"
    cut = F.create_map(*[F.lit(int(x)) for i, n in enumerate(chunks) for x in (i, n)])
    homes = indexed.select("list", F.pmod(F.xxhash64("id"), F.element_at(cut, F.col("list").cast("int"))).alias("chunk"), F.lit(0).cast("long").alias("side"), "id", "codes", "vector", "off")
    asked = fit.where(is_query).mapInArrow(probe, schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place, rows = None, None
        for (own, chunk, side), new, part in by_key(batches, 3):
            if side == 0:
                if new:
                    held, place, rows = [], (own, chunk), None
                held.append(part)
                continue
            if place != (own, chunk):
                continue  # a list without rows
            if rows is None:
                ids = np.concatenate([p.column(3).to_numpy() for p in held])
                order = np.argsort(ids, kind="stable")
                codes = np.concatenate([np.frombuffer(b"".join(p.column(4).to_pylist()), np.uint8).reshape(p.num_rows, -1) for p in held])
                x = np.concatenate([np.frombuffer(b"".join(p.column(5).to_pylist()), np.float64).reshape(p.num_rows, -1) for p in held])
                rows = ids[order], codes[order], x[order], np.concatenate([p.column(6).to_numpy() for p in held])[order]
            ids, codes, x, off = rows
            asking = part.column(3).to_numpy()
            q = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(-1, width)
            for i in range(0, len(q), 64):
                guess = index.estimates(scaled(q[i : i + 64]), own, codes)
                # Only what has the query's own id takes no part.
                mine = asking[i : i + 64, None] == ids
                guess[mine] = -np.inf
                out: list[tuple] = []
                for row, self_, query, name in zip(guess, mine, q[i : i + 64], asking[i : i + 64].tolist()):
                    best = np.argpartition(-row, exact - 1)[:exact] if len(row) > exact else np.arange(len(row))
                    best = best[~self_[best]]
                    score = (x[best] * query).sum(axis=1)
                    if len(row) > exact and len(best) >= k:
                        # Exact scores on the scale of the estimates.
                        to_guess = np.ldexp(1.0, down) * np.ldexp(1.0, -np.frexp(np.abs(query).max())[1])
                        bound = np.partition(score, -k)[-k] * to_guess
                        maybe = row + off * (ERRORS * np.linalg.norm(scaled(query[None])[0])) >= bound
                        maybe[best] = False
                        maybe &= ~self_
                        more = np.flatnonzero(maybe)
                        best, score = np.concatenate([best, more]), np.concatenate([score, (x[more] * query).sum(axis=1)])
                    top = np.lexsort((ids[best], -score))[:k]
                    out += [(name, i, s) for i, s in zip(ids[best[top]].tolist(), score[top].tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "vec_id", "score"])

    near = homes.unionByName(asked).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "side").mapInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
