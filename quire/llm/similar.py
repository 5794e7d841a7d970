"""Near-duplicates by the Jaccard similarity of word shingles.

A text's set of shingles is told by a hash; equal sets are one. Candidates come from two searches and are compared
exactly. The first is that of simhash: fingerprints of the shingles within BITS of one another, by multi-index hashing.
Sets at the least similarity of 0.8 differ in 10 of 64 bits on average and in 17 at times, which no table of small balls
reaches, so the second takes BANDS keys of ROWS smallest hashes of every set, and sets that share a key: a pair at 0.8
shares none with a probability of (1 - 0.8 ** ROWS) ** BANDS, 5e-8, a closer one with less. Sets that share a key are
first compared with one of the key, another for every key, which settles groups of copies in proportion to their number.
Sets of keys whose members are in several components still are then searched by rare shingles (prefix filtering with
positions), which is exact and meets no group as a whole: of a set, only as many of its rarest shingles count as a pair
at the least similarity may lack, so that what many texts have in common leads nowhere.

Defined results: words are lower-cased (ASCII) and cut at ASCII white space; a text of fewer words than a shingle is one
shingle, one without words an empty one; rows, ids and what stays are as in simhash.elected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, mapped, sketch, staged
from .simhash import elected, links, majority, row_key

SHINGLE, LEAST, BITS = 5, 0.8, 4
BANDS, ROWS, SEED = 32, 4, 42
#: Shingles whose hashes are permuted at once, and texts whose sets are held at once.
BLOCK, HELD = 1 << 10, 128

_rng = np.random.default_rng(SEED)
_TIMES, _PLUS, _MIX = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the whole text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, end = (end - length)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end)), np.uint64, len(start)))


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles, each made of ROWS smallest hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (_TIMES[:, None] * found[at : at + BLOCK] + _PLUS[:, None]).min(axis=1), out=least)
    return ((least ^ (least >> np.uint64(29))) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets(docs: DataFrame) -> DataFrame:
    """(k1, k2, id, n, fp, keys): the set of every row, its size, its fingerprint and its keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, HELD) for whole in batches for i in range(0, whole.num_rows, HELD)):
            found = [shingles(t.as_py()) for t in b.column(2)]
            ids = _signed([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found])
            keys = np.concatenate([bands(x) for x in found]) if found else np.zeros(0, np.uint64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64)))
            fps = _signed([majority([x]) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, pa.array([len(x) for x in found], pa.int64()), fps, keys], ["k1", "k2", "id", "n", "fp", "keys"])

    return mapped(docs.select(*row_key(docs), F.col("text").cast("string")), each, "k1 long, k2 long, id long, n long, fp long, keys array<long>")


def _whole(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the sets `wanted`, made again from one row's text each."""
    one = staged(rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2"), "one")
    k1, k2 = row_key(docs)
    texts = docs.where(sketch(one, "k1", "k2")(k1, k2)).select(k1, k2, F.col("text").cast("string").alias("text")).join(one, ["k1", "k2"]).select("id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, HELD) for whole in batches for i in range(0, whole.num_rows, HELD)):
            found = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return staged(mapped(texts, each, "id long, shingles array<long>").dropDuplicates(["id"]), "shingles")


def _verified(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of sets whose similarity is `least` or more; n_u, n_v: their sizes."""
    pairs = pairs.where(F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v")).select("u", "v").distinct()
    u, v = (whole.select(F.col("id").alias(n), F.col("shingles").alias(f"of_{n}")) for n in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    # Whole numbers until the last step: |u & v| / |u | v|.
    similar = both / (F.size("of_u") + F.size("of_v") - both) >= least
    return pairs.join(u, "u").join(v, "v").where(similar).select("u", "v")


def _close(sets: DataFrame) -> DataFrame:
    """(u, n_u, v, n_v): sets whose fingerprints are equal or linked, each with the first of its, or of the other, fingerprint."""
    one = staged(sets.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("u")).select("fp", F.col("u.id").alias("u"), F.col("u.n").alias("n_u")), "fingerprints")
    same = sets.join(one, "fp").where("id <> u").select("u", "n_u", F.col("id").alias("v"), F.col("n").alias("n_v"))
    a, b = (one.select(F.col("fp").alias(f"fp_{n}"), F.col("u").alias(n), F.col("n_u").alias(f"n_{n}")) for n in "uv")
    near = links(one.select("fp"), BITS).withColumnsRenamed({"u": "fp_u", "v": "fp_v"})
    both = near.join(a, "fp_u").join(b, "fp_v")
    return same.union(both.select("u", "n_u", "v", "n_v"))


def _by_rare_shingles(sets: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """(u, n_u, v, n_v): every pair of `sets` (id, n, root) of different roots that may reach `least`, n_u <= n_v.

    Shingles are ordered by how many of the sets have one, the rarest first. A pair that is similar enough shares one
    among the first n - least * n + 1 of the larger set and the first n - 2 * least / (1 + least) * n + 1 of the smaller,
    at places after which enough are left on both sides.
    """
    said = sets.join(whole, "id").select("id", "n", "root", F.explode("shingles").alias("s"))
    known = staged(said.groupBy("s").agg(F.count("*").alias("of")).where("of > 1"), "common")
    # Shingles of one set alone come first and lead nowhere, so only their number counts.
    mine = Window.partitionBy("id")
    nth = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("of", "s")) - 1
    placed = said.join(known, "s").withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9))
    placed = staged(placed.select("s", "id", "n", "root", "nth"), "rare")
    u, v = (placed.select("s", F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "root", "nth")]) for c in "uv")
    u = u.where(F.col("nth_u") <= F.col("n_u") - F.ceil(2 * least / (1 + least) * F.col("n_u") - 1e-9))
    order = "(n_u < n_v or (n_u = n_v and u < v)) and root_u <> root_v"
    enough = F.least(F.col("n_u") - F.col("nth_u"), F.col("n_v") - F.col("nth_v")) >= least / (1 + least) * (F.col("n_u") + F.col("n_v")) - 1e-9
    return u.join(v, "s").where(F.expr(order) & (F.col("n_u") >= least * F.col("n_v") - 1e-9) & enough).select("u", "n_u", "v", "n_v").distinct()


def linked(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(k1, k2, root) of every row of docs: the component of its set under similarities of `least` or more."""
    rows = staged(_sets(docs), "sets")
    sets = staged(rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "distinct")
    keys = staged(sets.select("id", "n", F.explode("keys").alias("key")), "keys")
    shared = staged(keys.groupBy("key").agg(F.min_by(F.struct("id", "n"), F.struct(F.xxhash64("id", "key"), "id")).alias("u"), F.count("*").alias("of")).where("of > 1").select("key", F.col("u.id").alias("u"), F.col("u.n").alias("n_u")), "shared")
    met = staged(keys.where(sketch(shared, "key")(F.col("key"))).join(shared, "key"), "met")
    discard(keys)
    first = staged(met.where("id <> u").select("u", "n_u", F.col("id").alias("v"), F.col("n").alias("n_v")).union(_close(sets)), "candidates")
    whole = _whole(docs, rows, met.select("id").union(first.select("u")).union(first.select("v")).distinct())
    near = staged(_verified(first, whole, least), "near")
    roots = staged(components(near).withColumnRenamed("node", "id"), "roots")
    # What the smallest sets left apart.
    placed = met.select("key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("key")
    placed = staged(placed.join(apart, "key").select("id", "n", "root").distinct(), "apart")
    rest = staged(_by_rare_shingles(placed, whole, least), "rest")
    more = _verified(rest.join(first.select("u", "v").distinct(), ["u", "v"], "left_anti"), whole, least)
    roots = components(near.union(more)).withColumnRenamed("node", "id")
    for done in (sets, shared, met, first, whole, near, placed, rest):
        discard(done)
    return rows.select("k1", "k2", "id").join(roots, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("root"))


def representatives(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that of its smallest doc_id."""
    return elected(docs, linked(docs, least))
