"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments with a radius each, so chosen that fingerprints within the threshold must agree
in one segment up to its radius (the radii plus one each add up to more than the threshold). Every distinct
fingerprint goes into one hash table per segment; the small Hamming ball round each of its segments is enumerated and
looked up there, and what is found is verified over all 64 bits.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and are linked like any
other; repeated rows and ties keep one row each, with the component of their fingerprint; a null doc_id stays null,
and never names a component unless no other id is there; an empty table gives an empty result; further columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, mapped, sketch, staged

SEED = 42
#: (first bit, bits, radius); 2 + 2 + 1 > 4 differing bits.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Shingles whose bits are counted at once, so that a very long text needs no more memory than this.
BLOCK = 1 << 16


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes in all blocks."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of the whole text's word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, end = (end - length)[: len(words) - shingle + 1], end[shingle - 1 :]
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist())], np.uint64) for at in range(0, len(start), BLOCK))


def fingerprints(docs: DataFrame, shingle: int = 4, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, fp), or the columns `key` for doc_id: fp the fingerprint's bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(len(key))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array(out.view(np.int64))], [*key, "fp"])

    schema = ", ".join(f"{k} long" for k in (*key, "fp"))
    return mapped(docs.select(*[F.col(k).cast("long") for k in key], F.col("text").cast("string")), each, schema)


def links(distinct: DataFrame, threshold: int = 4, segments: tuple = SEGMENTS) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints `fp` that differ in at most `threshold` bits: all of them, once each."""
    if sum(r + 1 for _, _, r in segments) <= threshold:
        raise ValueError("the segments' radii do not cover the threshold")
    if any(r > 1 for _, _, r in segments):
        raise ValueError("balls of radius 0 and 1 only")

    def key(n: int, first: int, bits: int, flip: int = 0):
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.lit(flip)).bitwiseOR(F.lit(n << 56))

    tables = F.array(*[key(n, first, bits) for n, (first, bits, _) in enumerate(segments)])
    balls = F.array(*[key(n, first, bits, flip) for n, (first, bits, r) in enumerate(segments) for flip in [0, *([1 << i for i in range(bits)] if r else [])]])
    index = distinct.select(F.col("fp").alias("v"), F.explode(tables).alias("place"))
    probe = distinct.select(F.col("fp").alias("u"), F.explode(balls).alias("at"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    return probe.join(index.hint("merge"), (F.col("at") == F.col("place")) & near).select("u", "v").distinct()


def _named(classes: DataFrame, threshold: int) -> DataFrame:
    """(fp, root, component_id) of classes (fp, first_id): the component of every fingerprint and its smallest doc_id."""
    roots = components(links(classes.select("fp"), threshold))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most `threshold` bits reach, one row per row of docs."""
    each = staged(fingerprints(docs, shingle), "fingerprints")
    classes = staged(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    return each.join(_named(classes, threshold).drop("root"), "fp").select("doc_id", "fp", "component_id")


def row_key(docs: DataFrame) -> list[Column]:
    """k1, k2: what tells rows of docs apart, also where ids are null (these come last) or repeated: doc_id and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k1"), F.xxhash64(text).alias("k2")]


def elected(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest key. found: (k1, k2, root) of every row of docs."""
    rows = staged(found.groupBy("root", "k1", "k2").agg(F.count("*").alias("n")), "rows")
    winners = rows.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("first"))
    keys = staged(rows.join(winners, "root").select("k1", "k2", "n", (F.struct("k1", "k2") == F.col("first")).alias("wins")), "keys")
    k1, k2 = row_key(docs)
    maybe = sketch(keys.where("n > 1 or not wins"), "k1", "k2")(k1, k2)
    # Only rows that may have to go are dealt out with their texts.
    doubtful = docs.where(maybe).select(k1, k2, F.struct(*docs.columns).alias("row")).join(keys.where("wins"), ["k1", "k2"], "left_semi")
    return docs.where(~maybe).unionByName(doubtful.groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*"))


def representatives(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """docs without near-duplicates: of each component the row of its smallest doc_id stays, of equal rows one.

    Rows of one doc_id, or of none, and different texts are different rows; null ids come last.
    """
    each = staged(fingerprints(docs.select(*row_key(docs), F.col("text").cast("string")), key=("k1", "k2")), "fingerprints")
    classes = staged(each.groupBy("fp").agg(F.min("k1").alias("first_id")), "classes")
    return elected(docs, each.join(_named(classes, threshold).select("fp", "root"), "fp").select("k1", "k2", "root"))
