"""Line dedup by pairwise alignment.

Documents are ordered by doc_id. Pairs of overlapping documents come from windows, the shortest runs of lines that
together have MIN_WORDS words: each window, in however many documents it stands, leads to the first one with it, so that
whatever a document shares with any earlier one is found. Blank lines are lines of no words. The lines of each pair, as
hashes, are aligned by patience diff (lines unique on both sides that keep their order are anchors; equal neighbours
extend them; the gaps between anchors are aligned alike), and aligned common blocks of MIN_WORDS words or more are
deleted from the later document, with every other window of it that the earlier one has: repeats, blocks in another
order, gaps without unique lines. A hot window leads every document to one other, never to all that have it, so pairs
grow with the input. Hashes are shuffled for the search; of the texts, only those that may lose lines.

Defined results: white space round a line does not count, and lines of it alone neither lead anywhere nor are counted as
words, though they go with a block round them; null texts stay null, empty ones empty; rows equal in doc_id and text are
one document and keep the same lines; documents of one doc_id and different texts follow the order of a hash of the
text; null ids come last; an empty table gives an empty result; texts of any length are compared whole; other columns
of the input are carried along where asked for, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, sketch, staged

MIN_WORDS = 25


def unique_matches(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Pairs of positions of lines unique in both slices, in the longest run that keeps the order on both sides."""
    ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {b[j]: j for j in range(b0, b1) if cb[b[j]] == 1 and ca.get(b[j]) == 1}
    pairs = [(i, at[a[i]]) for i in range(a0, a1) if a[i] in at]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back.append(ends[k - 1] if k else -1)
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of equal lines, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1 and (anchors := unique_matches(a, b, a0, a1, b0, b1)):
            for i, j in anchors:
                todo.append((a0, i, b0, j))
                out.append((i, j))
                a0, b0 = i + 1, j + 1
            todo.append((a0, a1, b0, b1))
    return sorted(out)


def windows(words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(first, end) of the shortest runs of lines with `least` words or more: from every line on, and up to every line.

    Every line of a longer run lies in one of these that the run holds whole: in the one from it on, in the one up to
    it, or in the one from the run's first line on. So two documents share a run if, and where, they share windows.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + least, "left")
    starts = np.searchsorted(total, total[1:] - least, "right") - 1
    return {(i, j) for i, j in enumerate(ends.tolist()) if j < len(total)} | {(i, j) for j, i in enumerate(starts.tolist(), 1) if i >= 0}


def common_blocks(a: list, b: list, words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) positions in a of runs, neighbours on both sides, of `least` words or more.

    Runs of the alignment, and what it leaves: repeats within a, blocks in another order, gaps without a unique line.
    """
    out, run, total = set(), [], 0
    for i, j in [*patience(a, b), (-9, -9)]:
        if run and (i, j) == (run[-1][0] + 1, run[-1][1] + 1):
            run.append((i, j))
        else:
            if run and total >= least:
                out.add((run[0][0], run[-1][0]))
            run, total = [(i, j)], 0
        total += words[i] if i >= 0 else 0
    gone = {x for i, z in out for x in range(i, z + 1)}
    left = [(i, j) for i, j in windows(words, least) if not gone.issuperset(range(i, j))]
    if left:
        # Lines that a has not count no words here: no window with one of them is in a.
        count = dict(zip(a, words))
        there = {tuple(b[i:j]) for i, j in windows([count.get(x, 0) for x in b], least)}
        out |= {(i, j - 1) for i, j in left if tuple(a[i:j]) in there}
    return sorted(out)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("k2", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def blocks(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, gone): for documents with anything to delete, the blocks of line numbers; docs: (k1, k2, text)."""
    hashes = F.transform(_lines(F.col("text")), lambda x: F.when(F.trim(x) == "", 0).otherwise(F.xxhash64(F.trim(x))))
    words = F.transform(_lines(F.col("text")), lambda x: F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), "\\s+"))))
    lined = staged(docs.where("text is not null").select("k1", "k2", hashes.alias("hashes"), words.alias("words")).dropDuplicates(["k1", "k2"]), "lines")
    def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1s, k2s, keys = [], [], []
            for k1, k2, h, w in zip(*(b.column(c) for c in range(4))):
                raw = h.values.to_numpy(zero_copy_only=False).tobytes()
                found = {xxhash.xxh64_intdigest(raw[8 * i : 8 * j]) for i, j in windows(w.values.to_numpy(zero_copy_only=False), least)}
                k1s += [k1.as_py()] * len(found)
                k2s += [k2.as_py()] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64))], ["k1", "k2", "key"])

    runs = staged(mapped(lined, window_hashes, "k1 long, k2 long, key long"), "windows")
    # Written, so that the join below deals out both sides anew and a hot window's rows can be split.
    first = staged(runs.groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("f"), F.count("*").alias("df")).where("df > 1").select("key", "f"), "first")
    met = runs.join(first, "key").where(F.struct("k1", "k2") > F.col("f"))
    pairs = met.select("k1", "k2", F.col("f.k1").alias("e1"), F.col("f.k2").alias("e2")).distinct()
    earlier = lined.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("hashes").alias("before"))
    both = pairs.join(lined, ["k1", "k2"]).join(earlier, ["e1", "e2"]).select("k1", "k2", "hashes", "words", "before")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k1, k2, [{"a": x, "z": y} for x, y in g]) for k1, k2, a, w, e in zip(*(c.to_pylist() for c in b.columns)) if (g := common_blocks(a, e, w, least))]
            if rows:
                k1, k2, gone = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(gone, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))], ["k1", "k2", "gone"])

    aligned = mapped(both, align, "k1 long, k2 long, gone array<struct<a: int, z: int>>")
    return aligned.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = MIN_WORDS) -> DataFrame:
    """The columns `keep`, text without the deleted blocks, n_lines and n_deleted of every row of docs."""
    keyed = _key(docs.withColumn("text", F.col("text").cast("string")))
    gone = staged(blocks(keyed.select("k1", "k2", "text"), least), "gone")
    rows = keyed.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], "k1", "k2", F.col("text").alias("whole"))
    n_lines = F.coalesce(F.size(_lines(F.col("whole"))), F.lit(0)).cast("long")
    kept = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    maybe = sketch(gone, "k1", "k2")(F.col("k1"), F.col("k2"))
    # Only documents that may lose lines are dealt out with their texts.
    whole = rows.where(~maybe).select(*kept, F.col("whole").alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"))
    joined = rows.where(maybe).join(gone, ["k1", "k2"], "left")
    stays = F.filter(_lines(F.col("whole")), lambda x, i: ~F.exists("gone", lambda b: (i >= b["a"]) & (i <= b["z"])))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(stays, "\n"))
    left = F.when(F.col("gone").isNull(), n_lines).otherwise(F.size(stays))
    cut = joined.select(*kept, text.alias("text"), n_lines.alias("n_lines"), (n_lines - left).cast("long").alias("n_deleted"))
    return whole.unionByName(cut)
