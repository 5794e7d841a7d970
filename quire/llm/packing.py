"""Packing token sequences into fixed windows by non-negative least squares.

Every document becomes pieces: whole windows, and one remainder shorter than a window. Shallow combinations of lengths
that fill a window exactly (two lengths; one length twice and a third; two lengths and a third on a grid) get repeat
counts by non-negative least squares against the histogram of lengths; the counts are rounded down and the pieces left
are packed greedily, the longest first, always with the longest that still fits. Only the histogram (a row for each
length at most) and the plan reach the driver; both are bounded by the window, not by the data. A piece finds its place
by its rank among all pieces of its length: its rank in the task that made it, plus the pieces of earlier tasks, of which
a row of counts for each task tells.

Defined results: a null or empty text is a document of the end id alone; null doc_ids and repeated rows are documents
like others; an empty table gives no pieces; texts of any length are tokenised whole, the tokenizer's added tokens in them as the library reads them; further
columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, staged

WINDOW, END = 1024, 0
#: Bytes that one worker's memory of chunks of text and their ids may take, and the longest chunk that it remembers.
CACHE, LONGEST = 48 << 20, 48
#: Tokens whose pieces are held at once, if no document alone has more.
HELD = 1 << 19
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Odd(Exception):
    """A chunk after which a space may not begin a pre-token."""


def _raw(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """Ids of chunks that follow a space; made where they are not yet known, and kept up to CACHE bytes of them."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self.odd = {""}
        self._room = CACHE

    def _holds(self, chunk: str, ids: bytes = b"") -> bool:
        # The two objects, and their share of the table.
        size = sys.getsizeof(chunk) + sys.getsizeof(ids) + 100
        if len(chunk) > LONGEST or size > self._room:
            return False
        self._room -= size
        return True

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[-1].isspace():
            if self._holds(chunk):
                self.odd.add(chunk)
            raise _Odd
        ids = _raw(self._encode(" " + chunk))
        if self._holds(chunk, ids):
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers, for a byte-level BPE tokenizer file.

    Equal to encoding the text at once: a single space between two characters that are no white space always begins a
    pre-token, so the pieces between such spaces can be encoded, and remembered, alone. Other texts are encoded at once.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        vocabulary, added = read["model"]["vocab"], read.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self._added = {t["content"]: t["id"] for t in added}
        # The leftmost, and of those the longest.
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=lambda t: (-len(t), t)))) + ")").split if added else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in self._added and all(c in byte for c in word)}
        self._encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known = _Known(self._encode)

    def encode(self, text: str) -> bytes:
        """Added tokens stand for themselves, as in the library; what lies between them is encoded alone."""
        if any(t in text for t in self._added):
            return b"".join(_raw([self._added[part]]) if i % 2 else self._plain(part) for i, part in enumerate(self._split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first[-1:].isspace() and self._known.odd.isdisjoint(rest):
            try:
                return _raw(self._encode(first)) + b"".join(map(self._known.__getitem__, rest))
            except _Odd:
                pass
        return _raw(self._encode(text))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth[, ids]): each document cut into windows and a remainder.

    nth counts the pieces of one length within the task. ids: little-endian unsigned 32-bit integers.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", *["ids"] * keep_ids]
    last = int(end).to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), Counter()
        rows: list[list] = [[] for _ in names]
        held = 0

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(r, pa.binary() if n == "ids" else pa.int64()) for n, r in zip(names, rows)], names)
            for r in rows:
                r.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "") + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[start * 4 : (start + window) * 4]
                    n = len(part) // 4
                    for to, value in zip(rows, (doc, start, n, zlib.crc32(part), total, task, seen[n], part)):
                        to.append(value)
                    seen[n] += 1
                held += total
                if held >= HELD:
                    yield made()
                    held = 0
        if rows[0]:
            yield made()

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def combinations(window: int, grid: int = 32) -> np.ndarray:
    """Rows of three lengths, 0 for none, that fill the window exactly."""
    found = {(a, window - a, 0) for a in range(1, window // 2 + 1)}
    found |= {tuple(sorted((a, a, window - 2 * a), reverse=True)) for a in range(1, (window - 1) // 2 + 1)}
    found |= {tuple(sorted((a, b, window - a - b), reverse=True)) for a in range(1, window) for b in range(grid, window - a, grid * 4)}
    return np.array(sorted(found), np.int64)


def nonnegative(rows: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Least squares x >= 0 for sum over rows of x * (lengths in the row) = target, by accelerated projected gradient."""
    real = rows > 0

    def spread(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (x[:, None] * real).ravel(), len(target))

    def gather(y: np.ndarray) -> np.ndarray:
        return (y[rows] * real).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):  # power iteration: the step must stay under 1 / the largest eigenvalue
        v = gather(spread(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * np.linalg.norm(gather(spread(v))))
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, z - step * gather(spread(z) - target))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, x = after + (before - 1) / t * (after - x), after
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): windows that use up the histogram of lengths, each length's pieces exactly."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    if left.any() and window > 1:
        rows = combinations(window)
        repeats = np.floor(nonnegative(rows, left.astype(float)) + 1e-9).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] <= 0:
                break
            use = Counter(int(x) for x in rows[k] if x)
            if (n := min(int(repeats[k]), *(int(left[x]) // m for x, m in use.items()))) > 0:
                out.append((tuple(use.elements()), n))
                for x, m in use.items():
                    left[x] -= n * m
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:
        use, room = Counter(), window
        while (at := bisect_right(lengths, room) - 1) >= 0:
            while at >= 0 and left[lengths[at]] <= use[lengths[at]]:
                at -= 1
            if at < 0:
                break
            use[lengths[at]] += 1
            room -= lengths[at]
        n = min(int(left[x]) // m for x, m in use.items())
        out.append((tuple(use.elements()), n))
        for x, m in use.items():
            left[x] -= n * m
        lengths = [x for x in lengths if left[x]]
    return out


def places(windows: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """(first, rank, sequence, offset): pieces numbered by (length, rank) from first[length] on; runs of them begin at
    rank and lie at offset in sequences from `sequence` on."""
    counts, runs, sequence = np.zeros(size + 2, np.int64), [], 0
    for lengths, n in windows:
        offset = 0
        for x in lengths:
            runs.append((x, int(counts[x]), sequence, offset))
            counts[x] += n
            offset += x
        sequence += n
    first = np.concatenate([[0], np.cumsum(counts)])[: size + 2]
    a = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return first, first[a[:, 0]] + a[:, 1], a[:, 2], a[:, 3]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Pieces with the sequence_id and offset at which they lie; sequences are numbered from 0 without gaps."""
    cut = staged(pieces(docs, tokenizer, window, end, keep_ids), "pieces")
    made = staged(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "made")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    first, rank, sequence, offset = places(plan(histogram, window), window)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = made.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row for each task: the number of its first piece of each length.
    listed = before.groupBy("task").agg(F.collect_list(F.struct("length", "before")).alias("at"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.zeros((b.num_rows, window + 1), np.int64)
            for row, found in zip(at, b.column("at").to_pylist()):
                for x in found:
                    row[x["length"]] = first[x["length"]] + x["before"]
            yield pa.RecordBatch.from_arrays([b.column("task"), pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, window + 1), pa.int32()), pa.array(at.ravel()))], ["task", "starts"])

    def place(number: pa.Array) -> pa.Array:
        n = number.to_numpy()
        run = np.searchsorted(rank, n, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[run] + n - rank[run]), pa.array(offset[run])], ["sequence_id", "offset"])

    joined = cut.join(mapped(listed, starts, "task long, starts array<long>"), "task")
    number = F.element_at("starts", (F.col("length") + 1).cast("int")) + F.col("nth")
    # explode: a step of its own, after which no row holds its task's list any more.
    numbered = joined.select(*cut.columns, F.explode(F.array(number)).alias("number"))
    # Only numbers go to Python; ids stay where they are.
    placed = numbered.withColumn("place", F.arrow_udf(place, "sequence_id long, offset long")("number"))
    return placed.select(*[c for c in cut.columns if c not in ("task", "nth")], "place.sequence_id", "place.offset")
