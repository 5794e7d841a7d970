"""Cutting texts into overlapping pieces at the best separators.

A text is cut at the first separator of the list that it has, separators staying with what follows; pieces that are
still too long are cut by the later ones; neighbours are then gathered up to the size, each piece beginning with as much
of the end of the one before as the overlap allows. Sizes are in characters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, SEPARATORS = 500, 80, ("\n\n", "\n", ". ", " ", "")


def cut(text: str, separator: str) -> list[str]:
    """Pieces that each begin with the separator, but for the first; every character where the separator is empty."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def gather(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if whole := "".join(held).strip():
                yield whole
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    if whole := "".join(held).strip():
        yield whole


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    out: list[str] = []
    short: list[str] = []
    for piece in cut(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += gather(short, size, overlap)
        short = []
        later = separators[at + 1 :]
        out += split_text(piece, size, overlap, later) if later else [piece]
    return [*out, *gather(short, size, overlap)]


def split_rows(df: DataFrame, column: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df with one row for each piece: piece_no and piece in place of the column."""
    rest = [c for c in df.columns if c != column]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    source = df.select(*rest, F.coalesce(F.col(column), F.lit("")).alias(column))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, number, pieces = [], [], []
            for i, text in enumerate(b.column(len(rest))):
                for n, p in enumerate(split_text(text.as_py(), size, overlap)):
                    take.append(i)
                    number.append(n)
                    pieces.append(p)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(len(rest))), pa.array(number, pa.int32()), pa.array(pieces, pa.string())], [*rest, "piece_no", "piece"])

    return source.mapInArrow(each, f"{kinds}{', ' if kinds else ''}piece_no int, piece string")
