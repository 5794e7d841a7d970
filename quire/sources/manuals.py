"""Reading manuals: files as bytes, a page reader for each, and the tables that an ingest takes.

A reader turns one file into what lies on its pages. Readers for PDF need libraries that may be absent; they are imported
when the first file is read, on the executors, and a missing one is an error that names it. A document is read in one
task, since its contents list and its pages belong together; many documents are read by many tasks.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Found:
    """What a reader finds. Pages count from 1; boxes are left, top, right, bottom in points from the top left."""

    blocks: list[tuple[int, list[float], str]] = field(default_factory=list)  # page, box, text
    toc: list[tuple[int, str, int]] = field(default_factory=list)  # level, title, page
    drawings: list[tuple[int, float, float, float, float]] = field(default_factory=list)  # page, box
    grids: list[tuple[int, int, list[float], list]] = field(default_factory=list)  # page, number on the page, box, cells
    pages: list[tuple[int, str, float, float]] = field(default_factory=list)  # page, whole text, width, height


class PageReader(Protocol):
    def read(self, content: bytes) -> Found: ...


class PdfReader:
    """Blocks, contents and drawings by pymupdf; grids of cells and page texts by pdfplumber."""

    def __init__(self, snap: int = 3):
        self.snap = snap

    def read(self, content: bytes) -> Found:
        try:
            import pdfplumber
            import pymupdf
        except ImportError as e:
            raise RuntimeError(f"reading PDF files needs {e.name}") from e
        found = Found()
        with pymupdf.open(stream=content, filetype="pdf") as doc:
            found.toc = [(level, title, page) for level, title, page, *_ in doc.get_toc()]
            for n, page in enumerate(doc, 1):
                for x0, y0, x1, y1, text, _, kind, *_ in page.get_text("blocks"):
                    if kind == 0 and text.strip():
                        found.blocks.append((n, [round(v, 1) for v in (x0, y0, x1, y1)], text.strip()))
                for drawing in page.get_drawings():
                    if (box := drawing.get("rect")) is not None:
                        found.drawings.append((n, box.x0, box.y0, box.x1, box.y1))
        with pdfplumber.open(io.BytesIO(content)) as doc:
            for n, page in enumerate(doc.pages, 1):
                found.pages.append((n, page.extract_text() or "", float(page.width), float(page.height)))
                for i, table in enumerate(page.find_tables(table_settings={"snap_tolerance": self.snap})):
                    found.grids.append((n, i, [float(v) for v in table.bbox], table.extract()))
        return found


_SHAPES = {
    "blocks": "page int, bbox array<double>, text string, line_no long",
    "toc": "ord int, level int, title string, page int",
    "drawings": "page int, x0 double, y0 double, x1 double, y1 double",
    "grids": "page int, table_idx int, bbox array<double>, cells array<array<string>>",
    "pages": "page int, text string, width double, height double",
}


def records(found: Found) -> Iterator[tuple[str, dict]]:
    """(kind, record) of everything found, blocks and contents numbered in order."""
    for n, (page, box, text) in enumerate(found.blocks):
        yield "blocks", {"page": page, "bbox": list(box), "text": text, "line_no": n}
    for n, (level, title, page) in enumerate(found.toc):
        yield "toc", {"ord": n, "level": level, "title": title, "page": page}
    for row in found.drawings:
        yield "drawings", dict(zip(("page", "x0", "y0", "x1", "y1"), row))
    for row in found.grids:
        yield "grids", dict(zip(("page", "table_idx", "bbox", "cells"), row))
    for row in found.pages:
        yield "pages", dict(zip(("page", "text", "width", "height"), row))


def read_pages(spark: SparkSession, root: str, registry: DataFrame, reader: PageReader) -> DataFrame:
    """(doc_id, kind, record): everything found in the registry's files under root, records as JSON.

    Worth writing to a table before it is used: every use of the result would read the files again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("full"), "content")
    known = registry.select("doc_id", "path").dropDuplicates(["doc_id"]).withColumn("name", F.element_at(F.split("path", "/"), -1))
    # Equal file names first, so that the join has a key; then the whole path.
    same = (F.element_at(F.split("full", "/"), -1) == F.col("name")) & F.endswith("full", F.concat(F.lit("/"), F.col("path")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(doc_id, kind, json.dumps(r, ensure_ascii=False)) for kind, r in records(reader.read(content.as_py()))]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[i : i + 10_000])], ["doc_id", "kind", "record"])

    return files.join(known, same).select("doc_id", "content").mapInArrow(each, "doc_id string, kind string, record string")


def tables_of(found: DataFrame) -> dict[str, DataFrame]:
    """The tables of plans.ingest.Inputs, by its names, from a table of read_pages."""
    out = {}
    for kind, schema in _SHAPES.items():
        rows = found.where(F.col("kind") == kind).select("doc_id", F.from_json("record", schema).alias("r"))
        out["cells" if kind == "grids" else kind] = rows.select("doc_id", "r.*")
    return out
