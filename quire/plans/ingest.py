"""From what readers found on pages to the searchable catalog: one plan over all documents, or over one."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import catalogs, chunks, layout
from ..operators.embed import Embedder, HashingEmbedder, build_index
from ..sources.files import Store


@dataclass
class Inputs:
    """What page readers hand over, for all documents: text blocks with line_no, contents lists, drawings, grids, pages.

    blocks: (doc_id, page, bbox, text, line_no); toc, drawings, cells and pages as in schemas.
    """

    blocks: DataFrame
    toc: DataFrame
    drawings: DataFrame
    cells: DataFrame
    pages: DataFrame


class Ingest:
    """Runs the steps in order; each writes its table, and the next reads what was written."""

    def __init__(self, store: Store, inputs: Inputs, embedder: Embedder | None = None):
        self.store, self.inputs, self.embedder = store, inputs, embedder or HashingEmbedder()

    def _put(self, name: str, df: DataFrame, only: str | None) -> None:
        if only:
            self.store.replace_documents(name, df, [only])
        else:
            self.store.overwrite(name, df)

    def run(self, registry: DataFrame, skip_figures: bool = False, skip_embed: bool = False, only_doc_id: str | None = None) -> Iterator[str]:
        """Yields a line as each step ends. A document without any block is reported and passed over."""
        docs = registry.where(F.col("doc_id") == only_doc_id) if only_doc_id else registry
        if only_doc_id and docs.isEmpty():
            raise LookupError(f"doc_id {only_doc_id!r} is not in the registry")
        mine = {k: v.join(docs.select("doc_id").distinct(), "doc_id", "left_semi") for k, v in vars(self.inputs).items()}
        for r in docs.select("doc_id").distinct().join(mine["blocks"].select("doc_id").distinct(), "doc_id", "left_anti").collect():
            yield f"skipped {r['doc_id']}: nothing was read from it"

        def blocks() -> DataFrame:
            return layout.resolve_sections(mine["blocks"].where(F.trim(F.coalesce("text", F.lit(""))) != ""), mine["toc"])

        def figures() -> DataFrame:
            if skip_figures:
                return self.store.spark.createDataFrame([], f"{schemas.FIGURES}, line_no long")
            return layout.figures(read("blocks"), mine["drawings"], mine["pages"])

        def read(name: str) -> DataFrame:
            table = self.store.read(name)
            return table.where(F.col("doc_id") == only_doc_id) if only_doc_id else table

        def tables() -> DataFrame:
            found = layout.tables(mine["cells"], read("blocks"), layout.figure_zones(read("figures")), mine["pages"])
            return number_lines(found)

        built: dict[str, DataFrame] = {}

        def registers() -> DataFrame:
            built["registers"], built["bit_fields"] = catalogs.build_registers(read("raw_tables"), read("blocks"), docs)
            return built["registers"]

        steps = [
            ("blocks", blocks),
            ("figures", figures),
            ("raw_tables", tables),
            ("registers", registers),
            ("bit_fields", lambda: built["bit_fields"]),
            ("general_tables", lambda: catalogs.build_general_tables(read("raw_tables"), docs)),
            ("chunks", lambda: chunks.build_chunks(read("blocks"), read("registers"), read("bit_fields"), read("figures"), read("raw_tables"), docs)),
            *([] if skip_embed else [("index", lambda: build_index(read("chunks"), self.embedder))]),
        ]
        for name, step in steps:
            began = time.monotonic()
            self._put(name, step(), only_doc_id)
            yield f"{name}: {read(name).count()} rows in {time.monotonic() - began:.1f} s"


def number_lines(tables: DataFrame) -> DataFrame:
    """line_no by document, page and place, without a sort of all rows in one task: documents are numbered by themselves."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_idx")) - 1
    return tables.withColumn("line_no", nth.cast("long"))
