"""Retrieval chunks: five builders over one set of columns, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.splitter import split_rows
from ..schemas import ELEMENT_TYPES
from .catalogs import KEY, with_table_ids


def _chunk(df: DataFrame, kind: str, **more: Column) -> DataFrame:
    """The columns of a chunk from (doc_id, revision, chip_part, section_path, page_start, page_end) and what differs."""
    empty = {c: F.lit("") for c in ("peripheral", "register_name", "figure_id", "image_path", "table_id")} | {c: F.array().cast("array<string>") for c in ("figure_refs", "table_refs")}
    more = empty | more
    return df.select(
        "doc_id", "revision", "chip_part", "section_path", "page_start", "page_end", F.lit(kind).alias("element_type"),
        *[more[c].alias(c) for c in ("peripheral", "register_name", "figure_id", "image_path", "table_id")], more["render_text"].alias("render_text"),
        T.citation(F.col("doc_id"), F.col("revision"), F.col("section_path"), F.col("page_start")).alias("citation"), more["figure_refs"].alias("figure_refs"), more["table_refs"].alias("table_refs"),
    )


def _known(df: DataFrame, registry: DataFrame, section: str = "section_path") -> DataFrame:
    docs = registry.select("doc_id", "revision", "chip_part").dropDuplicates(["doc_id"])
    return df.withColumn("section_path", T.or_else(F.col(section), T.UNKNOWN_SECTION)).join(docs, "doc_id")


def sections(blocks: DataFrame, keys: list[str], order: list[str], text: str, page: str) -> DataFrame:
    """For each key: full_text (texts in order, one to a line), page_start and page_end (of the first and last)."""
    item = F.array_sort(F.collect_list(F.struct(*order, F.col(page).alias("__p"), F.coalesce(F.col(text), F.lit("")).alias("__t"))))
    return blocks.groupBy(*keys).agg(item.alias("i")).select(*keys, F.array_join(F.transform("i", lambda x: x["__t"]), "\n").alias("full_text"), F.element_at("i", 1)["__p"].alias("page_start"), F.element_at("i", -1)["__p"].alias("page_end"))


def prose_chunks(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    placed = _known(blocks, registry).withColumn("y0", F.get("bbox", F.lit(1)))
    whole = sections(placed, ["doc_id", "revision", "chip_part", "section_path"], ["page", "y0", "line_no"], "text", "page").where(T.strip(F.col("full_text")) != "")
    cut = split_rows(whole, "full_text")
    return _chunk(cut, "prose", render_text=T.prose_text(F.col("section_path"), F.col("piece")), figure_refs=T.figure_refs(F.col("piece")), table_refs=T.table_refs(F.col("piece")))


def register_row_chunks(registers: DataFrame, bit_fields: DataFrame, registry: DataFrame) -> DataFrame:
    head = _known(registers.select(*KEY, "section_path", "page_start"), registry).withColumn("page_end", F.col("page_start"))
    rows = head.join(bit_fields.select(*KEY, "bits", "symbol", "access", "reset", "description"), KEY)
    said = T.register_row_text(F.col("section_path"), F.col("register_name"), *[F.col(c) for c in ("bits", "symbol", "access", "reset", "description")])
    return _chunk(rows, "register_row", peripheral=F.col("peripheral"), register_name=F.col("register_name"), render_text=said)


def figure_chunks(figures: DataFrame, registry: DataFrame) -> DataFrame:
    rows = _known(figures, registry).withColumns({"page_start": F.col("page"), "page_end": F.col("page")})
    said = T.figure_text(F.col("section_path"), F.col("figure_id"), F.coalesce("caption", F.lit("")), F.coalesce("vlm_summary", F.lit("")))
    return _chunk(rows, "figure", figure_id=F.col("figure_id"), image_path=F.coalesce("image_path", F.lit("")), render_text=said)


def table_chunks(tables: DataFrame, registry: DataFrame) -> DataFrame:
    """A summary for each general table, and a sentence for each of its rows that says anything."""
    rows = _known(with_table_ids(tables), registry).withColumns({"page_start": F.col("page"), "page_end": F.col("page")})
    summary = _chunk(rows, "table_summary", table_id=F.col("table_id"), render_text=T.table_summary(F.col("header"), F.col("rows"), F.col("table_title"), F.col("section_path")))
    each = rows.withColumn("row", F.explode("rows"))
    said = _chunk(each, "table_row", table_id=F.col("table_id"), render_text=T.row_sentence(F.col("header"), F.col("row"), F.col("table_title")))
    return summary.unionByName(said.where("render_text <> ''"))


def build_chunks(blocks: DataFrame, registers: DataFrame, bit_fields: DataFrame, figures: DataFrame, tables: DataFrame, registry: DataFrame) -> DataFrame:
    return prose_chunks(blocks, registry).unionByName(register_row_chunks(registers, bit_fields, registry)).unionByName(figure_chunks(figures, registry)).unionByName(table_chunks(tables, registry))


def counts_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("element_type", F.lit("unknown")).alias("element_type")).agg(F.count("*").alias("n"))


def missing_types(chunks: DataFrame) -> DataFrame:
    """(element_type): the kinds of chunks of which there is none."""
    need = chunks.sparkSession.createDataFrame([(x,) for x in ELEMENT_TYPES], "element_type string")
    return need.join(counts_by_type(chunks), "element_type", "left_anti")


def resolved_refs(chunks: DataFrame) -> DataFrame:
    """(doc_id, render_text, ref, kind, target): prose references joined with the figures and tables that they name."""
    said = chunks.where("element_type = 'prose'").select("doc_id", "render_text", F.explode(F.concat(F.transform("figure_refs", lambda r: F.struct(F.lit("figure").alias("kind"), r.alias("ref"))), F.transform("table_refs", lambda r: F.struct(F.lit("table").alias("kind"), r.alias("ref"))))).alias("r"))
    targets = chunks.where("element_type in ('figure', 'table_summary')").select("doc_id", F.when(F.col("element_type") == "figure", "figure").otherwise("table").alias("kind"), F.when(F.col("element_type") == "figure", F.col("figure_id")).otherwise(F.col("table_id")).alias("ref"), F.col("render_text").alias("target"))
    return said.select("doc_id", "render_text", "r.kind", "r.ref").join(targets, ["doc_id", "kind", "ref"], "left")
