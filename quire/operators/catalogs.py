"""The register, bit-field and general-table catalogs.

Tables carry line_no (their place in the shared file); last-wins and first-wins follow it. Nothing is collected: every
document is built in the same plan, so many documents cost one job, not one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as T

SUMMARY_COLUMNS = tuple(C.SUMMARY_COLUMNS)
KEY = ["peripheral", "register_name", "doc_id"]


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by `order`, as an upsert that the last write wins."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def summary_index(tables: DataFrame) -> DataFrame:
    """(doc_id, upper_name, address, reset_value, access): from tables that list registers; for each column the first
    value that is not empty counts."""
    listing = tables.where(~F.coalesce("is_register", F.lit(False)) & C.is_summary_header(F.coalesce("header", F.array().cast("array<string>"))))
    rows = listing.select("doc_id", "line_no", F.posexplode("rows").alias("row_idx", "row")).withColumn("e", C.lowered_cells(F.col("row")))
    named = rows.select("doc_id", "line_no", "row_idx", F.upper(C.find_column(F.col("e"), C.NAME_COLUMNS)).alias("upper_name"), *[C.find_column(F.col("e"), a).alias(n) for n, a in C.SUMMARY_COLUMNS.items()]).where("upper_name <> ''")
    return named.groupBy("doc_id", "upper_name").agg(*[F.min_by(F.col(n), F.when(F.col(n) != "", F.struct("line_no", "row_idx"))).alias(n) for n in C.SUMMARY_COLUMNS])


def build_registers(tables: DataFrame, blocks: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registers, bit_fields). Name, section and peripheral: the table's own, else the page's prose; address, reset and
    access: a summary table's, else the page's prose, else empty. Fields follow the table that wins its key."""
    from .layout import first_per_page

    docs = registry.select("doc_id", "revision").dropDuplicates(["doc_id"])
    own = tables.where(F.coalesce("is_register", F.lit(True))).join(docs, "doc_id")
    page = first_per_page(blocks).select("doc_id", "page", F.col("section_path").alias("page_section"), F.array_join("texts", " ").alias("prose"))
    near = own.join(page, ["doc_id", "page"], "left").withColumn("prose", F.coalesce("prose", F.lit("")))
    # A record that misses any of the three is completed from the page.
    name = T.or_else(F.col("register_name"), T.or_else(T.prose_register(F.col("prose")), F.concat(F.lit("REG_"), F.col("line_no").cast("string"))))
    section = T.or_else(F.col("section_path"), F.coalesce("page_section", F.lit("")))
    peripheral = T.or_else(F.col("peripheral"), T.guess_peripheral(F.col("page_section")))
    named = near.withColumns({"register_name": name, "section_path": section, "peripheral": peripheral})
    summed = named.join(summary_index(tables).withColumnRenamed("doc_id", "sdoc"), (F.col("doc_id") == F.col("sdoc")) & (F.upper("register_name") == F.col("upper_name")), "left")
    facts = {
        "address": T.or_else(F.col("address"), T.strip(T.first_match(F.col("prose"), T.ADDRESS))),
        "reset_value": T.or_else(F.col("reset_value"), T.strip(T.first_match(F.col("prose"), T.RESET))),
        "access": T.or_else(F.col("access"), T.first_match(F.col("prose"), T.ACCESS)),
    }
    full = summed.withColumns(facts).withColumn("fields", C.bit_fields(F.col("rows")))
    won = latest(full, KEY, F.desc("line_no"))
    said = lambda x, *names: {n: T.json_text(x(n)) for n in names}
    each = F.transform("fields", lambda f: T.json_object(**said(f.getField, "bits", "symbol", "access", "reset", "description")))
    document = T.json_object(**said(F.col, "register_name", "address", "reset_value", "access"), bit_fields=T.json_array(each))
    registers = won.select("peripheral", "register_name", "address", F.lit(32).alias("size_bits"), "reset_value", "access", "doc_id", "revision", "section_path", F.col("page").alias("page_start"), F.col("page").alias("page_end"), document.alias("json"), "line_no")
    fields = won.select(*KEY, F.posexplode("fields").alias("field_ord", "f")).select(*KEY, "f.bits", "f.symbol", "f.access", "f.reset", "f.description", "field_ord")
    return registers, fields


def empty_facts(registers: DataFrame) -> DataFrame:
    """One row: registers, and how many of them have no address, no reset value, no access."""
    return registers.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit("")) == "").alias(f"no_{c}") for c in SUMMARY_COLUMNS])


def with_table_ids(tables: DataFrame) -> DataFrame:
    """General tables with clean headers and table_id; a repeated id gets -1, -2, ... in file order, within a document."""
    kept = tables.where(C.is_general_table(F.col("is_register"), F.col("header"), F.col("rows")) & F.col("doc_id").isNotNull())
    based = kept.withColumn("header", C.clean_header(F.col("header"))).withColumn("base", T.table_id(F.col("table_title"), F.col("page"), F.col("table_idx")))
    return number_repeats(based, ["doc_id"], "base", "line_no", "table_id").drop("base")


def number_repeats(df: DataFrame, keys: list[str], base: str, order: str, name: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys, base).orderBy(order)) - 1
    return df.withColumn(name, F.when(nth == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), nth.cast("string"))))


def build_general_tables(tables: DataFrame, registry: DataFrame) -> DataFrame:
    docs = registry.select("doc_id", "chip_part").dropDuplicates(["doc_id"])
    ided = latest(with_table_ids(tables), ["table_id", "doc_id"], F.desc("line_no")).join(docs, "doc_id")
    return ided.select(
        "table_id", F.coalesce("table_title", F.lit("")).alias("title"), T.markdown_table(F.col("header"), F.col("rows"), F.col("table_title")).alias("markdown"), "doc_id", "chip_part",
        T.or_else(F.col("section_path"), T.UNKNOWN_SECTION).alias("section_path"), "page",
    )
