"""Reading and writing the files of a document store: JSON lines with line numbers, registries, partitioned tables.

A store is a folder (of any file system that Spark writes to) with one Parquet table for each name, partitioned by
doc_id, so that one document is read, replaced and deleted without touching others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

SCHEMAS = {
    "blocks": f"{schemas.BLOCKS}, line_no long",
    "figures": f"{schemas.FIGURES}, line_no long",
    "raw_tables": f"{schemas.RAW_TABLES}, line_no long",
    "registers": schemas.REGISTERS,
    "bit_fields": schemas.BIT_FIELDS,
    "general_tables": schemas.GENERAL_TABLES,
    "chunks": schemas.CHUNKS,
    "index": schemas.INDEX,
}
TABLES = tuple(SCHEMAS)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows in the order of their lines, numbered from 0 in line_no; blank lines are numbered but left out.

    Line numbers are those of one import: files in order of their paths, lines in order within.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"))
    # Ranks by file and block first, so that no single task sorts all lines.
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "block", "start", "first")
    # A block is read by one task in order, so that its lines are numbered without gaps: only the small table is dealt out.
    numbered = lines.join(starts, ["file", "block"]).withColumn("line_no", (F.col("start") + F.col("seen") - F.col("first")).cast("long"))
    return numbered.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "line_no").select("r.*", "line_no")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.drop("line_no").write.mode("append" if append else "overwrite").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents, with line_no as their place in it."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schemas.REGISTRY.replace(' string', ': string')}>>")).alias("line_no", "r"))
    return whole.select("r.*", F.col("line_no").cast("long").alias("line_no"))


def by_chip(registry: DataFrame) -> DataFrame:
    """One document for each chip_part: the last of several."""
    last = Window.partitionBy("chip_part").orderBy(F.desc("line_no"))
    return registry.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def first_lines(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("line_no").limit(n)


class Store:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, name: str) -> bool:
        fs, where = self._files(self.path(name))
        return fs.exists(where)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table, in its declared schema where it has one; one of no rows where it was never written."""
        schema = schema or SCHEMAS.get(name)
        if not self.exists(name) and schema:
            return self.spark.createDataFrame([], schema)
        kept = self.spark.read
        return (kept.schema(schema) if schema else kept).parquet(self.path(name))

    def overwrite(self, name: str, df: DataFrame) -> None:
        df.hint("rebalance", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("doc_id").parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        df.hint("rebalance", "doc_id").write.mode("append").partitionBy("doc_id").parquet(self.path(name))

    def _document_files(self, name: str, doc_id: str):
        part = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(doc_id)
        return self._files(f"{self.path(name)}/doc_id={part}")

    def _file_names(self, name: str, doc_id: str) -> set[str]:
        fs, where = self._document_files(name, doc_id)
        return {f.getPath().getName() for f in fs.listStatus(where)} if fs.exists(where) else set()

    def replace_documents(self, name: str, df: DataFrame, doc_ids: list[str]) -> None:
        """The rows of these documents and no others are exchanged; documents that df lacks lose theirs."""
        before = {d: self._file_names(name, d) for d in set(doc_ids)}
        written = df.where(F.col("doc_id").isin(doc_ids)).hint("rebalance", "doc_id")
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(self.path(name))
        # Every write names its files anew: a document that still has one of its old files got no rows.
        for doc_id, names in before.items():
            if names & self._file_names(name, doc_id):
                self.delete_document(name, doc_id)

    def delete_document(self, name: str, doc_id: str) -> None:
        fs, where = self._document_files(name, doc_id)
        fs.delete(where, True)

    def wipe(self, names: tuple[str, ...] = TABLES) -> None:
        for name in names:
            fs, where = self._files(self.path(name))
            fs.delete(where, True)

    def last_written(self, name: str) -> float | None:
        """Seconds since 1970 of the newest file of a table."""
        if not self.exists(name):
            return None
        newest = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path(name)).agg(F.max("modificationTime").cast("double")).first()[0]
        return newest
