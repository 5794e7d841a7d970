"""What the corpus operators share: inputs, staged tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits that a sketch of keys has at most (8 MB); more keys than it suits make more rows `maybe`, none wrong.
WORDS = 1 << 20
#: Rows and bytes of an Arrow batch that goes to a Python worker; Spark's own defaults hold many long texts at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH rows and bytes, which the session keeps for what follows."""
    for name, most in BATCH.items():
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def mapped(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(each, schema)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may already be gone when the interpreter ends
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: a short lineage that outlives executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/staged/" in x}:
        _remove(df.sparkSession, path)


def sketch(keys: DataFrame, *columns: str, words: int = WORDS) -> Callable[..., Column]:
    """A function of columns that is false only for values that no row of `keys` has.

    Rows it is false for need no join, and so no shuffle of their texts. A bit for each key, ten bits a key or as many as
    `words` allows; the bits are gathered where the keys are, and at most `words` words reach the driver, from where one
    row of them goes out as the value of a scalar subquery.
    """
    size = min(words, 1 << max(6, (keys.count() * 10 // 64).bit_length())) * 64
    at = keys.select(F.pmod(F.xxhash64(*columns), F.lit(size)).alias("b"))
    found = at.selectExpr("shiftright(b, 6) as w", "shiftleft(1L, cast(b & 63 as int)) as x").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found["w"].to_numpy()] = found["x"].to_numpy()
    held = keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))})).scalar()

    def maybe(*c: Column) -> Column:
        b = F.pmod(F.xxhash64(*c), F.lit(size))
        return F.getbit(F.element_at(held, (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    return maybe


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, root being the smallest node it reaches.

    edges: (u, v) of one integer type, in any direction and number; self loops are ignored. Alternating large-star and
    small-star steps; each round is written to the shared folder, so no lineage grows and nothing reaches the driver
    but a row count and a checksum.
    """
    now = staged(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        after = staged(_small_star(_large_star(now)), "stars")
        discard(now)
        now, was, before = after, before, mark(after)
        if was == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
    if before[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
