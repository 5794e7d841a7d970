"""The corpus pipeline: language identification, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
run() writes what each keeps to the shared folder before the next one reads it. SQL cannot express the stages, so there
is no ORACLE_SQL; tests hold each against a plain version.

Defined results of all stages: an empty table gives an empty one; texts of any length are read whole; further columns of
the input go no further. Null and empty texts are in no language and end at the first stage; where later stages get them
alone, line dedup keeps them, near-dedup takes them as one text, mixing keeps them, packing gives their end id. Null and
repeated doc_ids are rows like others, null ones the last in every order; equal rows fall to near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, linededup, mixing, packing, queries, similar
from quire.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language has less than this share of its positions is in no language.
LEAST_SCORE = 0.35
#: Even shares of tokens for sources, chosen ones for languages, topics as observed.
MIXTURE: dict[str, dict[str, float] | None] = {"source": None, "lang": queries.MIXTURE["lang"], "topic": {}}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; where lang is null, the predicted one takes its place."""
    found = langid.predict(docs, langid.fit(docs), COLUMNS)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has; documents of which nothing is left go."""
    found = linededup.dedup(docs, ("doc_id", "lang", "source", "n_chars"))
    changed = F.col("n_deleted") > 0
    kept = found.where(~changed | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return similar.representatives(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares."""
    return mixing.mix(docs, MIXTURE).where("kept").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with ids, in windows of 1024."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
