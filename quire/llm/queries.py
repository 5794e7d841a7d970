"""The registered queries of the corpus operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, langid, licenses, linededup, mixing, packing, pii, simhash, wrapper
from .common import table


def tokenizer() -> str:
    """Where the byte-level BPE file lies on the machine at hand."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), keep_ids=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even shares of sources, languages after MIXTURE, topics as observed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, MIXTURE).select("doc_id", "source", "lang", F.col("topic_used").alias("topic"), F.col("tokens_used").alias("tokens"), "probability", "kept")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.link(table(spark, sf_dir, "embeddings"), 0.9)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


#: Target shares of tokens: None asks for even ones, none named for those observed.
MIXTURE: dict[str, dict[str, float] | None] = {
    "source": None,
    "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15},
    "topic": {},
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_langid": op7_langid,
    "op8_ann": op8_ann,
    "op9_linededup": op9_linededup,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": """
WITH RECURSIVE fit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(n, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.n, link.w FROM reach JOIN link ON link.u = reach.r),
root AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
degree AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN root ON n = vec_id LEFT JOIN degree ON u = vec_id""",
    "op5_licenses": licenses.summary_sql(),
}
