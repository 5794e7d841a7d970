"""Lookups and filtered nearest-neighbour search.

Operators return DataFrames; the functions of `Manuals` answer one question each, as lists and dicts, as a tool would.
Distances are squared Euclidean ones of unit vectors, 2 - 2 cos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as T
from ..functions.text import query_prefix
from .catalogs import KEY
from .embed import Embedder, embed

DEFAULT_K, MOST_K, LEAST_SIMILARITY = 6, 10, 0.30
FARTHEST = 2 * (1 - LEAST_SIMILARITY)
#: Parts that the rows of one chip are split into where many queries are answered at once.
SPLITS = 16
#: What an answer tells of its chunk.
FACTS = ("element_type", "section_path", "render_text", "peripheral", "register_name", "figure_id", "image_path", "table_id", "citation")
CHUNK = (*FACTS, "page_start", "figure_refs", "table_refs")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, vector: list[float], k: int, tie: str, embedding: str = "embedding") -> DataFrame:
    """The k nearest rows with their distance: a top-k of each partition, merged."""
    target = F.array(*[F.lit(float(x)) for x in vector])
    return rows.withColumn("distance", squared_distance(F.col(embedding), target)).orderBy("distance", tie).limit(min(k, MOST_K))


def guarded(found: DataFrame, farthest: float = FARTHEST) -> DataFrame:
    """found, or nothing where even the nearest is too far."""
    best = F.min("distance").over(Window.partitionBy())
    return found.withColumn("best", best).where(F.col("best") <= farthest).drop("best")


def nearest_each(queries: DataFrame, rows: DataFrame, by: str, k: int, farthest: float = FARTHEST, own: str = "query_id") -> DataFrame:
    """For each query (query_id, `by`, vector) its k nearest rows (id, `by`, embedding) of equal `by`, the one of the id in `own` left out,
    with rank and whether the guard lets the answer pass.

    Rows are split by id within `by` and every query meets each part, so that a hot value is no single task; only the k
    nearest of a query in a task are dealt out again.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(SPLITS))
    split = queries.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))).join(rows.withColumn("__part", part.cast("int")), [by, "__part"])
    pairs = split.where(F.coalesce(F.col(own) != F.col("id"), F.lit(True))).select("query_id", "id", squared_distance(F.col("vector"), F.col("embedding")).alias("distance"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.withColumn("accepted", F.min("distance").over(Window.partitionBy("query_id")) <= farthest)


def name_matches(column: Column, name: str) -> Column:
    """Equal, or beginning alike whatever the case; `_` and `%` in the name stand for any character and characters."""
    return (column == name) | column.ilike(name.replace("\\", "\\\\") + "%")


def registers_named(registers: DataFrame, bit_fields: DataFrame, doc_id: str, name: str) -> DataFrame:
    """Registers of a document by name or its beginning, each with its fields in order."""
    hits = registers.where((F.col("doc_id") == doc_id) & name_matches(F.col("register_name"), name))
    field = F.struct("field_ord", "bits", "symbol", "access", "reset", "description")
    return _with_fields(hits, bit_fields.where(F.col("doc_id") == doc_id)).drop("doc_id").orderBy("peripheral", "register_name")


def registers_named_each(asked: DataFrame, registers: DataFrame, bit_fields: DataFrame) -> DataFrame:
    """registers_named for many questions (query_id, doc_id, name) at once: the hits of each, with its query_id and doc_id.

    A document's registers are split by their names and every question meets each part, so that a hot one is no single task.
    """
    part = F.pmod(F.xxhash64("register_name"), F.lit(SPLITS)).cast("int")
    split = asked.select("query_id", "doc_id", "name", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("__part"))
    beginning = F.concat(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    match = (F.col("register_name") == F.col("name")) | F.ilike("register_name", beginning)
    return _with_fields(registers.withColumn("__part", part).join(split, ["doc_id", "__part"]).where(match), bit_fields, "query_id")


def _with_fields(hits: DataFrame, bit_fields: DataFrame, *more: str) -> DataFrame:
    """Registers as answers, each with its fields in order; those of the hits alone are gathered."""
    field = F.struct("field_ord", "bits", "symbol", "access", "reset", "description")
    mine = bit_fields.join(hits.select(*KEY), KEY, "left_semi")
    fields = mine.groupBy(*KEY).agg(F.array_sort(F.collect_list(field)).alias("f"))
    joined = hits.join(fields, KEY, "left")
    return joined.select(
        *more, "doc_id", "peripheral", "register_name", "address", "size_bits", "reset_value", "access", T.or_else(F.col("section_path"), T.UNKNOWN_SECTION).alias("section_path"), F.coalesce("page_start", F.lit(0)).alias("page"),
        F.coalesce(F.transform("f", lambda x: x.dropFields("field_ord")), F.array().cast(f"array<{_FIELD}>")).alias("bit_fields"),
    )


_FIELD = "struct<bits:string,symbol:string,access:string,reset:string,description:string>"


def best_fields(fields: DataFrame, keys: list[str], wanted: Column, order: str) -> DataFrame:
    """One field for each key: the first whose symbol is `wanted` in any case, else the first whose bits hold it."""
    symbol = F.coalesce((F.col("symbol") != "") & (F.lower("symbol") == F.lower(wanted)), F.lit(False))
    rank = F.when(symbol, 0).when(C.bit_matches(F.col("bits"), wanted), 1)
    hits = fields.withColumn("match_rank", rank).where("match_rank is not null")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("match_rank", order))
    return hits.withColumn("__n", nth).where("__n = 1").drop("__n")


class Manuals:
    """Questions over a catalog: registry, registers, bit_fields, general_tables and an index of embedded chunks."""

    def __init__(self, registry: DataFrame, registers: DataFrame, bit_fields: DataFrame, general_tables: DataFrame, index: DataFrame, embedder: Embedder):
        self.registry, self.registers, self.bit_fields, self.general_tables, self.index, self.embedder = registry, registers, bit_fields, general_tables, index, embedder

    def _document(self, chip_part: str, last: bool = True):
        """The registry entry of a chip: of several the last (for figures the first)."""
        order = F.desc("line_no") if last else F.asc("line_no")
        return self.registry.where(F.col("chip_part") == chip_part).orderBy(order).first()

    def _otherwise(self):
        """For chips that the registry lacks: the entry of the chip that comes first in it."""
        first = self.registry.orderBy("line_no").first()
        return first and self._document(first["chip_part"])

    @staticmethod
    def _citation(doc, section: str, page: int) -> str:
        return f"【{doc['doc_id']} Rev.{doc['revision']} | {section} | p.{page}】"

    def search(self, query: str, chip_part: str, top_k: int = DEFAULT_K) -> list[dict] | str:
        """The nearest chunks of a chip, or a sentence that refuses where there are none or all are too far."""
        doc = self._document(chip_part) or self._otherwise()
        refusal = f"No relevant content found in {chip_part} UM Rev.{doc['revision'] if doc else ''}."
        rows = guarded(nearest(self.index.where(F.col("chip_part") == chip_part), self.embedder.query(query).tolist(), top_k, "render_text")).orderBy("distance", "render_text").collect()
        if not rows:
            return refusal
        split = lambda s: s.split(",") if s else []
        return [{c: r[c] for c in FACTS} | {"page": r["page_start"], "score": round(r["distance"], 4), "figure_refs": split(r["figure_refs"]), "table_refs": split(r["table_refs"])} for r in rows]

    def search_each(self, questions: DataFrame, top_k: int = DEFAULT_K) -> DataFrame:
        """search for many questions (query_id, query, chip_part) at once, as rows: (query_id, rank, score, refusal, the
        chunk's columns). A question without an answer is one row with a refusal and no chunk.

        query_id tells questions apart; a null query is an empty one. Among equally near chunks the smaller text comes
        first; chunks equal in text and citation are one.
        """
        asked = questions.select("query_id", "chip_part", F.concat(F.lit(query_prefix(self.embedder.model)), F.coalesce("query", F.lit(""))).alias("query"))
        asked = embed(asked, "query", self.embedder, "vector").select("query_id", "chip_part", "vector")
        key = F.struct("render_text", "citation")
        index = self.index.withColumn("id", key).dropDuplicates(["chip_part", "id"])
        near = nearest_each(asked.withColumn("own", F.lit(None).cast(index.schema["id"].dataType)), index.select("id", "chip_part", "embedding"), "chip_part", min(top_k, MOST_K), own="own")
        passed = near.where("accepted").join(asked.select("query_id", "chip_part"), "query_id").join(index.select("id", "chip_part", *CHUNK), ["chip_part", "id"])
        latest = self.registry.groupBy("chip_part").agg(F.max_by("revision", "line_no").alias("latest"), F.min("line_no").alias("from"))
        first = latest.agg(F.min_by("latest", "from").alias("first"))
        revision = F.coalesce("latest", "first", F.lit(""))
        refusal = F.when(F.col("rank").isNull(), F.concat(F.lit("No relevant content found in "), "chip_part", F.lit(" UM Rev."), revision, F.lit(".")))
        found = passed.select("query_id", "rank", F.round("distance", 4).alias("score"), *CHUNK)
        told = questions.select("query_id", "chip_part").join(latest.drop("from"), "chip_part", "left").join(F.broadcast(first))
        return told.join(found, "query_id", "left").select("query_id", "rank", "score", refusal.alias("refusal"), *CHUNK)

    def register_lookup(self, name: str, chip_part: str) -> list[dict]:
        doc = self._document(chip_part)
        if doc is None:
            return []
        rows = registers_named(self.registers, self.bit_fields, doc["doc_id"], name).collect()
        return [r.asDict(recursive=True) | {"citation": self._citation(doc, r["section_path"], r["page"])} for r in rows]

    def query_register_field(self, register_name: str, bit_or_symbol: str, chip_part: str) -> dict | None:
        """One field of the register of exactly this name (of several the first stored)."""
        doc = self._document(chip_part)
        if doc is None:
            return None
        register = self.registers.where((F.col("doc_id") == doc["doc_id"]) & (F.col("register_name") == register_name)).orderBy("line_no").limit(1)
        field = best_fields(self.bit_fields.join(register.select(*KEY), KEY), KEY, F.lit(bit_or_symbol), "field_ord")
        found = register.select(*KEY, "address", "section_path", "page_start").join(field, KEY).first()
        if found is None:
            return None
        section, page = found["section_path"] or T.UNKNOWN_SECTION, found["page_start"] or 0
        kept = ("peripheral", "register_name", "address", "bits", "symbol", "access", "reset", "description")
        return {c: found[c] for c in kept} | {"section_path": section, "page": page, "citation": self._citation(doc, section, page)}

    def get_figure(self, figure_id: str, chip_part: str) -> dict | None:
        hits = self.index.where((F.col("figure_id") == figure_id) & (F.col("chip_part") == chip_part)).withColumn("parts", T.caption_parts(F.col("render_text")))
        doc = self._document(chip_part, last=False)
        known = [F.lit(doc[c] if doc else "") for c in ("doc_id", "revision")]
        cited = T.figure_citation(F.col("citation"), *known, T.or_else(F.col("section_path"), T.UNKNOWN_SECTION), F.coalesce("page_start", F.lit(0)), F.lit(figure_id))
        found = hits.withColumn("cited", cited).orderBy("page_start", "render_text").first()
        if found is None:
            return None
        section, page = found["section_path"] or T.UNKNOWN_SECTION, found["page_start"] or 0
        return {"figure_id": figure_id, "caption": found["parts"]["caption"], "vlm_summary": found["parts"]["summary"], "image_path": found["image_path"], "section_path": section, "page": page, "citation": found["cited"]}

    def get_table(self, table_id: str, chip_part: str) -> dict | None:
        doc = self._document(chip_part)
        found = doc and self.general_tables.where((F.col("doc_id") == doc["doc_id"]) & (F.col("table_id") == table_id)).orderBy("page", "title").first()
        if not found:
            return None
        section, page = found["section_path"] or T.UNKNOWN_SECTION, found["page"] or 0
        return {"table_id": table_id, "title": found["title"], "markdown": found["markdown"], "section_path": section, "page": page, "citation": self._citation(doc, section, page)}

    def _entries(self, last: bool = True) -> DataFrame:
        """(chip_part, doc, rev): one registry entry for each chip, the last of several (for figures the first)."""
        entry = (F.max_by if last else F.min_by)(F.struct("doc_id", "revision"), "line_no")
        return self.registry.groupBy("chip_part").agg(entry.alias("e")).select("chip_part", F.col("e.doc_id").alias("doc"), F.col("e.revision").alias("rev"))

    @staticmethod
    def _first(rows: DataFrame, *order: str) -> DataFrame:
        """The first row of each question."""
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return rows.withColumn("__n", nth).where("__n = 1").drop("__n")

    def register_lookup_each(self, questions: DataFrame) -> DataFrame:
        """register_lookup for many questions (query_id, name, chip_part) at once; those without a hit have no row.

        Here as in the other batch forms: query_id tells questions apart, nulls match nothing, further columns are not read.
        """
        asked = questions.select("query_id", "name", "chip_part").join(self._entries(), "chip_part").select("query_id", "name", "rev", F.col("doc").alias("doc_id"))
        found = registers_named_each(asked, self.registers, self.bit_fields).join(asked.select("query_id", "rev"), "query_id")
        return found.withColumn("citation", T.citation(F.col("doc_id"), F.col("rev"), F.col("section_path"), F.col("page"))).drop("doc_id", "rev")

    def query_register_field_each(self, questions: DataFrame) -> DataFrame:
        """query_register_field for many questions (query_id, register_name, bit_or_symbol, chip_part) at once."""
        asked = questions.select("query_id", "register_name", "bit_or_symbol", "chip_part").join(self._entries(), "chip_part").select("query_id", "register_name", "bit_or_symbol", "rev", F.col("doc").alias("doc_id"))
        section, page = T.or_else(F.col("section_path"), T.UNKNOWN_SECTION), F.coalesce("page_start", F.lit(0))
        mine = self.registers.select(*KEY, "address", section.alias("section_path"), page.alias("page"), "line_no")
        register = self._first(asked.join(mine, ["doc_id", "register_name"]), "line_no")
        found = best_fields(self.bit_fields.join(register, KEY), ["query_id"], F.col("bit_or_symbol"), "field_ord")
        cited = T.citation(F.col("doc_id"), F.col("rev"), F.col("section_path"), F.col("page"))
        return found.select("query_id", "peripheral", "register_name", "address", "bits", "symbol", "access", "reset", "description", "section_path", "page", cited.alias("citation"))

    def get_figure_each(self, questions: DataFrame) -> DataFrame:
        """get_figure for many questions (query_id, figure_id, chip_part) at once."""
        hits = self._first(questions.select("query_id", "figure_id", "chip_part").join(self.index.drop("embedding"), ["figure_id", "chip_part"]), "page_start", "render_text").drop("doc_id")
        section, page = T.or_else(F.col("section_path"), T.UNKNOWN_SECTION), F.coalesce("page_start", F.lit(0))
        known = hits.join(self._entries(last=False), "chip_part", "left").withColumn("parts", T.caption_parts(F.col("render_text")))
        cited = T.figure_citation(F.col("citation"), F.coalesce("doc", F.lit("")), F.coalesce("rev", F.lit("")), section, page, F.col("figure_id"))
        return known.select("query_id", "figure_id", F.col("parts.caption").alias("caption"), F.col("parts.summary").alias("vlm_summary"), "image_path", section.alias("section_path"), page.alias("page"), cited.alias("citation"))

    def get_table_each(self, questions: DataFrame) -> DataFrame:
        """get_table for many questions (query_id, table_id, chip_part) at once."""
        asked = questions.select("query_id", "table_id", "chip_part").join(self._entries(), "chip_part").select("query_id", "table_id", "rev", F.col("doc").alias("doc_id"))
        found = self._first(asked.join(self.general_tables.drop("chip_part"), ["doc_id", "table_id"]), "page", "title")
        section, page = T.or_else(F.col("section_path"), T.UNKNOWN_SECTION), F.coalesce("page", F.lit(0))
        return found.select("query_id", "table_id", "title", "markdown", section.alias("section_path"), page.alias("page"), T.citation(F.col("doc_id"), F.col("rev"), section, page).alias("citation"))

    def search_um(self, query: str, chip_part: str, top_k: int = DEFAULT_K) -> list[dict] | dict:
        """search for callers that want a structure: a refusal comes as one."""
        found = self.search(query, chip_part, top_k)
        return {"refusal": found} if isinstance(found, str) else found
