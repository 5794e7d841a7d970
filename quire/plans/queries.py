"""The registered queries: each operator over the driver's tables, whole, with the same in SQL.

The tables are no manuals; each query names the part that its columns play.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as T
from ..functions.splitter import split_rows
from ..operators import catalogs, chunks, layout, search
from ..operators.embed import HashingEmbedder, embed
from ..sources.files import Store, read_jsonl, write_jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    return day + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.expr("1000000") * F.date_part(F.lit("SECOND"), ts)).cast("long")


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


_VECTOR = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


@query(
    f"""WITH q AS (SELECT embedding AS v, label AS l FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round({_VECTOR.format(a="embedding", b="v")}, 4) AS distance FROM embeddings, q WHERE label = l ORDER BY {_VECTOR.format(a="embedding", b="v")}, vec_id LIMIT 6"""
)
def knn_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of one chip (label) nearest to a query: vector 0."""
    rows = load(spark, sf_dir, "embeddings")
    q = rows.where("vec_id = 0").select("embedding", "label").first()
    found = search.nearest(rows.where(F.col("label") == q["label"]), list(q["embedding"]), search.DEFAULT_K, "vec_id")
    return found.select("vec_id", F.round("distance", 4).alias("distance"))


@query(
    f"""WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {_VECTOR.format(a="q.embedding", b="e.embedding")} AS d
  FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs)
SELECT query_id, id, rank, round(d, 4) AS distance, min(d) OVER (PARTITION BY query_id) <= 1.4 AS accepted FROM ranked WHERE rank <= 6"""
)
def knn_refusal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all of its chip; the guard tests the nearest alone."""
    rows = load(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("vector"))
    found = search.nearest_each(queries, rows.select(F.col("vec_id").alias("id"), "label", "embedding"), "label", search.DEFAULT_K)
    return found.select("query_id", "id", "rank", F.round("distance", 4).alias("distance"), "accepted")


def _brands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as registers (brand: name, type: peripheral), their line items as bit fields."""
    registers = load(spark, sf_dir, "part").select(F.col("p_type").alias("peripheral"), F.concat("p_brand", F.lit("/"), text_of("p_partkey")).alias("register_name"), F.lit("m").alias("doc_id"), "p_partkey", text_of("p_retailprice").alias("address"))
    fields = load(spark, sf_dir, "lineitem").select(
        "l_partkey", text_of("l_orderkey").alias("bits"), text_of("l_linenumber").alias("symbol"), F.col("l_returnflag").alias("access"), F.col("l_linestatus").alias("reset"), text_of("l_suppkey").alias("description"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus").alias("field_ord"),
    )
    keyed = fields.join(registers.select("peripheral", "register_name", "doc_id", F.col("p_partkey").alias("l_partkey")), "l_partkey")
    return registers, keyed


@query("""SELECT p_type AS peripheral, p_brand || '/' || p_partkey AS register_name, count(l_partkey) AS n_fields,
  coalesce(string_agg(l_orderkey || ':' || l_linenumber || ':' || l_returnflag, ',' ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus), '') AS fields
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_brand || '/' || p_partkey ILIKE 'brand#1%' GROUP BY ALL""")
def record_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers by the beginning of their names, in any case, with their fields in order."""
    registers, fields = _brands(spark, sf_dir)
    made = registers.withColumns({"size_bits": F.lit(32), "reset_value": F.lit(""), "access": F.lit(""), "section_path": F.lit(""), "page_start": F.lit(1)})
    found = search.registers_named(made, fields, "m", "brand#1")
    said = F.transform("bit_fields", lambda f: F.concat_ws(":", f["bits"], f["symbol"], f["access"]))
    return found.select("peripheral", "register_name", F.size("bit_fields").cast("long").alias("n_fields"), F.array_join(said, ",").alias("fields"))


@query("""SELECT name, count(DISTINCT p_partkey) AS n_registers, count(l_partkey) AS n_fields FROM (SELECT DISTINCT p_brand AS name FROM part)
  JOIN part ON p_brand || '/' || p_partkey ILIKE name || '%' LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY name""")
def record_prefix_lookup_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookups of all brands at once, each by the beginning of its registers' names in lower case."""
    registers, fields = _brands(spark, sf_dir)
    made = registers.withColumns({"size_bits": F.lit(32), "reset_value": F.lit(""), "access": F.lit(""), "section_path": F.lit(""), "page_start": F.lit(1)})
    asked = load(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.lit("m").alias("doc_id"), F.lower("p_brand").alias("name")).distinct()
    found = search.registers_named_each(asked, made, fields)
    return found.groupBy(F.col("query_id").alias("name")).agg(F.count("*").alias("n_registers"), F.sum(F.size("bit_fields")).cast("long").alias("n_fields"))


def _part_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_type", "p_partkey", F.concat((F.col("p_size") + 3).cast("string"), F.lit(":"), text_of("p_size")).alias("bits"), F.col("p_brand").alias("symbol"))


@query("""SELECT p_type, p_partkey, bits, symbol FROM (SELECT p_type, p_partkey, concat(p_size + 3, ':', p_size) AS bits, p_brand AS symbol,
  row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN lower(p_brand) = 'brand#12' THEN 0 ELSE 1 END, p_partkey) AS n FROM part WHERE lower(p_brand) = 'brand#12') WHERE n = 1""")
def field_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.best_fields(_part_fields(spark, sf_dir), ["p_type"], F.lit("BRAND#12"), "p_partkey")
    return found.select("p_type", "p_partkey", "bits", "symbol")


@query("""SELECT p_type, p_partkey, bits, symbol FROM (SELECT p_type, p_partkey, concat(p_size + 3, ':', p_size) AS bits, p_brand AS symbol,
  row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part WHERE 17 BETWEEN p_size AND p_size + 3) WHERE n = 1""")
def field_by_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No symbol is a number, so a number finds the first range that holds it."""
    found = search.best_fields(_part_fields(spark, sf_dir), ["p_type"], F.lit("17"), "p_partkey")
    return found.select("p_type", "p_partkey", "bits", "symbol")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""WITH s AS (SELECT s_nationkey, arg_min(CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END, s_suppkey) AS summary FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(nullif(summary, ''), nullif(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE c_mktsegment END, ''), '') AS address FROM customer LEFT JOIN s ON s_nationkey = c_nationkey""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register's fact: from the summary table, else from prose, else empty."""
    summary = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by(F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(""), "s_suppkey").alias("summary"))
    prose = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").otherwise(F.col("c_mktsegment"))
    joined = load(spark, sf_dir, "customer").join(summary, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("c_custkey", T.or_else(F.col("summary"), T.or_else(prose, "")).alias("address"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event (block) of a user (document) with the last signup (contents entry) at or before it."""
    events = load(spark, sf_dir, "events")
    marks = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("ord"), F.col("event_id").alias("section"))
    return layout.latest_before(events.select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", ["ord"], "section").select("event_id", "user_id", "section")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as vertical spans of a user's page, in microseconds: as long as their value in seconds."""
    at = micros(F.col("ts"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("y0"), (at + F.round(F.col("value") * 1000).cast("long") * 1000).alias("y1"))


_SPANS = "spans AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS y0, epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000 AS y1 FROM events)"


@query(
    f"""WITH {_SPANS} SELECT event_id, user_id FROM spans s WHERE event_type = 'purchase' OR NOT EXISTS (
  SELECT 1 FROM spans z WHERE z.event_type = 'error' AND z.user_id = s.user_id AND s.y0 < z.y1 AND s.y1 > z.y0)"""
)
def zone_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans (tables) that no error (figure zone) of their user overlaps; purchases (register tables) are exempt."""
    spans = _spans(spark, sf_dir)
    zones = spans.where("event_type = 'error'").select("user_id", F.col("y0").alias("zone_y0"), F.col("y1").alias("zone_y1"))
    return layout.outside_zones(spans, zones, ["user_id"], F.col("y0"), F.col("y1"), F.col("event_type") == "purchase").select("event_id", "user_id")


@query(
    f"""WITH {_SPANS}, reach AS (SELECT *, max(y1) OVER (PARTITION BY user_id ORDER BY y0, y1, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans)
SELECT event_id, user_id, sum(CASE WHEN y0 > r + 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y0, y1, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM reach"""
)
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans (drawings) of a user in clusters, an hour without any between two."""
    return layout.clusters(_spans(spark, sf_dir), ["user_id"], "y0", "y1", 3_600_000_000, ("event_id",)).select("event_id", "user_id", F.col("cluster").cast("long").alias("cluster"))


@query("""SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, '')) AS full_text, min(turn) AS page_start, max(turn) AS page_end FROM conversations GROUP BY conv_id""")
def section_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns (blocks) of a conversation (section) as one text, with its first and last page."""
    return chunks.sections(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "text", "turn")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    said = F.concat(F.lit(". See fig. "), (k % 7 + 1).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit(" and Table "), (k % 9).cast("string"), F.lit("."), (k % 4).cast("string"), F.lit("; figure "), (k % 7 + 1).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit(" and timetable 3.1."))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))


@query("""WITH m AS (SELECT doc_id, coalesce(text, '') || '. See fig. ' || (doc_id % 7 + 1) || '.' || (doc_id % 5) || ' and Table ' || (doc_id % 9) || '.' || (doc_id % 4) || '; figure ' || (doc_id % 7 + 1) || '.' || (doc_id % 5) || ' and timetable 3.1.' AS t FROM documents)
SELECT DISTINCT doc_id, 'Figure ' || x AS ref FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)Fig(?:ure)?\\.?\\s+(\\d+\\.\\d+(?:\\.\\d+)?)', 1)) AS x FROM m)
UNION ALL SELECT DISTINCT doc_id, 'table-' || x AS ref FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)Table\\s+(\\d+\\.\\d+)', 1)) AS x FROM m)""")
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each figure and table that a document names."""
    return _mentions(spark, sf_dir).select("doc_id", F.explode(F.concat(T.figure_refs(F.col("text")), T.table_refs(F.col("text")))).alias("ref"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Table "), F.col("p_size").cast("string"), F.lit(".1 "), F.col("p_name"))).otherwise(F.concat(F.lit("-- "), F.col("p_name"), F.lit(" / "), F.col("p_type")))
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", title.alias("title"), F.col("p_size").alias("page"), (F.col("p_partkey") % 4).cast("int").alias("idx"))


_TITLES = """titles AS (SELECT p_partkey, p_brand, p_size, p_partkey % 4 AS idx, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Table ' || p_size || '.1 ' || p_name ELSE '-- ' || p_name || ' / ' || p_type END AS title FROM part),
ids AS (SELECT *, 'table-' || CASE WHEN title = '' THEN 'p' || p_size || '-' || idx WHEN title LIKE 'Table %' THEN p_size || '.1' ELSE substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) END AS table_id FROM titles)"""


@query(f"WITH {_TITLES} SELECT p_partkey, table_id FROM ids")
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("p_partkey", T.table_id(F.col("title"), F.col("page"), F.col("idx")).alias("table_id"))


@query(f"WITH {_TITLES}, nth AS (SELECT *, row_number() OVER (PARTITION BY p_brand, table_id ORDER BY p_partkey) - 1 AS n FROM ids) SELECT p_partkey, p_brand, table_id || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS table_id FROM nth")
def table_ids_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids of a document (brand) numbered in file order."""
    based = _titles(spark, sf_dir).withColumn("base", T.table_id(F.col("title"), F.col("page"), F.col("idx")))
    return catalogs.number_repeats(based, ["p_brand"], "base", "p_partkey", "table_id").select("p_partkey", "p_brand", "table_id")


def _region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grouped = nations.groupBy("r_regionkey", "r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("names"))
    rows = F.transform(F.array_sort(F.map_keys("names")), lambda k: F.create_map(F.lit("Key"), k.cast("string"), F.lit("Name"), F.concat(F.element_at("names", k), F.lit("\n")), F.lit("Odd"), F.when(k % 2 == 1, "yes")))
    return grouped.select("r_regionkey", F.when(F.col("r_regionkey") > 0, F.concat(F.lit("Table 1."), text_of("r_regionkey"), F.lit(" "), F.col("r_name"))).otherwise("").alias("title"), F.array(F.lit("Key"), F.lit("Name"), F.lit("Odd")).alias("header"), rows.alias("rows"))


@query("""SELECT r_regionkey, CASE WHEN r_regionkey > 0 THEN '**Table 1.' || r_regionkey || ' ' || r_name || '**' || chr(10) || chr(10) ELSE '' END || '| Key | Name | Odd |' || chr(10) || '|---|---|---|' || chr(10) ||
  string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 1 THEN 'yes' ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_tables(spark, sf_dir).select("r_regionkey", T.markdown_table(F.col("header"), F.col("rows"), F.col("title")).alias("markdown"))


@query("""SELECT r_regionkey, 'In ' || CASE WHEN r_regionkey > 0 THEN 'Table 1.' || r_regionkey || ' ' || r_name ELSE 'this table' END || ', Key is ' || n_nationkey || ', Name is ' || n_name || CASE WHEN n_nationkey % 2 = 1 THEN ', Odd is yes' ELSE '' END || '.' AS sentence
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def row_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _region_tables(spark, sf_dir).withColumn("row", F.explode("rows"))
    return each.select("r_regionkey", T.row_sentence(F.col("header"), F.col("row"), F.col("title")).alias("sentence"))


@query("""SELECT r_regionkey, CASE WHEN r_regionkey > 0 THEN 'Table 1.' || r_regionkey || ' ' || r_name ELSE 'Untitled table' END || ' (in §UNKNOWN) — a table with ' || count(*) || ' row(s). Columns: Key, Name, Odd.' AS summary FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def table_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_tables(spark, sf_dir).select("r_regionkey", T.table_summary(F.col("header"), F.col("rows"), F.col("title"), F.lit(T.UNKNOWN_SECTION)).alias("summary"))


def _head_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    first = F.when(k % 4 == 0, F.array(F.lit(" Bit"), F.lit("Symbol"))).when(k % 4 == 1, F.array(F.lit("Bits"), F.lit("Value"))).when(k % 4 == 2, F.array(F.lit("bit rate"), F.col("p_type"))).otherwise(F.array(F.col("p_name"), F.lit(None).cast("string")))
    second = F.when(k % 8 == 7, F.array(F.lit("BIT NAME"), F.lit("Initial Value"))).otherwise(F.array(F.col("p_brand"), F.lit("R/W")))
    return load(spark, sf_dir, "part").select("p_partkey", F.array(first, second, F.array(F.lit("Bit"), F.lit("Reset"))).alias("cells"))


@query("""SELECT p_partkey, p_partkey % 4 = 0 OR (p_partkey % 4 = 2 AND regexp_matches(lower(p_type), 'symbol|value|r/w|reset|description|function')) OR p_partkey % 8 = 7 AS is_register FROM part""")
def register_table_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bit column and a keyword, in the first two rows."""
    return _head_cells(spark, sf_dir).select("p_partkey", C.is_register_table(F.col("cells")).alias("is_register"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || ':0' ELSE '' END AS bits, p_brand AS symbol, '' AS access, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS reset, p_name AS description FROM part""")
def bit_field_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's columns under the names of fields; a column that is there counts, even where it is empty."""
    k = F.col("p_partkey")
    row = F.create_map(
        F.lit("Bit "), F.when(k % 2 == 0, F.concat(text_of("p_size"), F.lit(":0 "))).otherwise(""), F.lit("bits"), F.lit("9"), F.lit("Bit Name"), F.col("p_brand"), F.lit("NAME"), F.lit("x"), F.lit("Reset"), F.when(k % 3 == 0, "").otherwise(F.col("p_type")), F.lit("Value"), F.lit("y"), F.lit("Desc"), F.col("p_name"),
    )
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(C.bit_fields(F.array(row))).alias("f")).select("p_partkey", "f.*")


@query("""SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, '§' || coalesce(nullif(regexp_extract(url, '://([^/]+)', 1), ''), '?') || ' > §' || trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS section_path FROM pages""")
def title_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as contents entries: host above title."""
    title = F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    host = T.or_else(F.regexp_extract("url", "://([^/]+)", 1), "?")
    return load(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.array_join(F.transform(F.array(host, title), lambda p: F.concat(F.lit("§"), p)), " > ").alias("section_path"))


@query("""SELECT o_custkey, o_orderkey, string_agg('§' || t, ' > ' ORDER BY lv) AS label FROM (
  SELECT a.o_custkey, a.o_orderkey, b.lv, arg_max(b.t, b.o_orderkey) AS t FROM l a JOIN l b ON b.o_custkey = a.o_custkey AND b.o_orderkey <= a.o_orderkey AND b.lv <= a.lv
  WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.o_custkey = a.o_custkey AND c.o_orderkey > b.o_orderkey AND c.o_orderkey <= a.o_orderkey AND c.lv < b.lv) GROUP BY ALL) GROUP BY ALL""")
def toc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as contents entries at three levels."""
    toc = load(spark, sf_dir, "orders").select(text_of("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"), F.concat(F.lit("O"), text_of("o_orderkey")).alias("title"), F.lit(1).alias("page"))
    return layout.toc_labels(toc).select(F.col("doc_id").cast("long").alias("o_custkey"), F.col("ord").alias("o_orderkey"), "label")


SQL["toc_paths"] = "WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 + 1 AS lv, 'O' || o_orderkey AS t FROM orders) " + SQL["toc_paths"]


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the five kinds, one from each of five tables."""
    empty = {"doc_id": F.lit("m"), "revision": F.lit("1"), "chip_part": F.lit("c"), "section_path": F.lit(T.UNKNOWN_SECTION), "page_start": F.lit(1), "page_end": F.lit(1)}
    made = [
        chunks._chunk(load(spark, sf_dir, table).withColumns(empty), kind, render_text=text_of(said))
        for table, kind, said in (("conversations", "prose", "text"), ("lineitem", "register_row", "l_partkey"), ("pages", "figure", "url"), ("region", "table_summary", "r_name"), ("nation", "table_row", "n_name"))
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


_KINDS = """kinds AS (SELECT 'prose' AS element_type, text AS render_text FROM conversations UNION ALL SELECT 'register_row', l_partkey::VARCHAR FROM lineitem UNION ALL SELECT 'figure', url FROM pages UNION ALL SELECT 'table_summary', r_name FROM region UNION ALL SELECT 'table_row', n_name FROM nation)"""


@query(f"WITH {_KINDS} SELECT element_type, render_text, '【m Rev.1 | §UNKNOWN | p.1】' AS citation FROM kinds")
def union_chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("element_type", "render_text", "citation")


@query(f"WITH {_KINDS} SELECT element_type, count(*) AS n FROM kinds GROUP BY 1")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.counts_by_type(_kinds(spark, sf_dir))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS chunk_count, CASE WHEN c_acctbal < 0 THEN '❌ PDF missing' WHEN coalesce(n, 0) > 0 THEN '✅ Indexed' ELSE '⚠️ Not yet indexed' END AS status FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def list_documents_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as chunks."""
    from .admin import documents_status

    docs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_acctbal")
    counted = documents_status(docs, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")), docs.limit(0))
    return counted.select(F.col("doc_id").alias("c_custkey"), "chunk_count", T.status_badge(F.col("c_acctbal") >= 0, F.col("chunk_count")).alias("status"))


@query("""SELECT p_partkey, 'Figure 1.' || p_size || chr(10) || p_name || CASE WHEN p_partkey % 2 = 1 THEN '.' ELSE '' END AS caption, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS summary FROM part""")
def caption_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure's rendered text taken apart; without a summary the full stop stays with the caption."""
    figure = F.concat(F.lit("Figure 1."), text_of("p_size"))
    caption = F.concat(figure, F.lit("\n"), F.col("p_name"))
    said = T.figure_text(F.lit("§1 A"), figure, caption, F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", T.caption_parts(T.strip(said)).alias("p")).select("p_partkey", "p.caption", "p.summary")


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS is_caption, CASE WHEN p_partkey % 3 = 0 THEN 'Figure 4.' || p_size || '.1' END AS figure_id, CASE WHEN p_partkey % 3 = 0 THEN 'fig4_' || p_size || '_1' END AS slug FROM part""")
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption's title is on the next line; long texts and mentions within a line are none."""
    k = F.col("p_partkey")
    head = F.concat(F.lit(" Fig. 4."), text_of("p_size"), F.lit(".1 "))
    text = F.when(k % 3 == 0, F.concat(head, F.lit("\n"), F.col("p_name"))).when(k % 3 == 1, F.concat(head, F.col("p_name"))).otherwise(F.concat(head, F.lit("\n"), F.repeat("p_type", 200)))
    is_caption = T.is_caption(text)
    figure = F.when(is_caption, T.caption_figure_id(text))
    return load(spark, sf_dir, "part").select("p_partkey", is_caption.alias("is_caption"), figure.alias("figure_id"), T.figure_slug(figure).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'REG' || p_size || 'n' ELSE '' END AS register_name, p_type || ' Unit' AS peripheral, CASE WHEN p_size >= 10 THEN 'SCI' ELSE coalesce(nullif(regexp_extract(p_type, '\\b([A-Z]{2,8})\\b', 1), ''), 'UNKNOWN') END AS guessed,
  CASE WHEN p_size >= 10 THEN '0x4000' || p_size ELSE '' END AS address, CASE WHEN p_partkey % 5 = 0 THEN '00H' ELSE '' END AS reset_value, 'R/W' AS access, 'R' || p_size || '_REG' AS prose_name FROM part""")
def register_scraping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and facts from a section path and from prose."""
    size, k = text_of("p_size"), F.col("p_partkey")
    section = F.concat(F.lit("§8. "), F.col("p_type"), F.lit(" Unit > §8.1 "), F.when(F.col("p_size") >= 10, "SCI ").otherwise("Sci "), F.lit("x > §8.1.2 "), F.when(k % 2 == 0, F.concat(F.lit("REG"), size, F.lit("n/Alt : Control"))).otherwise("no name"))
    prose = F.concat(F.lit("The R1 and R"), size, F.lit("_REG are here. "), F.when(F.col("p_size") >= 10, F.concat(F.lit("Address: 0x4000"), size, F.lit(" "))).otherwise(""), F.when(k % 5 == 0, "Initial value 00H ").otherwise(""), F.lit("access R/W."))
    return load(spark, sf_dir, "part").select(
        "p_partkey", T.section_register(section).alias("register_name"), T.section_chapter(section).alias("peripheral"), T.guess_peripheral(section).alias("guessed"),
        T.strip(T.first_match(prose, T.ADDRESS)).alias("address"), T.strip(T.first_match(prose, T.RESET)).alias("reset_value"), T.first_match(prose, T.ACCESS).alias("access"), T.prose_register(prose).alias("prose_name"),
    )


@query("""SELECT page_id, upper(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9_-]+', '_', 'g')) AS doc_id FROM pages WHERE url IS NOT NULL""")
def suggested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").where("url is not null").select("page_id", T.suggest_id(F.col("url")).alias("doc_id"))


@query("""SELECT c_mktsegment AS chip_part, arg_max(c_custkey, c_custkey) AS doc_id FROM customer GROUP BY 1""")
def registry_by_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several documents of one chip the last counts."""
    from ..sources.files import by_chip

    rows = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("chip_part"), F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("line_no"))
    return by_chip(rows).select("chip_part", "doc_id")


@query("""SELECT '| ' || c_name || ' | ' || c_mktsegment || ' | ' || CASE WHEN c_nationkey = 0 THEN '(root)' ELSE c_nationkey::VARCHAR END || ' | ✅ Indexed | ' || c_custkey + 1 || ' | 0 |' AS line FROM customer""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") + 1
    line = T.document_line(F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_nationkey") == 0, "").otherwise(text_of("c_nationkey")), T.status_badge(F.lit(True), n), n, F.lit(0))
    return load(spark, sf_dir, "customer").select(line.alias("line"))


@query()
def split_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in pieces of at most 500 characters."""
    return split_rows(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query()
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the benchmark's passages."""
    made = embed(load(spark, sf_dir, "benchmark").select("item_id", "text"), "text", HashingEmbedder(64))
    return made.select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"), F.size("embedding").alias("width"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, upper(event_type) AS upper_name, event_id, CASE WHEN value > 200 THEN 'A' || event_id ELSE '' END AS a, CASE WHEN event_id % 3 = 0 THEN 'R' || event_id ELSE '' END AS r FROM events)
SELECT doc_id, upper_name, arg_min(a, event_id) FILTER (WHERE a <> '') AS address, arg_min(r, event_id) FILTER (WHERE r <> '') AS reset_value, arg_min('W' || event_id, event_id) AS access FROM e GROUP BY ALL""")
def first_nonempty_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the tables of a user (document) that list registers: the first address, reset and access of each name."""
    k = text_of("event_id")
    row = F.create_map(F.lit("Symbol"), F.col("event_type"), F.lit("Address"), F.when(F.col("value") > 200, F.concat(F.lit("A"), k)).otherwise(""), F.lit("Initial Value"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("R"), k)).otherwise(""), F.lit("R/W"), F.concat(F.lit("W"), k))
    tables = load(spark, sf_dir, "events").select(text_of("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.lit(False).alias("is_register"), F.array(*map(F.lit, ("Symbol", "Address", "Initial Value", "R/W"))).alias("header"), F.array(row).alias("rows"))
    return catalogs.summary_index(tables)


@query(
    f"""WITH {_SPANS} SELECT s.event_id, coalesce(max(p.y1), 75)::DOUBLE AS floor FROM spans s LEFT JOIN spans p ON p.user_id = s.user_id AND p.event_type = s.event_type AND p.y0 < s.y0 - 86400000000 GROUP BY s.event_id"""
)
def prev_floor_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as captions, a page for each user and type: the lowest end of those that begin more than a day before."""
    found = _spans(spark, sf_dir).select("event_id", F.col("user_id").alias("doc_id"), F.col("event_type").alias("page"), F.col("y0").alias("caption_y"), F.col("y1").cast("double").alias("caption_y1"))
    return layout.with_floor(found, 86_400_000_000).select("event_id", "floor")


@query("""WITH said AS (SELECT doc_id AS k, 'table-' || (doc_id % 9) || '.' || (doc_id % 4) AS ref, 'table' AS kind FROM documents UNION ALL SELECT doc_id, 'Figure ' || (doc_id % 7 + 1) || '.' || (doc_id % 5), 'figure' FROM documents),
target AS (SELECT 'table-' || (n_nationkey // 4) || '.' || (n_nationkey % 4) AS ref, 'table' AS kind, n_name AS target FROM nation UNION ALL SELECT 'Figure ' || (r_regionkey + 1) || '.' || r_regionkey, 'figure', r_name FROM region)
SELECT 'd' || k AS render_text, said.kind, said.ref, target FROM said LEFT JOIN target ON target.ref = said.ref AND target.kind = said.kind""")
def ref_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prose with references, nations as tables and regions as figures: references joined with their targets."""
    k, n, r = F.col("doc_id"), F.col("n_nationkey"), F.col("r_regionkey")
    dotted = lambda head, a, b: F.concat(F.lit(head), a.cast("string"), F.lit("."), b.cast("string"))
    none = F.array().cast("array<string>")
    said = F.concat(F.lit("See "), dotted("Table ", k % 9, k % 4), dotted(" and fig. ", k % 7 + 1, k % 5))
    columns = lambda kind, render, figures, tables, figure, table: [F.lit("m").alias("doc_id"), render.alias("render_text"), F.lit(kind).alias("element_type"), figures.alias("figure_refs"), tables.alias("table_refs"), figure.alias("figure_id"), table.alias("table_id")]
    empty = F.lit("")
    made = load(spark, sf_dir, "documents").select(*columns("prose", F.concat(F.lit("d"), k.cast("string")), T.figure_refs(said), T.table_refs(said), empty, empty))
    made = made.unionByName(load(spark, sf_dir, "nation").select(*columns("table_summary", F.col("n_name"), none, none, empty, T.table_id(dotted("Table ", F.floor(n / 4), n % 4), F.lit(1), F.lit(0)))))
    made = made.unionByName(load(spark, sf_dir, "region").select(*columns("figure", F.col("r_name"), none, none, dotted("Figure ", r + 1, r), empty)))
    return chunks.resolved_refs(made).select("render_text", "kind", "ref", "target")


@query("SELECT x AS element_type FROM unnest(['prose', 'register_row', 'figure', 'table_summary', 'table_row']) t(x) WHERE x NOT IN (SELECT CASE turn % 3 WHEN 0 THEN 'prose' WHEN 1 THEN 'figure' ELSE 'note' END FROM conversations)")
def missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks of a kind each: the kinds that are wanting."""
    kind = F.when(F.col("turn") % 3 == 0, "prose").when(F.col("turn") % 3 == 1, "figure").otherwise("note")
    return chunks.missing_types(load(spark, sf_dir, "conversations").select(kind.alias("element_type")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS no_address, count(*) FILTER (WHERE p_partkey % 5 < 2) AS no_reset_value, 0::BIGINT AS no_access FROM part")
def empty_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registers: how many lack a fact."""
    k = F.col("p_partkey")
    facts = load(spark, sf_dir, "part").select(F.when(k % 3 != 0, "0x0").otherwise("").alias("address"), F.when(k % 5 == 0, "").when(k % 5 > 1, "00H").alias("reset_value"), F.lit("R").alias("access"))
    return catalogs.empty_facts(facts)


def _folder(spark: SparkSession) -> str:
    """A folder of this session's own under spark.checkpoint.dir (where that is unset, on one machine, a temporary one)."""
    import atexit
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    path = f"{root}/store-{uuid.uuid4().hex}"
    fs, where = Store(spark, path)._files(path)
    atexit.register(lambda: spark.sparkContext._jsc and fs.delete(where, True))
    return path


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """Documents in a store, each source a document of it."""
    rows = load(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("doc_id"), F.col("doc_id").alias("k"), "lang", "n_chars")
    store = Store(spark, _folder(spark))
    store.overwrite("rows", rows)
    return store, rows


@query("""WITH d AS (SELECT coalesce(source, 'none') AS doc_id, doc_id AS k, lang, n_chars FROM documents)
SELECT doc_id, k, n_chars FROM d WHERE doc_id NOT IN ('src3', 'src1') UNION ALL SELECT doc_id, k + 1000000000, n_chars FROM d WHERE doc_id = 'src3' AND lang = 'en'""")
def replace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents (sources) of a store exchanged for new rows, of which one has none; all others are kept."""
    store, rows = _stored(spark, sf_dir)
    new = rows.where("doc_id = 'src3' and lang = 'en'").withColumn("k", F.col("k") + 1_000_000_000)
    store.replace_documents("rows", new, ["src3", "src1"])
    return store.read("rows", "k long, n_chars long, doc_id string").select("doc_id", "k", "n_chars")


@query("SELECT coalesce(source, 'none') AS doc_id, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE source <> 'src3' OR source IS NULL GROUP BY 1")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of a store deleted with its rows."""
    store, _ = _stored(spark, sf_dir)
    store.delete_document("rows", "src3")
    return store.read("rows", "k long, n_chars long, doc_id string").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no FROM nation""")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as JSON lines and read again, with their places."""
    path = _folder(spark)
    write_jsonl(load(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey"), path)
    return read_jsonl(spark, path, "n_nationkey int, n_name string")


def _rendered(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "element_type", "render_text", "citation")


def _documents(df: DataFrame) -> DataFrame:
    """A registry of what doc_id holds."""
    return df.select("doc_id", F.lit("2").alias("revision"), F.concat(F.lit("chip "), F.col("doc_id")).alias("chip_part")).distinct()


@query("""SELECT o_orderstatus AS doc_id, 'register_row' AS element_type, '[' || o_orderpriority || ' > O' || o_orderkey || '] bits ' || l_linenumber || ' | ' || l_returnflag || ' | ' || l_linestatus || ' | reset ' || l_partkey || ' | ' || l_suppkey AS render_text,
  '【' || o_orderstatus || ' Rev.2 | ' || o_orderpriority || ' | p.' || (o_custkey % 100) || '】' AS citation FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def child_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each line item (bit field) of each order (register)."""
    key = {"register_name": F.concat(F.lit("O"), text_of("o_orderkey")), "peripheral": F.col("o_orderpriority"), "doc_id": F.col("o_orderstatus")}
    orders = load(spark, sf_dir, "orders").withColumns(key).withColumn("o_custkey", (F.col("o_custkey") % 100).cast("int"))
    registers = orders.select(*key, F.col("o_orderpriority").alias("section_path"), F.col("o_custkey").alias("page_start"))
    lines = load(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", *key), F.col("l_orderkey") == F.col("o_orderkey"))
    fields = lines.select(*key, text_of("l_linenumber").alias("bits"), F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("access"), text_of("l_partkey").alias("reset"), text_of("l_suppkey").alias("description"))
    return _rendered(chunks.register_row_chunks(registers, fields, _documents(registers)))


@query("""SELECT p_brand AS doc_id, 'figure' AS element_type, '[' || CASE WHEN p_partkey % 4 = 0 THEN '§UNKNOWN' ELSE '§' || p_type END || ' > Figure 1.' || p_size || '] ' || p_name || '. ' AS render_text,
  '【' || p_brand || ' Rev.2 | ' || CASE WHEN p_partkey % 4 = 0 THEN '§UNKNOWN' ELSE '§' || p_type END || ' | p.' || p_size || '】' AS citation FROM part""")
def figure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as figures of a manual for each brand."""
    section = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("§"), F.col("p_type")))
    found = load(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("int").alias("page"), F.concat(F.lit("Figure 1."), text_of("p_size")).alias("figure_id"), F.col("p_name").alias("caption"), F.lit(None).cast("string").alias("vlm_summary"), F.lit("x.png").alias("image_path"), section.alias("section_path"))
    return _rendered(chunks.figure_chunks(found, _documents(found)))


def _part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables of a manual for each brand: register tables among them, some without rows or title."""
    k = F.col("p_partkey")
    row = F.create_map(F.lit(" Name"), F.col("p_name"), F.lit("Size"), F.when(k % 2 == 0, text_of("p_size")).otherwise(" "), F.lit("Type"), F.col("p_type"))
    blank = F.create_map(F.lit("Size"), F.lit(""))
    header = F.when(k % 7 == 0, F.array(F.lit("Bit"), F.lit("Size"))).otherwise(F.array(F.lit("Size"), F.lit(None), F.lit(" Type "), F.lit("")))
    return load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_size").cast("int").alias("page"), F.lit(0).alias("table_idx"), F.when(k % 3 != 0, "§1 Parts").alias("section_path"), (k % 11 == 0).alias("is_register"),
        F.when(k % 5 != 0, F.concat(F.lit("Table 1."), text_of("p_size"), F.lit(" parts"))).alias("table_title"), header.alias("header"), F.when(k % 13 != 0, F.array(row, blank)).alias("rows"), k.alias("line_no"),
    )


_PART_TABLES = """kept AS (SELECT *, CASE WHEN p_partkey % 5 <> 0 THEN 'Table 1.' || p_size || ' parts' END AS title, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN '§1 Parts' END, '§UNKNOWN') AS section FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
based AS (SELECT *, CASE WHEN title IS NULL THEN 'table-p' || p_size || '-0' ELSE 'table-1.' || p_size END AS base FROM kept),
ided AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) - 1 AS nth FROM based)"""


@query(f"""WITH {_PART_TABLES} SELECT base || CASE WHEN nth = 0 THEN '' ELSE '-' || nth END AS table_id, coalesce(title, '') AS title, p_brand AS doc_id, 'chip ' || p_brand AS chip_part, section AS section_path, p_size AS page,
  coalesce('**' || title || '**' || chr(10) || chr(10), '') || '| Size | Type |' || chr(10) || '|---|---|' || chr(10) || '| ' || CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END || ' | ' || p_type || ' |' || chr(10) || '|  |  |' AS markdown FROM ided""")
def general_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of general tables: ids within a manual, Markdown, sections."""
    found = _part_tables(spark, sf_dir)
    return catalogs.build_general_tables(found, _documents(found))


@query(f"""WITH {_PART_TABLES}, said AS (SELECT p_brand, section, p_size, 'table_summary' AS element_type, coalesce(title, 'Untitled table') || ' (in ' || section || ') — a table with 2 row(s). Columns: Size, Type.' AS render_text FROM ided
UNION ALL SELECT p_brand, section, p_size, 'table_row', 'In ' || coalesce(title, 'this table') || ', ' || CASE WHEN p_partkey % 2 = 0 THEN 'Size is ' || p_size || ', ' ELSE '' END || 'Type is ' || p_type || '.' FROM ided)
SELECT p_brand AS doc_id, element_type, render_text, '【' || p_brand || ' Rev.2 | ' || section || ' | p.' || p_size || '】' AS citation FROM said""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary and row sentences of general tables; blank rows say nothing."""
    found = _part_tables(spark, sf_dir)
    return _rendered(chunks.table_chunks(found, _documents(found)))


@query("""WITH pg AS (SELECT 'Brand#' || (s_suppkey % 25) AS doc, s_suppkey % 50 + 1 AS page, arg_min('0x4000' || s_suppkey, s_suppkey) AS address FROM supplier GROUP BY ALL),
named AS (SELECT p_brand AS doc_id, p_size AS page_start, p_partkey, coalesce(address, '') AS address, CASE WHEN p_partkey % 2 = 0 THEN 'REG' || p_size WHEN address IS NOT NULL THEN 'SUPPLY_REG' ELSE 'REG_' || p_partkey END AS register_name,
  CASE WHEN address IS NULL THEN 'UNKNOWN' ELSE 'SCI' END AS peripheral, CASE WHEN address IS NULL THEN '' ELSE '§1 Alpha > §1.1 SCI' END AS section_path FROM part LEFT JOIN pg ON doc = p_brand AND page = p_size)
SELECT doc_id, peripheral, register_name, address, '' AS access, section_path, page_start, 1::BIGINT AS n_fields, upper(p_name) AS symbol FROM named JOIN part USING (p_partkey) QUALIFY row_number() OVER (PARTITION BY peripheral, register_name, doc_id ORDER BY p_partkey DESC) = 1""")
def register_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers, with their fields, built from parts as register tables and suppliers as pages' prose."""
    part = load(spark, sf_dir, "part")
    row = F.create_map(F.lit("Bit"), text_of("p_size"), F.lit("Symbol"), F.upper("p_name"), F.lit("R/W"), F.lit("R"), F.lit("Reset"), F.lit("0"), F.lit("Description"), F.col("p_type"))
    tables = part.select(
        F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.lit(0).alias("table_idx"), F.lit("").alias("section_path"), F.lit(True).alias("is_register"), F.lit("").alias("table_title"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("REG"), text_of("p_size"))).otherwise("").alias("register_name"), F.lit("").alias("peripheral"), F.array(F.lit("Bit")).alias("header"), F.array(row).alias("rows"), F.col("p_partkey").alias("line_no"),
    )
    blocks = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("doc_id"), (F.col("s_suppkey") % 50 + 1).cast("int").alias("page"), F.concat(F.lit("SUPPLY_REG address 0x4000"), text_of("s_suppkey")).alias("text"), F.lit("§1 Alpha > §1.1 SCI").alias("section_path"), F.col("s_suppkey").alias("line_no")
    )
    registers, fields = catalogs.build_registers(tables, blocks, _documents(tables))
    counted = fields.groupBy(*catalogs.KEY).agg(F.count("*").alias("n_fields"), F.max("symbol").alias("symbol"))
    return registers.join(counted, catalogs.KEY, "left").select("doc_id", "peripheral", "register_name", "address", "access", "section_path", "page_start", "n_fields", "symbol")


@query("""SELECT p_partkey, 'Table 2.' || p_size || ' sizes' AS table_title, p_type || ' - low|' || p_type || ' - high' AS header, 2::BIGINT AS n_rows,
  '0x10|' || CASE p_partkey % 3 WHEN 0 THEN '1: ' || p_name || '; 2: on again' WHEN 1 THEN p_name || ' goes on' ELSE p_name END AS first_row, '0x10|' || p_brand AS second_row FROM part""")
def header_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with a title, two header levels filled to the right, cells filled from above, option lists and wrapped lines."""
    part, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    told = F.when(k % 3 == 0, F.concat(F.lit("1: "), F.col("p_name"), F.lit("\n\n2: on\n again "))).when(k % 3 == 1, F.concat(F.col("p_name"), F.lit("\ngoes on"))).otherwise(F.concat(F.lit("\n "), F.col("p_name")))
    grid = F.array(F.array(F.concat(F.lit("Table 2."), text_of("p_size"), F.lit(" sizes")), none), F.array(F.col("p_type"), none), F.array(F.lit("low"), F.lit("high")), F.array(F.lit("0x10"), told), F.array(none, F.col("p_brand")))
    read = C.normalise_grids(part.select("p_partkey", grid.alias("cells")))
    cells = lambda at: F.array_join(F.transform("header", lambda h: F.element_at(F.element_at("rows", at), h)), "|")
    return read.select("p_partkey", "table_title", F.array_join("header", "|").alias("header"), F.size("rows").cast("long").alias("n_rows"), cells(1).alias("first_row"), cells(2).alias("second_row"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'stored ' || p_partkey ELSE '【' || p_brand || ' Rev.2 | ' || p_type || ' | p.' || p_size || ' | Figure 1.' || p_size || '】' END AS citation, '[' || p_type || '] ' || p_name AS prose FROM part""")
def figure_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored citation of a figure, else one that names it; and a section's prose."""
    stored = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("stored "), text_of("p_partkey"))).otherwise("")
    cited = T.figure_citation(stored, F.col("p_brand"), F.lit("2"), F.col("p_type"), F.col("p_size"), F.concat(F.lit("Figure 1."), text_of("p_size")))
    return load(spark, sf_dir, "part").select("p_partkey", cited.alias("citation"), T.prose_text(F.col("p_type"), F.col("p_name")).alias("prose"))
