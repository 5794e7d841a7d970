"""Sections, figure zones and crops: what the place of things on pages implies.

Pages and documents are the units of all windows here: a page's drawings or a document's contents list, never a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Points of a page's header, the smallest drawing, the gap between clusters, the share of a page that a
# figure is taken to fill where nothing is known.
HEADER_Y, SMALLEST, GAP, SHARE = 75.0, 30.0, 8.0, 0.45


def toc_labels(toc: DataFrame) -> DataFrame:
    """(doc_id, ord, page, label): each contents entry with the path of titles that it stands under.

    For its own level and each shallower one of its document an entry finds the last entry there; those that no
    shallower entry followed are its path. A row holds one entry for each level, never a contents list. ord tells the
    entries of a document apart; an entry without a level stands at the top.
    """
    level = F.coalesce(F.col("level").cast("int"), F.lit(1))
    levels = F.collect_set(level).over(Window.partitionBy("doc_id"))
    asked = toc.select("doc_id", "ord", "page", level.alias("level"), T.strip(F.col("title")).alias("title"), levels.alias("levels"))
    asked = asked.withColumn("at", F.explode(F.filter("levels", lambda x: x <= F.col("level"))))
    so_far = Window.partitionBy("doc_id", "at").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("at") == F.col("level"), F.struct("at", "ord", "title")), ignorenulls=True).over(so_far)
    found = asked.select("doc_id", "ord", "page", last.alias("last")).groupBy("doc_id", "ord", "page").agg(F.sort_array(F.collect_list("last")).alias("up"))
    path = F.filter("up", lambda x: ~F.exists("up", lambda y: (y["at"] < x["at"]) & (y["ord"] > x["ord"])))
    label = F.array_join(F.transform(path, lambda e: F.concat(F.lit("§"), e["title"])), " > ")
    return found.select("doc_id", "ord", "page", label.alias("label"))


def latest_before(points: DataFrame, marks: DataFrame, keys: list[str], at: str, order: list[str], value: str) -> DataFrame:
    """points with the `value` of the last mark at or before `at`, ties by `order`: one sort of both, no range join."""
    both = points.select("*", F.lit(1).alias("__kind"), *[F.lit(None).cast(marks.schema[c].dataType).alias(f"__{c}") for c in [*order, value]]).unionByName(
        marks.select(*keys, F.col(at), F.lit(0).alias("__kind"), *[F.col(c).alias(f"__{c}") for c in [*order, value]]), allowMissingColumns=True
    )
    order_by = [F.col(at), F.col("__kind"), *[F.col(f"__{c}") for c in order]]
    last = F.last(f"__{value}", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(value, last).where("__kind = 1").select(*points.columns, value)


def resolve_sections(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """blocks with section_path: the last contents entry whose page is at or before theirs. Only pages are sorted."""
    pages = blocks.select("doc_id", "page").distinct()
    labels = toc_labels(toc).withColumnRenamed("label", "section_path")
    known = latest_before(pages, labels, ["doc_id"], "page", ["ord"], "section_path")
    return blocks.drop("section_path").join(known, ["doc_id", "page"], "left")


def first_per_page(blocks: DataFrame, order: str = "line_no") -> DataFrame:
    """(doc_id, page, section_path, texts): the section of a page's first block, all its texts in order."""
    block = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("section_path").alias("s"), F.coalesce("text", F.lit("")).alias("t"))))
    return blocks.groupBy("doc_id", "page").agg(block.alias("b")).select("doc_id", "page", F.get("b", F.lit(0))["s"].alias("section_path"), F.transform("b", lambda x: x["t"]).alias("texts"))


def figure_zones(figures: DataFrame) -> DataFrame:
    """(doc_id, page, zone_y0, zone_y1): the crop where one is known, else the page down to 20 points below the caption."""
    cropped = F.coalesce(F.col("crop_y1") > F.col("crop_y0"), F.lit(False))
    usable = figures.where("page is not null and page <> 0").where(cropped | F.col("caption_y").isNotNull())
    return usable.select("doc_id", "page", F.when(cropped, F.col("crop_y0")).otherwise(0.0).alias("zone_y0"), F.when(cropped, F.col("crop_y1")).otherwise(F.col("caption_y") + 20).alias("zone_y1"))


def outside_zones(items: DataFrame, zones: DataFrame, keys: list[str], low: Column, high: Column, exempt: Column) -> DataFrame:
    """items that no zone of their keys overlaps (touching is no overlap), and those that are exempt."""
    z = zones.select(*[F.col(k).alias(f"__{k}") for k in keys], "zone_y0", "zone_y1")
    on = (low < F.col("zone_y1")) & (high > F.col("zone_y0")) & ~exempt
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return items.join(z, on, "left_anti")


def clusters(rects: DataFrame, keys: list[str], low: str, high: str, gap: float = GAP, tie: tuple[str, ...] = ()) -> DataFrame:
    """rects with `cluster` from 0: a new one begins where the low end lies more than `gap` past all high ends before."""
    order = Window.partitionBy(*keys).orderBy(low, high, *tie)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rects.withColumn("__new", F.coalesce((F.col(low) > reach + gap).cast("int"), F.lit(0)))
    return marked.withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, figure_id, caption, caption_y, caption_y1) of blocks that are figure captions."""
    return blocks.where(T.is_caption(F.col("text"))).select(
        "doc_id", "page", "line_no", T.caption_figure_id(F.col("text")).alias("figure_id"), T.strip(F.col("text")).alias("caption"), F.get("bbox", F.lit(1)).alias("caption_y"), F.get("bbox", F.lit(3)).alias("caption_y1")
    )


def with_floor(found: DataFrame, gap: float = 5.0) -> DataFrame:
    """found with `floor`: the lowest end of the captions of its page that begin more than `gap` above, else the header's."""
    page = ["doc_id", "page"]
    other = found.select(*page, F.col("caption_y").alias("oy"), F.col("caption_y1").alias("oy1"))
    above = F.max(F.when(F.col("oy") < F.col("caption_y") - gap, F.col("oy1"))).alias("floor")
    return found.join(other, page, "left").groupBy(*found.columns).agg(above).withColumn("floor", F.coalesce("floor", F.lit(HEADER_Y)))


def crops(found: DataFrame, drawings: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Captions with crop_y0 and crop_y1: from the last cluster of drawings above the caption, not reaching over an
    earlier caption or a paragraph; from the text alone where nothing is drawn; a share of the page where that is too low.

    pages: (doc_id, page, height).
    """
    page = ["doc_id", "page"]
    floor = with_floor(found)
    cap = [*page, "line_no"]
    drawn = floor.join(drawings, page).where((F.col("y1") > F.col("floor")) & (F.col("y0") < F.col("caption_y")))
    union = drawn.groupBy(*cap).agg((F.max("y1") - F.min(F.greatest("y0", "floor"))).alias("drawn"))
    last = clusters(drawn, cap, "y0", "y1").groupBy(*cap, "cluster").agg(F.min("y0").alias("top")).groupBy(*cap).agg(F.max_by("top", "cluster").alias("top"))
    seen = floor.join(union, cap, "left").join(last, cap, "left").withColumn("top", F.greatest("floor", F.col("top") - 4))
    prose = blocks.where((T.strip(F.coalesce("text", F.lit(""))) != "") & ~T.strip(F.coalesce("text", F.lit(""))).rlike(T.CAPTION)).select(*page, F.get("bbox", F.lit(3)).alias("by1"))
    above = seen.join(prose, page, "left").groupBy(*seen.columns).agg(F.max(F.when(F.col("by1") < F.col("top") - 2, F.col("by1"))).alias("text_y1")).withColumn("text_y1", F.greatest("floor", "text_y1"))
    sized = above.join(pages.select(*page, "height"), page, "left")
    has = F.coalesce(F.col("drawn") >= SMALLEST, F.lit(False))
    y0 = F.when(has, F.greatest("top", F.col("text_y1") + 2)).otherwise(F.col("floor") + 4)
    y1 = F.when(has, F.least("height", F.col("caption_y1") + 6)).otherwise(F.col("caption_y1") + 6)
    low = sized.withColumn("c0", y0).withColumn("c1", y1)
    flat = F.col("c1") - F.col("c0") < SMALLEST
    return low.select(
        *found.columns,
        F.round(F.when(flat, F.greatest(F.lit(0.0), F.col("caption_y") - F.col("height") * SHARE)).otherwise(F.col("c0")), 1).alias("crop_y0"),
        F.round(F.when(flat, F.least("height", F.col("caption_y1") + 6)).otherwise(F.col("c1")), 1).alias("crop_y1"),
    )


def figures(blocks: DataFrame, drawings: DataFrame, pages: DataFrame, raw_blocks: DataFrame | None = None) -> DataFrame:
    """Figure records: captions with crops, ids, image paths and their page's section.

    raw_blocks: blocks as first read, used for pages on which `blocks` has no caption.
    """
    found = captions(blocks)
    if raw_blocks is not None:
        found = found.unionByName(captions(raw_blocks).join(found.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))
    cut = crops(found, drawings, blocks, pages)
    nth = F.row_number().over(Window.partitionBy("doc_id", "figure_id").orderBy("page", "line_no")) - 1
    name = F.concat(F.lit("data/figures/"), F.col("doc_id"), F.lit("/p"), F.col("page").cast("string"), F.lit("_"), T.figure_slug(F.col("figure_id")), F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.lit(".png"))
    sized = cut.withColumn("image_path", name).join(pages.select("doc_id", "page", F.col("width").alias("page_width")), ["doc_id", "page"], "left")
    scale = 150 / 72
    sections = first_per_page(blocks).select("doc_id", "page", "section_path")
    return sized.join(sections, ["doc_id", "page"], "left").select(
        "doc_id", "page", "figure_id", "caption", "caption_y", "crop_y0", "crop_y1", F.lit("").alias("vlm_type"), F.lit("").alias("vlm_summary"), F.array().cast("array<string>").alias("labels_seen"), "image_path", "section_path",
        F.round(F.col("page_width") * scale).cast("int").alias("width"), F.round((F.col("crop_y1") - F.col("crop_y0")) * scale).cast("int").alias("height"), "line_no",
    )


def tables(grids: DataFrame, blocks: DataFrame, zones: DataFrame, page_text: DataFrame | None = None) -> DataFrame:
    """Table records from extracted grids (doc_id, page, table_idx, bbox, cells): classified, normalised, without those
    in figures and without what is no table.

    page_text: (doc_id, page, text), read for names on pages that have no blocks.
    """
    from ..functions import cells as C

    marked = grids.withColumn("is_register", C.is_register_table(F.col("cells")))
    kept = outside_zones(marked, zones, ["doc_id", "page"], F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)), F.col("is_register"))
    placed = kept.join(first_per_page(blocks), ["doc_id", "page"], "left")
    if page_text is not None:
        raw = page_text.where(T.strip(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id", "page").agg(F.min("text").alias("raw"))
        placed = placed.join(raw, ["doc_id", "page"], "left").withColumn("texts", F.coalesce("texts", F.when(F.col("raw").isNotNull(), F.array("raw")))).drop("raw")
    section = F.coalesce("section_path", F.lit(""))
    own = T.section_register(section)
    near = F.filter(F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.regexp_extract(t, T.BLOCK_NAME, 1)), lambda x: x != "")
    named = placed.select(
        "doc_id", "page", "table_idx", section.alias("section_path"), "is_register", "cells",
        F.when(F.col("is_register"), F.when(own != "", own).otherwise(F.coalesce(F.get(near, F.lit(0)), F.lit("")))).otherwise("").alias("register_name"),
        F.when(F.col("is_register"), T.section_chapter(section)).otherwise("").alias("peripheral"),
    )
    read = C.normalise_grids(named)
    untitled = F.col("table_title") == ""
    junk = ~F.col("is_register") & ((untitled & (F.size("rows") < 2)) | (F.size("header") <= 1))
    return read.where(~junk).select("doc_id", "page", "table_idx", "section_path", "is_register", "table_title", "register_name", "peripheral", "header", "rows")
