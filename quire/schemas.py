"""Declared schemas. Order columns (line_no, row_idx, field_ord) carry what files express by position."""

from __future__ import annotations

REGISTRY = "doc_id string, revision string, chip_part string, path string"
BLOCKS = "doc_id string, page int, bbox array<double>, text string, section_path string"
FIGURES = (
    "doc_id string, page int, figure_id string, caption string, caption_y double, crop_y0 double, crop_y1 double, vlm_type string, vlm_summary string, "
    "labels_seen array<string>, image_path string, section_path string, width int, height int"
)
RAW_TABLES = (
    "doc_id string, page int, table_idx int, section_path string, is_register boolean, table_title string, register_name string, peripheral string, "
    "header array<string>, rows array<map<string,string>>"
)
FIELD = "struct<bits: string, symbol: string, access: string, reset: string, description: string>"
REGISTERS = (
    "peripheral string, register_name string, address string, size_bits int, reset_value string, access string, doc_id string, revision string, "
    "section_path string, page_start int, page_end int, json string, line_no long"
)
BIT_FIELDS = "peripheral string, register_name string, doc_id string, bits string, symbol string, access string, reset string, description string, field_ord int"
GENERAL_TABLES = "table_id string, title string, markdown string, doc_id string, chip_part string, section_path string, page int"
CHUNKS = (
    "doc_id string, revision string, chip_part string, section_path string, page_start int, page_end int, element_type string, peripheral string, "
    "register_name string, figure_id string, image_path string, table_id string, render_text string, citation string, figure_refs array<string>, table_refs array<string>"
)
INDEX = CHUNKS.replace("figure_refs array<string>, table_refs array<string>", "figure_refs string, table_refs string, embedding array<float>")
ELEMENT_TYPES = ("prose", "register_row", "figure", "table_summary", "table_row")
#: What the PDF readers of other systems hand over; no PDF library is needed here.
TOC = "doc_id string, ord int, level int, title string, page int"
DRAWINGS = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
TABLE_CELLS = "doc_id string, page int, table_idx int, bbox array<double>, cells array<array<string>>"
PAGE_TEXT = "doc_id string, page int, text string, width double, height double"
