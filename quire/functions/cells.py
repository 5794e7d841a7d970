"""Functions over table cells: arrays of rows, maps of cells, bit ranges. Built-in expressions but for normalise_grid."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# How register tables, data cells, titles and option lists look, and what columns are called.
BIT_CELL = r"(?i)^bit\b"
KEYWORDS = ("symbol", "value", "r/w", "reset", "description", "function")
DATA_CELL = r"(?i)0x[0-9A-Fa-f_]+|\b\d+\s*(KB|MB|GB|bit|Hz|MHz)\b"
TITLE_CELL = r"(?i)^Table\s+\d+\.\d+"
OPTION_LINE = r"^\s*(?:[•·-]|\d+\s*[.):]|\d[\s\d]*:)\s*"
NAME_COLUMNS = ("symbol", "register name", "register")
SUMMARY_COLUMNS = {
    "address": ("address", "addr"),
    "reset_value": ("initial value", "reset value", "reset"),
    "access": ("r/w", "access"),
}
FIELD_COLUMNS = {
    "bits": ("bit", "bits"),
    "symbol": ("symbol", "bit name", "name"),
    "access": ("r/w", "access"),
    "reset": ("reset", "value"),
    "description": ("description", "desc"),
}
#: Rows at the top that may be titles, and rows after the title that may be headers.
TOP_ROWS, HEADER_ROWS = 3, 4


def is_register_row(row: Column) -> Column:
    """A header of a register table: a cell that begins with the word bit, and a keyword within any cell."""
    cells = F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit(""))))
    keyword = lambda c: F.greatest(*[F.lower(c).contains(k) for k in KEYWORDS])
    return F.exists(cells, lambda c: c.rlike(BIT_CELL)) & F.exists(cells, keyword)


def is_register_table(rows: Column) -> Column:
    return F.coalesce(F.exists(F.slice(rows, 1, 2), is_register_row), F.lit(False))


def has_bit_header(header: Column) -> Column:
    return F.exists(header, lambda h: h.rlike(BIT_CELL))


def clean_header(header: Column) -> Column:
    """Names without white space round them; null and empty names go."""
    return F.transform(F.filter(F.coalesce(header, F.array().cast("array<string>")), lambda h: h.isNotNull() & (h != "")), strip)


def is_general_table(is_register: Column, header: Column, rows: Column) -> Column:
    names = clean_header(header)
    return ~F.coalesce(is_register, F.lit(False)) & ~has_bit_header(names) & (F.size(names) > 0) & (F.coalesce(F.size(rows), F.lit(0)) > 0)


def lowered_cells(row: Column) -> Column:
    """A row map as entries in order, with keys in lower case and values without white space round them."""
    return F.transform(F.map_entries(row), lambda e: F.struct(F.lower(e["key"]).alias("key"), strip(F.coalesce(e["value"], F.lit("None"))).alias("value")))


def find_column(entries: Column, aliases: tuple[str, ...]) -> Column:
    """The value of the first column whose name contains the first alias that any name contains; else empty."""
    hits = [F.get(F.filter(entries, _named(a)), F.lit(0))["value"] for a in aliases]
    return F.coalesce(*hits, F.lit(""))


def _named(alias: str):
    return lambda e: e["key"].contains(alias)


def _contains_any(aliases: tuple[str, ...]):
    return lambda h: F.greatest(*[F.lower(h).contains(a) for a in aliases]) if len(aliases) > 1 else F.lower(h).contains(aliases[0])


def is_summary_header(header: Column) -> Column:
    """A register-name column, and a column of addresses, resets or access."""
    every = tuple(a for aliases in SUMMARY_COLUMNS.values() for a in aliases)
    return F.exists(header, _contains_any(NAME_COLUMNS)) & F.exists(header, _contains_any(every))


def bit_fields(rows: Column) -> Column:
    """The fields of a register table's rows: the first alias that a row has as a column counts, even where its cell is
    empty; rows without bits and symbol go."""

    def field(row: Column) -> Column:
        keyed = F.map_from_entries(F.transform(F.map_entries(row), lambda e: F.struct(strip(F.lower(e["key"])), F.coalesce(e["value"], F.lit("")))))

        def pick(aliases: tuple[str, ...]) -> Column:
            out = F.lit("")
            for a in reversed(aliases):
                out = F.when(F.map_contains_key(keyed, F.lit(a)), F.element_at(keyed, F.lit(a))).otherwise(out)
            return strip(out)

        return F.struct(*[pick(aliases).alias(name) for name, aliases in FIELD_COLUMNS.items()])

    return F.filter(F.transform(F.coalesce(rows, F.array().cast("array<map<string,string>>")), field), lambda f: (f["bits"] != "") | (f["symbol"] != ""))


def bit_matches(bits: Column, wanted: Column) -> Column:
    """Is the number `wanted` the bit, or within `high:low`? Anything that is no number matches nothing."""
    target = F.when(wanted.rlike("^[0-9]+$"), wanted.try_cast("long"))
    ends = F.transform(F.split(bits, ":", 2), lambda x: strip(x).try_cast("long"))
    ranged = (F.get(ends, F.lit(1)) <= target) & (target <= F.get(ends, F.lit(0)))
    return F.coalesce(F.when(bits.contains(":"), ranged).otherwise(strip(bits).try_cast("long") == target), F.lit(False))


# What follows works on one grid at a time, as a plain function behind an Arrow map: levels of headers, titles and fills
# depend on one another row by row.


class Grid:
    """A table as extracted: rows of nullable cells, null rows included."""

    def __init__(self, rows: list):
        self.rows = rows

    @staticmethod
    def _text(cell) -> str:
        return str(cell).strip() if cell else ""

    def _texts(self, at: int) -> list[str]:
        return [t for t in map(self._text, self.rows[at]) if t] if self.rows[at] is not None else []

    def register_header(self) -> int | None:
        for at in range(min(TOP_ROWS, len(self.rows))):
            texts = self._texts(at)
            if any(re.match(BIT_CELL, t) for t in texts) and any(k in t.lower() for t in texts for k in KEYWORDS):
                return at
        return None

    def title(self) -> str:
        """The first cell of the first row that is not null, where it is a title; rows of titles alone are passed over."""
        for at in range(min(TOP_ROWS, len(self.rows))):
            row = self.rows[at]
            if row is not None:
                first = self._text(row[0]) if row else ""
                return first if re.match(TITLE_CELL, first) else ""
        return ""

    def header_span(self) -> tuple[int, int]:
        """[first, end) rows of the header of a table that is no register table."""
        first = 0
        for at in range(min(TOP_ROWS, len(self.rows))):
            texts = self._texts(at)
            if texts and re.match(TITLE_CELL, texts[0]):
                first = at + 1
                break
        for at in range(first, min(first + HEADER_ROWS, len(self.rows))):
            if self.rows[at] is not None and any(c and re.search(DATA_CELL, str(c)) for c in self.rows[at]):
                return first, at
        return first, first + 1

    def flattened(self, levels: list[list]) -> list[str]:
        """One name for each column: the levels above it, filled to the right, joined, without blanks and repeats."""
        if len(levels) == 1:
            return [self._text(c) for c in levels[0]]
        width = max(map(len, levels))
        filled = []
        for level in levels:
            row: list[str] = []
            for cell in [*level, *[None] * (width - len(level))]:
                row.append(self._text(cell) or (row[-1] if row else ""))
            filled.append(row)
        names = []
        for column in zip(*filled):
            parts = [p for p in column if p]
            names.append(" - ".join(p for i, p in enumerate(parts) if i == 0 or p != parts[i - 1]))
        return names

    def records(self) -> tuple[list[str], list[dict[str, str]]]:
        if not self.rows:
            return [], []
        at = self.register_header()
        if at is not None:
            header, begin, clean = [self._text(c) for c in self.rows[at]], at + 1, self._text
        else:
            first, begin = self.header_span()
            levels = [r for r in self.rows[first:begin] if r is not None] or ([self.rows[first]] if first < len(self.rows) and self.rows[first] is not None else [[]])
            header, clean = self.flattened(levels), lambda c: clean_text(str(c)) if c else ""
        out, above = [], []
        for row in self.rows[begin:]:
            if row is None:
                continue
            above = [above[i] if c is None and i < len(above) else c for i, c in enumerate(row)]
            record = dict(zip(header, map(clean, above)))
            if "Function" in record:
                record.setdefault("Description", record["Function"])
            out.append(record)
        return header, out


def clean_text(text: str) -> str:
    """Lines of an option list joined by `; `, wrapped lines by a space."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if len(lines) < 2:
        return text.replace("\n", " ").strip()
    begins = [i for i, x in enumerate(lines) if i == 0 or re.match(OPTION_LINE, x)]
    return "; ".join(" ".join(lines[a:z]) for a, z in zip(begins, [*begins[1:], len(lines)]))


def normalise_grids(tables: DataFrame, cells: str = "cells") -> DataFrame:
    """tables with table_title, header and rows read off the column of cells."""
    names = tables.columns
    at = names.index(cells)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tables.schema), "table_title string, header array<string>, rows array<map<string,string>>"])
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.map_(pa.string(), pa.string())))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grids = [Grid(x or []) for x in b.column(at).to_pylist()]
            read = [g.records() for g in grids]
            made = ([g.title() for g in grids], [h for h, _ in read], [[list(r.items()) for r in rows] for _, rows in read])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(made, kinds))], [*names, "table_title", "header", "rows"])

    return tables.mapInArrow(each, schema)
