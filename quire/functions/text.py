"""Column functions over text: citations, references, ids, rendered chunks, names scraped from prose.

All are built-in expressions. White space follows Unicode, as (?U) makes Java's classes do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_SECTION = "§UNKNOWN"

# The patterns by which references, captions and register facts are written.
FIGURE_REF = r"(?i)Fig(?:ure)?\.?\s+(\d+\.\d+(?:\.\d+)?)"
TABLE_REF = r"(?i)Table\s+(\d+\.\d+)"
TITLE_NUMBER = r"(?i)^Table\s+(\d+\.\d+)"
CAPTION = r"(?i)^Fig(?:ure)?\.?\s+(\d+\.\d+(?:\.\d+)?)\s*\n"
CAPTION_LONGEST = 300
ADDRESS = r"(?i)(?:Address(?:es)?|Addr\.?)\s*[:\–\-]?\s*(0x[0-9A-Fa-f]{4,}(?:\s*\+\s*[0-9A-Fx×]+\s*×?\s*n?)?)"
RESET = r"(?i)(?:Reset\s*[Vv]alue|Initial\s*[Vv]alue|Reset)\s*[:\–\-]?\s*(0x[0-9A-Fa-f]+|[0-9A-Fa-f]+H|\b0b[01]+\b)"
ACCESS = r"\b(R/W|R/W1C|R/W1S|RO|WO|R|W)\b"
CAPITALS = r"\b([A-Z][A-Z0-9_]{2,}(?:n|m)?)\b"
HEADING_NAME = r"§[\d.]+\s+([A-Z][A-Z0-9_/\[\]<>a-z]+)\s*[:/]"
HEADING_TITLE = r"§[\d.]+\s+(.+)"
BLOCK_NAME = r"\b([A-Z][A-Z0-9_]{2,}(?:n|m)?)\s*(?::|Register|Reg\.?)"
BGE_PREFIX = "Represent this sentence for searching relevant passages: "


def strip(c: Column) -> Column:
    """Without white space at both ends, any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_else(c: Column, default) -> Column:
    """default where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def first_match(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, empty where there is none."""
    return F.coalesce(F.regexp_extract(c, pattern, 1), F.lit(""))


def citation(doc_id: Column, revision: Column, section: Column, page: Column) -> Column:
    return F.concat(F.lit("【"), doc_id, F.lit(" Rev."), revision, F.lit(" | "), section, F.lit(" | p."), page.cast("string"), F.lit("】"))


def figure_citation(stored: Column, doc_id: Column, revision: Column, section: Column, page: Column, figure_id: Column) -> Column:
    """The stored citation; where that is empty, one that also names the figure."""
    own = F.concat(F.lit("【"), doc_id, F.lit(" Rev."), revision, F.lit(" | "), section, F.lit(" | p."), page.cast("string"), F.lit(" | "), figure_id, F.lit("】"))
    return or_else(stored, own)


def figure_refs(text: Column) -> Column:
    """`Figure N.M` for each mention, once each, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FIGURE_REF), 1), lambda x: F.concat(F.lit("Figure "), x)))


def table_refs(text: Column) -> Column:
    """`table-N.M` for each mention, once each, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TABLE_REF), 1), lambda x: F.concat(F.lit("table-"), x)))


def refs_of(joined: Column) -> Column:
    """The list behind comma-joined references; empty or null is the empty list."""
    return F.when(F.coalesce(joined, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


def table_id(title: Column, page: Column, idx: Column) -> Column:
    """From the title's number, else from its words (40 characters), else from the place."""
    number = F.regexp_extract(title, TITLE_NUMBER, 1)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    place = F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.coalesce(idx, F.lit(0)).cast("string"))
    return F.concat(F.lit("table-"), F.when(F.coalesce(title, F.lit("")) == "", place).when(number != "", number).otherwise(slug))


def figure_slug(figure_id: Column) -> Column:
    short = F.regexp_replace(figure_id, r"[Ff]ig(?:ure)?\.?\s*", "fig")
    return F.lower(F.regexp_replace(F.regexp_replace(short, "[^a-zA-Z0-9]", "_"), "^_+|_+$", ""))


def cell(row: Column, name: Column) -> Column:
    """A cell of a row map as one line; missing and null are empty."""
    return strip(F.replace(F.coalesce(F.element_at(row, name), F.lit("")), F.lit("\n"), F.lit(" ")))


def markdown_table(header: Column, rows: Column, title: Column) -> Column:
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.when(F.coalesce(title, F.lit("")) != "", F.array(F.concat(F.lit("**"), title, F.lit("**")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda _: F.lit("---")), "|"), F.lit("|"))
    body = F.transform(rows, lambda r: bar(F.transform(header, lambda h: cell(r, h))))
    return F.array_join(F.concat(head, F.array(bar(header), rule), body), "\n")


def table_summary(header: Column, rows: Column, title: Column, section: Column) -> Column:
    return F.concat(or_else(title, "Untitled table"), F.lit(" (in "), section, F.lit(") — a table with "), F.size(rows).cast("string"), F.lit(" row(s). Columns: "), F.array_join(header, ", "), F.lit("."))


def row_sentence(header: Column, row: Column, title: Column) -> Column:
    """`In TITLE, A is 1, B is 2.`; blank cells are left out, a row of them is empty."""
    said = F.filter(F.transform(header, lambda h: F.when(cell(row, h) != "", F.concat(h, F.lit(" is "), cell(row, h)))), lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.lit("In "), or_else(title, "this table"), F.lit(", "), F.array_join(said, ", "), F.lit("."))).otherwise("")


def register_row_text(section: Column, register: Column, bits: Column, symbol: Column, access: Column, reset: Column, description: Column) -> Column:
    said = [F.coalesce(c, F.lit("")) for c in (bits, symbol, access, reset, description)]
    return F.concat(F.lit("["), section, F.lit(" > "), register, F.lit("] bits "), said[0], F.lit(" | "), said[1], F.lit(" | "), said[2], F.lit(" | reset "), said[3], F.lit(" | "), said[4])


def figure_text(section: Column, figure_id: Column, caption: Column, summary: Column) -> Column:
    return F.concat(F.lit("["), section, F.lit(" > "), figure_id, F.lit("] "), caption, F.lit(". "), summary)


def prose_text(section: Column, text: Column) -> Column:
    return F.concat(F.lit("["), section, F.lit("] "), text)


def caption_parts(rendered: Column) -> Column:
    """struct(caption, summary) of a rendered figure text; both empty where it has no section prefix."""
    whole = r"(?s)^\[.*?\]\s*(.+?)(?:\.\s+(.+))?$"
    return F.struct(strip(F.coalesce(F.regexp_extract(rendered, whole, 1), F.lit(""))).alias("caption"), strip(F.coalesce(F.regexp_extract(rendered, whole, 2), F.lit(""))).alias("summary"))


def is_caption(text: Column) -> Column:
    return strip(text).rlike(CAPTION) & (F.char_length(strip(text)) <= CAPTION_LONGEST)


def caption_figure_id(text: Column) -> Column:
    return F.concat(F.lit("Figure "), F.regexp_extract(strip(text), CAPTION, 1))


def section_register(section: Column) -> Column:
    """The register that the deepest part of a section path names, up to a slash; empty where it names none."""
    deepest = strip(F.element_at(F.split(F.coalesce(section, F.lit("")), ">"), -1))
    return strip(F.element_at(F.split(first_match(deepest, HEADING_NAME), "/"), 1))


def section_chapter(section: Column) -> Column:
    """The title of the top part of a section path."""
    top = strip(F.element_at(F.split(F.coalesce(section, F.lit("")), ">"), 1))
    return or_else(strip(first_match(top, HEADING_TITLE)), "UNKNOWN")


def guess_peripheral(section: Column) -> Column:
    """The first word of 2 to 8 capitals in the last part that has one."""
    hits = F.filter(F.transform(F.reverse(F.split(F.coalesce(section, F.lit("")), ">")), lambda p: F.regexp_extract(p, r"\b([A-Z]{2,8})\b", 1)), lambda x: x != "")
    return F.coalesce(F.get(hits, F.lit(0)), F.lit("UNKNOWN"))


def prose_register(text: Column) -> Column:
    """The first token of capitals that has 4 characters or ends in n; empty where there is none."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(CAPITALS), 1), lambda x: (F.char_length(x) >= 4) | x.endswith("n"))
    return F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))


def suggest_id(path: Column) -> Column:
    """A document id from a file name: its stem in capitals, runs of other characters as underscores."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.upper(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9_-]+", "_"))


def status_badge(pdf_exists: Column, chunks: Column) -> Column:
    return F.when(~pdf_exists, "❌ PDF missing").when(chunks > 0, "✅ Indexed").otherwise("⚠️ Not yet indexed")


def document_line(doc_id: Column, chip_part: Column, folder: Column, badge: Column, chunks: Column, registers: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", doc_id, chip_part, or_else(folder, "(root)"), badge, chunks.cast("string"), registers.cast("string")), F.lit(" |"))


def query_prefix(model: str) -> str:
    """What a model wants before a query; documents get none."""
    return BGE_PREFIX if "bge" in model.lower() else ""


# Characters that JSON writes as two.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_text(s: Column) -> Column:
    """A JSON string in ASCII: what is not printable ASCII as lower-case code units, two where a character needs two."""

    def unit(x: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))

    def char(c: Column) -> Column:
        code, short = F.ascii(c), F.element_at(F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair]), c)
        high, low = F.lit(0xD7C0) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))
        return F.when(short.isNotNull(), short).when(code.between(32, 126), c).when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))

    plain = ~s.rlike(r'[^ !#-\[\]-~]')
    return F.when(plain, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.split(s, ""), char), ""), F.lit('"')))


def json_object(**members: Column) -> Column:
    """A JSON object of members that are JSON already, with a blank after colons and commas."""
    said = [x for name, value in members.items() for x in (F.lit(f'"{name}": '), value, F.lit(", "))]
    return F.concat(F.lit("{"), *said[:-1], F.lit("}"))


def json_array(members: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(members, ", "), F.lit("]"))
