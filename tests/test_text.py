"""Text functions against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import cells as C
from quire.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "figures", "tables"),
    [
        ("see Figure 3.2 and Table 7.1", ["Figure 3.2"], ["table-7.1"]),
        ("Fig. 3.2, figure 3.2.1, FIG 3.2", ["Figure 3.2", "Figure 3.2.1"], []),
        ("Timetable 3.1, config 1.2", ["Figure 1.2"], ["table-3.1"]),
        ("nothing", [], []),
    ],
)
def test_references(spark, text, figures, tables):
    assert value(spark, T.figure_refs(F.lit(text))) == figures
    assert value(spark, T.table_refs(F.lit(text))) == tables


@pytest.mark.parametrize(
    ("title", "page", "idx", "expected"),
    [("Table 12.3 Modes", 5, 0, "table-12.3"), ("", 5, 2, "table-p5-2"), (None, 5, None, "table-p5-0"), ("== Pin List ==", 1, 0, "table-pin-list"), ("a" * 39 + " b", 1, 0, "table-" + "a" * 39 + "-")],
)
def test_table_ids(spark, title, page, idx, expected):
    assert value(spark, T.table_id(F.lit(title).cast("string"), F.lit(page), F.lit(idx).cast("int"))) == expected


def test_strip_takes_unicode_spaces(spark):
    assert value(spark, T.strip(F.lit(" \t x  \n"))) == "x"


def test_citations(spark):
    own = [F.lit(x) for x in ("UM1", "2.0", "§3 X")]
    assert value(spark, T.citation(*own, F.lit(7))) == "【UM1 Rev.2.0 | §3 X | p.7】"
    assert value(spark, T.figure_citation(F.lit(""), *own, F.lit(7), F.lit("Figure 3.1"))) == "【UM1 Rev.2.0 | §3 X | p.7 | Figure 3.1】"
    assert value(spark, T.figure_citation(F.lit("given"), *own, F.lit(7), F.lit("Figure 3.1"))) == "given"


def test_caption_parts(spark):
    said = F.lit("[§1 A > Figure 1.1] Figure 1.1\nClock tree. Shows the clocks")
    assert tuple(value(spark, T.caption_parts(said))) == ("Figure 1.1\nClock tree", "Shows the clocks")
    assert tuple(value(spark, T.caption_parts(F.lit("no prefix")))) == ("", "")


@pytest.mark.parametrize(("text", "is_caption"), [("Figure 4.1\nBus", True), ("Figure 4.1 Bus", False), ("fig. 4.1.2 \n x", True), ("Figure 4.1\n" + "x" * 300, False), ("A Figure 4.1\n", False)])
def test_captions(spark, text, is_caption):
    assert value(spark, T.is_caption(F.lit(text))) is is_caption


def test_names_from_sections(spark):
    section = F.lit("§19. I/O Ports > §19.2 PmnPFS/PmnPFS_HA : Port Control")
    assert value(spark, T.section_register(section)) == "PmnPFS"
    assert value(spark, T.section_chapter(section)) == "I/O Ports"
    assert value(spark, T.guess_peripheral(F.lit("§1 ADC > §1.1 of"))) == "ADC"
    assert value(spark, T.guess_peripheral(F.lit(None).cast("string"))) == "UNKNOWN"
    assert value(spark, T.prose_register(F.lit("the ABC and SCRn and ABCD"))) == "SCRn"


@pytest.mark.parametrize(("bits", "wanted", "hit"), [("16", "16", True), ("8:0", "4", True), ("0:8", "4", False), ("8:0", "9", False), ("b7", "7", False), ("8:x", "1", False), ("16", "²", False), ("16", "RST", False)])
def test_bit_matches(spark, bits, wanted, hit):
    assert value(spark, C.bit_matches(F.lit(bits), F.lit(wanted))) is hit


@pytest.mark.parametrize(
    ("cell", "expected"),
    [("0 0: Sun\n0 1: Mon\nmore", "0 0: Sun; 0 1: Mon more"), ("one line", "one line"), ("wrapped\n\nline", "wrapped line"), ("• a\n• b", "• a; • b"), ("", ""), ("\n a \n", "a")],
)
def test_clean_cell(cell, expected):
    assert C.clean_text(cell) == expected


@pytest.mark.parametrize(
    ("rows", "is_register"),
    [([["Bit", "Symbol"]], True), ([["Bit rate", "Value"]], True), ([["Bits", "Symbol"]], False), ([["x"], ["y"], ["Bit", "Reset"]], False), ([None, ["bit", "R/W"]], True), ([], False), ([["Bit", None]], False)],
)
def test_register_tables(spark, rows, is_register):
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    assert df.select(C.is_register_table(F.col("r"))).first()[0] is is_register


def test_grid_levels_and_fills():
    cells = [["Table 3.4 Memory", None, None], ["Kind", "Size", None], [None, "min", "max"], ["Flash", "16 KB", "32 KB"], [None, "1 KB", None], ["SRAM", None, "x\ny"]]
    grid = C.Grid(cells)
    header, rows = grid.records()
    assert grid.title() == "Table 3.4 Memory"
    assert header == ["Kind", "Size - min", "Size - max"]
    assert rows == [
        {"Kind": "Flash", "Size - min": "16 KB", "Size - max": "32 KB"},
        {"Kind": "Flash", "Size - min": "1 KB", "Size - max": "32 KB"},
        {"Kind": "SRAM", "Size - min": "1 KB", "Size - max": "x y"},
    ]


def test_grid_of_a_register():
    header, rows = C.Grid([["Title", None], ["Bit", "Function"], ["0", "start\nnow"]]).records()
    assert header == ["Bit", "Function"]
    assert rows == [{"Bit": "0", "Function": "start\nnow", "Description": "start\nnow"}]
    assert C.Grid([]).records() == ([], [])


@pytest.mark.parametrize("said", ["", "plain", 'a "b" \\ /', "\n\r\t\b\f\x01\x7f", "naïve § 漢", "a\U0001d11eb\U0010ffff"])
def test_json_is_as_json_dumps_writes_it(spark, said):
    assert value(spark, T.json_text(F.lit(said))) == json.dumps(said)
    made = T.json_object(a=T.json_text(F.lit(said)), b=T.json_array(F.array(T.json_text(F.lit(said)), T.json_text(F.lit("x")))))
    assert value(spark, made) == json.dumps({"a": said, "b": [said, "x"]})
    assert value(spark, T.json_array(F.array().cast("array<string>"))) == json.dumps([])
