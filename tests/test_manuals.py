"""Files to tables with a reader of our own, and the whole way to an answer."""

import sys
from types import SimpleNamespace

import pytest

from quire.operators.embed import HashingEmbedder
from quire.operators.search import Manuals
from quire.plans.ingest import Ingest, Inputs
from quire.sources.files import Store
from quire.sources.manuals import Found, PdfReader, read_pages, records, tables_of


class Plain:
    """A file's lines as blocks, one page each; a line with bars is a grid."""

    def read(self, content):
        found = Found(toc=[(1, "SCI", 1)])
        for n, line in enumerate(content.decode().splitlines(), 1):
            if "|" in line:
                found.grids.append((n, 0, [0.0, 10.0, 1.0, 20.0], [r.split(",") for r in line.split("|")]))
            else:
                found.blocks.append((n, [0.0, 1.0, 2.0, 3.0], line))
            found.pages.append((n, line, 600.0, 800.0))
        return found


def test_from_files_to_answers(spark, tmp_path):
    for name, text in (("a/one.pdf", "SCR : Control\nBit,Symbol|0,EN|1,DIS\nclock source text"), ("b/one.pdf", "other"), ("b/left.pdf", "x")):
        (tmp_path / "pdfs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pdfs" / name).write_text(text)
    registry = spark.createDataFrame([("D1", "1", "c1", "a/one.pdf", 0), ("D2", "1", "c2", "b/one.pdf", 1)], "doc_id string, revision string, chip_part string, path string, line_no long")
    found = read_pages(spark, f"file://{tmp_path}/pdfs", registry, Plain()).cache()
    assert {(r["doc_id"], r["text"]) for r in tables_of(found)["blocks"].collect()} == {("D1", "SCR : Control"), ("D1", "clock source text"), ("D2", "other")}
    store = Store(spark, f"file://{tmp_path}/store")
    list(Ingest(store, Inputs(**tables_of(found)), HashingEmbedder(32)).run(registry))
    m = Manuals(registry, *(store.read(n) for n in ("registers", "bit_fields", "general_tables", "index")), HashingEmbedder(32))
    assert [(r["page_start"], r["register_name"]) for r in store.read("registers").collect()] == [(2, "REG_0")]  # no name on its page
    assert [f["symbol"] for f in m.register_lookup("REG_", "c1")[0]["bit_fields"]] == ["EN", "DIS"]
    assert m.search("clock source text", "c1")[0]["section_path"] == "§SCI"


def test_records_are_numbered():
    got = list(records(Found(blocks=[(1, [0, 0, 1, 1], "a"), (2, [0, 0, 1, 1], "b")], toc=[(1, "T", 1)])))
    assert [r["line_no"] for k, r in got if k == "blocks"] == [0, 1] and got[2] == ("toc", {"ord": 0, "level": 1, "title": "T", "page": 1})


class Closing:
    """A document that counts how often it is closed."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.closed = True


class DrawnPage:
    def __init__(self, blocks, drawings):
        self.blocks, self.drawings = blocks, drawings

    def get_text(self, kind):
        assert kind == "blocks"
        return self.blocks

    def get_drawings(self):
        return self.drawings


class Drawn(Closing):
    pages = [
        DrawnPage([(0.04, 1.06, 2.0, 3.0, " first \n", 0, 0), (0, 0, 1, 1, "an image", 1, 1), (0, 0, 1, 1, " \n", 2, 0)], [{"rect": SimpleNamespace(x0=1.0, y0=2.0, x1=3.0, y1=4.0)}, {"rect": None}, {}]),
        DrawnPage([(5, 6, 7, 8, "second", 0, 0)], []),
    ]

    def get_toc(self):
        return [[1, "1 One", 1], [2, "1.1 Two", 2]]

    def __iter__(self):
        return iter(self.pages)


class Plumbed(Closing):
    def __init__(self):
        table = SimpleNamespace(bbox=(1, 2, 3, 4), extract=lambda: [["Bit", None], ["0", "x"]])
        self.asked = []

        def find_tables(table_settings):
            self.asked.append(table_settings)
            return [table, table]

        self.pages = [SimpleNamespace(extract_text=lambda: None, width=600, height=800, find_tables=lambda table_settings: []), SimpleNamespace(extract_text=lambda: "t", width=600, height=800, find_tables=find_tables)]


def test_pdf_reader_takes_what_its_libraries_find(monkeypatch):
    """With stand-ins for both libraries: images and blank blocks go, boxes have one decimal, pages count from 1."""
    drawn, plumbed = Drawn(), Plumbed()
    monkeypatch.setitem(sys.modules, "pymupdf", SimpleNamespace(open=lambda stream, filetype: drawn if (stream, filetype) == (b"%PDF", "pdf") else None))
    monkeypatch.setitem(sys.modules, "pdfplumber", SimpleNamespace(open=lambda file: plumbed if file.read() == b"%PDF" else None))
    found = PdfReader().read(b"%PDF")
    assert found.blocks == [(1, [0.0, 1.1, 2.0, 3.0], "first"), (2, [5, 6, 7, 8], "second")]
    assert found.toc == [(1, "1 One", 1), (2, "1.1 Two", 2)]
    assert found.drawings == [(1, 1.0, 2.0, 3.0, 4.0)]
    assert found.grids == [(2, i, [1.0, 2.0, 3.0, 4.0], [["Bit", None], ["0", "x"]]) for i in (0, 1)]
    assert found.pages == [(1, "", 600.0, 800.0), (2, "t", 600.0, 800.0)]
    assert plumbed.asked == [{"snap_tolerance": 3}] and drawn.closed and plumbed.closed


def test_missing_libraries_are_named():
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="needs"):
            PdfReader().read(b"")
