"""Catalogs, chunks, search and administration over small documents of our own."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.splitter import split_text
from quire.operators import catalogs, chunks, layout, search
from quire.operators.embed import HashingEmbedder, ModelEmbedder, build_index, embed, mean_pooled
from quire.plans.admin import Admin, Settings
from quire.plans.ingest import Ingest, Inputs
from quire.sources.files import Store, by_chip, read_jsonl, read_registry
from quire.streaming.ingest import follow_jsonl


def registry(spark):
    return spark.createDataFrame([("D1", "1.0", "chipA", "p/one.pdf", 0), ("D2", "2.0", "chipB", "p/two.pdf", 1)], f"{schemas.REGISTRY}, line_no long")


def raw_tables(spark):
    field = [{"Bit": "8:0", "Symbol": "DATA", "R/W": "R/W", "Reset": "0", "Description": "data"}, {"Bit": "16", "Symbol": "RST", "Description": "reset"}, {"Bit": "", "Symbol": ""}]
    listing = [{"Symbol": "SCR", "Address": "0x4000_0000", "Initial Value": "", "R/W": "R"}, {"Symbol": "scr", "Address": "0x9", "Initial Value": "0x1F", "R/W": "W"}]
    rows = [
        ("D1", 1, 0, "§1 SCI > §1.1 x", True, "", "SCR", "SCI", ["Bit", "Symbol"], [{"Bit": "1", "Symbol": "OLD"}], 0),
        ("D1", 1, 1, "§1 SCI > §1.1 x", True, "", "SCR", "SCI", ["Bit", "Symbol"], field, 1),
        ("D1", 2, 0, "", False, "Table 2.1 List", None, None, ["Symbol", "Address", "Initial Value", "R/W"], listing, 2),
        ("D1", 3, 0, None, False, "Table 2.1 List", None, None, ["A", "B"], [{"A": "1", "B": "x\ny"}, {"A": "", "B": None}], 3),
        ("D1", 3, 1, None, False, "", None, None, ["Bit rate", "B"], [{"B": "2"}], 4),
        ("D2", 1, 0, "§1 SCI > §1.1 x", True, "", "SCR", "SCI", ["Bit"], [{"Bit": "3", "Symbol": "OTHER"}], 5),
        ("D2", 9, 0, None, None, "", "", "", ["Bit"], [{"Bit": "4"}], 6),
        (None, 1, 0, "x", False, "t", None, None, ["A"], [{"A": "1"}], 7),
    ]
    return spark.createDataFrame(rows, f"{schemas.RAW_TABLES}, line_no long")


def blocks(spark):
    rows = [
        ("D1", 1, [0.0, 50.0, 1.0, 60.0], "second, see Figure 1.1 and Table 2.1", "§1 SCI > §1.1 x", 1),
        ("D1", 1, [0.0, 10.0, 1.0, 20.0], "first, access R/W1C", "§1 SCI > §1.1 x", 0),
        ("D1", 2, None, "later", "§1 SCI > §1.1 x", 2),
        ("D2", 9, [0.0, 1.0, 2.0, 3.0], "Reset value 0x7 here", None, 3),
    ]
    return spark.createDataFrame(rows, f"{schemas.BLOCKS}, line_no long")


def built(spark):
    return catalogs.build_registers(raw_tables(spark), blocks(spark), registry(spark))


def test_registers(spark):
    registers, fields = built(spark)
    rows = {(r["doc_id"], r["register_name"]): r for r in registers.collect()}
    assert set(rows) == {("D1", "SCR"), ("D2", "SCR"), ("D2", "REG_6")}
    one = rows["D1", "SCR"]
    assert (one["address"], one["reset_value"], one["access"], one["size_bits"]) == ("0x4000_0000", "0x1F", "R", 32)
    assert (rows["D2", "SCR"]["address"], rows["D2", "REG_6"]["reset_value"], rows["D2", "REG_6"]["peripheral"]) == ("", "0x7", "UNKNOWN")
    assert [f["symbol"] for f in json.loads(one["json"])["bit_fields"]] == ["DATA", "RST"]
    assert one["json"] == json.dumps(json.loads(one["json"])) and list(json.loads(one["json"])) == ["register_name", "address", "reset_value", "access", "bit_fields"]
    assert {r["symbol"] for r in fields.where("doc_id = 'D1'").collect()} == {"DATA", "RST"}


def test_general_tables_and_ids(spark):
    rows = catalogs.build_general_tables(raw_tables(spark), registry(spark)).orderBy("table_id").collect()
    assert [(r["table_id"], r["section_path"]) for r in rows] == [("table-2.1", "§UNKNOWN"), ("table-2.1-1", "§UNKNOWN")]
    assert rows[1]["markdown"] == "**Table 2.1 List**\n\n| A | B |\n|---|---|\n| 1 | x y |\n|  |  |"


def all_chunks(spark):
    registers, fields = built(spark)
    figures = spark.createDataFrame([("D1", 1, "Figure 1.1", "Figure 1.1\nBus", 90.0, 0.0, 0.0, "", "", [], "data/figures/D1/p1_fig1_1.png", None, 1, 1)], schemas.FIGURES)
    return chunks.build_chunks(blocks(spark), registers, fields, figures, raw_tables(spark), registry(spark))


def test_chunks(spark):
    made = all_chunks(spark)
    assert {r["element_type"]: r["n"] for r in chunks.counts_by_type(made).collect()} == {"prose": 2, "register_row": 4, "figure": 1, "table_summary": 2, "table_row": 3}
    prose = made.where("element_type = 'prose' and doc_id = 'D1'").first()
    assert prose["render_text"] == "[§1 SCI > §1.1 x] first, access R/W1C\nsecond, see Figure 1.1 and Table 2.1\nlater"
    assert (prose["page_start"], prose["page_end"], prose["figure_refs"], prose["table_refs"]) == (1, 2, ["Figure 1.1"], ["table-2.1"])
    assert "[§1 SCI > §1.1 x > SCR] bits 16 | RST |  | reset  | reset" in {r["render_text"] for r in made.where("element_type = 'register_row'").collect()}
    assert "In Table 2.1 List, A is 1, B is x y." in {r["render_text"] for r in made.where("element_type = 'table_row'").collect()}
    found = {(r["kind"], r["ref"]): r["target"] for r in chunks.resolved_refs(made).collect()}
    assert found["figure", "Figure 1.1"].startswith("[§UNKNOWN > Figure 1.1]")
    assert found["table", "table-2.1"].startswith("Table 2.1 List (in §UNKNOWN) — a table with 2 row(s).")


def manuals(spark):
    registers, fields = built(spark)
    embedder = HashingEmbedder(64)
    return search.Manuals(registry(spark), registers, fields, catalogs.build_general_tables(raw_tables(spark), registry(spark)), build_index(all_chunks(spark), embedder).cache(), embedder)


def test_lookups(spark):
    m = manuals(spark)
    assert [r["register_name"] for r in m.register_lookup("sc", "chipA")] == ["SCR"]
    assert [f["symbol"] for f in m.register_lookup("SCR", "chipA")[0]["bit_fields"]] == ["DATA", "RST"]
    assert m.register_lookup("SCR", "none") == [] and m.register_lookup("X", "chipA") == []
    assert m.query_register_field("SCR", "rst", "chipA")["bits"] == "16"
    assert m.query_register_field("SCR", "4", "chipA")["symbol"] == "DATA"
    assert m.query_register_field("SCR", "16", "chipB") is None and m.query_register_field("SC", "4", "chipA") is None
    assert m.get_figure("Figure 1.1", "chipA")["caption"] == "Figure 1.1\nBus."
    assert m.get_figure("Figure 9.9", "chipA") is None
    assert m.get_table("table-2.1", "chipA")["citation"] == "【D1 Rev.1.0 | §UNKNOWN | p.2】"
    assert m.get_table("table-2.1", "chipB") is None


def test_search(spark):
    m = manuals(spark)
    found = m.search("first, access R/W1C second, see Figure 1.1 and Table 2.1 later", "chipA", 99)
    assert len(found) <= 10 and found[0]["element_type"] == "prose" and found[0]["figure_refs"] == ["Figure 1.1"]
    assert all(a["score"] <= b["score"] for a, b in zip(found, found[1:]))
    assert m.search("zzzz qqqq", "chipC") == "No relevant content found in chipC UM Rev.1.0."
    assert m.search_um("zzzz", "chipC") == {"refusal": "No relevant content found in chipC UM Rev.1.0."}


def test_chips_without_entry_take_the_last_of_the_first_chip(spark):
    entries = [("D1", "1.0", "a", "x"), ("D2", "5.0", "b", "x"), ("D3", "2.0", "a", "x")]
    m = manuals(spark)
    m.registry = spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], f"{schemas.REGISTRY}, line_no long")
    assert m.search("q", "none") == "No relevant content found in none UM Rev.2.0."
    assert m.search_each(spark.createDataFrame([(1, "q", "none")], "query_id long, query string, chip_part string")).first()["refusal"] == "No relevant content found in none UM Rev.2.0."


def test_a_process_loads_a_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}", "x"):  # an error for the second time in one process
            pass

        def tokenize(texts, longest):
            ids = np.array([[ord(c) for c in t[:4].ljust(4)] for t in texts])
            return ids, (ids != 32).astype(np.int64)

        return tokenize, lambda ids, mask: np.stack([ids, np.ones_like(ids)], axis=2).astype(np.float64)

    model = ModelEmbedder(folder, load, together=2)
    texts = ["ab", "abc", None, "d", "ab", "e"]
    for _ in range(2):
        rows = embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2), "t", model).collect()
        for r in rows:
            codes = [ord(c) for c in r["t"] or ""]
            mean = np.array([np.mean(codes), 1.0]) if codes else np.zeros(2)
            assert np.allclose(r["embedding"], mean / max(np.linalg.norm(mean), 1e-12), atol=1e-6)


def test_search_of_many_questions_is_that_of_each(spark):
    m = manuals(spark)
    asked = [(1, "first, access R/W1C second, see Figure 1.1 and Table 2.1 later", "chipA"), (2, "zzzz qqqq", "chipC"), (3, "bits 16 RST", "chipA"), (4, None, "chipA"), (5, "List A", "chipB")]
    rows = m.search_each(spark.createDataFrame(asked, "query_id long, query string, chip_part string"), 5).collect()
    for query_id, query, chip in asked:
        mine = sorted((r for r in rows if r["query_id"] == query_id), key=lambda r: r["rank"] or 0)
        one = m.search(query or "", chip, 5)
        if isinstance(one, str):
            assert [(r["refusal"], r["render_text"]) for r in mine] == [(one, None)]
        else:
            assert [(r["render_text"], r["score"], r["page_start"], r["refusal"]) for r in mine] == [(a["render_text"], a["score"], a["page"], None) for a in one]
    assert m.search_each(spark.createDataFrame([], "query_id long, query string, chip_part string")).count() == 0


def test_lookups_of_many_questions_are_those_of_each(spark):
    m = manuals(spark)

    def rows(found):
        return sorted((r.asDict(recursive=True) for r in found.collect()), key=str)

    names = [(n, name, chip) for n, (name, chip) in enumerate((n, c) for n in ("sc", "SCR", "S_R", "X", "", "%", "\\", None) for c in ("chipA", "chipB", "none", None))]
    one = [{"query_id": n} | r for n, name, chip in names if name is not None for r in m.register_lookup(name, chip)]
    assert rows(m.register_lookup_each(spark.createDataFrame(names, "query_id long, name string, chip_part string"))) == sorted(one, key=str) and one
    bits = [(n, *q) for n, q in enumerate((r, b, c) for r in ("SCR", "SC") for b in ("rst", "4", "16", "3", "") for c in ("chipA", "chipB", "none"))]
    one = [{"query_id": n} | r for n, *q in bits if (r := m.query_register_field(*q))]
    assert rows(m.query_register_field_each(spark.createDataFrame(bits, "query_id long, register_name string, bit_or_symbol string, chip_part string"))) == sorted(one, key=str) and one
    for kind, ids in (("figure", ("Figure 1.1", "Figure 9.9", "")), ("table", ("table-2.1", "table-9.9", ""))):
        asked = [(n, *q) for n, q in enumerate((i, c) for i in ids for c in ("chipA", "chipB", "none"))]
        one = [{"query_id": n} | r for n, *q in asked if (r := getattr(m, f"get_{kind}")(*q))]
        found = getattr(m, f"get_{kind}_each")(spark.createDataFrame(asked, f"query_id long, {kind}_id string, chip_part string"))
        assert rows(found) == sorted(one, key=str) and one
    assert m.register_lookup_each(spark.createDataFrame([], "query_id long, name string, chip_part string")).count() == 0


def test_guard_tests_the_nearest_alone(spark):
    rows = spark.createDataFrame([(1, 1.4), (2, 1.9)], "id int, distance double")
    assert search.guarded(rows).count() == 2
    assert search.guarded(rows.where("id = 2")).count() == 0


def test_prefixes_follow_like(spark):
    names = spark.createDataFrame([("RxA9",), ("R_A1",), ("r",)], "n string")
    assert {r["n"] for r in names.where(search.name_matches(F.col("n"), "r_a")).collect()} == {"RxA9", "R_A1"}


@pytest.mark.parametrize("length", [0, 1, 499, 500, 501, 2000])
def test_splitter_limits(length):
    for text in ("x" * length, ("word " * length)[:length], ("A line. \n\n" * length)[:length]):
        pieces = split_text(text)
        assert all(0 < len(p) <= 500 and p == p.strip() for p in pieces)
        assert set("".join("".join(pieces).split())) == set("".join(text.split()))


def test_splitter_overlaps():
    words = [f"w{i:04d}" for i in range(400)]
    pieces = split_text(" ".join(words))
    at = 0
    for a, b in zip(pieces, pieces[1:]):
        shared = [w for w in a.split() if w in set(b.split())]
        assert b.split()[: len(shared)] == shared and len(" ".join(shared)) <= 80
        at += 1
    assert at and sorted({w for p in pieces for w in p.split()}) == words


def test_sections(spark):
    toc = spark.createDataFrame([("D", 0, 1, " A ", 1), ("D", 1, 2, "B", 2), ("D", 2, 3, "C", 2), ("D", 3, 2, "E", 4), ("D", 4, 1, "F", 9)], schemas.TOC)
    assert [r["label"] for r in layout.toc_labels(toc).orderBy("ord").collect()] == ["§A", "§A > §B", "§A > §B > §C", "§A > §E", "§F"]
    pages = spark.createDataFrame([("D", p, [0.0] * 4, "t", None) for p in (0, 1, 2, 3, 5)], schemas.BLOCKS)
    found = {r["page"]: r["section_path"] for r in layout.resolve_sections(pages, toc).collect()}
    assert found == {0: None, 1: "§A", 2: "§A > §B > §C", 3: "§A > §B > §C", 5: "§A > §E"}


def test_clusters_and_zones(spark):
    rects = spark.createDataFrame([(0.0, 10.0, 1), (2.0, 4.0, 2), (18.0, 20.0, 3), (28.1, 30.0, 4)], "y0 double, y1 double, k int").withColumn("p", F.lit(1))
    assert [r["cluster"] for r in layout.clusters(rects, ["p"], "y0", "y1").orderBy("k").collect()] == [0, 0, 0, 1]
    zones = spark.createDataFrame([(1, 20.0, 28.1)], "p int, zone_y0 double, zone_y1 double")
    kept = layout.outside_zones(rects, zones, ["p"], F.col("y0"), F.col("y1"), F.col("k") == 9)
    assert {r["k"] for r in kept.collect()} == {1, 2, 3, 4}  # touching is no overlap
    zones = spark.createDataFrame([(1, 19.0, 29.0)], "p int, zone_y0 double, zone_y1 double")
    assert {r["k"] for r in layout.outside_zones(rects, zones, ["p"], F.col("y0"), F.col("y1"), F.col("k") == 4).collect()} == {1, 2, 4}


def test_crops(spark):
    cap = [("D", 1, [0.0, 200.0, 1.0, 210.0], "Figure 1.1\nA", "s", 0), ("D", 1, [0.0, 400.0, 1.0, 410.0], "Figure 1.2\nB", "s", 1), ("D", 2, [0.0, 500.0, 1.0, 510.0], "Figure 1.1\nC", None, 2)]
    rows = spark.createDataFrame(cap, f"{schemas.BLOCKS}, line_no long")
    drawings = spark.createDataFrame([("D", 1, 0.0, 100.0, 9.0, 190.0), ("D", 1, 0.0, 230.0, 9.0, 250.0), ("D", 1, 0.0, 300.0, 9.0, 390.0)], schemas.DRAWINGS)
    pages = spark.createDataFrame([("D", 1, "", 600.0, 800.0), ("D", 2, "", 600.0, 800.0)], schemas.PAGE_TEXT)
    got = {r["image_path"]: (r["crop_y0"], r["crop_y1"]) for r in layout.figures(rows, drawings, pages).collect()}
    assert got == {"data/figures/D/p1_fig1_1.png": (96.0, 216.0), "data/figures/D/p1_fig1_2.png": (296.0, 416.0), "data/figures/D/p2_fig1_1_1.png": (79.0, 516.0)}


def test_pooling():
    import numpy as np

    tokens = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(mean_pooled(tokens, np.array([[1, 1, 0]])), [[0.6, 0.8]])


def test_files_and_store(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"doc_id": "D1", "page": 1}\n\n{"doc_id": "D 2", "page": 3}\n')
    rows = read_jsonl(spark, f"file://{tmp_path}/t.jsonl", "doc_id string, page int")
    assert [(r["doc_id"], r["line_no"]) for r in rows.orderBy("line_no").collect()] == [("D1", 0), ("D 2", 2)]
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("notes", "doc_id string, page int").count() == 0 and store.read("chunks").columns
    store.overwrite("notes", rows)
    store.replace_documents("notes", rows.where("doc_id = 'D1'").withColumn("page", F.lit(7)), ["D1"])
    assert {(r["doc_id"], r["page"]) for r in store.read("notes").collect()} == {("D1", 7), ("D 2", 3)}
    store.replace_documents("notes", rows.limit(0), ["D 2"])
    assert {r["doc_id"] for r in store.read("notes").collect()} == {"D1"}
    assert store.last_written("notes") > 0
    store.wipe(("notes",))
    assert not store.exists("notes") and store.last_written("notes") is None


def test_admin(spark, tmp_path):
    (tmp_path / "in.pdf").write_bytes(b"%PDF")
    path = f"file://{tmp_path}/registry.json"
    store = Store(spark, f"file://{tmp_path}/store")
    admin = Admin(store, path, f"file://{tmp_path}/pdfs")
    assert admin.documents_markdown().startswith("_No documents")
    admin.add_document("D1", "1.0", "c", "sub", f"file://{tmp_path}/in.pdf")
    admin.add_document("D2", "1.0", "c", "", f"file://{tmp_path}/in.pdf")
    with pytest.raises(ValueError):
        admin.add_document("D1", "1.0", "c", "", f"file://{tmp_path}/in.pdf")
    store.overwrite("chunks", spark.createDataFrame([("D1", "prose"), ("D1", "figure"), ("D2", "prose")], "doc_id string, element_type string"))
    listed = admin.list_documents()
    assert [(d["doc_id"], d["folder"], d["pdf_exists"], d["chunk_count"], d["register_count"]) for d in listed] == [("D1", "sub", True, 2, 0), ("D2", ".", True, 1, 0)]
    assert "| D1 | c | sub | ✅ Indexed | 2 | 0 |" in admin.documents_markdown()
    admin.remove_document("D1", wipe_data=True)
    assert [d["doc_id"] for d in admin.list_documents()] == ["D2"]
    assert admin.health()["counts_by_type"] == {"prose": 1} and "**Last indexed:** never" in admin.health_markdown()
    assert [r["doc_id"] for r in by_chip(read_registry(spark, path)).collect()] == ["D2"]
    admin.reset()
    assert admin.health()["total_chunks"] == 0 and [d["doc_id"] for d in admin.list_documents()] == ["D2"]


def test_settings():
    assert Settings.of("# x\nEMBED_MODEL=m\nUSE_OPENVINO=1\n") == Settings("m", True)
    assert Settings.of("") == Settings() and Settings.of(Settings("a", True).lines()) == Settings("a", True)


def ingest_inputs(spark):
    texts = [("D1", 1, [0.0, 10.0, 5.0, 20.0], "SCR : Control Register", None, 0), ("D1", 1, [0.0, 300.0, 5.0, 310.0], "Figure 1.1\nBus", None, 1), ("D2", 1, [0.0, 1.0, 2.0, 3.0], " hello ", None, 2)]
    grid = [["Bit", "Symbol"], ["0", "EN"]]
    cells = [("D1", 1, 0, [0.0, 120.0, 9.0, 190.0], grid), ("D1", 1, 1, [0.0, 320.0, 9.0, 380.0], [["Name", "Size"], ["a", "1 KB"], ["b", "2 KB"]]), ("D1", 1, 2, [0.0, 200.0, 9.0, 250.0], [["In", "Figure"], ["a", "1 KB"], ["b", "2 KB"]])]
    return Inputs(
        spark.createDataFrame(texts, f"{schemas.BLOCKS}, line_no long"),
        spark.createDataFrame([("D1", 0, 1, "SCI", 1)], schemas.TOC),
        spark.createDataFrame([("D1", 1, 0.0, 195.0, 9.0, 260.0)], schemas.DRAWINGS),
        spark.createDataFrame(cells, schemas.TABLE_CELLS),
        spark.createDataFrame([("D1", 1, "", 600.0, 800.0)], schemas.PAGE_TEXT),
    )


def test_ingest_all_and_one(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ingest = Ingest(store, ingest_inputs(spark), HashingEmbedder(16))
    lines = list(ingest.run(registry(spark)))
    assert [x.split(":")[0] for x in lines] == ["blocks", "figures", "raw_tables", "registers", "bit_fields", "general_tables", "chunks", "index"]
    assert {(r["is_register"], tuple(r["header"])) for r in store.read("raw_tables").collect()} == {(True, ("Bit", "Symbol")), (False, ("Name", "Size"))}
    register = store.read("registers").first()
    assert (register["register_name"], register["section_path"]) == ("SCR", "§SCI")
    before = {tuple(r) for r in store.read("chunks").where("doc_id = 'D2'").select("doc_id", "render_text").collect()}
    list(ingest.run(registry(spark), only_doc_id="D1", skip_figures=True, skip_embed=True))
    assert {tuple(r) for r in store.read("chunks").where("doc_id = 'D2'").select("doc_id", "render_text").collect()} == before
    assert store.read("figures").count() == 0
    with pytest.raises(LookupError):
        list(ingest.run(registry(spark), only_doc_id="none"))


def test_streamed_files_replace_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"doc_id": "D1", "page": 1}\n{"doc_id": "D2", "page": 1}\n')
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: follow_jsonl(spark, f"file://{folder}", "doc_id string, page int", store, "blocks", f"file://{tmp_path}/cp").awaitTermination()
    run()
    (folder / "b.json").write_text('{"doc_id": "D1", "page": 5}\n')
    run()
    assert {(r["doc_id"], r["page"]) for r in store.read("blocks").collect()} == {("D1", 5), ("D2", 1)}
