import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from lattica.operators import attach, extract, normalize, parse, search, store
from lattica.plans.ingest import ingest
from lattica.session import checkpointed
from lattica.sources.files import EXTRACTORS
from lattica.sources.providers import embed, hashed_embedder, model_ids
from lattica.streaming.watch import PageTables, watch


def walk(html):
    return parse.PageWalk("P", html)


def test_styles_and_nesting():
    assert walk("<s><b>x</b></s>").chunks == [{"content": "x", "style": "bold"}]
    assert walk("<s>a</s><del>b</del>c").chunks == [{"content": "a b", "style": "cancelled"}, {"content": "c", "style": "normal"}]
    nested = walk("<table><tr><th>H</th></tr><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table>")
    assert [t["headers"] for t in nested.tables] == [["H"], []]
    assert nested.cells[-1]["prov_path"] == "page:P/table:0/table:1/row:1/col:0/row:0/col:0"
    assert walk("<!DOCTYPE html><!-- ad --><p>x</p>").chunks[0]["content"] == "html ad x"


def test_attachment_links():
    page = walk('<a href="/download/attachments/1/r.pdf?v=2">r</a><a href="/download/attachments/1/r.pdf?v=2">r</a><ac:image><ri:attachment ri:filename="i.png"></ac:image>')
    assert [(r["filename"], r["url"]) for r in page.refs] == [("r.pdf", "/download/attachments/1/r.pdf?v=2"), ("i.png", "")]


def test_components_of_a_long_path(spark):
    from lattica.operators.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "a int, b int")
    nodes = spark.createDataFrame([(k,) for k in (*range(61), 100, 101, 200)], "id int")
    assert {r.id: r.component for r in components(nodes, edges).collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 200}


def test_traverse_cycle_deleted_and_missing(spark):
    nodes = spark.createDataFrame([("A", False), ("B", True), ("C", False), ("E", False)], "_id string, is_deleted boolean")
    edges = spark.createDataFrame([("A", "r", "B"), ("B", "r", "C"), ("C", "r", "A"), ("A", "r", "D"), ("D", "r", "E")], "source_id string, relation string, target_id string")
    got = {r._id: r.level for r in search.traverse(nodes, edges, "A", ["r"], 3).collect()}
    assert got == {"C": 2, "E": 2}


def test_vector_search_skips_unusable(spark):
    rows = [("a", [1.0, 0.0], None), ("z", [0.0, 0.0], None), ("n", None, None), ("e", [], None), ("b", [1.0, 1.0], datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "_id string, embedding array<float>, timestamp timestamp_ntz").withColumn("is_deleted", F.lit(False))
    assert [r._id for r in search.vector_search(df, [1.0, 0.0], 9).collect()] == ["a", "b"]
    assert search.vector_search(df, [0.0, 0.0], 9).count() == 0
    assert [r._id for r in search.vector_search(df, [1.0, 0.0], 9, before=F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00'")).collect()] == ["b"]


def test_two_stage_cut(spark):
    old = [(f"o{k}", [1.0, 0.0], datetime(2000, 1, 1)) for k in range(10)]
    df = spark.createDataFrame([*old, ("new", [1.0, 1.0], datetime(2025, 12, 31))], "_id string, embedding array<float>, timestamp timestamp_ntz").withColumn("is_deleted", F.lit(False))
    got = search.semantic_retrieve([("row", df, None)], [1.0, 0.0], F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"), 2)
    assert "new" not in {r._id for r in got.collect()}


def test_soft_delete_is_idempotent(spark):
    nodes = spark.createDataFrame([("1", "Event", "p", False), ("2", "Application", "p", False), ("3", "Event", "q", None)], "_id string, type string, page_id string, is_deleted boolean")
    pages = spark.createDataFrame([("p",), ("p",)], "page_id string")
    once = store.soft_delete_nodes(nodes, pages)
    twice = store.soft_delete_nodes(once, pages)
    want = {"1": True, "2": False, "3": False}
    assert {r._id: r.is_deleted for r in once.collect()} == want == {r._id: r.is_deleted for r in twice.collect()}


def test_needs_upsert(spark):
    t = datetime(2024, 1, 1), datetime(2024, 1, 2)
    pages = spark.createDataFrame([(k, t[1]) for k in ("new", "error", "null", "equal", "older")], "page_id string, last_modified timestamp_ntz")
    log = spark.createDataFrame([("error", "error", t[1]), ("null", "done", None), ("equal", "done", t[1]), ("older", "done", t[0])], "page_id string, status string, source_modified timestamp_ntz")
    got = {r.page_id for r in store.with_log(pages, log).where(store.needs_upsert()).collect()}
    assert got == {"new", "error", "null", "older"}


def test_scan_ids_is_unicode_aware(spark):
    df = spark.createDataFrame([("p", 0, "12345678901 123456789 a123456789 ١٢٣٤٥٦٧٨٩", "x")], "page_id string, ord int, text string, path string")
    got = [(r.id_type, r.raw_value) for r in extract.scan_ids(df).orderBy("pos").collect()]
    assert got == [("app_id", "12345678901"), ("project_id", "123456789"), ("project_id", "١٢٣٤٥٦٧٨٩")]
    assert extract.validate_ids(extract.scan_ids(df), None).where("is_valid").count() == 0


def test_headless_table_consolidates_to_nothing_and_last_duplicate_wins(spark):
    chunk = lambda s: [(s, "normal")]
    cells = spark.createDataFrame(
        [(1, 0, 0, chunk("H")), (1, 1, 0, chunk("a")), (1, 1, 1, chunk("b")), (1, 2, 0, chunk(" ")), (2, 0, 0, chunk("x"))],
        "ord int, row int, col int, chunks array<struct<content:string,style:string>>",
    )
    tables = spark.createDataFrame([(1, ["A", "a "], "s", True), (2, [], "s", False)], "ord int, headers array<string>, schema_id string, headed boolean")
    schema = spark.createDataFrame([("s", {"A": "f"})], "schema_id string, column_mapping map<string,string>")
    rows = normalize.consolidate(cells, normalize.column_map(tables, schema), tables).collect()
    assert [(r.ord, r.row, r["values"]) for r in rows] == [(1, 1, {"f": "b"})]


def test_hostile_tables():
    page = walk("<table><tr><td>" * 1500 + "x")
    assert len(page.tables) == 1500 and page.cells[-1]["chunks"] == [{"content": "x", "style": "normal"}]
    wide = walk(f'<table><tr><td rowspan="{"9" * 5000}" colspan="{"9" * 5000}">x</td></tr><tr><td>y</td></tr></table>')
    assert len(wide.cells) == 1 + 1000 + 1 and wide.cells[-1]["col"] == 1000
    assert walk('<table><tr><td rowspan="-1" colspan="²">x</td><td rowspan="0">y</td></tr></table>').cells[1]["col"] == 1


def test_styles_come_from_around_the_table():
    assert walk("<s><table><tr><td>x<b>y</b></td></tr></table></s>").cells[0]["chunks"] == [{"content": "x", "style": "cancelled"}, {"content": "y", "style": "bold"}]


def test_log_marks(spark):
    log = spark.createDataFrame([("a", "new", 1, "old", None), ("b", "new", 0, None, None)], "page_id string, status string, retry_count int, error_message string, processed_at timestamp_ntz")
    a = spark.createDataFrame([("a",), ("zz",)], "page_id string")
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    row = lambda df: {r.page_id: (r.status, r.retry_count, r.error_message, r.processed_at is not None) for r in df.collect()}
    b = ("new", 0, None, False)
    assert row(store.mark_log(log, a, "processing", at=at)) == {"a": ("processing", 1, "old", True), "b": b}
    assert row(store.mark_log(log, a, "done", at=at)) == {"a": ("done", 1, None, True), "b": b}
    assert row(store.mark_log(log, a, "error", F.lit("e"))) == {"a": ("error", 2, "e", False), "b": b}
    assert row(store.mark_log(log, a, "needs_review", F.lit("no date"))) == {"a": ("needs_review", 1, "no date", False), "b": b}


def test_office_files_and_failures(spark):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>2</v></c></row></sheetData></worksheet>')
    rows = [("p", "1", "a.docx", "docx", book.getvalue()), ("p", "2", "b.xlsx", "excel", sheet.getvalue()), ("p", "3", "c.docx", "docx", b"junk"), ("p", "4", "d.pdf", "pdf", None)]
    df = spark.createDataFrame(rows, "page_id string, attachment_id string, filename string, kind string, content binary")
    out = attach.extract_text(df, EXTRACTORS)
    assert {r.attachment_id: r.tables for r in out.collect()} == {"1": [[["c"]]], "2": [[["k", "", "2"]]], "3": [], "4": []}
    got = {r.attachment_id: (r.text, r.error) for r in out.collect()}
    assert got["1"] == ("Hello\nc", None) and got["2"] == ("[Sheet: S]\nk |  | 2", None)
    assert got["3"][1].startswith("extraction_failed") and got["4"][1].startswith("download_failed")


def test_sheets_follow_the_relations_of_the_workbook():
    data = io.BytesIO()
    row = lambda v: f'<worksheet><sheetData><row><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="rel"><sheets><sheet name="First" r:id="b"/><sheet name="Second" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", row(1))
        z.writestr("xl/worksheets/sheet2.xml", row(2))
    assert EXTRACTORS["excel"](data.getvalue(), "x.xlsx")[0] == "[Sheet: First]\n2\n[Sheet: Second]\n1"


def test_a_table_in_a_cell_is_text_of_the_cell():
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>out</w:t></w:r></w:p>{inner}</w:tc></w:tr></w:tbl></w:body></w:document>')
    assert EXTRACTORS["docx"](data.getvalue(), "x.docx")[1] == [[["outin"]]]


def test_providers(spark):
    df = embed(spark.createDataFrame([("a b",), ("a b",), ("",)], "text string"), hashed_embedder(8))
    vectors = [tuple(r.embedding) for r in df.collect()]
    assert vectors[0] == vectors[1] and len(vectors[2]) == 8
    inputs = spark.createDataFrame([("p", "x"), ("q", "bad")], "page_id string, input string")
    answer = lambda t: '{"additional_app_ids": ["1"]}' if t == "x" else "no json"
    assert [(r.page_id, r.raw) for r in model_ids(inputs, answer).collect()] == [("p", "1")]


def test_embedding_failures_keep_their_rows(spark):
    def fussy(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return hashed_embedder(4)(texts)

    rows = {r.text: (r.embedding, r.embedding_error) for r in embed(spark.createDataFrame([("a",), ("bad",), ("b",)], "text string").coalesce(1), fussy).collect()}
    assert rows["bad"] == (None, "no") and rows["a"][0] is not None and rows["b"][0] is not None


def docx(*rows):
    cells = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in rows)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>About 11111111111.</w:t></w:r></w:p><w:tbl>{cells}</w:tbl></w:body></w:document>')
    return data.getvalue()


def test_ingest_with_attachments_graph_and_vectors(spark):
    html = (
        "<p>id 123456789</p><table><tr><th>Acuerdo</th><th>Fecha</th></tr><tr><td>do it <a href='/download/attachments/1/a.docx'>a</a></td><td>now</td></tr></table>"
        "<p>End.</p>"
    )
    pages = spark.createDataFrame([("p1", "T", datetime(2024, 1, 1), html), ("p2", "U", None, None)], "page_id string, title string, page_date timestamp_ntz, html string")
    schemas = spark.createDataFrame([(0, "s", ["acuerdo", "fecha"], {"Acuerdo": "acuerdo", "Fecha": "fecha"})], "schema_ord int, schema_id string, canonical_columns array<string>, column_mapping map<string,string>")
    metadata = spark.createDataFrame([("p1", 0, "m1", "a.docx", "/a", 10), ("p1", 1, "m2", "free.docx", "/f", 10), ("p1", 2, "m3", "x.zip", "/x", 10)], "page_id string, pos long, attachment_id string, filename string, url string, size long")
    files = spark.createDataFrame([("p1", "a.docx", docx(("Acuerdo", "Fecha"), ("file it", "today"))), ("p1", "free.docx", b"junk")], "page_id string, filename string, content binary")
    known = spark.createDataFrame([("app_id", "11111111111"), ("project_id", "123456789")], "id_type string, id string")
    answer = lambda text: '{"events": [{"event_type": "decision", "description": "Go.", "app_ids": ["11111111111"], "project_ids": []}]}'
    out = ingest(pages, schemas, known, metadata, files, answer, hashed_embedder(8), keep=checkpointed)
    assert {(r.page_id, r.table_index, r.n_rows) for r in out["tables"].collect()} == {("p1", 0, 2), ("p1", 1, 2)}
    assert {r["values"]["acuerdo"] for r in out["rows"].collect()} == {"do it a", "file it"}
    assert {r._id for r in out["rows"].collect()} == {"p1_table_0_row_1", "p1_table_1_row_1"}
    assert {(r.raw_value, r.is_valid) for r in out["ids"].collect()} == {("123456789", True), ("11111111111", True)}
    nodes = {r._id: r for r in out["nodes"].collect()}
    ref = "p1_att_/download/attachments/1/a.docx"
    assert set(nodes) == {"page_p1", "page_p2", "p1_table_0", "p1_table_1", ref, "event_p1_0", "app_11111111111", "proj_123456789"}
    assert (nodes[ref].origin, nodes[ref].table_index, nodes[ref].row, nodes[ref].col, nodes[ref].chunk_count) == ("table", 0, 1, 0, 1)
    edges = {(r.source_id, r.relation, r.target_id) for r in out["edges"].collect()}
    assert edges == {
        ("page_p1", "CONTAINS", "p1_table_0"), ("page_p1", "CONTAINS", "p1_table_1"), ("page_p1", "HAS_ATTACHMENT", ref), ("page_p1", "HAS_EVENT", "event_p1_0"),
        ("app_11111111111", "HAS_EVENT", "event_p1_0"), ("page_p1", "REFERENCES_APP", "app_11111111111"), ("page_p1", "REFERENCES_PROJ", "proj_123456789"),
    }
    vectors = {r._id: r for r in out["vectors"].collect()}
    assert sorted(r.kind for r in vectors.values()) == ["ConfPage", "ConfPage", "Event", "chunk", "row", "row", "row", "row"]
    assert set(vectors) == {"page_p1", "page_p2", "event_p1_0", *(f"p1_table_{t}__row_{r}" for t in (0, 1) for r in (0, 1)), f"{ref}__chunk_0"}
    assert (vectors["p1_table_0__row_0"].text, vectors["p1_table_1__row_1"].text) == ("Acuerdo: Acuerdo | Fecha: Fecha", "Acuerdo: file it | Fecha: today")
    assert out["vectors"].where("embedding IS NULL").count() == 0
    # the same page again, without its table: what it owned is flagged, shared nodes stay
    again = ingest(pages.where("page_id = 'p1'").withColumn("html", F.lit("<p>id 123456789</p>")), schemas, known, keep=checkpointed)
    refreshed = spark.createDataFrame([("p1",)], "page_id string")
    stored, links = store.refresh_graph(out["nodes"], out["edges"], again["nodes"], again["edges"], refreshed)
    assert {r._id for r in stored.where("NOT is_deleted").collect()} == {"page_p1", "page_p2", "app_11111111111", "proj_123456789"}
    assert {(r.source_id, r.relation, r.target_id) for r in links.collect()} == {("page_p1", "REFERENCES_PROJ", "proj_123456789")}
    rows = store.upsert_rows(out["rows"], again["rows"], refreshed)
    assert rows.where("NOT is_deleted").count() == 0 and rows.count() == 2


def test_batch_that_is_resumed(spark, tmp_path):
    from lattica import cli

    row = lambda page, html, date: (page, "t", "S", html, datetime(2024, 1, 1), date)
    day = datetime(2024, 1, 1)
    pages = spark.createDataFrame([row("a", "<p>a</p>", day), row("b", "<p>b</p>", None)], cli.PAGE_SCHEMA)
    more = pages.union(spark.createDataFrame([row("c", "<p>c</p>", day)], cli.PAGE_SCHEMA))
    for df in (pages, more):
        cli.run_batch(spark, df, f"{tmp_path}/out", None, None, None, None, resume=True)
    tables = PageTables(spark, f"{tmp_path}/out")
    assert {r.page_id: (r.status, r.error_message) for r in tables.log().collect()} == {"a": ("done", None), "b": ("needs_review", "no date"), "c": ("done", None)}
    assert sorted(r.content for r in tables.results("chunks").collect()) == ["a", "c"]
    assert tables.read("pages").count() == 2  # a was skipped the second time
    runs = tables.runs().orderBy("run_id").collect()
    assert [(r.state, r.pages_done, r.pages_error, r.pages_needs_review, r.pages_skipped) for r in runs] == [("done", 1, 0, 1, 0), ("done", 1, 0, 1, 1)]


def test_command_line_with_all_inputs(spark, tmp_path):
    from lattica import cli

    html = "<p>id 123456789 and 99999999999</p><table><tr><th>Acuerdo</th><th>Fecha</th></tr><tr><td>do it <a href='/download/attachments/1/a.docx'>a</a></td><td>now</td></tr></table>"
    day = datetime(2024, 1, 1)
    pages = spark.createDataFrame([("p1", "t", "S", html, day, day)], cli.PAGE_SCHEMA)
    (tmp_path / "att/files/p1").mkdir(parents=True)
    (tmp_path / "att/files/p1/a.docx").write_bytes(docx(("Acuerdo", "Fecha"), ("file it", "today")))
    spark.createDataFrame([("p1", 0, "m1", "a.docx", "/a", 10)], cli.METADATA_SCHEMA).write.parquet(f"{tmp_path}/att/metadata")
    spark.createDataFrame([("project_id", "123456789")], "id_type string, id string").write.parquet(f"{tmp_path}/known")
    schemas = [(0, "s", "t", ["acuerdo", "fecha"], {"Acuerdo": "acuerdo", "Fecha": "fecha"}, "approved", 1), (1, "x", "t", ["acuerdo"], {}, "pending_approval", 2)]
    spark.createDataFrame(schemas, cli.SCHEMA_COLUMNS).write.parquet(f"{tmp_path}/schemas")
    given = cli.Inputs(f"{tmp_path}/att", f"{tmp_path}/known", f"{tmp_path}/schemas", True)
    cli.run_batch(spark, pages, f"{tmp_path}/out", None, None, None, None, given)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert {r["values"]["acuerdo"] for r in read("rows").collect()} == {"do it a", "file it"}
    assert {r.raw_value for r in read("unvalidated").collect()} == {"99999999999", "11111111111"} and read("attachments").count() == 1
    assert read("vectors").where("embedding IS NOT NULL").count() == 6 and {r.route for r in read("routes").collect()} == {"assigned"}
    assert read("nodes").count() == 5 and read("edges").count() == 4


def test_project_info_by_former_id(spark):
    df = spark.createDataFrame([("p1", "1", ["7", "8"], False), ("p2", "2", [], False)], "_id string, project_id string, raw_ids array<string>, is_deleted boolean")
    assert [search.project_info(df, i).first() and search.project_info(df, i).first()._id for i in ("2", "8", "9")] == ["p2", "p1", None]


def test_ingest_plan(spark):
    html = "<p>id 123456789 <s>gone</s></p><table><tr><th>Acuerdo</th><th>Fecha</th></tr><tr><td>do it</td><td>12345678901</td></tr></table>"
    pages = spark.createDataFrame([("p1", html), ("p2", None)], "page_id string, html string")
    schemas = spark.createDataFrame([(0, "s", ["acuerdo", "fecha"], {"Acuerdo": "acuerdo", "Fecha": "fecha"})], "schema_ord int, schema_id string, canonical_columns array<string>, column_mapping map<string,string>")
    out = ingest(pages, schemas)
    assert {r.raw_value for r in out["ids"].collect()} == {"123456789", "12345678901"}
    assert [r["values"] for r in out["rows"].collect()] == [{"acuerdo": "do it", "fecha": "12345678901"}]
    assert [r.has_cancelled for r in out["cancelled"].collect()] == [True]


def test_stream_equals_batch(spark, tmp_path):
    schema = "page_id string, title string, last_modified timestamp_ntz"
    first = [("a", "1", datetime(2024, 1, 1)), ("b", "1", datetime(2024, 1, 1))]
    second = [("a", "2", datetime(2024, 1, 2)), ("b", "1", datetime(2024, 1, 1))]
    tables = PageTables(spark, f"{tmp_path}/tables")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        watch(spark, f"{tmp_path}/in", schema, tables, f"{tmp_path}/check").awaitTermination(120)
    assert {(r.page_id, r.title) for r in tables.pages().collect()} == {("a", "2"), ("b", "1")}
    assert tables.read("pages").count() == 3  # the unchanged page was not taken again


def test_command_line(spark, tmp_path):
    from lattica import cli

    rows = [("1", "t", "S", "<p>id 123456789</p>", None, datetime(2024, 5, 1)), ("2", "t", "S", "<p>x</p>", None, datetime(2025, 1, 1)), ("3", "t", "T", "<p>y</p>", None, None)]
    spark.createDataFrame(rows, cli.PAGE_SCHEMA).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    cli.run_batch(spark, pages, f"{tmp_path}/out", "S", "2024-01-01", "2024-12-31", None)
    assert [r.page_id for r in spark.read.parquet(f"{tmp_path}/out/chunks").collect()] == ["1"]
    assert [r.raw_value for r in spark.read.parquet(f"{tmp_path}/out/ids").collect()] == ["123456789"]
    cli.run_batch(spark, pages, f"{tmp_path}/out", None, None, None, ["3", "2"])
    assert {r.page_id for r in spark.read.parquet(f"{tmp_path}/out/chunks").collect()} == {"2", "3"}
